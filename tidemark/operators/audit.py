"""Auditing a corpus: strata, seeded samples, how much other spellings would add."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_of(day: Column, start: str, cutoff: str) -> Column:
    """``before`` or ``after`` the cutoff by the text of the date; null before the start."""
    d = F.substring(day, 1, 10)
    return F.when(d < start, None).when(d < cutoff, "before").when(d >= cutoff, "after")


def stratified(df: DataFrame, strata: Mapping[str, Column]) -> DataFrame:
    """One row per row and stratum it is in; strata may overlap."""
    names = F.array_compact(F.array(*(F.when(test, name) for name, test in strata.items())))
    return df.withColumn("stratum", F.explode(names))


def sample_per_stratum(df: DataFrame, k: int, id_col: str, seed: int = 42, strata: tuple[str, ...] = ("stratum",)) -> DataFrame:
    """A uniform sample of ``k`` rows of every stratum, the same for the same ids and seed.

    Rows are ordered by a hash (MD5) of seed and id; Spark keeps the first ``k`` of each
    task before it shuffles, so a stratum of any size sends few rows.
    """
    w = Window.partitionBy(*strata).orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string"))), F.col(id_col))
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def alias_recall(df: DataFrame, aliases: Mapping[str, Column], covered: Column, period: Column) -> DataFrame:
    """``alias, period, total_mentions, uncovered``: mentions of each alias, and those the query doesn't cover."""
    found = F.explode(F.array_compact(F.array(*(F.when(test, name) for name, test in aliases.items()))))
    rows = df.select(found.alias("alias"), F.coalesce(covered, F.lit(False)).alias("_covered"), period.alias("period"))
    return rows.groupBy("alias", "period").agg(F.count("*").alias("total_mentions"), F.count_if(~F.col("_covered")).alias("uncovered"))


def cutoff_segments(df: DataFrame, day: str, cutoffs: list[str]) -> DataFrame:
    """``cutoff, before_n, on_n, after_n`` for each cutoff, in one pass over the days."""
    daily = df.filter(F.col(day).isNotNull()).groupBy(day).agg(F.count("*").alias("n"))
    marks = F.explode(F.array(*(F.to_date(F.lit(c)) for c in cutoffs)))
    rows = daily.select(day, "n", marks.alias("cutoff"))
    part = [F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(name) for name, test in (("before_n", F.col(day) < F.col("cutoff")), ("on_n", F.col(day) == F.col("cutoff")), ("after_n", F.col(day) > F.col("cutoff")))]
    return rows.groupBy("cutoff").agg(*part)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``n, raw_agreement, kappa``: how far two codings agree, and beyond chance (Cohen).

    Rows with a null in either coding are left out; kappa is null where chance alone
    explains everything.  Works on the table of counts of both codes.
    """
    cells = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().groupBy("a", "b").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy()).cast("double")
    share_a = F.sum("n").over(Window.partitionBy("a")) / total
    share_b = F.sum("n").over(Window.partitionBy("b")) / total
    # Chance agreement is the sum of products over the codes both use: take it once for each code.
    rows = cells.select("a", "b", "n", total.alias("total"), share_a.alias("pa"), share_b.alias("pb"))
    left = rows.groupBy("a").agg(F.first("pa").alias("pa"))
    right = rows.groupBy("b").agg(F.first("pb").alias("pb"))
    chance = left.join(right, left["a"] == right["b"]).agg(F.coalesce(F.sum(F.col("pa") * F.col("pb")), F.lit(0.0)).alias("chance"))
    raw = rows.agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).cast("double"), F.sum("n")).alias("raw_agreement"))
    return raw.crossJoin(F.broadcast(chance)).select("n", "raw_agreement", F.try_divide(F.col("raw_agreement") - F.col("chance"), 1 - F.col("chance")).alias("kappa"))

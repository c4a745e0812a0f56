"""Reports per author: totals, typical title, popularity of a topic, latest examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def author_totals(df: DataFrame, author: str, on_topic: Column, measures: list[str]) -> DataFrame:
    """``author, posts_total, posts_on_topic, <measure>_mean_all, <measure>_mean_topic, popularity``."""
    rows = df.withColumn("_on", F.coalesce(on_topic, F.lit(False)))
    aggs = [F.count("*").alias("posts_total"), F.count_if("_on").alias("posts_on_topic")]
    aggs += [F.avg(m).alias(f"{m}_mean_all") for m in measures]
    aggs += [F.avg(F.when(F.col("_on"), F.col(m))).alias(f"{m}_mean_topic") for m in measures]
    out = rows.groupBy(author).agg(*aggs)
    return out.withColumn("popularity", F.col("posts_on_topic") / F.greatest(F.col("posts_total"), F.lit(1)))


def typical_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value``: the most frequent non-empty value of each key, the smallest of equals, ``""`` if it has none.

    Counted in two steps, so that a key with most of the rows is pre-aggregated by
    value instead of being sorted.
    """
    text = F.coalesce(F.trim(F.col(value)), F.lit(""))
    counts = df.select(key, text.alias(value)).groupBy(key, value).agg(F.count("*").alias("_n"))
    best = F.max(F.struct((F.col(value) != "").alias("given"), F.when(F.col(value) != "", F.col("_n")).alias("n")))
    top = counts.groupBy(key).agg(best.alias("_best"))
    both = counts.alias("c").join(top.alias("t"), F.equal_null(F.col(f"c.{key}"), F.col(f"t.{key}")))
    given = F.col(f"c.{value}") != ""
    kept = both.filter(F.when(F.col("t._best.given"), given & (F.col("c._n") == F.col("t._best.n"))).otherwise(F.lit(True)))
    return kept.groupBy(F.col(f"c.{key}").alias(key)).agg(F.min(f"c.{value}").alias(value))


def latest_examples(df: DataFrame, author: str, order: list[Column], example: Column, k: int = 5) -> DataFrame:
    """``author, example_1 .. example_k``: the latest rows' texts side by side, ``""`` where there are fewer."""
    w = Window.partitionBy(author).orderBy(*order)
    rows = df.select("*", F.row_number().over(w).alias("_k")).filter(F.col("_k") <= k).select(author, "_k", example.alias("_text"))
    cells = [F.coalesce(F.max(F.when(F.col("_k") == i, F.col("_text"))), F.lit("")).alias(f"example_{i}") for i in range(1, k + 1)]
    return rows.groupBy(author).agg(*cells)


def author_report(totals: DataFrame, *details: DataFrame, key: str) -> DataFrame:
    """``totals`` with the columns of every detail table, left-joined on ``key``; a null key meets a null key."""
    out = totals
    for n, detail in enumerate(details):
        side = detail.withColumnRenamed(key, f"_key{n}")
        out = out.join(side, F.equal_null(F.col(key), F.col(f"_key{n}")), "left").drop(f"_key{n}")
    return out

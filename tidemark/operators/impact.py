"""Change around a cutoff: scenario windows, before/after tables, tests and intervals.

Every report is one conditional aggregation over the data; tests and intervals
work on the few rows it leaves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("negative", "neutral", "positive")


@dataclass(frozen=True)
class Scenario:
    """Two adjoining spans of whole days; the cutoff day belongs to the second."""

    name: str
    before_start: date
    before_end: date
    after_start: date
    after_end: date

    @property
    def n_days_after(self) -> int:
        return (self.after_end - self.after_start).days + 1

    def period(self, day: Column) -> Column:
        return F.when(day.between(F.lit(self.before_start), F.lit(self.before_end)), "before").when(day.between(F.lit(self.after_start), F.lit(self.after_end)), "after")


def scenarios(start: date, end: date, cutoff: date) -> list[Scenario]:
    """``full``: all days before against all after; ``symmetric``: as many days before as after."""
    if not start < cutoff <= end:
        raise ValueError(f"the cutoff {cutoff} must lie after {start} and not after {end}")
    n = (end - cutoff).days + 1
    day = timedelta(days=1)
    return [Scenario("full", start, cutoff - day, cutoff, end), Scenario("symmetric", cutoff - n * day, cutoff - day, cutoff, end)]


def share(n: Column, total: Column) -> Column:
    """Share of a total, which counts as 1 at least."""
    return n / F.greatest(F.lit(1), total)


def before_after(df: DataFrame, keys: Sequence[str], period: Column, over: Sequence[str] = ()) -> DataFrame:
    """``keys, before_n, after_n, before_share, after_share, delta_share, abs_delta_share``.

    One pass; null keys are groups of their own.  Shares are of all rows of the
    period, per group of ``over`` if given.  The window runs over the aggregate.
    """
    marked = df.withColumn("_period", period).filter(F.col("_period").isNotNull())
    counts = marked.groupBy(*over, *keys).agg(F.count_if(F.col("_period") == "before").alias("before_n"), F.count_if(F.col("_period") == "after").alias("after_n"))
    whole = Window.partitionBy(*over) if over else Window.partitionBy()
    shares = counts.withColumn("before_share", share(F.col("before_n"), F.sum("before_n").over(whole))).withColumn("after_share", share(F.col("after_n"), F.sum("after_n").over(whole)))
    return shares.withColumn("delta_share", F.col("after_share") - F.col("before_share")).withColumn("abs_delta_share", F.abs("delta_share"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; ties must be settled by ``order``."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def label_counts(df: DataFrame, keys: Sequence[str], period: Column, label: str) -> DataFrame:
    """``keys`` with ``before_n, after_n`` and ``before_<label>_n, after_<label>_n``: all that tests and intervals need."""
    marked = df.withColumn("_period", period).filter(F.col("_period").isNotNull())
    aggs = [F.count_if(F.col("_period") == p).alias(f"{p}_n") for p in ("before", "after")]
    aggs += [F.count_if((F.col("_period") == p) & (F.col(label) == name)).alias(f"{p}_{name}_n") for p in ("before", "after") for name in LABELS]
    return marked.groupBy(*keys).agg(*aggs)


def with_shares(counts: DataFrame) -> DataFrame:
    """Shares of the labels, null where a side is empty, and ``delta_negative``."""
    for p in ("before", "after"):
        for name in LABELS:
            counts = counts.withColumn(f"{p}_{name}", F.try_divide(F.col(f"{p}_{name}_n").cast("double"), F.col(f"{p}_n")))
    return counts.withColumn("delta_negative", F.col("after_negative") - F.col("before_negative"))


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0, relative error below 1.2e-7 (Chebyshev form of Numerical Recipes)."""
    t = 1 / (1 + z / 2)
    # Coefficients of the approximation, highest power first.
    poly = F.lit(0.0)
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + F.lit(c)
    return t * F.exp(poly - z * z)


def with_chi_square(counts: DataFrame) -> DataFrame:
    """``chi2`` and ``chi2_pvalue`` of the 2 x 3 table of labels by period, in closed form.

    Labels that never occur are left out: with two labels Yates' correction is
    made, with one chi2 is 0 and p is 1.  Null where a side is empty.
    """
    cells = [(F.col(f"before_{x}_n").cast("double"), F.col(f"after_{x}_n").cast("double")) for x in LABELS]
    left, right = F.lit(0.0), F.lit(0.0)
    used = F.lit(0)
    for b, a in cells:
        left, right, used = left + b, right + a, used + (b + a > 0).cast("int")
    total = left + right
    plain, yates = F.lit(0.0), F.lit(0.0)
    for b, a in cells:
        for seen, row in ((b, left), (a, right)):
            expected = row * (b + a) / total
            gap = F.abs(seen - expected)
            plain += F.when(expected > 0, gap * gap / expected).otherwise(0.0)
            less = gap - F.least(F.lit(0.5), gap)
            yates += F.when(expected > 0, less * less / expected).otherwise(0.0)
    valid = (left > 0) & (right > 0)
    chi2 = F.when(valid & (used == 3), plain).when(valid & (used == 2), yates).when(valid, 0.0)
    p = F.when(used == 3, F.exp(-F.col("chi2") / 2)).when(used == 2, erfc(F.sqrt(F.col("chi2") / 2))).when(valid, 1.0)
    return counts.withColumn("chi2", chi2).withColumn("chi2_pvalue", F.when(F.col("chi2").isNotNull(), p))


def bootstrap_delta(before: tuple[int, int], after: tuple[int, int], rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Resampled differences of two shares given (hits, size) of each side.

    The mean of a resample of 0/1 data is a binomial count over the size, so the
    data themselves aren't needed.
    """
    (kb, nb), (ka, na) = before, after
    return rng.binomial(na, ka / na, rounds) / na - rng.binomial(nb, kb / nb, rounds) / nb


def interval(draws: np.ndarray, level: float = 0.95) -> tuple[float, float]:
    tail = 50 * (1 - level)
    lo, hi = np.percentile(draws, [tail, 100 - tail])
    return float(lo), float(hi)


def seed_of(*parts: object) -> int:
    """A seed that depends on what is resampled, not on the order it is done in."""
    import zlib

    return zlib.crc32("|".join(map(str, parts)).encode())


def with_intervals(counts: DataFrame, keys: Sequence[str], rounds: int = 5000, seed: int = 42) -> DataFrame:
    """``delta_neg_ci_lo`` and ``delta_neg_ci_hi`` for every row of :func:`label_counts`, on the executors."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    keys = list(keys)

    def run(frames):
        for pdf in frames:
            lo, hi = [], []
            for row in pdf.itertuples(index=False):
                r = row._asdict() if hasattr(row, "_asdict") else dict(zip(pdf.columns, row))
                if r["before_n"] and r["after_n"]:
                    rng = np.random.default_rng([seed, seed_of(*(r[k] for k in keys))])
                    a, b = interval(bootstrap_delta((r["before_negative_n"], r["before_n"]), (r["after_negative_n"], r["after_n"]), rounds, rng))
                else:
                    a = b = None
                lo.append(a)
                hi.append(b)
            yield pdf.assign(delta_neg_ci_lo=lo, delta_neg_ci_hi=hi)

    schema = StructType([*counts.schema.fields, StructField("delta_neg_ci_lo", DoubleType()), StructField("delta_neg_ci_hi", DoubleType())])
    return counts.mapInPandas(run, schema)


def contrasts(counts: DataFrame, scenario: str, obj: str, pairs: Sequence[tuple[str, str]], rounds: int = 5000, seed: int = 42) -> DataFrame:
    """``scenario, contrast, point, ci_lo, ci_hi, significant_95``: difference of two objects' changes.

    ``counts`` is a report of a few rows per scenario; each scenario is one small
    task.  A contrast with an empty side is null and not significant.
    """
    def run(pdf):
        import pandas as pd

        by = {r[obj]: r for r in pdf.to_dict("records")}
        out = []
        for a, b in pairs:
            sides = [by.get(a), by.get(b)]
            name = pdf[scenario].iloc[0]
            if any(s is None or not s["before_n"] or not s["after_n"] for s in sides):
                out.append((name, f"{a} - {b}", None, None, None, False))
                continue
            draws, point = [], []
            for s in sides:
                rng = np.random.default_rng([seed, seed_of(name, a, b, s[obj])])
                k = (s["before_negative_n"], s["before_n"]), (s["after_negative_n"], s["after_n"])
                draws.append(bootstrap_delta(*k, rounds, rng))
                point.append(k[1][0] / k[1][1] - k[0][0] / k[0][1])
            lo, hi = interval(draws[0] - draws[1])
            out.append((name, f"{a} - {b}", point[0] - point[1], lo, hi, bool(lo > 0 or hi < 0)))
        return pd.DataFrame(out, columns=["scenario", "contrast", "point", "ci_lo", "ci_hi", "significant_95"])

    return counts.groupBy(scenario).applyInPandas(run, "scenario string, contrast string, point double, ci_lo double, ci_hi double, significant_95 boolean")


def repaired_terms(df: DataFrame, urls: DataFrame, term: str, group_terms: Sequence[str], url_col: str = "post_url", terms_col: str = "terms", flag_col: str = "in_group") -> DataFrame:
    """Rows whose URL is listed lose ``term``; ``flag_col`` tells whether a term of the group is left.

    The list is deduplicated and joined on the URL; null URLs are in no list.
    """
    from tidemark.functions.text import separated

    listed = urls.select(F.trim(F.col(urls.columns[0])).alias("_url")).filter("_url <> ''").distinct().withColumn("_listed", F.lit(True))
    rows = df.join(listed, F.col(url_col) == F.col("_url"), "left").drop("_url")
    held = separated(F.col(terms_col))
    left = F.when(F.col("_listed"), F.array_remove(held, term)).otherwise(held)
    rows = rows.withColumn(terms_col, F.array_join(left, ","))
    return rows.withColumn(flag_col, F.arrays_overlap(left, F.array(*map(F.lit, group_terms)))).drop("_listed")

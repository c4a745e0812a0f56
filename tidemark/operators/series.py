"""Time series: anchored bins, filled bins, rolling windows, first against last bin.

Windows run over daily aggregates, so their input is as many rows as there are
days (per key), whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_start(day: Column, origin: Column, days: int) -> Column:
    """First day of the ``days``-day bin, counted from ``origin``."""
    return F.date_add(origin, (F.floor(F.datediff(day, origin) / days) * days).cast("int"))


def binned_counts(df: DataFrame, day: str, keys: Sequence[str], days: int) -> DataFrame:
    """``bin, keys, n``: rows per bin and key; bins start at the first day of the data, empty ones are absent."""
    daily = df.filter(F.col(day).isNotNull()).groupBy(day, *keys).agg(F.count("*").alias("n"))
    first = daily.agg(F.min(day).alias("_origin"))
    rows = daily.crossJoin(F.broadcast(first))
    return rows.groupBy(bin_start(F.col(day), F.col("_origin"), days).alias("bin"), *keys).agg(F.sum("n").alias("n"))


def daily_labels(df: DataFrame, day: str, label: str, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, day`` with ``total`` and a count per label."""
    counts = [F.count_if(F.col(label) == x).alias(x) for x in labels]
    return df.filter(F.col(day).isNotNull()).groupBy(*keys, day).agg(F.count("*").alias("total"), *counts)


def filled_bins(daily: DataFrame, day: str, labels: Sequence[str], days: int) -> DataFrame:
    """``bin`` and the labels' shares, for every bin from the first to the last day; shares of an empty bin are 0."""
    ends = daily.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    grid = ends.filter("lo is not null").select(F.explode(F.sequence("lo", "hi", F.expr(f"interval {days} days"))).alias("bin"))
    sums = [F.sum(x).alias(x) for x in (*labels, "total")]
    binned = daily.crossJoin(F.broadcast(ends)).groupBy(bin_start(F.col(day), F.col("lo"), days).alias("bin")).agg(*sums)
    shares = [F.coalesce(F.try_divide(F.col(x).cast("double"), F.col("total")), F.lit(0.0)).alias(x) for x in labels]
    return grid.join(binned, "bin", "left").select("bin", *shares)


def _by_day(day: str, keys: Sequence[str], days: int):
    return Window.partitionBy(*keys).orderBy(F.unix_date(F.col(day))).rangeBetween(-(days - 1), 0)


def rolling_share(daily: DataFrame, day: str, label: str, days: int, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, day, share``: share of ``label`` over the last ``days`` calendar days, weighted by the days' totals."""
    w = _by_day(day, keys, days)
    return daily.select(*keys, day, F.try_divide(F.sum(label).over(w).cast("double"), F.sum("total").over(w)).alias("share"))


def rolling_mean(daily: DataFrame, day: str, label: str, days: int, least: int, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, day, mean``: unweighted mean of the daily shares of the last ``days`` days; null below ``least`` days with data."""
    w = _by_day(day, keys, days)
    value = F.try_divide(F.col(label).cast("double"), F.col("total"))
    return daily.select(*keys, day, F.when(F.count(value).over(w) >= least, F.avg(value).over(w)).alias("mean"))


def rolling_rows(daily: DataFrame, day: str, label: str, rows: int, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, day, mean``: mean of the daily shares of the last ``rows`` days that have data."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-(rows - 1), 0)
    return daily.select(*keys, day, F.avg(F.try_divide(F.col(label).cast("double"), F.col("total"))).over(w).alias("mean"))


def first_last_change(binned: DataFrame, key: str) -> DataFrame:
    """``key, first_share, last_share, change, n``: shares in the first and the last bin of all.

    With a single bin the change is null and ``n`` ranks the keys.
    """
    ends = binned.agg(F.min("bin").alias("_lo"), F.max("bin").alias("_hi"))
    rows = binned.crossJoin(F.broadcast(ends))
    counts = rows.groupBy(key, "_lo", "_hi").agg(F.sum(F.when(F.col("bin") == F.col("_lo"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("bin") == F.col("_hi"), F.col("n")).otherwise(0)).alias("b"), F.sum("n").alias("n"))
    whole = Window.partitionBy()
    shares = counts.select(key, "n", (F.col("_lo") < F.col("_hi")).alias("_two"), F.try_divide(F.col("a").cast("double"), F.sum("a").over(whole)).alias("first_share"), F.try_divide(F.col("b").cast("double"), F.sum("b").over(whole)).alias("last_share"))
    return shares.select(key, "first_share", "last_share", F.when(F.col("_two"), F.col("last_share") - F.col("first_share")).alias("change"), "n")

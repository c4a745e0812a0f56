"""Small reports over aggregates: ordered heads, pivots, fixed categories, labels, and the frames behind charts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.impact import Scenario


def most_common(counts: DataFrame, n: str, names: Sequence[str], k: int | None = None) -> DataFrame:
    """Rows by falling ``n``, equal ones by ``names``; the first ``k`` if given.

    Spark takes the head of each task before it merges them.
    """
    rows = counts.orderBy(F.desc_nulls_last(n), *names)
    return rows if k is None else rows.limit(k)


def top_by_total(df: DataFrame, key: str, n: str, k: int) -> DataFrame:
    """``key, total`` of the ``k`` keys with the largest sums of ``n``."""
    return most_common(df.groupBy(key).agg(F.sum(n).alias("total")), "total", [key], k)


def pivoted(df: DataFrame, row: str, column: str, values: Sequence, measure: Column) -> DataFrame:
    """One row per ``row`` and a column for each of ``values``; cells without data are 0.

    The values are given, so that no pass is needed to find them.
    """
    wide = df.groupBy(row).pivot(column, list(values)).agg(measure)
    return wide.na.fill(0, [c for c in wide.columns if c != row])


def shares_in_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """``position, column, n, share`` for each category of ``order``, also for those without rows.

    Shares are of all rows that have a category, those outside ``order`` included.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_c")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    fixed = df.sparkSession.createDataFrame(list(enumerate(order)), f"position int, {column} string")
    rows = fixed.join(counts, F.col(column) == F.col("_c"), "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return rows.select("position", column, n.alias("n"), F.coalesce(F.try_divide(n.cast("double"), F.col("_all")), F.lit(0.0)).alias("share"))


def scenario_summary(df: DataFrame, day: str, windows: Sequence[Scenario]) -> DataFrame:
    """One row per scenario: its days, ``n_days_after``, and the rows in all, before and after."""
    spans = [(s.name, s.before_start, s.before_end, s.after_start, s.after_end, s.n_days_after) for s in windows]
    fixed = df.sparkSession.createDataFrame(spans, "scenario string, before_start date, before_end date, after_start date, after_end date, n_days_after int")
    daily = df.groupBy(day).agg(F.count("*").alias("_n"))
    # A row for each day meets a handful of scenarios.
    rows = daily.crossJoin(F.broadcast(fixed))
    within = lambda a, b: F.coalesce(F.sum(F.when(F.col(day).between(F.col(a), F.col(b)), F.col("_n"))), F.lit(0))
    sums = rows.groupBy("scenario").agg(F.sum("_n").alias("docs_in_scenario"), within("before_start", "before_end").alias("docs_before"), within("after_start", "after_end").alias("docs_after"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("docs_in_scenario", "docs_before", "docs_after")]
    return fixed.join(F.broadcast(sums), "scenario", "left").select(*fixed.columns, *counts)


def labelled(code: Column, labels: Mapping[str, str]) -> Column:
    """The label of a code; a code without one stands for itself."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code) if pairs else code


def points(share: Column) -> Column:
    """A change of shares in percentage points, with its sign."""
    return F.concat(F.format_string("%+.1f", share * 100), F.lit(" п.п."))


def percent(share: Column, n: Column) -> Column:
    return F.concat(F.format_string("%.1f", share * 100), F.lit("% (n="), n.cast("string"), F.lit(")"))


def grouped(n: Column) -> Column:
    """A whole number with spaces between its thousands."""
    return F.translate(F.format_number(n, 0), ",", " ")


def day_label(day: Column) -> Column:
    return F.date_format(day, "dd.MM.yyyy")


def before_first(c: Column, separator: str) -> Column:
    """What stands before the first separator; all of it where there is none."""
    return F.substring_index(c, separator, 1)


def file_name(c: Column) -> Column:
    """A name that can be a file's: slashes as two underscores, everything but letters, digits, dots, hyphens and underscores as one."""
    return F.regexp_replace(F.replace(c, F.lit("/"), F.lit("__")), r"[^\p{L}\p{N}._-]", "_")


def topic_mask(name: Column, keywords: Sequence[str]) -> Column:
    """Whether a topic's name matches one of the keywords, which are patterns, ignoring case; false for null."""
    wanted = [k.lower().strip() for k in keywords if k.strip()]
    if not wanted:
        raise ValueError("no keyword")
    return F.coalesce(F.lower(name).rlike("|".join(wanted)), F.lit(False))


def supported(df: DataFrame, n: str, least: int = 30) -> DataFrame:
    """Rows of a report with at least ``least`` cases."""
    return df.filter(F.col(n) >= least)


def attach_codes(docs: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """``docs`` with the columns of a coding table; texts that weren't coded have nulls, one coded twice keeps its first coding in order."""
    columns = [c for c in codes.columns if c != key]
    first = codes.groupBy(key).agg(F.min(F.struct(*columns)).alias("_codes"))
    return docs.join(first, key, "left").select(*(F.col(c) for c in docs.columns), *(F.col(f"_codes.{c}").alias(c) for c in columns if c not in docs.columns))


def write_frames(frames: Mapping[str, DataFrame], folder: str) -> None:
    """The data behind charts, one CSV file with a header each; they are aggregates."""
    for name, df in frames.items():
        df.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}")


def package(spark: SparkSession, pairs: Sequence[tuple[str, str]], folder: str) -> list[str]:
    """Copies files or folders under new names into one folder; gives those that are missing."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path, missing = jvm.org.apache.hadoop.fs.Path, []
    for source, name in pairs:
        where, target = path(source), path(f"{folder}/{name}")
        files = where.getFileSystem(conf)
        if files.exists(where):
            jvm.org.apache.hadoop.fs.FileUtil.copy(files, where, target.getFileSystem(conf), target, False, True, conf)
        else:
            missing.append(source)
    return missing

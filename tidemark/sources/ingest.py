"""Sources and sinks: line-delimited and array JSON, CSV, Parquet, and idempotent loading."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.tables import require_columns


def json_objects(text: Column) -> Column:
    """The text itself if it is a JSON object, else null."""
    parsed = F.try_parse_json(text)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), text)


def field(payload: Column, name: str, kind: str) -> Column:
    """A field of a JSON payload as ``kind``; null if absent, null or of another kind."""
    return F.get_json_object(payload, f"$.{name}").try_cast(kind)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``source_file, line_number, line``: every line of text files of any size, numbered from 1 in its file.

    A number depends on its file alone, so that files that come later change none.  A
    file is read in splits, by as many tasks; a first pass counts the lines of each,
    and their running sum, a table of one row per split, gives the numbers.
    """
    here = [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block")]
    lines = spark.read.text(path).select(*here, F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    splits = lines.groupBy("source_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("source_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = lines.join(splits, ["source_file", "_block"])
    return numbered.select("source_file", (F.col("_at") + F.col("_shift") + 1).cast("bigint").alias("line_number"), "line")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Posts of line-delimited JSON files, with the 1-based number of each line in its file.

    Every line counts, blank and broken ones too; those are left out of the
    result.
    """
    return posts_of(numbered_lines(spark, path))


def posts_of(lines: DataFrame) -> DataFrame:
    """Rows of ``posts_raw`` (without ``id``) from ``source_file, line_number, line``; lines that hold no JSON object are dropped."""
    rows = lines.withColumn("payload_json", json_objects(F.col("line"))).filter(F.col("payload_json").isNotNull())
    p = F.col("payload_json")
    return rows.select("source_file", "line_number", field(p, "channel_id", "bigint").alias("channel_id"), field(p, "channel_username", "string").alias("channel_username"), field(p, "post_id", "bigint").alias("post_id"), field(p, "date", "string").alias("post_date"), "payload_json")


def broken_lines(lines: DataFrame) -> DataFrame:
    """``source_file, blank_n, broken_n`` per file."""
    blank = F.trim("line") == ""
    return lines.groupBy("source_file").agg(F.count_if(blank).alias("blank_n"), F.count_if(~blank & json_objects(F.col("line")).isNull()).alias("broken_n"))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Channels of files that hold a JSON array: ``source_json_path, row_index, channel_name, handle, normalized_handle, resolved_id, payload_json``.

    Elements that aren't objects are skipped but counted by ``row_index``.
    ``resolved_id`` is ``resolved_id_y``, and ``resolved_id_x`` only where the key is
    absent -- a null there stays null.  A file that is no array gives no rows.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_json_path"), F.try_parse_json("value").alias("v"))
    arrays = files.filter(F.schema_of_variant("v").startswith("ARRAY"))
    items = arrays.select("source_json_path", F.posexplode(F.expr("try_variant_get(v, '$', 'array<variant>')")).alias("i", "item"))
    rows = items.filter(F.schema_of_variant("item").startswith("OBJECT")).select("source_json_path", (F.col("i") + 1).cast("bigint").alias("row_index"), F.to_json("item").alias("payload_json"))
    p = F.col("payload_json")
    return rows.select("source_json_path", "row_index", *channel_columns(p), "payload_json")


def channel_columns(p: Column) -> list[Column]:
    keys = F.json_object_keys(p)
    given = F.array_contains(keys, "resolved_id_y")
    return [
        F.get_json_object(p, "$['Channel Name']").alias("channel_name"),
        F.get_json_object(p, "$.Handle").alias("handle"),
        F.get_json_object(p, "$.normalized_handle").alias("normalized_handle"),
        F.when(given, field(p, "resolved_id_y", "bigint")).otherwise(field(p, "resolved_id_x", "bigint")).alias("resolved_id"),
    ]


def insert_new(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """``(new_rows, counts)``: incoming rows whose key is neither stored nor earlier in the batch.

    ``counts`` has one row ``inserted, duplicates``.  Keys alone are shuffled to find
    the winners; a null in a key is equal to a null.
    """
    keys = list(key)
    first = incoming.groupBy(*keys).agg(F.min(order).alias("_first"))
    stored = existing.select(*keys).distinct()
    same = [F.equal_null(first[k], stored[k]) for k in keys]
    fresh = first.join(stored, same, "left_anti")
    match = [F.equal_null(incoming[k], fresh[k]) for k in keys] + [incoming[order] == fresh["_first"]]
    rows = incoming.join(fresh, match, "left_semi")
    counts = incoming.agg(F.count("*").alias("_all")).crossJoin(fresh.agg(F.count("*").alias("inserted"))).select("inserted", (F.col("_all") - F.col("inserted")).alias("duplicates"))
    return rows, counts


def model_input(df: DataFrame, lists: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """Rewrite for a model: list columns as comma-separated text, some columns dropped."""
    for c in lists:
        df = df.withColumn(c, F.array_join(c, ","))
    return df.drop(*drop)


def read_csv(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """Rows of CSV files with a header; rows that don't fit the schema, or lack one of ``required``, are dropped."""
    rows = spark.read.schema(schema).option("header", "true").option("mode", "DROPMALFORMED").option("multiLine", "false").csv(path)
    return rows.dropna(subset=list(required)) if required else rows


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """``item``: the different lines of text files, stripped, blank ones left out."""
    return spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("item")).filter("item <> ''").distinct()


def within_days(df: DataFrame, day: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows whose day, the first ten characters of ``day``, lies in the window; rows without a readable day don't."""
    d = F.substring(F.col(day).cast("string"), 1, 10).try_cast("date")
    test = d.isNotNull()
    if first is not None:
        test = test & (d >= F.lit(first).cast("date"))
    if last is not None:
        test = test & (d <= F.lit(last).cast("date"))
    return df.filter(test)


def read_documents(df: DataFrame, text: str = "text", day: str = "date") -> DataFrame:
    """Texts collapsed, times as UTC; rows without text (empty, ``nan``) or readable time dropped."""
    from tidemark.functions.text import collapse

    rows = require_columns(df, text, day).withColumn(text, collapse(F.col(text))).withColumn(day, F.try_to_timestamp(F.col(day)))
    return rows.filter((F.col(text) != "") & (F.lower(text) != "nan") & F.col(day).isNotNull())


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, letters as they are, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header; ``df`` must be an aggregate."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_summary(spark: SparkSession, values: dict, path: str) -> None:
    """Counters of a run as one JSON file, in any file system Spark can write to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(json.dumps(values, ensure_ascii=False, indent=2, default=str), "utf-8"))
    finally:
        out.close()


def stage(spark: SparkSession, path: str, make, refresh: bool = False) -> DataFrame:
    """The stage's stored result if there is one, else what ``make()`` gives, stored first."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if refresh or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

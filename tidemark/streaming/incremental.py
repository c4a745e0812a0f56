"""The stateless operators over streams, with windowed counts and exactly-once delivery into tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.tables import shared_folder


def windowed_counts(stream: DataFrame, time_col: str, keys: list[str], window: str = "1 day", lateness: str | None = "2 days") -> DataFrame:
    """``start, keys, n``: rows per tumbling window.

    With ``lateness`` rows later than that are dropped by the watermark and windows
    that it has passed are forgotten; with None every window is kept, and every row
    counts.
    """
    rows = stream.filter(F.col(time_col).isNotNull())
    rows = rows if lateness is None else rows.withWatermark(time_col, lateness)
    return rows.groupBy(F.window(time_col, window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def first_deliveries(stream: DataFrame, keys: list[str], time_col: str, lateness: str = "2 days") -> DataFrame:
    """Each identifier once, with a bounded state: an identifier is forgotten when the watermark has passed it.

    Rows later than ``lateness`` are dropped, and an identifier may come again after it.
    :func:`delivered_once` has neither limit.
    """
    return stream.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(keys)


def _each_batch(stream: DataFrame, path: str, mode: str, write: Callable[[DataFrame, int], None]) -> None:
    """Everything that is there now, batch by batch; a second call takes up where this one ended."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", path + "-progress").trigger(availableNow=True).start()
    query.awaitTermination()


def _earlier(spark: SparkSession, path: str, schema, batch: int) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(schema).option("basePath", path).parquet(path).filter(F.col("_batch") < batch)


def _numbered(stream: DataFrame) -> StructType:
    return StructType([*stream.schema.fields, StructField("_batch", LongType())])


def delivered_once(stream: DataFrame, keys: Sequence[str], order: Sequence[str], path: str) -> DataFrame:
    """The table at ``path`` with one row of every identifier, however late and in however many batches its deliveries come.

    Of the rows of one batch the first by ``order`` stays; an identifier that an earlier
    batch has is kept out by an anti-join of the keys with the table.  A batch is
    written under its number, so that one that is run again replaces itself.  Null
    equals null in a key.
    """
    spark = stream.sparkSession
    stored = _numbered(stream)

    def write(batch: DataFrame, number: int) -> None:
        names = list(batch.columns)
        first = batch.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row")).select("_row.*")
        before = _earlier(batch.sparkSession, path, stored, number)
        if before is not None:
            known = before.select(*keys).distinct()
            first = first.join(known, [F.equal_null(first[k], known[k]) for k in keys], "left_anti")
        first.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    _each_batch(stream, path, "append", write)
    return spark.read.schema(stored).option("basePath", path).parquet(path).drop("_batch")


def latest_values(stream: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """The last state of every key of an aggregating stream, kept as a table of changes.

    Each batch writes what it changed under its number; the table shows the latest row
    of each key.
    """
    spark = stream.sparkSession
    stored = _numbered(stream)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    _each_batch(stream, path, "update", write)
    rows = spark.read.schema(stored).option("basePath", path).parquet(path)
    names = stream.columns
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "_batch").alias("_row")).select("_row.*")


def run_available(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Everything that is there now, into a Parquet table; a second call takes up where this one ended."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", path + "-progress").trigger(availableNow=True).start()
    query.awaitTermination()


def new_table(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def streamed(spark: SparkSession, path: str, schema, transform, files_per_batch: int = 1) -> DataFrame:
    """``transform`` over the files at ``path`` as a stream, and the table it fills."""
    target = new_table(spark, "stream")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    run_available(transform(source), target)
    return spark.read.parquet(target)

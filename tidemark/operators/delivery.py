"""Problem 7: messages delivered more than once.

Method: only the identifier, the delivery order and the position of a row (a key of
its file and its number there) are shuffled; they settle which delivery wins.  The
rows to drop become deletion vectors per file, and the wide payloads are read row
group by row group through them, so they are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a file that one bitmap covers.
CHUNK = 32_768


def _winners(narrow: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first delivery of every identifier delivered more than once; combines map-side."""
    return narrow.groupBy(*keys).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")


def repeated_deliveries(narrow: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``narrow`` whose identifier has an earlier delivery.

    ``narrow`` should hold the identifier, the delivery order and what names the
    row, nothing wide.  An identifier with a null is no identifier: such rows are
    never repeated.  Rows alike in identifier and order are kept together (the
    order column is meant to be unique).
    """
    known = narrow.dropna(subset=keys)
    winners = _winners(known, keys, order)
    return known.join(winners.select(*keys, "_first"), keys).filter(F.col(order) > F.col("_first")).select(*narrow.columns)


def _files(posts: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``file, key``: the files of a scan under 64-bit keys that are all different, and what makes a key of a path."""
    path = F.col("_metadata.file_path")
    for seed in range(4):
        files = posts.select(path.alias("file")).distinct().withColumn("key", F.xxhash64("file", F.lit(seed)))
        if files.groupBy("key").count().filter("count > 1").isEmpty():
            return files, lambda c: F.xxhash64(c, F.lit(seed))  # noqa: B023
    raise ValueError("no keys that tell the files apart")


def deletion_vectors(posts: DataFrame, keys: list[str], order: str, file_key: Callable[[Column], Column]) -> DataFrame:
    """``key, chunk, vector``: for every file, by its key, bitmaps of the rows to drop, 32,768 rows each; chunks count from 0."""
    narrow = posts.select(*keys, order, file_key(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    losers = repeated_deliveries(narrow, keys, order)
    # The bitmap functions count from 1.
    place = F.col("_row") + 1
    return losers.groupBy(F.col("_file").alias("key"), (F.bitmap_bucket_number(place) - 1).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("vector"))


def _open(uri: str):
    from pyarrow import fs
    from pyarrow.parquet import ParquetFile

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return ParquetFile(unquote(parsed.path or uri))
    filesystem, path = fs.FileSystem.from_uri(unquote(uri))
    return ParquetFile(filesystem.open_input_file(path))


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, key, part, at, n``: every row group, its first row in the file and its rows."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for row in batch.to_pylist():
            footer, at = _open(row["file"]).metadata, 0
            for part in range(footer.num_row_groups):
                n = footer.row_group(part).num_rows
                for held, x in zip(out, (row["file"], row["key"], part, at, n)):
                    held.append(x)
                at += n
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["file", "key", "part", "at", "n"])


def _reader(schema: pa.Schema, batch_rows: int, dropped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vectors = {v["chunk"]: np.unpackbits(np.frombuffer(v["vector"], np.uint8), bitorder="little").view(bool) for v in row["vectors"]}
                at = row["at"]
                for part in _open(row["file"]).iter_batches(batch_rows, row_groups=[row["part"]], columns=schema.names):
                    drop = np.zeros(part.num_rows, bool)
                    for chunk in range(at // CHUNK, (at + part.num_rows - 1) // CHUNK + 1):
                        bits = vectors.get(chunk)
                        if bits is not None:
                            lo, hi = max(at, chunk * CHUNK), min(at + part.num_rows, (chunk + 1) * CHUNK)
                            drop[lo - at : hi - at] = bits[lo - chunk * CHUNK : hi - chunk * CHUNK]
                    at += part.num_rows
                    yield part.filter(pa.array(drop if dropped else ~drop)).select(schema.names).cast(schema)

    return run


def _read(posts: DataFrame, columns: list[str], keys: list[str], order: str, batch_rows: int, dropped: bool) -> DataFrame:
    files, file_key = _files(posts)
    vectors = deletion_vectors(posts, keys, order, file_key)
    # As many tasks as the scan itself would have, so that neither many files nor a large one end up in a few.
    tasks = max(posts.rdd.getNumPartitions(), posts.sparkSession.sparkContext.defaultParallelism)
    groups = files.repartition(tasks).mapInArrow(_footers, "file string, key long, part int, at long, n long").filter("n > 0")
    chunks = groups.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / CHUNK), F.floor((F.col("at") + F.col("n") - 1) / CHUNK))))
    # One bitmap of 4 kB for 32,768 rows: a row of this table is bounded by its row group.
    held = chunks.join(vectors, ["key", "chunk"], "inner" if dropped else "left").groupBy("file", "part", "at")
    plan = held.agg(F.collect_list(F.when(F.col("vector").isNotNull(), F.struct("chunk", "vector"))).alias("vectors")).repartition(tasks)
    wanted = posts.select(*columns).schema
    return plan.mapInArrow(_reader(to_arrow_schema(wanted), batch_rows, dropped), wanted)


def exactly_once(posts: DataFrame, keys: list[str], order: str, batch_rows: int = 4096) -> DataFrame:
    """``posts`` with exactly one row of every identifier, the first delivered.

    ``posts`` must be a plain read of Parquet files.  Rows whose identifier has a
    null are all kept.  All columns come back as they are, in any number and under
    any name; only ``keys`` and ``order`` are looked at.  A row group without repeated
    deliveries is read without a vector; an empty table gives an empty result.
    Row groups are read by as many tasks as a scan of ``posts`` has.
    """
    return _read(posts, posts.columns, keys, order, batch_rows, dropped=False)


def dropped_rows(posts: DataFrame, keys: list[str], order: str, columns: list[str], batch_rows: int = 65_536) -> DataFrame:
    """``columns`` of the rows that :func:`exactly_once` drops, read through the same vectors; row groups without any aren't opened."""
    return _read(posts, columns, keys, order, batch_rows, dropped=True)

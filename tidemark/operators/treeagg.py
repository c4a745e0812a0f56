"""Problem 4: a few keys holding most records.

Method: multi-level tree aggregation.  Rows are combined in fixed-size chunks of
their input partitions, without moving them; the partial states are then merged
in rounds, ``fan_in`` neighbouring nodes into one, until one node per key is
left.  No reducer ever gets more than ``fan_in`` partial states of a key, so a key
with a third of all rows costs no task more than any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def channel_name(c: Column) -> Column:
    """Lower case without leading ``@``."""
    return F.regexp_replace(F.lower(c), "^@+", "")


def tree_aggregate(df: DataFrame, keys: list[str], first: dict[str, Column], merge: dict[str, Column], fan_in: int = 16, chunks: int | None = None) -> DataFrame:
    """Per-key results of a mergeable aggregate: ``keys`` and the columns of ``first``.

    ``first`` builds the state of a chunk from rows, ``merge`` merges states (over
    the columns named alike).  A chunk is what one task reads, so its size is set
    by the scan (``spark.sql.files.maxPartitionBytes``) and its states are formed
    by the map-side combine of the first round.  Nodes are numbered by the chunks'
    order.  Null keys are a key of their own.  An empty table gives no rows.
    ``chunks`` is given where ``df`` is no scan: the most partitions it can have.
    """
    if set(first) != set(merge):
        raise ValueError("first and merge must name the same columns")
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    if chunks is None:
        chunks = max(1, df.rdd.getNumPartitions()) if not df.isStreaming else 1
    rounds = max(1, math.ceil(math.log(chunks, fan_in))) if chunks > 1 else 1
    node = "_node"
    while node in df.columns:
        node += "_"
    state = df.withColumn(node, F.spark_partition_id().cast("long"))
    states = [v.alias(k) for k, v in first.items()]
    merged = [v.alias(k) for k, v in merge.items()]
    state = state.groupBy(*keys, node).agg(*states)
    for _ in range(rounds):
        state = state.withColumn(node, F.floor(F.col(node) / fan_in)).groupBy(*keys, node).agg(*merged)
    return state.groupBy(*keys).agg(*merged)


def per_channel(posts: DataFrame, channel_col: str = "channel_username", fan_in: int = 16) -> DataFrame:
    """Complete results per channel: ``channel_username, n_rows, n_messages, n_files, first_id, last_id, text_bytes``.

    ``n_messages`` is the number of different ``post_id`` and ``n_files`` that of
    source files; all are exact.  Rows are first combined to one for each channel
    and ``post_id``, and for each channel and file, which spreads a channel over all
    tasks; the tree then adds up these groups.
    Rows without a channel make up the null channel.  Nulls in the other columns
    don't count; a channel without any ``post_id`` has 0 messages.
    """
    channel = channel_name(F.col(channel_col).cast("string")).alias("_channel")
    messages = (
        posts.select(channel, "post_id", "id", F.octet_length("payload_json").cast("long").alias("_bytes"))
        .groupBy("_channel", "post_id")
        .agg(F.count("*").alias("n_rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("_bytes").alias("text_bytes"))
        .select("_channel", "n_rows", F.col("post_id").isNotNull().cast("long").alias("n_messages"), F.lit(0).cast("long").alias("n_files"), "first_id", "last_id", "text_bytes")
    )
    files = posts.select(channel, "source_file").filter("source_file is not null").distinct()
    files = files.select("_channel", *(F.lit(0).cast("long").alias(c) for c in ("n_rows", "n_messages")), F.lit(1).cast("long").alias("n_files"), *(F.lit(None).cast(messages.schema[c].dataType).alias(c) for c in ("first_id", "last_id", "text_bytes")))
    adds = {c: F.sum(c) for c in ("n_rows", "n_messages", "n_files")} | {"first_id": F.min("first_id"), "last_id": F.max("last_id"), "text_bytes": F.sum("text_bytes")}
    chunks = 2 * int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tree_aggregate(messages.unionByName(files), ["_channel"], adds, adds, fan_in, chunks).withColumnRenamed("_channel", "channel_username")


def channel_counts(posts: DataFrame, channel_col: str = "channel_username", fan_in: int = 16) -> DataFrame:
    """``channel_username, n_rows, first_id, last_id`` per channel, exact; reads two narrow columns only."""
    rows = posts.select(channel_name(F.col(channel_col).cast("string")).alias("channel_username"), "id")
    first = {"n_rows": F.count("*"), "first_id": F.min("id"), "last_id": F.max("id")}
    merge = {"n_rows": F.sum("n_rows"), "first_id": F.min("first_id"), "last_id": F.max("last_id")}
    return tree_aggregate(rows, ["channel_username"], first, merge, fan_in)


def heavy_channels(posts: DataFrame, share: float = 0.04, channel_col: str = "channel_username", fan_in: int = 16) -> DataFrame:
    """``channel_username, n_rows`` of the channels with at least ``share`` of all rows.

    The null channel counts in the total but is no channel.  At most 1/share rows.
    """
    counts = tree_aggregate(posts.select(channel_name(F.col(channel_col).cast("string")).alias("channel_username")), ["channel_username"], {"n_rows": F.count("*")}, {"n_rows": F.sum("n_rows")}, fan_in)
    total = counts.agg(F.sum("n_rows").alias("_total"))
    # Whole numbers in units of a millionth, so that exactly the share is enough.
    enough = F.col("n_rows") * 1_000_000 >= F.col("_total") * round(share * 1_000_000)
    return counts.crossJoin(F.broadcast(total)).filter(F.col("channel_username").isNotNull() & enough).select("channel_username", "n_rows")

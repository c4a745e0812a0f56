import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import delivery, treeagg

KEY = ["channel_id", "post_id"]
SCHEMA = "id long, channel_id long, post_id long, payload string, _first string, path string"


def deliveries(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        key = (1, 1) if rng.random() < 0.34 else (rng.choice([None, 1, 2]), rng.choice([None, *range(40)]))
        rows.append((i, *key, f"text {i}", "clash", None))
    rng.shuffle(rows)
    return rows


def losers(rows):
    first = {}
    for r in sorted(rows):
        if None not in r[1:3]:
            first.setdefault(r[1:3], r[0])
    return {r[0] for r in rows if None not in r[1:3] and first[r[1:3]] < r[0]}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("posts") / "with space & plus+")
    spark.createDataFrame(deliveries(), SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def test_repeated_deliveries(spark, stored):
    got = delivery.repeated_deliveries(stored.select("id", *KEY), KEY, "id")
    assert {r.id for r in got.collect()} == losers(deliveries())


def test_exactly_once_reads_through_deletion_vectors(spark, stored):
    rows = deliveries()
    kept = delivery.exactly_once(stored, KEY, "id", batch_rows=7)
    assert kept.columns == stored.columns
    assert sorted(kept.collect()) == sorted(r for r in stored.collect() if r.id not in losers(rows))


def test_exactly_once_beyond_one_bitmap(spark, tmp_path):
    path = str(tmp_path / "big")
    spark.range(0, 100_000, numPartitions=1).select("id", (F.col("id") % 60_000).alias("k")).write.parquet(path)
    kept = delivery.exactly_once(spark.read.parquet(path), ["k"], "id")
    assert kept.count() == 60_000 and kept.agg(F.max("id")).first()[0] == 59_999


def test_dropped_rows_are_the_rest(spark, stored):
    got = delivery.dropped_rows(stored, KEY, "id", ["id", "_first"], batch_rows=9)
    assert sorted(got.collect()) == sorted((i, "clash") for i in losers(deliveries()))


def _partitions(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_files_and_row_groups_are_read_by_many_tasks(spark, tmp_path):
    many, large = str(tmp_path / "many"), str(tmp_path / "large")
    rows = spark.range(0, 80_000).select("id", (F.col("id") % 60_000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    rows.repartition(16).write.parquet(many)
    # Row groups are closed by size, looked at every hundred rows or more.
    rows.coalesce(1).write.option("parquet.block.size", 200_000).option("parquet.page.size.row.check.min", 100).option("parquet.block.size.row.check.min", 100).parquet(large)
    want = sorted(r.id for r in rows.collect() if r.id < 60_000)
    for path in (many, large):
        kept = delivery.exactly_once(spark.read.parquet(path), ["k"], "id")
        assert sorted(r.id for r in kept.collect()) == want
        assert _partitions(kept) >= 4
        assert delivery.dropped_rows(spark.read.parquet(path), ["k"], "id", ["id"]).count() == 20_000


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    none = spark.read.parquet(path)
    assert delivery.exactly_once(none, KEY, "id").count() == 0
    assert delivery.dropped_rows(none, KEY, "id", ["id"]).count() == 0
    assert treeagg.heavy_channels(none.withColumn("channel_username", F.lit("a"))).count() == 0


@pytest.mark.parametrize("partitions,fan_in", [(1, 2), (7, 2), (40, 3)])
def test_tree_aggregate_is_the_plain_aggregate(spark, partitions, fan_in):
    rng = random.Random(3)
    rows = [(i, None if rng.random() < 0.02 else "hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string").repartition(partitions).withColumn("_node", F.lit(1))
    first = {"n": F.count("*"), "lo": F.min("id"), "s": F.sum("id")}
    merge = {"n": F.sum("n"), "lo": F.min("lo"), "s": F.sum("s")}
    got = sorted(treeagg.tree_aggregate(df, ["k"], first, merge, fan_in).collect(), key=str)
    want = sorted(df.groupBy("k").agg(*(v.alias(k) for k, v in first.items())).collect(), key=str)
    assert got == want


def test_heavy_channels(spark):
    rows = [(i, c) for i, c in enumerate(["@Hot"] * 3 + ["HOT", None] + ["edge"] * 4 + [f"c{i}" for i in range(91)])]
    df = spark.createDataFrame(rows, "id long, channel_username string")
    assert {tuple(r) for r in treeagg.heavy_channels(df).collect()} == {("hot", 4), ("edge", 4)}


def test_profiles_estimate_distincts(spark):
    rows = [(i, "a", i % 50, "f", "x" * 3) for i in range(1000)] + [(5000, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, channel_username string, post_id long, source_file string, payload_json string")
    got = {r.channel_username: r for r in treeagg.per_channel(df).collect()}
    assert got["a"].n_rows == 1000 and abs(got["a"].n_messages - 50) <= 2 and got["a"].n_files == 1 and got["a"].text_bytes == 3000
    assert got[None].n_rows == 1 and got[None].n_messages == 0


@pytest.mark.parametrize("fan_in", [2, 16])
def test_profiles_count_exactly(spark, fan_in):
    hot = spark.range(60_000, numPartitions=8).select("id", F.lit("@Hot").alias("channel_username"), (F.col("id") % 30_001).alias("post_id"), F.concat(F.lit("f"), F.col("id") % 7003).alias("source_file"), F.lit("я").alias("payload_json"))
    rest = spark.createDataFrame([(90_000, "HOT", None, None, None), (90_001, None, 1, "f", ""), (90_002, None, None, "f", None), (90_003, "b", None, None, None)], "id long, channel_username string, post_id long, source_file string, payload_json string")
    got = {r.channel_username: tuple(r)[1:] for r in treeagg.per_channel(hot.unionByName(rest), fan_in=fan_in).collect()}
    assert got == {"hot": (60_001, 30_001, 7003, 0, 90_000, 120_000), None: (2, 1, 1, 90_001, 90_002, 0), "b": (1, 0, 0, 90_003, 90_003, None)}


def test_bad_arguments(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        treeagg.tree_aggregate(df, ["id"], {"n": F.count("*")}, {"m": F.count("*")})
    with pytest.raises(ValueError):
        treeagg.tree_aggregate(df, ["id"], {"n": F.count("*")}, {"n": F.sum("n")}, fan_in=1)

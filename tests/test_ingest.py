import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, inference
from tidemark.sources import ingest
from tidemark.sources.sqlite import SQLiteSource
from tidemark.streaming import incremental
from tidemark.tables import require_columns, small, spread


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"channel_id": 1, "post_id": 2, "date": "d", "text": "т\\u0451"}\n\nbroken\n[1]\n{"channel_id": "x", "post_id": null}\r\n', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("", encoding="utf-8")
    rows = ingest.read_json_lines(spark, str(tmp_path)).orderBy("line_number").collect()
    assert [(r.line_number, r.channel_id, r.post_id, r.post_date) for r in rows] == [(1, 1, 2, "d"), (5, None, None, None)]
    assert rows[0].source_file.endswith("a.jsonl")
    lines = spark.createDataFrame([("a", ""), ("a", "{"), ("a", "{}"), ("b", "7")], "source_file string, line string")
    assert {tuple(r) for r in ingest.broken_lines(lines).collect()} == {("a", 1, 1), ("b", 0, 1)}


def test_numbers_of_lines_depend_on_their_file_alone(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    texts = {"b.txt": [f"строка {i} " + "x" * (i % 50) if i % 7 else "" for i in range(3000)], "c.txt": ["one"]}
    for name, held in texts.items():
        (folder / name).write_text("\n".join(held) + "\n", encoding="utf-8")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    read = lambda: {(r.source_file.rsplit("/", 1)[1], r.line_number): r.line for r in ingest.numbered_lines(spark, str(folder)).collect()}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 3
        want = {(name, n): x for name, held in texts.items() for n, x in enumerate(held, 1)}
        assert read() == want
        (folder / "a.txt").write_text("new\nlines\n", encoding="utf-8")
        assert read() == want | {("a.txt", 1): "new", ("a.txt", 2): "lines"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_csv_lists_and_days(spark, tmp_path):
    (tmp_path / "r.csv").write_text("day,n\n2025-01-01,3\nno day,4\n2025-01-02,x\n2025-01-03,\n", encoding="utf-8")
    rows = ingest.read_csv(spark, str(tmp_path / "r.csv"), "day date, n int", ["n"]).collect()
    assert [(str(r.day), r.n) for r in rows] == [("2025-01-01", 3)]
    (tmp_path / "l.txt").write_text(" a \n\nb\na\n\u00a0\n", encoding="utf-8")
    assert sorted(r.item for r in ingest.read_list(spark, str(tmp_path / "l.txt")).collect()) == ["a", "b"]
    days = spark.createDataFrame([("2025-01-01T10:00:00+03:00",), ("2025-01-05",), ("bad",), (None,)], "d string")
    assert ingest.within_days(days, "d", "2025-01-02").count() == 1 and ingest.within_days(days, "d", None, "2025-01-02").count() == 1 and ingest.within_days(days, "d").count() == 2


def test_json_array(spark, tmp_path):
    items = [{"Channel Name": "Один", "Handle": "@a", "resolved_id_x": 5}, 7, {"resolved_id_x": 5, "resolved_id_y": None}, {"resolved_id_x": 5, "resolved_id_y": 6}]
    (tmp_path / "c.json").write_text(json.dumps(items, indent=1, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "d.json").write_text('{"no": "array"}', encoding="utf-8")
    rows = ingest.read_json_array(spark, str(tmp_path)).orderBy("row_index").collect()
    assert [(r.row_index, r.channel_name, r.resolved_id) for r in rows] == [(1, "Один", 5), (3, None, None), (4, None, 6)]


def test_insert_new(spark):
    old = spark.createDataFrame([("a", 1), (None, 2)], "f string, n long")
    new = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("a", 2, 12), (None, 2, 13), (None, 3, 14)], "f string, n long, o long")
    rows, counts = ingest.insert_new(old, new, ["f", "n"], "o")
    assert {r.o for r in rows.collect()} == {11, 14} and tuple(counts.first()) == (2, 3)
    rows, counts = ingest.insert_new(old.limit(0), new.limit(0), ["f", "n"], "o")
    assert rows.count() == 0 and tuple(counts.first()) == (0, 0)


def test_sinks_and_stages(spark, tmp_path):
    df = spark.createDataFrame([(1, ["ё", "б"], None)], "id long, t array<string>, x string")
    ingest.write_json_lines(df, str(tmp_path / "j"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "j").glob("part*"))
    assert json.loads(text) == {"id": 1, "t": ["ё", "б"], "x": None} and "ё" in text
    flat = ingest.model_input(df, ["t"], ["x"])
    assert flat.columns == ["id", "t"] and flat.first().t == "ё,б"
    ingest.write_report(flat, str(tmp_path / "r"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "r")).count() == 1
    ingest.write_summary(spark, {"n": 1, "день": "д"}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text(encoding="utf-8"))["день"] == "д"
    made = []
    for _ in range(2):
        assert ingest.stage(spark, str(tmp_path / "stage"), lambda: made.append(1) or flat).count() == 1
    assert len(made) == 1
    ingest.stage(spark, str(tmp_path / "stage"), lambda: made.append(1) or flat, refresh=True)
    assert len(made) == 2


def test_documents(spark):
    df = spark.createDataFrame([(" a  б\n", "2025-01-01T01:00:00+03:00"), ("nan", "2025-01-01"), ("", "2025-01-01"), ("x", "no"), (None, "2025-01-01")], "text string, date string")
    rows = ingest.read_documents(df).collect()
    assert [(r.text, str(r.date)) for r in rows] == [("a б", "2024-12-31 22:00:00")]
    with pytest.raises(ValueError, match="missing columns: date"):
        ingest.read_documents(df.drop("date"))
    assert require_columns(df, "text") is df


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "posts.db")
    with sqlite3.connect(path) as c:
        c.execute("create table posts (id integer primary key, name text, n integer, x real)")
        c.executemany("insert into posts values (?, ?, ?, ?)", [(i * 3, f"п{i}" if i % 5 else None, i, i / 2) for i in range(1, 101)])
        c.execute("create table none (a text)")
    spark.dataSource.register(SQLiteSource)
    read = spark.read.format("sqlite").option("path", path)
    df = read.option("table", "posts").load()
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "n": "bigint", "x": "double"}
    assert df.count() == 100 and df.agg(F.sum("id")).first()[0] == 3 * 5050 and df.filter("name is null").count() == 20
    assert read.option("table", "posts").option("columns", "n, id").option("limit", "7").load().count() == 7
    assert spark.read.format("sqlite").option("path", path).option("table", "none").load().count() == 0


def test_streams(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, f"2025-01-0{1 + i % 3} 10:00:00", "a" if i % 2 else "b") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, at string, k string").withColumn("at", F.col("at").cast("timestamp"))
    df.repartition(3).write.parquet(source)
    df.write.mode("append").parquet(source)
    once = incremental.streamed(spark, source, df.schema, lambda s: incremental.first_deliveries(s, ["id"], "at", "10 days"))
    assert once.count() == 30
    counts = lambda: incremental.windowed_counts(spark.readStream.schema(df.schema).parquet(source), "at", ["k"])
    query = counts().writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == 60
    stream = spark.readStream.schema(df.schema).parquet(source)
    incremental.run_available(stream, target)
    incremental.run_available(spark.readStream.schema(df.schema).parquet(source), target)
    assert spark.read.parquet(target).count() == 60


def test_deliveries_and_counts_over_batches(spark, tmp_path):
    """Repeats within and across batches, late rows and null keys; a second run takes up where the first ended."""
    import os

    source = tmp_path / "in"
    schema = "id long, k string, at timestamp, v long"

    def deliver(n, rows):
        df = spark.createDataFrame(rows, "id long, k string, at string, v long").withColumn("at", F.col("at").cast("timestamp"))
        df.coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        source.mkdir(exist_ok=True)
        os.rename(next((tmp_path / f"p{n}").glob("*.parquet")), source / f"{n}.parquet")
        os.utime(source / f"{n}.parquet", (1_000_000 + n, 1_000_000 + n))

    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    once = lambda: sorted((r.id, r.k, r.v) for r in incremental.delivered_once(stream(), ["id", "k"], ["v"], str(tmp_path / "once")).collect())
    daily = lambda: incremental.latest_values(incremental.windowed_counts(stream(), "at", ["k"], lateness=None), ["start", "k"], str(tmp_path / "daily"))
    days = lambda: sorted((str(r.start)[:10], r.k, r.n) for r in daily().collect())
    deliver(1, [(1, "a", "2025-01-20", 5), (1, "a", "2025-01-20", 4), (2, "b", "2025-01-20", 6)])
    deliver(2, [(1, "a", "2025-01-20", 1), (3, "a", "2025-01-01", 7)])
    assert once() == [(1, "a", 4), (2, "b", 6), (3, "a", 7)]
    assert days() == [("2025-01-01", "a", 1), ("2025-01-20", "a", 3), ("2025-01-20", "b", 1)]
    deliver(3, [(2, "b", "2024-01-01", 9), (4, "c", "2024-01-01", 8), (4, "c", "2025-01-20", 2), (1, "b", None, 3)])
    assert once() == [(1, "a", 4), (1, "b", 3), (2, "b", 6), (3, "a", 7), (4, "c", 2)]
    assert days() == [("2024-01-01", "b", 1), ("2024-01-01", "c", 1), ("2025-01-01", "a", 1), ("2025-01-20", "a", 3), ("2025-01-20", "b", 1), ("2025-01-20", "c", 1)]


def test_first_deliveries_in_reverse_order_of_time(spark, tmp_path):
    import os
    import shutil

    from tidemark.plans import analysis

    for k, day in enumerate(("20", "10", "01")):
        rows = spark.createDataFrame([(i, f"2025-01-{day} 10:00:00") for i in range(10 * k, 10 * k + 15)], "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        rows.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        name = tmp_path / ("events.parquet" if not k else f"events{k}.parquet")
        shutil.copy(next((tmp_path / f"part{k}").glob("*.parquet")), name)
        os.utime(name, (1_000_000 + k, 1_000_000 + k))
    got = [r.event_id for r in analysis.QUERIES["stream_first_deliveries"](spark, str(tmp_path)).collect()]
    assert sorted(got) == list(range(35))


def test_inference(spark):
    def broken():
        raise OSError

    df = spark.createDataFrame([(1, "сбой и жалоба"), (2, "спасибо"), (3, None)], "id long, text string")
    stems = inference.stem_scorer({"negative": ["сбо", "жалоб"], "positive": ["спасиб"]})
    scores = inference.score(df, "id", "text", {"a": stems, "b": broken, "c": lambda: lambda texts: np.zeros((len(texts), 2))}, batch=2)
    assert scores.filter("probs is null").count() == 6
    got = {r.id: r for r in inference.ensemble_scores(scores).collect()}
    assert got[1].label == "negative" and got[2].label == "positive" and got[3].label == "negative"
    assert got[1].negative + got[1].neutral + got[1].positive == pytest.approx(1)
    assert {(r.model, r.error.split(":")[0], r.n) for r in inference.failures(scores).collect()} == {("b", "loading", 3), ("c", "scoring", 3)}
    none = inference.ensemble_scores(inference.score(df, "id", "text", {"b": broken}))
    assert [r.label for r in none.collect()] == [None] * 3


def test_audit(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else "y", ["p", "q"][i % 3 == 0]) for i in range(500)], "id long, a string, b string")
    strata = audit.stratified(df, {"odd": F.col("a") == "x", "third": F.col("b") == "q", "none": F.col("a") == "z"})
    assert strata.count() == 250 + 167
    one = audit.sample_per_stratum(strata, 20, "id")
    assert one.count() == 40 and sorted(one.collect()) == sorted(audit.sample_per_stratum(strata.repartition(7), 20, "id").collect())
    assert sorted(r.id for r in one.collect()) != sorted(r.id for r in audit.sample_per_stratum(strata, 20, "id", seed=1).collect())
    codes = spark.createDataFrame([("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15 + [(None, "a")], "p string, q string")
    row = audit.agreement(codes, "p", "q").first()
    assert row.n == 50 and row.raw_agreement == pytest.approx(0.7) and row.kappa == pytest.approx(0.4)


def test_small_and_spread(spark):
    df = spark.range(10).repartition(1)
    assert spread(df).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    wide = spark.range(10).repartition(50)
    assert spread(wide) is wide
    assert small(df, 10).count() == 10 and small(df, 3) is df


def test_embedding(spark):
    df = spark.createDataFrame([(1, "аб"), (2, None), (3, "б")], "id long, text string")
    make = lambda: lambda texts: np.array([[t.count("а"), t.count("б")] for t in texts], float)
    got = {r.id: [round(x, 4) for x in r.embedding] for r in inference.embed(df, "id", "text", make, 2, batch=2).collect()}
    assert got == {1: [0.7071, 0.7071], 2: [0.0, 0.0], 3: [0.0, 1.0]}
    with pytest.raises(Exception, match="vectors of shape"):
        inference.embed(df, "id", "text", make, 3).collect()
    scores = inference.score(df, "id", "text", {"s": inference.stem_scorer({"negative": ["аб"]})}, shards=2)
    assert scores.count() == 3 and inference.failures(scores).count() == 0


def test_tables_are_declared(spark, tmp_path):
    from tidemark.sources import schemas

    spark.sql(f"create database if not exists declared location '{tmp_path}/declared'")
    try:
        schemas.create_tables(spark, "declared")
        schemas.create_tables(spark, "declared")
        assert spark.table("declared.posts_raw").schema.fieldNames() == schemas.POSTS_RAW.fieldNames()
        rows = spark.createDataFrame([(1, "f", 1, 2, "u", 3, "2025-01-01", "{}")], schemas.POSTS_RAW)
        rows.write.insertInto("declared.posts_raw")
        assert spark.table("declared.posts_raw").count() == 1
    finally:
        spark.sql("drop database declared cascade")


def test_command_line(spark, tmp_path):
    from tidemark import __main__ as command

    source = tmp_path / "in"
    (source / "docs_topics.parquet").parent.mkdir()
    spark.createDataFrame([(1, "1_a"), (2, None)], "row_id long, topic_name string").withColumn("date_day", F.lit("2025-01-01")).write.parquet(str(source / "docs_topics.parquet"))
    command.main(["txt_topic_labels", "--tables", str(source), "--out", str(tmp_path / "out"), "--format", "json"])
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    with pytest.raises(SystemExit):
        command.main(["no_such_query"])

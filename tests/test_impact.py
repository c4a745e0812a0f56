import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import authors, components, impact, reports, series, topics
from tidemark.operators.verify import Check, snapshot, verify


def chi2_tail(x, dof):
    return math.exp(-x / 2) if dof == 2 else math.erfc(math.sqrt(x / 2))


def test_scenarios():
    full, same = impact.scenarios(date(2022, 2, 24), date(2026, 4, 24), date(2026, 1, 16))
    assert full.before_end == date(2026, 1, 15) and full.n_days_after == 99
    assert (same.before_end - same.before_start).days + 1 == 99 and same.after_end == full.after_end
    with pytest.raises(ValueError):
        impact.scenarios(date(2022, 1, 1), date(2022, 2, 1), date(2022, 3, 1))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        d = date(2025, 1, 1).toordinal() + int(rng.integers(0, 60))
        rows.append((i, None if i % 97 == 0 else date.fromordinal(d), int(rng.integers(-1, 4)) if i % 50 else None, ["negative", "neutral", "positive"][int(rng.integers(0, 3))], "A" if i % 3 else "B"))
    return spark.createDataFrame(rows, "id long, day date, topic int, label string, obj string")


def period():
    return F.when(F.col("day") < "2025-02-01", "before").when(F.col("day") >= "2025-02-01", "after")


def test_shares_add_up(docs):
    for over in ([], ["obj"]):
        rows = impact.before_after(docs, ["topic"], period(), over).toPandas()
        for _, part in rows.groupby(over) if over else [(None, rows)]:
            assert part.before_share.sum() == pytest.approx(1) and part.after_share.sum() == pytest.approx(1)
            assert part.delta_share.sum() == pytest.approx(0)
    assert rows.before_n.sum() + rows.after_n.sum() == docs.filter("day is not null").count()
    assert rows.topic.isna().any()
    none = impact.before_after(docs.limit(0), ["topic"], period())
    assert none.count() == 0


def counts(spark, *rows):
    names = [f"{p}_{x}_n" for p in ("before", "after") for x in impact.LABELS]
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} long" for n in names))
    return df.withColumn("before_n", sum(F.col(n) for n in names[:3])).withColumn("after_n", sum(F.col(n) for n in names[3:]))


def test_chi_square(spark):
    rows = [(10, 20, 30, 15, 25, 5), (10, 0, 30, 15, 0, 5), (0, 7, 0, 0, 9, 0), (0, 0, 0, 1, 2, 3), (8, 8, 8, 8, 8, 8)]
    got = impact.with_chi_square(counts(spark, *rows)).collect()
    table = np.array(rows[0], float).reshape(2, 3)
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    chi2 = ((table - expected) ** 2 / expected).sum()
    assert got[0].chi2 == pytest.approx(chi2) and got[0].chi2_pvalue == pytest.approx(chi2_tail(chi2, 2))
    table = np.array([[10, 30], [15, 5]], float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    yates = ((abs(table - expected) - 0.5) ** 2 / expected).sum()
    assert got[1].chi2 == pytest.approx(yates) and got[1].chi2_pvalue == pytest.approx(chi2_tail(yates, 1), rel=1e-6)
    assert (got[2].chi2, got[2].chi2_pvalue) == (0, 1) and got[3].chi2 is None and got[3].chi2_pvalue is None
    assert got[4].chi2 == 0 and got[4].chi2_pvalue == 1


def test_intervals_and_contrasts(spark):
    df = counts(spark, (400, 300, 300, 700, 200, 100), (400, 300, 300, 410, 295, 295), (0, 0, 0, 5, 5, 5))
    df = df.withColumn("obj", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.when(F.col("before_n") == 0, 3).when(F.col("after_negative_n") == 700, 1).otherwise(2)))).withColumn("scenario", F.lit("full"))
    rows = {r.obj: r for r in impact.with_intervals(df, ["scenario", "obj"]).collect()}
    assert rows["A"].delta_neg_ci_lo < 0.3 < rows["A"].delta_neg_ci_hi and rows["A"].delta_neg_ci_lo > 0.2
    assert rows["C"].delta_neg_ci_lo is None or np.isnan(rows["C"].delta_neg_ci_lo)
    got = {r.contrast: r for r in impact.contrasts(df, "scenario", "obj", [("A", "B"), ("A", "C")]).collect()}
    assert got["A - B"].point == pytest.approx(0.29) and got["A - B"].significant_95
    assert not got["A - C"].significant_95
    again = {r.obj: r for r in impact.with_intervals(df.repartition(3), ["scenario", "obj"]).collect()}
    assert again["A"] == rows["A"]


def test_url_repair(spark):
    df = spark.createDataFrame([("u1", "a,b"), ("u2", "a"), ("u1", "a"), (None, "a"), ("u3", None)], "post_url string, terms string")
    urls = spark.createDataFrame([(" u1 ",), ("u1",), ("",), (None,)], "url string")
    got = sorted(map(tuple, impact.repaired_terms(df, urls, "a", ["a"]).select("post_url", "terms", "in_group").collect()), key=str)
    assert got == sorted([("u1", "b", False), ("u2", "a", True), ("u1", "", False), (None, "a", True), ("u3", "", False)], key=str)


def test_bins(spark, docs):
    lone = spark.createDataFrame([(date(2025, 1, 20), "x"), (date(2025, 2, 19), "x"), (date(2025, 4, 1), "y")], "day date, k string")
    got = {(str(r.bin), r.k): r.n for r in series.binned_counts(lone, "day", ["k"], 30).collect()}
    assert got == {("2025-01-20", "x"): 1, ("2025-02-19", "x"): 1, ("2025-03-21", "y"): 1}
    daily = series.daily_labels(lone.withColumn("label", F.lit("negative")), "day", "label", impact.LABELS)
    filled = series.filled_bins(daily, "day", impact.LABELS, 10).orderBy("bin").collect()
    assert len(filled) == 8 and sum(r.negative for r in filled) == 3 and filled[1].negative == 0
    assert series.filled_bins(daily.limit(0), "day", impact.LABELS, 10).count() == 0


def test_rolling(spark):
    daily = spark.createDataFrame([(date(2025, 1, d), t, n) for d, t, n in [(1, 10, 5), (2, 2, 0), (7, 4, 4), (8, 1, 1)]], "day date, total long, negative long")
    share = [r.share for r in series.rolling_share(daily, "day", "negative", 7).orderBy("day").collect()]
    assert share == pytest.approx([0.5, 5 / 12, 9 / 16, 5 / 7])
    mean = [r["mean"] for r in series.rolling_mean(daily, "day", "negative", 14, 3).orderBy("day").collect()]
    assert mean[:2] == [None, None] and mean[2:] == pytest.approx([0.5, 0.625])
    rows = [r["mean"] for r in series.rolling_rows(daily, "day", "negative", 2).orderBy("day").collect()]
    assert rows == pytest.approx([0.5, 0.25, 0.5, 1.0])


def test_first_last_with_one_bin(spark):
    one = spark.createDataFrame([(date(2025, 1, 1), 1, 5), (date(2025, 1, 1), 2, 7)], "bin date, topic int, n long")
    assert {(r.topic, r.change, r.n) for r in series.first_last_change(one, "topic").collect()} == {(1, None, 5), (2, None, 7)}


def test_ensemble(spark):
    df = spark.createDataFrame([(0.2, 0.4, 0.4), (0.5, 0.5, 0.0), (None, 0.5, 0.5)], "a double, b double, c double")
    e = df.select(topics.ensemble([[F.col("a"), F.col("b"), F.col("c")]] * 2).alias("e")).collect()
    assert [r.e.label for r in e[:2]] == ["neutral", "negative"] and e[0].e.score == pytest.approx(0.4)
    with pytest.raises(ValueError):
        topics.ensemble([])


def test_modes_and_examples(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "y", 3), ("a", "x", 4), ("a", "", 5), ("b", " ", 6), ("b", None, 7), (None, "z", 8)], "k string, v string, i int")
    assert {tuple(r) for r in authors.typical_value(df, "k", "v").collect()} == {("a", "x"), ("b", ""), (None, "z")}
    rows = {r.k: r for r in authors.latest_examples(df, "k", [F.desc("i")], F.col("i").cast("string"), 3).collect()}
    assert (rows["a"].example_1, rows["a"].example_3, rows["b"].example_3) == ("5", "3", "")


def test_topic_words(spark):
    df = spark.createDataFrame([(1, "a a b"), (1, "a c"), (2, "b b d"), (None, "c c")], "topic int, text string")
    got = topics.class_tf_idf(df, "topic", F.split("text", " "), top=1).collect()
    assert {(r.topic, r.word) for r in got} == {(1, "a"), (2, "b"), (None, "c")}
    kept = topics.class_tf_idf(df, "topic", F.split("text", " "), min_docs=2, max_share=0.5).collect()
    assert {r.word for r in kept} == {"a", "b", "c"}


def test_unit_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, v array<double>")
    got = {r.id: r.v for r in topics.unit_vectors(df, "v").collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0, 0] and got[3] is None


def test_clusters(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (np.eye(8)[i % 3] + rng.normal(0, 0.02, 8)).tolist()) for i in range(90)]
    got = topics.cluster_vectors(spark.createDataFrame(rows, "id long, v array<double>"), "v", "id", k=3, dims=3)
    topic = {r.id: r.topic for r in got.collect()}
    assert len(topic) == 90 and all(len({topic[i] for i in range(s, 90, 3)} - {-1}) == 1 for s in range(3))


def test_clusters_are_fitted_on_all_rows(spark):
    rows = spark.range(200_000, numPartitions=4)
    # Rows that a sample of half of them by this hash would leave out.
    rare = [r.id for r in rows.filter(F.pmod(F.xxhash64("id", F.lit(42)), F.lit(1_000_000)) >= 500_000).limit(3).collect()]
    place = F.when(F.col("id").isin(rare), 2).otherwise(F.col("id") % 2)
    df = rows.select("id", F.array(*(F.when(place == i, 1.0).otherwise(0.0) + 0.001 * F.sin(F.col("id") + i) for i in range(3))).alias("v"))
    got = topics.cluster_vectors(df, "v", "id", k=3, dims=3)
    assert [r.id for r in got.filter("topic = 2").orderBy("id").collect()] == sorted(rare)


def test_checks():
    def broken():
        raise OSError

    checks = [Check("a", "exact", lambda: 3), Check("b", "approx", lambda: 1.005, 0.01), Check("c", "approx_rel", lambda: 40, 0.3, "warn"), Check("d", "exists", lambda: []), Check("e", "exact", broken), Check("f", "exact", lambda: 1)]
    assert verify(checks, {"a": 3, "b": 1.0, "c": 31, "e": 1}) == {"a": "PASS", "b": "PASS", "c": "PASS", "d": "FAIL", "e": "FAIL", "f": "MISSING"}
    assert verify(checks[2:3], {"c": 20}) == {"c": "WARN"}
    files = [Check("f", "filelist", lambda: ["a", "b"]), Check("g", "filelist", lambda: ["a"], level="warn")]
    assert verify(files, {"f": ["b"], "g": ["a", "c"]}) == {"f": "PASS", "g": "WARN"}
    assert snapshot(checks[:2]) == {"a": 3, "b": 1.005}


def test_vectors_by_key(spark):
    docs = spark.createDataFrame([(1,), (2,)], "row long")
    full = spark.createDataFrame([(2, [0.0, 1.0]), (1, [1.0, 0.0])], "id long, v array<double>")
    assert {(r.row, tuple(r.vector)) for r in topics.attach_vectors(docs, full, "row", "id", "v", 2).collect()} == {(1, (1.0, 0.0)), (2, (0.0, 1.0))}
    for wrong in (full.limit(1), full.union(full), spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>")):
        with pytest.raises(ValueError):
            topics.attach_vectors(docs, wrong, "row", "id", "v", 2)
    assert topics.attach_vectors(docs, full.limit(1), "row", "id", "v", 2, strict=False).filter("vector is null").count() == 1


def test_exact_medians(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", 2.0), ("a", 2.0), ("b", 5.0), ("b", None), (None, 1.0), (None, 4.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.size, r.v_mean, r.v_median) for r in topics.topic_label_stats(df, ["k"], ["v"]).collect()}
    assert got == {"a": (4, 2.0, 2.0), "b": (2, 5.0, 5.0), None: (2, 2.5, 2.5), "c": (1, None, None)}


def test_density_clusters(spark):
    """A ring around a blob, which no k-means can part, and a few rows far off."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1200):
        a = 2 * math.pi * i / 1200
        rows.append((i, [math.cos(a) * 0.5, math.sin(a) * 0.5, 1.0]))
    for i in range(1200, 1500):
        rows.append((i, [*rng.normal(0, 0.02, 2).tolist(), 1.0]))
    rows += [(1500, [5.0, 5.0, 1.0]), (1501, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    topic = {r.id: r.topic for r in topics.density_clusters(df, "v", "id", dims=3, width=0.05, least=4).collect()}
    assert len(topic) == 1501 and topic[1500] == -1
    ring, blob = ([topic[i] for i in part] for part in (range(1200), range(1200, 1500)))
    assert set(ring) <= {0, -1} and ring.count(0) > 1150 and set(blob) <= {1, -1} and blob.count(1) > 280
    assert topics.density_clusters(df.limit(0), "v", "id").count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(400, 401)]
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "label long, other long")
    got = {r.label: r.root for r in components.connected(both.select("label").distinct(), both).collect()}
    assert got == {i: 0 for i in range(301)} | {400: 400, 401: 400}


def test_fitted_models_are_stored(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = [(i, [float(i % 2), float(i % 3), 1.0]) for i in range(30)]
    topics.cluster_vectors(spark.createDataFrame(rows, "id long, v array<double>"), "v", "id", k=2, dims=2, save_to=str(tmp_path / "m"))
    assert len(PipelineModel.load(str(tmp_path / "m")).stages) == 2


def test_report_labels(spark):
    row = spark.range(1).select(
        reports.points(F.lit(0.0123)).alias("a"), reports.points(F.lit(-0.2)).alias("b"), reports.percent(F.lit(0.5), F.lit(7)).alias("c"), reports.grouped(F.lit(1234567)).alias("d"),
        reports.day_label(F.lit("2025-02-01").cast("date")).alias("e"), reports.before_first(F.lit("a=b=c"), "=").alias("f"), reports.file_name(F.lit("org/model v1:x")).alias("g"),
        reports.labelled(F.lit("x"), {"x": "икс"}).alias("h"), reports.labelled(F.lit("y"), {"x": "икс"}).alias("i"), reports.topic_mask(F.lit("1_VPN_сбой"), ["впн", "vpn"]).alias("j"), reports.topic_mask(F.lit(None).cast("string"), ["a"]).alias("k"),
    ).first()
    assert tuple(row) == ("+1.2 п.п.", "-20.0 п.п.", "50.0% (n=7)", "1 234 567", "01.02.2025", "a", "org__model_v1_x", "икс", "y", True, False)
    with pytest.raises(ValueError):
        reports.topic_mask(F.lit("x"), [" "])


def test_fixed_categories_and_codes(spark):
    df = spark.createDataFrame([(1, "b"), (2, "b"), (3, None), (4, "x")], "id long, c string")
    assert [(r.position, r.c, r.n, round(r.share, 3)) for r in reports.shares_in_order(df, "c", ["a", "b"]).orderBy("position").collect()] == [(0, "a", 0, 0.0), (1, "b", 2, 0.667)]
    assert [r.share for r in reports.shares_in_order(df.limit(0), "c", ["a"]).collect()] == [0.0]
    codes = spark.createDataFrame([(1, "y", "k"), (1, "z", "a"), (9, "q", "q")], "id long, code string, c string")
    assert sorted(tuple(r) for r in reports.attach_codes(df, codes, "id").collect()) == [(1, "b", "y"), (2, "b", None), (3, None, None), (4, "x", None)]


def test_package_and_frames(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}", encoding="utf-8")
    reports.write_frames({"frame": spark.range(2)}, str(tmp_path / "f"))
    missing = reports.package(spark, [(str(tmp_path / "a.json"), "b.json"), (str(tmp_path / "none"), "c"), (str(tmp_path / "f/frame"), "frame")], str(tmp_path / "out"))
    assert missing == [str(tmp_path / "none")] and (tmp_path / "out/b.json").read_text(encoding="utf-8") == "{}"
    assert spark.read.option("header", "true").csv(str(tmp_path / "out/frame")).count() == 2


def test_written_tables_are_removed_with_their_scope(spark):
    from pathlib import Path

    from tidemark.tables import materialize, scratch

    with scratch(spark):
        kept = materialize(spark.range(3), "kept")
        folder = Path(kept.inputFiles()[0].removeprefix("file:")).parent
        assert kept.count() == 3 and folder.exists()
    assert not folder.exists()

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import nested

ARRAYS = ["media", "sizes", "replies"]


def walk(value, path, parent, out):
    if isinstance(value, dict):
        for name, x in value.items():
            here = f"{path}.{name}"
            if name in ARRAYS:
                if isinstance(x, str):
                    try:
                        x = y if isinstance(y := json.loads(x), (dict, list)) else x
                    except ValueError:
                        pass
                x = [x] if isinstance(x, dict) else x
                if isinstance(x, list):
                    for i, e in enumerate(x):
                        if isinstance(e, dict):
                            out.append((parent, f"{here}[{i}]"))
                        walk(e, f"{here}[{i}]", f"{here}[{i}]" if isinstance(e, dict) else parent, out)
                    continue
            walk(x, here, parent, out)
    elif isinstance(value, list):
        for i, e in enumerate(value):
            walk(e, f"{path}[{i}]", parent, out)
    return out


RECORDS = [
    {"media": [{"w": 1, "meta": {"sizes": [{"h": 1}, None, 3, {"h": 2, "variants": []}]}}, None, "x", {"sizes": '[{"h": 5}, 7]'}]},
    {"media": {"sizes": {"h": 9}}, "text": "[no json]"},
    {"replies": [{"replies": [{"replies": []}, {"replies": [{"n": 1}]}]}, {}]},
    {"media": [], "other": [{"media": [{"w": 2}]}, [{"media": {"w": 3}}]]},
    {"media": [[{"w": 1}], {"w": 2}], "sizes": "[broken", "replies": None},
    {"meta": {"a": {"media": '{"sizes": "[{}]"}'}}, "empty": {}},
    {},
    [{"media": [{}]}],
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, json.dumps(r)) for i, r in enumerate(RECORDS)] + [(90, None), (91, "not json"), (92, ""), (0, json.dumps(RECORDS[0]))]
    # A column with the name of a result column is ignored.
    return spark.createDataFrame(rows, "id long, payload string").withColumn("path", F.lit("clash"))


def test_objects_match_a_plain_walk(spark, table):
    stripes = nested.shred(table, "id", "payload", ARRAYS)
    got = sorted((r.record_id, r.parent_path, r.path) for r in nested.objects(stripes, ARRAYS).collect())
    want = sorted((i, p, q) for i, r in [*enumerate(RECORDS), (0, RECORDS[0])] if isinstance(r, dict) for p, q in walk(r, "$", "$", []))
    assert got == want and got


def test_the_same_objects_in_one_pass(spark, table):
    stripes = nested.objects(nested.shred(table, "id", "payload", ARRAYS), ARRAYS)
    assert sorted(stripes.collect()) == sorted(nested.nested_objects(table, "id", "payload", ARRAYS).collect())


ODD = [
    {"tags": ["a", "b", 3], "mixed": [1, None, {"x": []}, [], [[]], [[1, {"y": None}], "z"], {}], "a.b": {"c[0]": [{"#": 1}], "": {"": [2]}, "~": "t~1", "]": [3]}},
    {"meta": {"media": "[1, {\"w\": \"2\"}]"}, "media": {"sizes": None}, "same": {"k": [{"k": {"k": [0]}}]}},
    {"n": 1.5, "big": 10**25, "t": True, "s": "7", "u": "\u00e9\n"},
]


def test_records_come_back_from_their_levels(spark, table):
    shredder = nested.Shredder(ARRAYS)
    for record in [*(r for r in RECORDS if isinstance(r, dict)), *ODD]:
        assert nested.assemble(shredder.stripes(record)) == shredder.as_counted(record)
    rows = [(i, json.dumps(r)) for i, r in enumerate([*RECORDS, *ODD])]
    df = spark.createDataFrame(rows, "id long, payload string")
    got = {r.record_id: json.loads(r.payload_json) for r in nested.rebuild(nested.shred(df, "id", "payload", ARRAYS)).collect()}
    assert got == {i: shredder.as_counted(json.loads(t)) for i, t in rows if t[0] == "{"}


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["media", "sizes", "a", "b.c", "", "x[]", "~0", "#"]), x, max_size=3), max_leaves=20))
def test_any_record_comes_back(value):
    shredder = nested.Shredder(ARRAYS)
    record = {"v": value, "media": value}
    assert nested.assemble(shredder.stripes(record)) == shredder.as_counted(record)


def test_typed_tables_and_their_files(spark, tmp_path):
    record = {"media": [{"w": 1, "meta": {"h": "x"}}, {"w": "2", "sizes": [{"h": 5}]}, 3], "text": "t"}
    flat = nested.flat_tables(spark.createDataFrame([(1, json.dumps(record))], "id long, payload string"), "id", "payload", ARRAYS)
    media = nested.typed(flat, "media[]", {"w": "bigint", "meta.h": "int"})
    assert sorted(tuple(r) for r in media.collect()) == [(1, "$", "$.media[0]", 1, None), (1, "$", "$.media[1]", 2, None)]
    sizes = nested.typed(flat, "media[].sizes[]", {"h": "int"})
    assert [tuple(r) for r in sizes.join(media.select("record_id", F.col("path").alias("parent_path"), "w"), ["record_id", "parent_path"]).select("h", "w").collect()] == [(5, 2)]
    nested.write_tables(flat, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {r[0]: r[1] for r in back.groupBy("table").count().collect()} == {"$": 1, "media[]": 2, "media[].value": 1, "media[].sizes[]": 1}


def test_levels_of_the_textbook_example():
    """Repetition and definition levels as in the published description of record shredding."""
    s = nested.Shredder(["name", "language"])
    columns = s.stripes({"name": [{"language": [{"code": "en-us"}, {"code": "en"}]}, {"url": "B"}, {"language": [{"code": "en-gb"}]}]})
    rep, level, value = columns["name[].language[].code"]
    assert rep == [0, 2, 1, 1]
    assert value == ["en-us", "en", None, "en-gb"]
    assert [x == max(level) for x in level] == [True, True, False, True]
    rep, level, value = columns["name[].url"]
    assert rep == [0, 1, 1] and value == [None, "B", None]


def test_flat_tables_keep_fields(spark):
    df = spark.createDataFrame([(1, json.dumps({"media": [{"w": 1, "meta": {"mime": "a"}, "no": None}, {"w": "x", "sizes": [{"h": 2}, {"k": True}]}]}))], "id long, payload string")
    rows = {r.path: r for r in nested.flat_tables(df, "id", "payload", ARRAYS).collect()}
    assert rows["$.media[0]"].fields == {"w": "1", "meta.mime": "a", "no": None}
    assert rows["$.media[1]"].fields == {"w": "x"}
    assert rows["$.media[1].sizes[1]"].fields == {"k": "true"} and rows["$.media[1].sizes[1]"].parent_path == "$.media[1]"
    assert rows["$.media[1].sizes[0]"].table == "media[].sizes[]"


def test_flat_tables_lose_no_value(spark):
    record = {"text": "т", "views": None, "meta": {"lang": "ru"}, "media": ["a", 7, None, {"w": 1, "tags": ["x", {"y": 2}]}], "list": [True, [3]]}
    df = spark.createDataFrame([(1, json.dumps(record)), (2, "{}"), (3, "[1]")], "id long, payload string")
    rows = sorted((r.record_id, r.table, r.parent_path, r.path, r.fields) for r in nested.flat_tables(df, "id", "payload", ["media"]).collect())
    value = lambda table, path, x, parent="$": (1, f"{table}.value", parent, path, {"value": x})
    assert rows == sorted(
        [
            (1, "$", None, "$", {"text": "т", "views": None, "meta.lang": "ru"}),
            (2, "$", None, "$", {}),
            (1, "media[]", "$", "$.media[3]", {"w": "1"}),
            (1, "media[].tags[]", "$.media[3]", "$.media[3].tags[1]", {"y": "2"}),
            value("media[]", "$.media[0]", "a"),
            value("media[]", "$.media[1]", "7"),
            value("media[]", "$.media[2]", None),
            value("media[].tags[]", "$.media[3].tags[0]", "x", "$.media[3]"),
            value("list[]", "$.list[0]", "true"),
            value("list[][]", "$.list[1][0]", "3"),
        ]
    )


def test_empty_table_and_deep_records(spark):
    none = spark.createDataFrame([], "id long, payload string")
    assert nested.flat_tables(none, "id", "payload", ARRAYS).count() == 0
    deep: dict = {}
    at = deep
    for _ in range(60):
        at["replies"] = [{}, {}]
        at = at["replies"][1]
    df = spark.createDataFrame([(1, json.dumps(deep))], "id long, payload string")
    assert nested.objects(nested.shred(df, "id", "payload", ARRAYS), ARRAYS).count() == 120

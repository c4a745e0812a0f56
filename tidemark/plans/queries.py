"""Queries of the core, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import delivery, nested, treeagg
from tidemark.plans import analysis, corpora, reports
from tidemark.tables import spread, table

FLAGSHIP = "agg_object_scenario"

# The fields of the payloads that hold arrays.
POST_ARRAYS = "media sizes variants reactions recent entities comments replies poll_options voters edits".split()
CHANNEL_ARRAYS = [*POST_ARRAYS, *"admins rights similar tags history".split()]


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "posts_raw")


def p2_found(spark, sf_dir):
    out = None
    for name, arrays in (("posts_raw", POST_ARRAYS), ("channels_enriched", CHANNEL_ARRAYS)):
        rows = nested.nested_objects(spread(table(spark, sf_dir, name)), "id", "payload_json", arrays)
        rows = rows.select(F.lit(name).alias("source_table"), "record_id", "parent_path", "path")
        out = rows if out is None else out.unionByName(rows)
    return out


def _flat(spark, sf_dir):
    return nested.flat_tables(spread(_posts(spark, sf_dir)), "id", "payload_json", POST_ARRAYS)


def p2_tables(spark, sf_dir):
    out = None
    for name, arrays in (("posts_raw", POST_ARRAYS), ("channels_enriched", CHANNEL_ARRAYS)):
        rows = nested.flat_tables(spread(table(spark, sf_dir, name)), "id", "payload_json", arrays)
        rows = rows.select(F.lit(name).alias("source_table"), "record_id", "table", "parent_path", "path", F.to_json("fields").alias("fields"))
        out = rows if out is None else out.unionByName(rows)
    return out


def p2_reactions(spark, sf_dir):
    """The flat table of reactions, with the number of recent users hanging from each."""
    rows = _flat(spark, sf_dir)
    reactions = nested.typed(rows, "reactions[]", {"emoji": "string", "count": "bigint"})
    recent = nested.typed(rows, "reactions[].recent[]", {}).groupBy("record_id", F.col("parent_path").alias("path")).agg(F.count("*").alias("n_recent"))
    return reactions.drop("parent_path").join(recent, ["record_id", "path"], "left").na.fill(0, ["n_recent"])


def p2_entities(spark, sf_dir):
    """The flat table of entities at the top of posts."""
    return nested.typed(_flat(spark, sf_dir), "entities[]", {"type": "string", "offset": "bigint", "length": "bigint", "url": "string"})


def p4_found(spark, sf_dir):
    return treeagg.heavy_channels(_posts(spark, sf_dir)).select("channel_username")


def p4_channels(spark, sf_dir):
    return treeagg.channel_counts(_posts(spark, sf_dir))


def p4_profiles(spark, sf_dir):
    return treeagg.per_channel(_posts(spark, sf_dir))


KEY = ["channel_id", "post_id"]


def p7_found(spark, sf_dir):
    return delivery.dropped_rows(_posts(spark, sf_dir), KEY, "id", ["id"])


def p7_kept(spark, sf_dir):
    return delivery.exactly_once(_posts(spark, sf_dir), KEY, "id")


QUERIES = {f.__name__: f for f in (p2_found, p2_tables, p2_reactions, p2_entities, p4_found, p4_channels, p4_profiles, p7_found, p7_kept)} | analysis.QUERIES | corpora.QUERIES | reports.QUERIES



def _walk(name: str, arrays: list[str]) -> str:
    """All values of a table's records with their paths, as recursive SQL: ``id, path, parent, v, listed, elem``."""
    listed = "(" + ", ".join(f"'{a}'" for a in arrays) + ")"
    text = "(x->>'$')"
    decoded = f"case when json_type(x) = 'VARCHAR' and regexp_matches({text}, '^\\s*[\\[{{]') and json_valid({text}) then {text}::json else x end"
    lone = "case when json_type(x) = 'OBJECT' then ('[' || x || ']')::json else x end"
    held = f"list_transform([list_transform([json_extract(v, '$.\"' || k || '\"')], lambda x: {decoded})[1]], lambda x: {lone})[1]"
    of_object = f"list_transform(json_keys(v), lambda k: {{'step': '.' || k, 'v': case when k in {listed} then {held} else json_extract(v, '$.\"' || k || '\"') end, 'listed': k in {listed}, 'elem': false}})"
    of_list = "list_transform(generate_series(0, json_array_length(v)::bigint - 1), lambda i: {'step': '[' || i || ']', 'v': json_extract(v, '$[' || i || ']'), 'listed': false, 'elem': listed})"
    return f"""walk_{name} as (
  select id, '$' as path, '$' as parent, payload_json::json as v, false as listed, false as elem from {name} where json_valid(payload_json) and json_type(payload_json) = 'OBJECT'
  union all
  select id, path || c.step, case when elem and json_type(v) = 'OBJECT' then path else parent end, c.v, c.listed, c.elem
  from (select *, unnest(case json_type(v) when 'OBJECT' then {of_object} when 'ARRAY' then {of_list} end) as c from walk_{name} where json_type(v) in ('OBJECT', 'ARRAY')))"""


_CASES = "elem and json_type(v) = 'OBJECT'"
_POSTS = _walk("posts_raw", POST_ARRAYS)
_RECENT = r"(select id, parent, count(*) as n from walk_posts_raw where {c} and regexp_matches(path, '^\$\.reactions\[\d+\]\.recent\[\d+\]$') group by all)".format(c=_CASES)

_CHANNEL = "regexp_replace(lower(channel_username), '^@+', '')"
SQL = analysis.SQL | reports.SQL | {
    "p2_found": f"with recursive {_POSTS}, {_walk('channels_enriched', CHANNEL_ARRAYS)} select 'posts_raw' as source_table, id as record_id, parent as parent_path, path from walk_posts_raw where {_CASES} union all select 'channels_enriched', id, parent, path from walk_channels_enriched where {_CASES}",
    "p2_reactions": f"with recursive {_POSTS} select w.id as record_id, w.path, v->>'$.emoji' as emoji, try_cast(v->>'$.count' as bigint) as count, coalesce(n, 0) as n_recent from walk_posts_raw w left join {_RECENT} r on r.id = w.id and r.parent = w.path where {_CASES} and regexp_matches(w.path, '^\\$\\.reactions\\[\\d+\\]$')",
    "p2_entities": f"with recursive {_POSTS} select id as record_id, parent as parent_path, path, v->>'$.type' as type, try_cast(v->>'$.offset' as bigint) as offset, try_cast(v->>'$.length' as bigint) as length, v->>'$.url' as url from walk_posts_raw where {_CASES} and regexp_matches(path, '^\\$\\.entities\\[\\d+\\]$')",
    "p4_found": f"select {_CHANNEL} as channel_username from posts_raw where channel_username is not null group by 1 having count(*) * 100 >= 4 * (select count(*) from posts_raw)",
    "p4_channels": f"select {_CHANNEL} as channel_username, count(*) as n_rows, min(id) as first_id, max(id) as last_id from posts_raw group by 1",
    "p4_profiles": f"select {_CHANNEL} as channel_username, count(*) as n_rows, count(distinct post_id) as n_messages, count(distinct source_file) as n_files, min(id) as first_id, max(id) as last_id, cast(sum(strlen(payload_json)) as bigint) as text_bytes from posts_raw group by 1",
    "p7_found": "select id from (select id, min(id) over (partition by channel_id, post_id) as winner from posts_raw where channel_id is not null and post_id is not null) where id > winner",
    "p7_kept": "select * from posts_raw where channel_id is null or post_id is null union all select * from posts_raw where channel_id is not null and post_id is not null qualify row_number() over (partition by channel_id, post_id order by id) = 1",
}


def session_sql() -> dict[str, str]:
    """SQL that is written with the help of the running session; without one there is none."""
    return corpora.sql(SparkSession.getActiveSession() or SparkSession._instantiatedSession)

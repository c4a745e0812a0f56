"""The text problems as queries over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, leaks, neardup, quality, sourcelines, spans, unify
from tidemark.tables import spread, table


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "candidates"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def p1_found(spark, sf_dir):
    return sourcelines.excess_occurrences(_candidates(spark, sf_dir)).select(F.col("id").alias("src_id"), "line_no")


def p1_lines(spark, sf_dir):
    _, excess = sourcelines.repeated_lines(_candidates(spark, sf_dir))
    return excess.select(F.col("source").alias("channel_username"), F.hex("line_key").alias("line_key"), "k_in", "n_in", "k_out", "n_out", F.round("g2", 4).alias("g2"))


def p1_texts(spark, sf_dir):
    return sourcelines.without_repeated_lines(_candidates(spark, sf_dir)).withColumnRenamed("id", "src_id")


def p3_found(spark, sf_dir):
    return unify.same_look_pairs(_candidates(spark, sf_dir)).toDF("src_id_a", "src_id_b")


def p3_forms(spark, sf_dir):
    return unify.unify(_candidates(spark, sf_dir)).withColumnRenamed("id", "src_id")


def p5_found(spark, sf_dir):
    return neardup.similar_pairs(_candidates(spark, sf_dir), words=3, similarity=0.6).toDF("src_id_a", "src_id_b")


def p5_groups(spark, sf_dir):
    return neardup.groups(_candidates(spark, sf_dir)).withColumnRenamed("id", "src_id")


def p6_found(spark, sf_dir):
    return spans.shared_spans(_candidates(spark, sf_dir)).withColumnRenamed("id", "src_id")


def p6_share(spark, sf_dir):
    shared = spans.shared_spans(_candidates(spark, sf_dir)).groupBy("id").agg(F.sum("n_chars").alias("shared_chars"), F.count("*").alias("n_spans")).withColumnRenamed("id", "src_id")
    rows = _candidates(spark, sf_dir).select("src_id", F.length("text").alias("n_chars"))
    joined = rows.join(shared, "src_id", "left").na.fill(0, ["shared_chars", "n_spans"])
    return joined.withColumn("share", F.round(F.try_divide(F.col("shared_chars").cast("double"), F.col("n_chars")), 6))


def p6_passages(spark, sf_dir):
    return spans.passages(_candidates(spark, sf_dir)).toDF("src_id", "start_pos", "n_chars", "other_id", "other_pos")


def p8_ids(spark, sf_dir):
    return bpe.encode(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def _leaks(spark, sf_dir):
    return leaks.leaks(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p9_found(spark, sf_dir):
    return _leaks(spark, sf_dir).filter("exact_words >= 15").select("doc_id", "item_id")


def p9_leaks(spark, sf_dir):
    return _leaks(spark, sf_dir).filter("aligned_words >= 15")


def p10_found(spark, sf_dir):
    # The cases are defined by all rules but the one about bullets.
    return quality.not_prose(_documents(spark, sf_dir), table(spark, sf_dir, "stop_words"), rules=quality.RULES[:-1])


def p10_stats(spark, sf_dir):
    stats = quality.text_statistics(_documents(spark, sf_dir), table(spark, sf_dir, "stop_words"))
    return stats.withColumn("reasons", F.array_join("reasons", ","))


QUERIES = {f.__name__: f for f in (p1_found, p1_lines, p1_texts, p3_found, p3_forms, p5_found, p5_groups, p6_found, p6_share, p6_passages, p8_ids, p9_found, p9_leaks, p10_found, p10_stats)}

_SPACE = r"[\t-\r\x{85}\p{Z}]"
_COUNTS = rf"""
with judged as (
  select doc_id, case when not regexp_full_match(text, '{_SPACE}*') then text end as t from documents),
counted as (
  select doc_id, t, length(t) as n_chars,
    regexp_extract_all(t, '[\p{{L}}\p{{N}}]+') as words,
    length(regexp_replace(t, '[^\p{{L}}\p{{N}}]+', '', 'g')) as n_alnum,
    length(regexp_replace(t, '{_SPACE}+', '', 'g')) as n_visible,
    list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> '') as ls
  from judged),
common as (
  select doc_id, count(*) as n from (select doc_id, lower(unnest(words)) as w from counted)
  where w in (select lower(word) from stop_words) group by doc_id),
numbers as (
  select c.doc_id, n_chars, case when t is not null then len(words) end as n_words, n_alnum, n_visible, len(ls) as n_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '[.!?…]$'))) as n_ended,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^{_SPACE}*([•▪‣·*►–—-]|[0-9]+[.)]){_SPACE}'))) as n_bullets,
    case when t is not null then coalesce(m.n, 0) end as n_common
  from counted c left join common m on m.doc_id = c.doc_id)
"""
_FAILS = "n_words < 8 or (n_words > 0 and (n_alnum < 3 * n_words or n_alnum > 10 * n_words)) or 10 * (n_visible - n_alnum) > 3 * n_visible or 2 * n_ended < n_lines or 10 * n_common < n_words"

_REASONS = {
    "few_words": "n_words < 8",
    "short_words": "n_words > 0 and n_alnum < 3 * n_words",
    "long_words": "n_words > 0 and n_alnum > 10 * n_words",
    "symbols": "10 * (n_visible - n_alnum) > 3 * n_visible",
    "line_ends": "2 * n_ended < n_lines",
    "few_common": "10 * n_common < n_words",
    "bullets": "10 * n_bullets > 9 * n_lines",
}
_LISTED = "coalesce(array_to_string([" + ", ".join(f"case when {test} then '{name}' end" for name, test in _REASONS.items()) + "], ','), '')"

# The look-alike letters of the test texts, each above the one it is compared as.
_ALIKE = (
    "aeopcyxABCEHKMOPTXYi" "οΟΤΚΗΑΒΕΜΡΧΥ" "ëË",
    "аеорсухАВСЕНКМОРТХУі" "оОТКНАВЕМРХУ" "ёЁ",
)
_WIDE = tuple("".join(chr(first + i) for i in range(94) if i != 6) for first in (0xFF01, 0x21))


def _look(t: str) -> str:
    """The consistent form, said in SQL: what draws nothing is dropped, then widths, spaces, accents, and letters one for one."""
    bare = rf"regexp_replace(regexp_replace({t}, '[\p{{Cf}}\x00-\x08\x0b-\x1f\x7f-\x9f]', '', 'g'), '\p{{Zs}}', ' ', 'g')"
    form = f"translate({bare}, '{_WIDE[0]}', '{_WIDE[1]}')"
    for _ in range(2):
        form = f"translate(nfc_normalize({form}), '{_ALIKE[0]}', '{_ALIKE[1]}')"
    return f"nfc_normalize({form})"


def _words(t: str) -> str:
    return rf"regexp_extract_all(replace(lower({_look(t)}), 'ё', 'е'), '[\p{{L}}\p{{N}}]+')"


def _runs(words: str, n: int) -> str:
    """Every ``n`` successive words of a list, as one text each."""
    return f"list_transform(generate_series(1, len({words}) - {n - 1}), lambda i: array_to_string(list_slice({words}, i, i + {n - 1}), ' '))"


_SPANS = """
with s as (select src_id, i, substring(text, i, 200) as s from (select src_id, text, unnest(generate_series(1, length(text) - 199)) as i from candidates where length(text) >= 200)),
m as (select src_id, i from s where s in (select s from s group by s having count(distinct src_id) > 1)),
g as (select src_id, i, sum(new) over (partition by src_id order by i) as g from (select src_id, i, (i - lag(i, 1, -1000) over (partition by src_id order by i) > 200)::int as new from m)),
spans as (select src_id, min(i)::int as start_pos, (max(i) - min(i) + 200)::int as n_chars from g group by src_id, g.g)
"""

SQL = {
    "p1_found": rf"""with l as (select src_id, regexp_replace(lower(channel_username), '^@+', '') as ch, unnest(string_split(text, chr(10))) as line, unnest(generate_series(1, len(string_split(text, chr(10)))))::int as line_no from candidates),
f as (select src_id, ch, line_no, trim(regexp_replace(lower({_look("line")}), '\s+', ' ', 'g')) as form from l), n as (select ch, form from f where ch is not null and form <> '' group by ch, form having count(distinct src_id) >= 10)
select src_id, line_no from f join n using (ch, form)""",
    "p3_found": f"with f as (select src_id, text, {_look('text')} as form from candidates) select a.src_id as src_id_a, b.src_id as src_id_b from f a join f b on a.form = b.form and a.src_id < b.src_id and a.text <> b.text",
    "p5_found": f"""with w as (select src_id, {_words("text")} as w from candidates), s as (select distinct src_id, unnest({_runs("w", 3)}) as s from w), n as (select src_id, count(*) as n from s group by src_id),
c as (select a.src_id as x, b.src_id as y, count(*) as n from s a join s b on a.s = b.s and a.src_id < b.src_id group by all)
select x as src_id_a, y as src_id_b from c join n a on a.src_id = x join n b on b.src_id = y where c.n >= 0.6 * (a.n + b.n - c.n)
union all select a.src_id, b.src_id from w a join w b on a.w = b.w and a.src_id < b.src_id where len(a.w) < 3""",
    "p9_found": f"""with d as (select doc_id, {_words("text")} as w from documents where text is not null), i as (select item_id, {_words("text")} as w from eval_items where text is not null),
p as (select distinct doc_id, unnest({_runs("w", 15)}) as p from d), q as (select distinct item_id, unnest({_runs("w", 15)}) as p from i) select distinct doc_id, item_id from p join q using (p)""",
    "p6_found": f"{_SPANS} select src_id, start_pos, n_chars from spans",
    "p6_share": f"{_SPANS} select c.src_id, length(text)::int as n_chars, coalesce(shared_chars, 0) as shared_chars, coalesce(n_spans, 0) as n_spans, round(coalesce(shared_chars, 0)::double / nullif(length(text), 0), 6) as share from candidates c left join (select src_id, sum(n_chars)::bigint as shared_chars, count(*) as n_spans from spans group by src_id) using (src_id)",
    "p10_found": f"{_COUNTS} select doc_id from numbers where {_FAILS}",
    "p10_stats": f"""{_COUNTS}
select doc_id, n_chars::int as n_chars, n_words::int as n_words, n_alnum::int as n_alnum, n_visible::int as n_visible, n_lines::int as n_lines, n_ended::int as n_ended, n_bullets::int as n_bullets, n_common::int as n_common,
  round(n_alnum / nullif(n_words, 0), 6) as mean_word, round((n_visible - n_alnum) / nullif(n_visible, 0), 6) as symbol_ratio, round(n_ended / nullif(n_lines, 0), 6) as ended_share,
  round(n_bullets / nullif(n_lines, 0), 6) as bullet_share, round(n_common / nullif(n_words, 0), 6) as common_share,
  case when n_chars is not null then {_LISTED} end as reasons, case when n_chars is not null then {_LISTED} = '' end as is_prose from numbers""",
}

"""Queries of the corpus, topic, impact and series operators over the test tables."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import windows as W
from tidemark.operators import audit, authors, corpus, impact, inference, scan, series, topics
from tidemark.sources import ingest
from tidemark.streaming import incremental
from tidemark.tables import spread, table

CUTOFF, START = date(2025, 8, 15), date(2025, 1, 1)
# Groups of flags that stand for the objects of the impact analysis.
OBJECTS = {
    "A": ["roskomnadzor", "rkn_abbr", "grchc", "radiochastotny_centr", "cmu_ssop", "tspu", "mincifry", "minsvyaz", "ministerstvo_cifrovogo"],
    "B": ["kreml", "adm_prezidenta", "ap_abbr", "sovbez", "sovet_bezopasnosti", "garant"],
    "GOV": ["kabmin"],
    "AGENCIES": ["fas_svyaz", "prokuratura_gen"],
}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "candidates"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "docs_topics").withColumn("day", F.to_date("date_day"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts, over all cores: what follows is heavy for each row."""
    docs = spread(table(spark, sf_dir, "docs_topics")).withColumn("day", F.to_date("date_day"))
    return docs.join(table(spark, sf_dir, "candidates").select("src_id", "text"), "src_id")


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


_NORM = "replace(lower(text), 'ё', 'е')"
_TOKENS = rf"regexp_extract_all({_NORM}, '[\p{{L}}\p{{N}}]+')"
_W, _S, _NS = r"[\p{L}\p{N}_]", r"[\t-\r\x{85}\p{Z}]", r"[^\t-\r\x{85}\p{Z}]"
_EDGE = rf"(?:^|[^\p{{L}}\p{{N}}_])"

# --- text -------------------------------------------------------------------------------------------------


@query(f"select src_id, len({_TOKENS}) as n_tokens, len(list_distinct({_TOKENS})) as n_distinct, {_TOKENS}[1] as first_token from candidates")
def txt_tokens(spark, sf_dir):
    t = X.tokens(F.col("text"))
    return _candidates(spark, sf_dir).select("src_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"), F.get(t, F.lit(0)).alias("first_token"))


_FOOTER_SQL = rf"подпис(аться|ывайся|ывайтесь|ка|чик)|t\.me/|max\.ru|кана[лм]{_W}*{_S}+в{_S}+max|мы{_S}+в{_S}+max|{_EDGE}буст|{_EDGE}boost|вступай|наш{_S}+канал|прислать{_S}+новост|обратная{_S}+связь|поддержать{_S}+(нас|канал)|резервн{_W}+{_S}+канал"
_FOOTER_LINES = rf"""
with l as (select src_id, unnest(string_split(text, chr(10))) as line, unnest(generate_series(1, len(string_split(text, chr(10))))) as i from candidates),
f as (select src_id, i, line, length(line) <= 200 and regexp_matches(replace(lower(line), 'ё', 'е'), '{_FOOTER_SQL}') as footer, len(regexp_extract_all(line, '{_NS}+')) as words from l),
n as (select *, lead(footer) over (partition by src_id order by i) as next from f where words > 0),
d as (select src_id, i, line from n where footer or (length(line) <= 60 and words <= 2 and coalesce(next, false)))
"""


@query(rf"{_FOOTER_LINES}, c as (select src_id, count(*) as n, sum(length(line) + 1) as gone from d group by src_id) select t.src_id, coalesce(n, 0) as footer_lines, cast(case when coalesce(n, 0) = len(string_split(text, chr(10))) then 0 else length(text) - coalesce(gone, 0) end as bigint) as n_kept from candidates t left join c on c.src_id = t.src_id")
def txt_footer(spark, sf_dir):
    rows = _candidates(spark, sf_dir).select("src_id", "text", X.footer_lines(F.col("text")).alias("lines"))
    return rows.select("src_id", F.size("lines").cast("bigint").alias("footer_lines"), F.length(X.without_lines(F.col("text"), F.col("lines"))).cast("bigint").alias("n_kept"))


_VIEWS = "json_extract_string(payload_json, '$.views')"


@query(rf"select id, cast(trunc(try_cast(regexp_replace({_VIEWS}, '{_S}+', '', 'g') as double)) as bigint) as views from posts_raw")
def txt_views(spark, sf_dir):
    return table(spark, sf_dir, "posts_raw").select("id", X.to_count(F.get_json_object("payload_json", "$.views")).alias("views"))


@query("select row_id, regexp_replace(topic_name, '^-*[0-9]+_', '') as label, left(cast(date_day as varchar), 7) as month from docs_topics")
def txt_topic_labels(spark, sf_dir):
    return table(spark, sf_dir, "docs_topics").select("row_id", X.topic_label(F.col("topic_name")).alias("label"), X.month(F.col("date_day").cast("string")).alias("month"))


_FLAT = rf"trim(regexp_replace(text, '{_S}+', ' ', 'g'))"


@query(rf"select src_id, case when length({_FLAT}) > 180 then left({_FLAT}, 177) || '...' else {_FLAT} end as snippet from candidates")
def txt_snippets(spark, sf_dir):
    return _candidates(spark, sf_dir).select("src_id", X.snippet(F.col("text")).alias("snippet"))


@query("select id, try_cast(left(post_date, 10) as date) as local_day from posts_raw")
def txt_local_days(spark, sf_dir):
    return table(spark, sf_dir, "posts_raw").select("id", X.local_day(F.col("post_date")).alias("local_day"))


@query("""with p as (select id, trim(coalesce(json_extract_string(payload_json, '$.channel_username'), ''), ' ') as u, trim(coalesce(json_extract_string(payload_json, '$.channel_title'), ''), ' ') as t, coalesce(json_extract_string(payload_json, '$.channel_id'), '') as c from posts_raw)
select id, case when u <> '' then case when starts_with(u, '@') then u else '@' || u end when t <> '' then t else 'id_' || c end as author from p""")
def txt_authors(spark, sf_dir):
    p = F.col("payload_json")
    name = X.author_name(F.get_json_object(p, "$.channel_username"), F.get_json_object(p, "$.channel_title"), F.get_json_object(p, "$.channel_id"))
    return table(spark, sf_dir, "posts_raw").select("id", name.alias("author"))


# --- filters and rules --------------------------------------------------------------------------------------


def _like(parts) -> str:
    return "(" + " or ".join(f"contains(t, '{p}')" for p in parts) + ")"


_SCREEN = rf"""({_like(corpus.PRESCREEN)} or regexp_matches(t, '{_EDGE}(ркн|ап|фас|vpn|впн|тг)([^\p{{L}}\p{{N}}_]|$)')
  or (contains(t, 'совет') and contains(t, 'безопасност')) or (contains(t, 'министерств') and contains(t, 'цифров'))
  or (contains(t, 'генеральн') and contains(t, 'прокуратур')) or ({_like(corpus.RESTRICT)} and {_like(corpus.PLATFORM)}))"""


@query(f"select src_id from (select src_id, {_NORM} as t from candidates) where {_SCREEN}")
def flt_prescreen(spark, sf_dir):
    return _candidates(spark, sf_dir).filter(corpus.prescreen(X.norm_text(F.col("text")))).select("src_id")


@query(rf"select src_id from (select src_id, {_NORM} as t from candidates) where contains(t, 'канал') and (regexp_matches(t, 'топ{_S}*[-–—]?{_S}*[0-9]{{2,3}}') or (length(t) - length(replace(t, '@', '')) >= 8 and regexp_matches(t, 'подборк|топ|рейтинг')))")
def flt_rating_lists(spark, sf_dir):
    return _candidates(spark, sf_dir).filter(corpus.rating_list(X.norm_text(F.col("text")))).select("src_id")


_AT = "generate_series(1, len(w))"


def _win(r: int) -> str:
    return f"list_slice(w, greatest(1, i - {r}), i + {r})"


@query(f"select src_id, len(list_filter({_AT}, lambda i: starts_with(w[i], 'роскомнадзор') and len(list_filter({_win(5)}, lambda x: starts_with(x, 'замедл') or starts_with(x, 'блокир'))) > 0)) as n from (select src_id, {_TOKENS} as w from candidates)")
def flt_prefix_window(spark, sf_dir):
    t = F.col("t")
    hits = F.filter(W.prefix_places(t, ["роскомнадзор"]), lambda i: W.near_prefix(t, i, 5, ["замедл", "блокир"]))
    return _candidates(spark, sf_dir).select("src_id", X.tokens(F.col("text")).alias("t")).select("src_id", F.size(hits).cast("bigint").alias("n"))


@query(f"select src_id, len(list_filter({_AT}, lambda i: w[i] = 'ркн' and len(list_filter({_win(6)}, lambda x: x in ('vpn', 'youtube', 'telegram'))) > 0)) as n from (select src_id, {_TOKENS} as w from candidates)")
def flt_exact_window(spark, sf_dir):
    t = F.col("t")
    hits = F.filter(W.exact_places(t, ["ркн"]), lambda i: W.near_exact(t, i, 6, ["vpn", "youtube", "telegram"]))
    return _candidates(spark, sf_dir).select("src_id", X.tokens(F.col("text")).alias("t")).select("src_id", F.size(hits).cast("bigint").alias("n"))


@query(f"select src_id, len(list_filter({_AT}, lambda i: starts_with(w[i], 'министерств') and len(list_filter(list_slice(w, i + 1, i + 2), lambda x: starts_with(x, 'цифров'))) > 0)) as n from (select src_id, {_TOKENS} as w from candidates)")
def flt_pair_window(spark, sf_dir):
    hits = W.pair_places(F.col("t"), ["министерств"], ["цифров"], 2)
    return _candidates(spark, sf_dir).select("src_id", X.tokens(F.col("text")).alias("t")).select("src_id", F.size(hits).cast("bigint").alias("n"))


@query(f"""with p as (select src_id, list_filter({_AT}, lambda i: w[i] in ('vpn', 'впн', 'тг') or starts_with(w[i], 'telegram') or starts_with(w[i], 'youtube')) as a,
  list_filter({_AT}, lambda i: starts_with(w[i], 'замедл') or starts_with(w[i], 'блокир')) as b from (select src_id, {_TOKENS} as w from candidates))
select src_id from p where len(list_filter(a, lambda i: len(list_filter(b, lambda j: abs(i - j) <= 12)) > 0)) > 0""")
def jn_proximity(spark, sf_dir):
    t = F.col("t")
    a = F.concat(W.exact_places(t, ["vpn", "впн", "тг"]), W.prefix_places(t, ["telegram", "youtube"]))
    return _candidates(spark, sf_dir).select("src_id", X.tokens(F.col("text")).alias("t")).filter(W.close(a, W.prefix_places(t, ["замедл", "блокир"]), 12)).select("src_id")


# Stems of platforms, as labels of what is near a mention.
PLATFORM_LABELS = {"telegram": "Telegram", "телеграм": "Telegram", "youtube": "YouTube", "ютуб": "YouTube", "whatsapp": "WhatsApp", "вотсап": "WhatsApp", "vpn": "VPN", "впн": "VPN"}
_LABEL = "case " + " ".join(f"when starts_with(x, '{k}') then '{v}'" for k, v in PLATFORM_LABELS.items()) + " end"


@query(f"""with p as (select src_id, unnest(list_filter({_AT}, lambda i: starts_with(w[i], 'роскомнадзор'))) as i, w from (select src_id, {_TOKENS} as w from candidates)),
x as (select src_id, unnest({_win(8)}) as x from p) select src_id, string_agg(distinct {_LABEL}, ',' order by {_LABEL}) as labels from x where {_LABEL} is not null group by src_id""")
def flt_labels_near(spark, sf_dir):
    t = F.col("t")
    found = W.labels_near(t, W.prefix_places(t, ["роскомнадзор"]), 8, PLATFORM_LABELS)
    rows = _candidates(spark, sf_dir).select("src_id", X.tokens(F.col("text")).alias("t")).select("src_id", F.array_join(found, ",").alias("labels"))
    return rows.filter("labels <> ''")


@query(f"select src_id from (select src_id, {_NORM} as t from candidates) where contains(t, 'связь') and length(replace(t, '#связь', '')) + 6 * ((length(t) - length(replace(t, 'связь', ''))) / 5) = length(t)")
def flt_hashtag_only(spark, sf_dir):
    return _candidates(spark, sf_dir).filter(W.let(X.norm_text(F.col("text")), lambda t: X.hashtag_only(t, "связь"))).select("src_id")


@query("""with c as (select ensemble_label as a, case when ensemble_negative_prob > 0.4 then 'negative' when ensemble_positive_prob > 0.4 then 'positive' else 'neutral' end as b from docs_topics),
c2 as (select * from c where a is not null), n as (select count(*) as n, count(*) filter (where a = b) as k from c2),
e as (select sum(pa * pb) as e from (select a as code, count(*) / (select n from n) as pa from c2 group by a) x join (select b as code, count(*) / (select n from n) as pb from c2 group by b) y using (code))
select n, round(k / n, 6) as raw_agreement, round((k / n - e) / (1 - e), 6) as kappa from n, e""")
def agg_agreement(spark, sf_dir):
    guess = F.when(F.col("ensemble_negative_prob").cast("double") > 0.4, "negative").when(F.col("ensemble_positive_prob").cast("double") > 0.4, "positive").otherwise("neutral")
    out = audit.agreement(_docs(spark, sf_dir).withColumn("guess", guess), "ensemble_label", "guess")
    return out.select("n", _r("raw_agreement"), _r("kappa"))


@query("select src_id, " + ", ".join(scan.FLAGS) + ", matched_actors, matched_leaders from candidates")
def scan_flags(spark, sf_dir):
    return scan.flag_texts(_candidates(spark, sf_dir)).select("src_id", *scan.FLAGS, "matched_actors", "matched_leaders")


@query(f"select term, left(post_date, 7) as month, count(*) as posts_n from (unpivot (select post_date, {', '.join(scan.FLAGS)} from candidates) on {', '.join(scan.FLAGS)} into name term value v) where v = 1 group by all")
def agg_term_month(spark, sf_dir):
    return scan.term_months(scan.flag_texts(_candidates(spark, sf_dir)))


@query(f"select term, count(*) as posts_n from (unpivot (select {', '.join(scan.FLAGS)} from candidates) on {', '.join(scan.FLAGS)} into name term value v) where v = 1 group by all")
def agg_term_totals(spark, sf_dir):
    return scan.term_totals(scan.flag_texts(_candidates(spark, sf_dir)))


def _re2(pattern: str) -> str:
    """A flag's pattern, alternative by alternative, without the shorthands that are ASCII there."""
    out = []
    for part in scan._alternatives(pattern):
        part = part.replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\s", r"[\t-\r\x{85}\p{Z}]")
        part = re.sub(r"^\\b", lambda m: _EDGE, part)
        out.append(re.sub(r"\\b$", lambda m: r"(?:$|[^\p{L}\p{N}_])", part))
    return "|".join(out)


def _flagged(names) -> str:
    return ", ".join(f"regexp_matches(t, '{_re2(p)}') as {n}" for n, p in names.items())


def _named(names) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {n} then '{n}' end" for n in names) + "], lambda x: x is not null), ',')"


@query(f"""with t as (select id, replace(lower(json_extract_string(payload_json, '$.text')), 'ё', 'е') as t from posts_raw), f as (select id, {_flagged({**scan.ACTORS, **scan.LEADERS, **scan.CONTEXT})} from t where t is not null)
select id, {_named(scan.ACTORS)} as matched_actors, {_named(scan.LEADERS)} as matched_leaders from f where {' or '.join([*scan.ACTORS, *scan.LEADERS])} or (({' or '.join(scan.PLATFORMS)}) and ({' or '.join(scan.RESTRICTIONS)}))""")
def scan_relevant(spark, sf_dir):
    posts = spread(table(spark, sf_dir, "posts_raw")).select("id", "post_date", F.get_json_object("payload_json", "$.text").alias("text"))
    return scan.flag_texts(scan.relevant_texts(posts)).select("id", "matched_actors", "matched_leaders")


# --- aggregates of dated, labelled texts ---------------------------------------------------------------------

_PERIOD = f"case when date_day between date '{START}' and date '{CUTOFF}' - 1 then 'before' when date_day >= date '{CUTOFF}' then 'after' end"


def _full(docs: DataFrame):
    """The period of the scenario that takes in all days from START on."""
    return F.when(F.col("day").between(F.lit(START), F.date_sub(F.lit(CUTOFF), 1)), "before").when(F.col("day") >= F.lit(CUTOFF), "after")


_SHARES = "round(before_n / greatest(1, sum(before_n) over ({w})), 6) as before_share, round(after_n / greatest(1, sum(after_n) over ({w})), 6) as after_share, round(after_n / greatest(1, sum(after_n) over ({w})) - before_n / greatest(1, sum(before_n) over ({w})), 6) as delta_share, round(abs(after_n / greatest(1, sum(after_n) over ({w})) - before_n / greatest(1, sum(before_n) over ({w}))), 6) as abs_delta_share"
_COUNTS = "count(*) filter (where p = 'before') as before_n, count(*) filter (where p = 'after') as after_n"


def _rounded_shares(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "before_n", "after_n", *(_r(c) for c in ("before_share", "after_share", "delta_share", "abs_delta_share")))


@query(f"select topic_id, before_n, after_n, {_SHARES.format(w='')} from (select topic_id, {_COUNTS} from (select topic_id, {_PERIOD} as p from docs_topics) where p is not null group by topic_id)")
def agg_topic_before_after(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return _rounded_shares(impact.before_after(docs, ["topic_id"], _full(docs)), "topic_id")


@query(f"select topic_id, before_n, after_n, {_SHARES.format(w='')} from (select topic_id, {_COUNTS} from (select topic_id, case when date_day < date '{CUTOFF}' then 'before' when date_day >= date '{CUTOFF}' then 'after' end as p from docs_topics where topic_id not in (-1, 0)) where p is not null group by topic_id)")
def agg_topic_delta_excl(spark, sf_dir):
    docs = _docs(spark, sf_dir).filter(~F.col("topic_id").isin(-1, 0))
    return _rounded_shares(impact.before_after(docs, ["topic_id"], F.when(F.col("day") < F.lit(CUTOFF), "before").when(F.col("day") >= F.lit(CUTOFF), "after")), "topic_id")


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per labelled text and object it mentions (``C``: a restricted platform, no actor or leader)."""
    flags = sorted({f for fs in OBJECTS.values() for f in fs} | {scan.CROSS})
    coded = _docs(spark, sf_dir).join(_candidates(spark, sf_dir).select("src_id", *flags), "src_id")
    any_of = {o: F.greatest(*map(F.col, fs)) == 1 if len(fs) > 1 else F.col(fs[0]) == 1 for o, fs in OBJECTS.items()}
    none = ~(any_of["A"] | any_of["B"] | any_of["GOV"] | any_of["AGENCIES"])
    names = F.array_compact(F.array(*(F.when(c, o) for o, c in any_of.items()), F.when(none & (F.col(scan.CROSS) == 1), "C")))
    return coded.select("row_id", "day", "channel_username", "topic_id", "topic_name", "ensemble_label", F.explode(names).alias("object"))


_ANY = {o: "(" + " or ".join(f"{f} = 1" for f in fs) + ")" for o, fs in OBJECTS.items()}
_OBJ = "with o as (" + " union all ".join(f"select d.*, '{o}' as object from docs_topics d join candidates c using (src_id) where {c}" for o, c in {**_ANY, "C": f"not ({' or '.join(_ANY.values())}) and {scan.CROSS} = 1"}.items()) + ")"


@query(f"""{_OBJ}, s as (select object, topic_id, {_COUNTS} from (select object, topic_id, {_PERIOD} as p from o) where p is not null group by all),
h as (select *, before_n / greatest(1, sum(before_n) over w) as bs, after_n / greatest(1, sum(after_n) over w) as afs from s window w as (partition by object))
select object, topic_id, before_n, after_n, round(bs, 6) as before_share, round(afs, 6) as after_share, round(afs - bs, 6) as delta_share, round(abs(afs - bs), 6) as abs_delta_share from h
qualify row_number() over (partition by object order by round(abs(afs - bs), 9) desc, topic_id) <= 5""")
def agg_object_topic_topn(spark, sf_dir):
    rows = _objects(spark, sf_dir)
    shares = impact.before_after(rows, ["topic_id"], _full(rows), ["object"])
    return _rounded_shares(impact.top_per_group(shares, ["object"], [F.desc(F.round("abs_delta_share", 9)), F.col("topic_id")], 5), "object", "topic_id")


@query(f"select ensemble_label, before_n, after_n, {_SHARES.format(w='')} from (select ensemble_label, {_COUNTS} from (select ensemble_label, {_PERIOD} as p from docs_topics) where p is not null group by all)")
def agg_sentiment_before_after(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return _rounded_shares(impact.before_after(docs, ["ensemble_label"], _full(docs)), "ensemble_label")


def _scenario_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label counts of every object in both scenarios; the windows end at the last day of the data."""
    last = _docs(spark, sf_dir).agg(F.max("day").alias("end")).select(F.lit("full").alias("scenario"), F.lit(START).alias("lo"), "end").unionByName(_docs(spark, sf_dir).agg(F.max("day").alias("end")).select(F.lit("symmetric").alias("scenario"), F.date_sub(F.lit(CUTOFF), F.datediff("end", F.lit(CUTOFF)) + 1).alias("lo"), "end"))
    rows = _objects(spark, sf_dir).join(F.broadcast(last), F.col("day").between(F.col("lo"), F.col("end")))
    return impact.label_counts(rows, ["scenario", "object"], F.when(F.col("day") < F.lit(CUTOFF), "before").otherwise("after"), "ensemble_label")


_LABELS_SQL = ", ".join(f"count(*) filter (where p = '{p}'{c}) as {n}" for p in ("before", "after") for c, n in [("", f"{p}_n"), *((f" and ensemble_label = '{x}'", f"{p}_{x}_n") for x in impact.LABELS)])
_SCEN = f"""{_OBJ}, e as (select max(date_day) as hi from docs_topics),
w as (select 'full' as scenario, timestamp '{START}' as lo, hi from e union all select 'symmetric', timestamp '{CUTOFF}' - (hi - timestamp '{CUTOFF}') - interval 1 day, hi from e),
n as (select scenario, object, {_LABELS_SQL} from (select w.scenario, o.*, case when date_day < date '{CUTOFF}' then 'before' else 'after' end as p from o join w on date_day between w.lo and w.hi) group by all)"""
# Every cell as (seen, expected); expected 0 only in a label that never occurs.
_CELLS = [(f"{p}_{x}_n", f"({p}_n * (before_{x}_n + after_{x}_n)::double / (before_n + after_n))") for x in impact.LABELS for p in ("before", "after")]
_PLAIN = " + ".join(f"coalesce(power({o} - {e}, 2) / nullif({e}, 0), 0)" for o, e in _CELLS)
_YATES = " + ".join(f"coalesce(power(greatest(abs({o} - {e}) - 0.5, 0), 2) / nullif({e}, 0), 0)" for o, e in _CELLS)
_USED = " + ".join(f"(before_{x}_n + after_{x}_n > 0)::int" for x in impact.LABELS)
_HORNER = "0.0"
for _c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
    _HORNER = f"({_HORNER} * t + {_c}::double)"


@query(f"""{_SCEN}, c as (select *, {_USED} as used, case when before_n > 0 and after_n > 0 then case {_USED} when 3 then {_PLAIN} when 2 then {_YATES} else 0 end end as x from n),
v as (select *, 1 / (1 + sqrt(x / 2) / 2) as t from c)
select scenario, object, before_n, after_n, {", ".join(f"round({p}_{x}_n / nullif({p}_n, 0), 6) as {p}_{x}" for p in ("before", "after") for x in impact.LABELS)},
round(after_negative_n / nullif(after_n, 0) - before_negative_n / nullif(before_n, 0), 6) as delta_negative, round(x, 6) as chi2,
round(case when x is null then null when used = 3 then exp(-x / 2) when used = 2 then t * exp({_HORNER} - x / 2) else 1 end, 6) as chi2_pvalue from v""")
def agg_object_scenario(spark, sf_dir):
    report = impact.with_chi_square(impact.with_shares(_scenario_counts(spark, sf_dir)))
    shares = [_r(f"{p}_{x}") for p in ("before", "after") for x in impact.LABELS]
    return report.select("scenario", "object", "before_n", "after_n", *shares, _r("delta_negative"), _r("chi2"), _r("chi2_pvalue"))


@query()
def agg_bootstrap(spark, sf_dir):
    return impact.with_intervals(_scenario_counts(spark, sf_dir), ["scenario", "object"]).select("scenario", "object", "delta_neg_ci_lo", "delta_neg_ci_hi")


@query()
def agg_contrasts(spark, sf_dir):
    return impact.contrasts(_scenario_counts(spark, sf_dir), "scenario", "object", [("A", "B"), ("A", "GOV"), ("A", "AGENCIES"), ("A", "C")])


@query(f"""with t as (select unnest(string_split(matched_actors, ',')) as term, ensemble_label, {_PERIOD} as p from docs_topics join candidates using (src_id) where matched_actors <> '')
select term, count(*) filter (where p = 'before') as before_n, count(*) filter (where p = 'after') as after_n,
round(count(*) filter (where p = 'before' and ensemble_label = 'negative') / nullif(count(*) filter (where p = 'before'), 0), 6) as before_negative,
round(count(*) filter (where p = 'after' and ensemble_label = 'negative') / nullif(count(*) filter (where p = 'after'), 0), 6) as after_negative
from t where p is not null group by term""")
def agg_entities(spark, sf_dir):
    rows = _docs(spark, sf_dir).join(_candidates(spark, sf_dir).select("src_id", "matched_actors"), "src_id")
    rows = rows.select("day", "ensemble_label", F.explode(X.separated(F.col("matched_actors"))).alias("term"))
    report = impact.with_shares(impact.label_counts(rows, ["term"], _full(rows), "ensemble_label"))
    return report.select("term", "before_n", "after_n", _r("before_negative"), _r("after_negative"))


@query(f"{_OBJ} select object, date_day::date as day, count(*) as n from o where date_day is not null group by all")
def agg_object_daily(spark, sf_dir):
    return _objects(spark, sf_dir).filter("day is not null").groupBy("object", "day").agg(F.count("*").alias("n"))


@query("select c.cutoff, cast(sum((date_day < c.cutoff)::int) as bigint) as before_n, cast(sum((date_day = c.cutoff)::int) as bigint) as on_n, cast(sum((date_day > c.cutoff)::int) as bigint) as after_n from docs_topics, (select unnest([date '2025-05-01', date '2025-08-15']) as cutoff) c where date_day is not null group by c.cutoff")
def agg_cutoff_segments(spark, sf_dir):
    return audit.cutoff_segments(_docs(spark, sf_dir), "day", ["2025-05-01", "2025-08-15"])


@query("with n as (select topic_id, ensemble_label, count(*) as n from docs_topics group by all) select *, round(n / sum(n) over (partition by ensemble_label), 6) as share from n")
def agg_crosstab(spark, sf_dir):
    return topics.normalised_crosstab(_docs(spark, sf_dir), "topic_id", "ensemble_label").withColumn("share", F.round("share", 6))


@query("select topic_id, count(*) as size, round(avg(ensemble_negative_prob::double), 6) as ensemble_negative_prob_mean, round(quantile_cont(ensemble_negative_prob::double, 0.5), 6) as ensemble_negative_prob_median, round(avg(ensemble_positive_prob::double), 6) as ensemble_positive_prob_mean, round(quantile_cont(ensemble_positive_prob::double, 0.5), 6) as ensemble_positive_prob_median from docs_topics group by topic_id")
def agg_topic_probs(spark, sf_dir):
    stats = topics.topic_label_stats(_docs(spark, sf_dir), ["topic_id"], ["ensemble_negative_prob", "ensemble_positive_prob"])
    return stats.select("topic_id", "size", *(_r(c) for c in stats.columns[2:]))


@query("select topic_id, count(*) as topic_count, arg_min(topic_name, row_id) filter (where topic_name is not null) as topic_name from docs_topics group by topic_id")
def agg_topic_table(spark, sf_dir):
    return topics.topic_table(_docs(spark, sf_dir), "topic_id", "topic_name", "row_id")


@query("""select channel_username, count(*) as posts_total, count(*) filter (where topic_id in (6, 9)) as posts_on_topic,
round(avg(ensemble_negative_prob::double), 6) as ensemble_negative_prob_mean_all, round(avg(ensemble_negative_prob::double) filter (where topic_id in (6, 9)), 6) as ensemble_negative_prob_mean_topic,
round(count(*) filter (where topic_id in (6, 9)) / greatest(count(*), 1), 6) as popularity from docs_topics group by channel_username""")
def agg_authors(spark, sf_dir):
    out = authors.author_totals(_docs(spark, sf_dir), "channel_username", F.col("topic_id").isin(6, 9), ["ensemble_negative_prob"])
    return out.select("channel_username", "posts_total", "posts_on_topic", _r("ensemble_negative_prob_mean_all"), _r("ensemble_negative_prob_mean_topic"), _r("popularity"))


@query("""with c as (select channel_username, trim(coalesce(topic_name, '')) as topic_name, count(*) as n from docs_topics group by all)
select channel_username, topic_name from c qualify row_number() over (partition by channel_username order by (topic_name <> '') desc, n desc, topic_name) = 1""")
def agg_channel_mode(spark, sf_dir):
    return authors.typical_value(_docs(spark, sf_dir), "channel_username", "topic_name")


_EX = "coalesce(strftime(date_day, '%Y-%m-%d'), '') || ' | ' || src_id"


@query(f"select channel_username, " + ", ".join(f"coalesce(max(case when k = {i} then t end), '') as example_{i}" for i in range(1, 6)) + f" from (select channel_username, {_EX} as t, row_number() over (partition by channel_username order by date_day desc nulls last, row_id desc, src_id desc) as k from docs_topics) where k <= 5 group by channel_username")
def agg_author_examples(spark, sf_dir):
    text = F.concat_ws(" | ", F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("")), F.col("src_id"))
    return authors.latest_examples(_docs(spark, sf_dir), "channel_username", [F.desc_nulls_last("day"), F.desc("row_id"), F.desc("src_id")], text)


@query("select coalesce(max(date_day)::date, null) as last_day, min(date_day)::date as first_day, count(*) as n from docs_topics")
def agg_day_range(spark, sf_dir):
    return _docs(spark, sf_dir).agg(F.max("day").alias("last_day"), F.min("day").alias("first_day"), F.count("*").alias("n"))


@query(rf"""with a as (select text, replace(lower(text), 'ё', 'е') as t, post_date, roskomnadzor from candidates),
m as (select 'rkn' as alias, * from a where regexp_matches(t, '{_EDGE}ркн([^\p{{L}}\p{{N}}_]|$)') union all select 'kreml', * from a where contains(t, 'кремл') union all select 'vpn', * from a where contains(t, 'vpn'))
select alias, case when left(post_date, 10) < '2025-01-01' then null when left(post_date, 10) < '2025-08-15' then 'before' when left(post_date, 10) >= '2025-08-15' then 'after' end as period, count(*) as total_mentions, count(*) filter (where roskomnadzor = 0) as uncovered from m group by all""")
def agg_alias_recall(spark, sf_dir):
    t = X.norm_text(F.col("text"))
    aliases = {"rkn": t.rlike(r"(?U)\bркн\b"), "kreml": t.contains("кремл"), "vpn": t.contains("vpn")}
    return audit.alias_recall(_candidates(spark, sf_dir), aliases, F.col("roskomnadzor") == 1, audit.period_of(F.col("post_date"), "2025-01-01", "2025-08-15"))


_STRATA = {"actor": scan.ACTORS, "leader": scan.LEADERS, "platform": [scan.CROSS]}


@query("with s as (" + " union all ".join(f"select '{k}' as stratum, src_id, post_date from candidates where greatest({', '.join(v)}) = 1" for k, v in _STRATA.items()) + """),
p as (select stratum, src_id, case when left(post_date, 10) < '2025-01-01' then null when left(post_date, 10) < '2025-08-15' then 'before' when left(post_date, 10) >= '2025-08-15' then 'after' end as period from s)
select * from p qualify row_number() over (partition by stratum, period order by md5('42-' || src_id), src_id) <= 60""")
def agg_strata_sample(spark, sf_dir):
    rows = _candidates(spark, sf_dir).select("src_id", "post_date", *scan.FLAGS)
    rows = audit.stratified(rows.withColumn("period", audit.period_of(F.col("post_date"), "2025-01-01", "2025-08-15")), {"actor": F.greatest(*(F.col(x) for x in scan.ACTORS)) == 1, "leader": F.greatest(*(F.col(x) for x in scan.LEADERS)) == 1, "platform": F.col(scan.CROSS) == 1})
    return audit.sample_per_stratum(rows, 60, "src_id", strata=("stratum", "period")).select("stratum", "period", "src_id")


# --- series -------------------------------------------------------------------------------------------------


@query("with d as (select date_day::date as d, topic_id from docs_topics where date_day is not null), o as (select min(d) as o from d) select cast(o + cast(floor((d - o) / 14) * 14 as integer) as date) as bin, topic_id, count(*) as n from d, o group by all")
def ts_bins(spark, sf_dir):
    return series.binned_counts(_docs(spark, sf_dir), "day", ["topic_id"], 14)


_DAILY = "d as (select date_day::date as day, count(*) as total, count(*) filter (where ensemble_label = 'negative') as negative, count(*) filter (where ensemble_label = 'neutral') as neutral, count(*) filter (where ensemble_label = 'positive') as positive from docs_topics where date_day is not null group by 1)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.daily_labels(_docs(spark, sf_dir), "day", "ensemble_label", impact.LABELS)


@query(f"with {_DAILY}, o as (select min(day) as lo, max(day) as hi from d), g as (select cast(unnest(generate_series(lo, hi, interval 5 days)) as date) as bin from o), b as (select cast(lo + cast(floor((day - lo) / 5) * 5 as integer) as date) as bin, sum(total) as t, sum(negative) as a, sum(neutral) as b, sum(positive) as c from d, o group by 1) select g.bin, round(coalesce(a / nullif(t, 0), 0), 6) as negative, round(coalesce(b / nullif(t, 0), 0), 6) as neutral, round(coalesce(c / nullif(t, 0), 0), 6) as positive from g left join b on b.bin = g.bin")
def ts_filled_bins(spark, sf_dir):
    return series.filled_bins(_daily(spark, sf_dir), "day", impact.LABELS, 5).select("bin", *(_r(x) for x in impact.LABELS))


@query(f"with {_DAILY} select day, round(negative / total, 6) as negative, round(neutral / total, 6) as neutral, round(positive / total, 6) as positive from d")
def ts_daily_shares(spark, sf_dir):
    return _daily(spark, sf_dir).select("day", *(F.round(F.col(x) / F.col("total"), 6).alias(x) for x in impact.LABELS))


_RANGE = "over (order by day range between interval {n} days preceding and current row)"


@query(f"with {_DAILY} select day, round(sum(negative) {_RANGE.format(n=6)} / sum(total) {_RANGE.format(n=6)}, 6) as share from d")
def ts_rolling_share(spark, sf_dir):
    return series.rolling_share(_daily(spark, sf_dir), "day", "negative", 7).select("day", _r("share"))


@query(f"with {_DAILY} select day, round(case when count(*) {_RANGE.format(n=13)} >= 3 then avg(negative / total) {_RANGE.format(n=13)} end, 6) as mean from d")
def ts_rolling_mean(spark, sf_dir):
    return series.rolling_mean(_daily(spark, sf_dir), "day", "negative", 14, 3).select("day", _r("mean"))


@query(f"with {_DAILY} select day, round(avg(negative / total) over (order by day rows between 6 preceding and current row), 6) as mean from d")
def ts_rolling_rows(spark, sf_dir):
    return series.rolling_rows(_daily(spark, sf_dir), "day", "negative", 7).select("day", _r("mean"))


@query("""with d as (select date_day::date as d, topic_id from docs_topics where date_day is not null), o as (select min(d) as o from d), b as (select cast(floor((d - o) / 30) as integer) as bin, topic_id, count(*) as n from d, o group by all), e as (select min(bin) as lo, max(bin) as hi from b),
c as (select topic_id, coalesce(sum(n) filter (where bin = lo), 0) as a, coalesce(sum(n) filter (where bin = hi), 0) as z, sum(n) as n from b, e group by topic_id)
select topic_id, round(a / sum(a) over (), 6) as first_share, round(z / sum(z) over (), 6) as last_share, round(z / sum(z) over () - a / sum(a) over (), 6) as change, cast(n as bigint) as n from c""")
def ts_first_last(spark, sf_dir):
    out = series.first_last_change(series.binned_counts(_docs(spark, sf_dir), "day", ["topic_id"], 30), "topic_id")
    return out.select("topic_id", _r("first_share"), _r("last_share"), _r("change"), "n")


@query(f"""with c as (select topic_id, {_COUNTS} from (select topic_id, {_PERIOD} as p from docs_topics where topic_id not in (-1, 0)) where p is not null group by topic_id),
s as (select topic_id, abs(after_n / greatest(1, sum(after_n) over ()) - before_n / greatest(1, sum(before_n) over ())) as a from c),
r as (select topic_id, row_number() over (order by round(a, 9) desc, topic_id) as k from s),
t as (select topic_id, 1 as pass, k from r where k <= 5 union all select topic_id, 2, row_number() over (order by topic_id) from r where k > 5)
select topic_id from t order by pass, k limit 8""")
def set_topic_padding(spark, sf_dir):
    docs = _docs(spark, sf_dir).filter(~F.col("topic_id").isin(-1, 0))
    deltas = impact.before_after(docs, ["topic_id"], _full(docs))
    top = deltas.orderBy(F.desc(F.round("abs_delta_share", 9)), "topic_id").limit(5).select("topic_id", F.lit(1).alias("pass"), (-F.round("abs_delta_share", 9)).alias("k"))
    rest = deltas.join(top, "topic_id", "left_anti").select("topic_id", F.lit(2).alias("pass"), F.col("topic_id").cast("double").alias("k"))
    return top.unionByName(rest).orderBy("pass", "k", "topic_id").limit(8).select("topic_id")


# --- models and vectors ---------------------------------------------------------------------------------------


@query("""with m as (select row_id, src_id, (ensemble_negative_prob::double + 0.5) / 2 as negative, (ensemble_neutral_prob::double + 0.3) / 2 as neutral, (ensemble_positive_prob::double + 0.2) / 2 as positive from docs_topics)
select row_id, round(negative, 6) as negative, round(neutral, 6) as neutral, round(positive, 6) as positive, case when negative >= neutral and negative >= positive then 'negative' when neutral >= positive then 'neutral' else 'positive' end as label, round(greatest(negative, neutral, positive), 6) as score from m""")
def ens_argmax(spark, sf_dir):
    own = [F.col(f"ensemble_{x}_prob") for x in impact.LABELS]
    prior = [F.lit(x) for x in (0.5, 0.3, 0.2)]
    rows = _docs(spark, sf_dir).select("row_id", topics.ensemble([own, prior]).alias("e"))
    return rows.select("row_id", *(F.round(f"e.{x}", 6).alias(x) for x in impact.LABELS), F.col("e.label").alias("label"), F.round("e.score", 6).alias("score"))


@query("with n as (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as l from embeddings) select vec_id, round(embedding[1]::double / l, 5) as first, round(embedding[len(embedding)]::double / l, 5) as last from n")
def emb_unit(spark, sf_dir):
    rows = topics.unit_vectors(table(spark, sf_dir, "embeddings"), "embedding")
    return rows.select("vec_id", F.round(F.get("embedding", F.lit(0)), 5).alias("first"), F.round(F.element_at("embedding", -1), 5).alias("last"))


@query()
def emb_density(spark, sf_dir):
    """Clusters of the embeddings by density, without a given number."""
    return topics.density_clusters(table(spark, sf_dir, "embeddings"), "embedding", "vec_id")


@query()
def emb_topics(spark, sf_dir):
    return topics.cluster_vectors(table(spark, sf_dir, "embeddings"), "embedding", "vec_id")


@query(f"""with t as (select topic_id, {_TOKENS} as w from docs_topics join candidates using (src_id)), x as (select topic_id, unnest(w) as word from t), n as (select topic_id, word, count(*) as n from x group by all),
f as (select word, sum(n) as f from n group by word), z as (select topic_id, sum(n) as s from n group by topic_id), m as (select avg(s) as m from z),
r as (select n.topic_id as topic, n.word, n.n / z.s as tf, n.n / z.s * ln(1 + m.m / f.f) as weight from n join f using (word) join z on z.topic_id = n.topic_id, m)
select topic, word, round(tf, 6) as tf, round(weight, 6) as weight, row_number() over (partition by topic order by round(weight, 9) desc, word) as rank from r qualify rank <= 10""")
def topic_words(spark, sf_dir):
    rows = _texts(spark, sf_dir)
    out = topics.class_tf_idf(rows, "topic_id", X.tokens(F.col("text")))
    return out.select("topic", "word", _r("tf"), _r("weight"), F.col("rank").cast("bigint").alias("rank"))


#: Up to so many stop words are literals of a filter; more are joined.
MAX_STOPS = 10_000


@query(f"""with t as (select row_number() over () as r, topic_id, list_filter({_TOKENS}, lambda x: not list_contains(stops, x)) as w from docs_topics join candidates using (src_id), (select list(distinct word) as stops from stop_words where word is not null)),
g as (select r, topic_id, list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) as w from t),
x as (select r, topic_id, unnest(w) as word from g), n as (select topic_id, word, count(*) as n, count(distinct r) as d from x group by all),
f as (select word, sum(n) as f from n group by word having sum(d) >= 10 and sum(d) <= 0.9 * (select count(*) from t)), k as (select n.topic_id, n.word, n.n, f.f from n join f using (word)),
z as (select topic_id, sum(n) as s from k group by topic_id), m as (select avg(s) as m from z),
s as (select k.topic_id as topic, k.word, k.n / z.s as tf, k.n / z.s * ln(1 + m.m / k.f) as weight from k join z on z.topic_id is not distinct from k.topic_id, m)
select topic, word, round(tf, 6) as tf, round(weight, 6) as weight, row_number() over (partition by topic order by round(weight, 9) desc, word) as rank from s qualify rank <= 10""")
def topic_bigrams(spark, sf_dir):
    """Words and pairs of words that mark a topic, without stop words, rare and ubiquitous ones."""
    stops = table(spark, sf_dir, "stop_words").filter("word is not null").select("word").distinct()
    few = [r["word"] for r in stops.limit(MAX_STOPS + 1).collect()]
    if len(few) <= MAX_STOPS:
        rows = _texts(spark, sf_dir)
        kept = F.filter(X.tokens(F.col("text")), lambda t: ~t.isin(few))
    else:
        texts = _candidates(spark, sf_dir).select("src_id", X.tokens(F.col("text")).alias("tokens"))
        words = texts.select("src_id", F.posexplode("tokens").alias("pos", "word")).join(stops, "word", "left_anti")
        texts = words.groupBy("src_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("tokens"))
        kept = F.coalesce(F.col("tokens.word"), F.array().cast("array<string>"))
        rows = _docs(spark, sf_dir).join(_candidates(spark, sf_dir).select("src_id"), "src_id").join(texts, "src_id", "left")
    out = topics.class_tf_idf(rows, "topic_id", X.ngrams(kept), min_docs=10, max_share=0.9)
    return out.select("topic", "word", _r("tf"), _r("weight"), F.col("rank").cast("bigint").alias("rank"))


# Stems of a demonstration scorer.
STEMS = {"negative": ["жалоб", "сбо", "терпени", "упал", "отключ", "заблок"], "positive": ["открыли", "вырос", "доволь", "спасиб"], "neutral": ["сообщ", "ответил"]}


def _stems(label: str) -> str:
    return " + ".join(f"(length(t) - length(replace(t, '{x}', ''))) // {len(x)}" for x in STEMS[label])


@query(f"""with c as (select src_id, {", ".join(f"{_stems(x)} as {x[:3]}" for x in impact.LABELS)} from (select src_id, lower(text) as t from candidates)),
e as (select src_id, {", ".join(f"exp({x[:3]} - greatest(neg, neu, pos)) as {x[:3]}" for x in impact.LABELS)} from c),
m as (select src_id, {", ".join(f"({x[:3]} / (neg + neu + pos) + 1.0::double / 3) / 2 as {x}" for x in impact.LABELS)} from e)
select src_id, round(negative, 6) as negative, round(neutral, 6) as neutral, round(positive, 6) as positive, case when negative >= neutral and negative >= positive then 'negative' when neutral >= positive then 'neutral' else 'positive' end as label, round(greatest(negative, neutral, positive), 6) as score from m""")
def ml_stem_scores(spark, sf_dir):
    scores = inference.score(_candidates(spark, sf_dir), "src_id", "text", {"stems": inference.stem_scorer(STEMS), "flat": inference.stem_scorer({})})
    return inference.ensemble_scores(scores).select(F.col("id").alias("src_id"), *(_r(x) for x in impact.LABELS), "label", _r("score"))


@query(f"""with x as (select topic_id as topic, date_trunc('month', date_day)::date as bin, unnest({_TOKENS}) as word from docs_topics join candidates using (src_id) where date_day is not null),
n as (select topic, bin, word, count(*) as n from x group by all), f as (select word, sum(n) as f from n group by word),
c as (select topic, bin, sum(n) as s from n group by all), l as (select n.topic, n.bin, n.word, n.n / c.s * ln(1 + (select avg(s) from c) / f.f) as w from n join f using (word) join c using (topic, bin)),
t as (select topic, word, sum(n) as n from n group by all), z as (select topic, sum(n) as s from t group by topic), o as (select t.topic, t.word, t.n / z.s * ln(1 + (select avg(s) from z) / f.f) as o from t join f using (word) join z using (topic)),
b as (select topic, bin, lead(bin) over (partition by topic order by bin) as next from (select distinct topic, bin from l)), p as (select l.topic, b.next as bin, l.word, l.w as b from l join b using (topic, bin) where next is not null),
m as (select topic, bin, word, (coalesce(w, 0) + coalesce(b, w, 0) + coalesce(o, 0)) / 3 as s from l full join p using (topic, bin, word) left join o using (topic, word))
select topic, bin, word, round(s, 6) as weight, row_number() over (partition by topic, bin order by round(s, 9) desc, word) as rank from m qualify rank <= 5""")
def topic_words_over_time(spark, sf_dir):
    rows = _texts(spark, sf_dir).filter("day is not null")
    out = topics.topic_words_over_time(rows.withColumn("bin", F.trunc("day", "month")), "topic_id", "bin", X.tokens(F.col("text")))
    return out.select("topic", "bin", "word", _r("weight"), F.col("rank").cast("bigint").alias("rank"))


# --- joins, loading, streams ------------------------------------------------------------------------------------


@query("""with l as (select distinct post_url as u from candidates where post_url is not null and vpn = 1),
r as (select src_id, matched_actors, case when l.u is not null then list_filter(string_split(matched_actors, ','), lambda x: x <> 'roskomnadzor') else string_split(matched_actors, ',') end as t from candidates c left join l on l.u = c.post_url)
select src_id, array_to_string(t, ',') as terms, len(list_intersect(t, ['roskomnadzor', 'rkn_abbr', 'tspu'])) > 0 as in_group from r""")
def join_url_repair(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    urls = rows.filter("vpn = 1 and post_url is not null").select("post_url")
    rows = rows.select("src_id", "post_url", F.col("matched_actors").alias("terms"))
    return impact.repaired_terms(rows, urls, "roskomnadzor", ["roskomnadzor", "rkn_abbr", "tspu"]).select("src_id", "terms", "in_group")


@query("select row_id, label, round(embedding[1]::double, 5) as first from docs_topics left join embeddings on vec_id = row_id")
def join_vectors(spark, sf_dir):
    rows = topics.attach_vectors(_docs(spark, sf_dir).select("row_id"), table(spark, sf_dir, "embeddings"), "row_id", "vec_id", "embedding", 64, strict=False)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label")
    return rows.join(labels, "row_id", "left").select("row_id", "label", F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("first"))


@query(f"""with t as (select channel_username, count(*) as posts_total, count(*) filter (where topic_id in (6, 9)) as posts_on_topic from docs_topics group by channel_username),
c as (select channel_username, trim(coalesce(topic_name, '')) as topic_name, count(*) as n from docs_topics group by all),
m as (select channel_username, topic_name from c qualify row_number() over (partition by channel_username order by (topic_name <> '') desc, n desc, topic_name) = 1),
e as (select channel_username, {_EX} as example_1 from docs_topics qualify row_number() over (partition by channel_username order by date_day desc nulls last, row_id desc, src_id desc) = 1)
select t.*, m.topic_name, e.example_1 from t left join m on m.channel_username is not distinct from t.channel_username left join e on e.channel_username is not distinct from t.channel_username""")
def join_author_report(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    totals = authors.author_totals(docs, "channel_username", F.col("topic_id").isin(6, 9), []).drop("popularity")
    text = F.concat_ws(" | ", F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("")), F.col("src_id"))
    examples = authors.latest_examples(docs, "channel_username", [F.desc_nulls_last("day"), F.desc("row_id"), F.desc("src_id")], text, 1)
    return authors.author_report(totals, authors.typical_value(docs, "channel_username", "topic_name"), examples, key="channel_username")


@query("""select 'posts only' as side, channel_username from (select channel_username from posts_raw except select channel_username from candidates)
union all select 'both', channel_username from (select channel_username from posts_raw intersect select channel_username from candidates)""")
def set_channels(spark, sf_dir):
    posts, found = (table(spark, sf_dir, t).select("channel_username") for t in ("posts_raw", "candidates"))
    only = posts.distinct().subtract(found.distinct()).select(F.lit("posts only").alias("side"), "channel_username")
    return only.unionByName(posts.intersect(found).select(F.lit("both").alias("side"), "channel_username"))


@query("select n_name, count(*) as orders_n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def join_dimensions(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation")}
    rows = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("orders_n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("with s as (select distinct channel_id, post_id from posts_raw where id % 2 = 0), i as (select *, row_number() over (partition by channel_id, post_id order by id) as k from posts_raw where id % 2 = 1) select id from i where k = 1 and not exists (select 1 from s where s.channel_id is not distinct from i.channel_id and s.post_id is not distinct from i.post_id)")
def src_insert_new(spark, sf_dir):
    # Even ids play the stored table, odd ids the batch: every row is in one of them.
    posts = table(spark, sf_dir, "posts_raw").select("id", "channel_id", "post_id")
    rows, _ = ingest.insert_new(posts.filter("id % 2 = 0"), posts.filter("id % 2 = 1"), ["channel_id", "post_id"], "id")
    return rows.select("id")


@query("select id, try_cast(json_extract_string(payload_json, '$.channel_id') as bigint) as channel_id, json_extract_string(payload_json, '$.channel_username') as channel_username, try_cast(json_extract_string(payload_json, '$.post_id') as bigint) as post_id, json_extract_string(payload_json, '$.date') as post_date from posts_raw")
def src_payload_fields(spark, sf_dir):
    p = F.col("payload_json")
    return table(spark, sf_dir, "posts_raw").select("id", ingest.field(p, "channel_id", "bigint").alias("channel_id"), ingest.field(p, "channel_username", "string").alias("channel_username"), ingest.field(p, "post_id", "bigint").alias("post_id"), ingest.field(p, "date", "string").alias("post_date"))


@query("""select id, json_extract_string(payload_json, '$."Channel Name"') as channel_name, json_extract_string(payload_json, '$.Handle') as handle, json_extract_string(payload_json, '$.normalized_handle') as normalized_handle,
try_cast(case when list_contains(json_keys(payload_json), 'resolved_id_y') then json_extract_string(payload_json, '$.resolved_id_y') else json_extract_string(payload_json, '$.resolved_id_x') end as bigint) as resolved_id from channels_enriched""")
def src_channel_fields(spark, sf_dir):
    return table(spark, sf_dir, "channels_enriched").select("id", *ingest.channel_columns(F.col("payload_json")))


@query("select cast(ts as date) as day, event_type, count(*) as n from events where ts is not null group by all")
def stream_daily_events(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events*.parquet")
    counts = incremental.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], lateness=None)
    daily = incremental.latest_values(counts, ["start", "event_type"], incremental.new_table(spark, "daily"))
    return daily.select(F.to_date("start").alias("day"), "event_type", "n")


@query("select distinct event_id from events")
def stream_first_deliveries(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events*.parquet")
    return incremental.delivered_once(events, ["event_id"], ["ts"], incremental.new_table(spark, "once")).select("event_id")

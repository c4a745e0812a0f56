"""Queries of the corpora, and their SQL, written from the same rules once a session can be asked for the names of countries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import audit, corpus, places, rules
from tidemark.plans import rulesql as R
from tidemark.plans.analysis import _FOOTER_LINES, _NORM, _SCREEN
from tidemark.tables import materialize, spread, table

START, CUTOFF = "2025-01-01", "2025-08-15"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "candidates"))


def _carved(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return corpus.carve(_candidates(spark, sf_dir), "src_id", "text", **options)


def flt_corpus(spark, sf_dir):
    return _carved(spark, sf_dir).select(F.col("id").alias("src_id"), "dropped", "footer_lines", "terms", "grps", "residual", "residual_guard")


def flt_exclusions(spark, sf_dir):
    # The carved corpus is one stage's result: written once, reported on as often as needed.
    return rules.exclusion_report(materialize(_carved(spark, sf_dir).select("id", "verdicts"), "carved"), "id")


def flt_views(spark, sf_dir):
    """Posts that would be in the corpus but have not been viewed."""
    return _carved(spark, sf_dir, views_col="views").filter("dropped = 'views'").select(F.col("id").alias("src_id"))


def agg_corpus_counters(spark, sf_dir):
    carved = _carved(spark, sf_dir)
    held = X.separated(F.col("grps"))
    return carved.agg(
        F.count("*").alias("screened"),
        F.count_if(F.col("dropped") == "footer_only").alias("footer_only"),
        F.count_if(F.col("dropped") == "rating_list").alias("rating_lists"),
        F.count_if((F.col("terms") != "") | F.col("residual")).alias("written"),
        F.count_if("residual").alias("residual"),
        F.sum("footer_lines").alias("footer_lines"),
        *(F.count_if(F.array_contains(held, g)).alias(f"obj_{g}") for g in GROUPS),
    )


GROUPS = ("A", "AGENCIES", "B", "GOV")


def _office(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All posts with a text; the head of state is in few candidates."""
    posts = spread(table(spark, sf_dir, "posts_raw")).select("id", F.get_json_object("payload_json", "$.text").alias("text"))
    return corpus.carve_office(posts, "id", "text", markers=places.ADJECTIVES)


def flt_office(spark, sf_dir):
    return _office(spark, sf_dir).select("id", "dropped", "terms", F.coalesce("mixed", F.lit(False)).alias("mixed"))


def flt_mixed(spark, sf_dir):
    """The corpus of the office without its mixed posts."""
    return rules.without_mixed(_office(spark, sf_dir).filter("terms <> ''")).select("id", "terms")


def flt_countries_near(spark, sf_dir):
    """Posts by the country that stands beside an office, one count for each country of a post."""
    posts = _tokens(spark, sf_dir)
    near = corpus.countries_near(F.col("tokens"), places.countries(spark), "министр", 2)
    return posts.select("id", F.explode(near).alias("country")).groupBy("country").agg(F.count("*").alias("posts_n"))


def _tokens(spark: SparkSession, sf_dir: str, screen: str | None = None) -> DataFrame:
    posts = spread(table(spark, sf_dir, "posts_raw")).select("id", "post_date", F.get_json_object("payload_json", "$.text").alias("text"))
    posts = posts.filter(X.norm_text(F.col("text")).rlike(screen)) if screen else posts
    return posts.select("id", "post_date", X.tokens(F.col("text")).alias("tokens"))


def _verdicts(spark: SparkSession, sf_dir: str, wanted, screen: str) -> DataFrame:
    rows = rules.apply_rules(_tokens(spark, sf_dir, screen), wanted)
    period = audit.period_of(F.col("post_date"), START, CUTOFF)
    return rows.select("id", period.alias("period"), F.explode("verdicts").alias("v")).filter("v.status = 'match' and period is not null").select("id", "period", F.col("v.term").alias("term"))


def agg_trigger_strata(spark, sf_dir):
    """Posts of every stratum of the audit, strata that overlap."""
    return _verdicts(spark, sf_dir, corpus.triggers(), corpus.OFFICE_PRESCREEN).groupBy("term", "period").agg(F.count("*").alias("posts_n"))


def agg_alias_checks(spark, sf_dir):
    """Mentions of other words for the office, and those in posts that the plain query doesn't cover."""
    found = _verdicts(spark, sf_dir, (*corpus.aliases(), *corpus.office_query()), corpus.ALIAS_PRESCREEN)
    covered = found.groupBy("id", "period").agg(F.collect_set(F.when(~F.col("term").isin("prezident", "verkhovn"), F.col("term"))).alias("terms"), F.bool_or(F.col("term").isin("prezident", "verkhovn")).alias("covered"))
    return covered.select("period", "covered", F.explode("terms").alias("alias")).groupBy("alias", "period").agg(F.count("*").alias("total_mentions"), F.count_if(~F.col("covered")).alias("uncovered"))


QUERIES = {f.__name__: f for f in (flt_corpus, flt_exclusions, flt_views, agg_corpus_counters, flt_office, flt_mixed, flt_countries_near, agg_trigger_strata, agg_alias_checks)}

_VIEWS = "try_cast(views as double)"
_EDGE = r"(?:^|[^\p{L}\p{N}_])"


def _texts(source: str, key: str, screen: str) -> str:
    """CTEs up to ``docs``: screened texts without their footers, and their tokens."""
    return rf"""{_FOOTER_LINES.replace("from candidates", f"from {source}").replace("src_id", key)},
gone as (select {key}, count(*) as n from d group by {key}),
kept as (select l.{key}, string_agg(l.line, chr(10) order by l.i) as clean from l left join d on d.{key} = l.{key} and d.i = l.i where d.i is null group by l.{key}),
flat as (select s.*, coalesce(n, 0) as footer_lines, coalesce(clean, '') as clean from {source} s left join gone using ({key}) left join kept using ({key}) where {screen.format(t=_NORM)}),
marked as (select *, replace(lower(clean), 'ё', 'е') as c from flat),
dropped as (select *, case when footer_lines > 0 and not ({screen.format(t="c")}) then 'footer_only'
  when contains(c, 'канал') and (regexp_matches(c, 'топ[\t-\r\x{{85}}\p{{Z}}]*[-–—]?[\t-\r\x{{85}}\p{{Z}}]*[0-9]{{2,3}}') or (length(c) - length(replace(c, '@', '')) >= 8 and regexp_matches(c, 'подборк|топ|рейтинг'))) then 'rating_list' end as dropped from marked),
docs as (select *, case when dropped is null then regexp_extract_all(c, '[\p{{L}}\p{{N}}]+') else [] end as w from dropped, gaz)"""


def sql(spark: SparkSession | None) -> dict[str, str]:
    """SQL of the queries above; empty without a session."""
    if spark is None:
        return {}
    names = places.countries(spark)
    gaz = f"gaz as {R.gazetteer(names)}"
    registry, left, other = corpus.registry(names), corpus.residual(names), corpus.office_query()
    screen = "(exists (select 1 from (select {t} as t) where " + _SCREEN.replace("{", "{{").replace("}", "}}") + "))"
    own = "v.grp not in ('C', 'P')"
    carved = f"""{_texts("candidates", "src_id", screen).replace("with l as", f"with {gaz}, l as", 1)},
v as {R.verdicts((*registry, left, *other), "docs", "src_id")},
t as (select src_id, string_agg(term, ',' order by term) filter (where status = 'match' and {own}) as terms, string_agg(distinct grp, ',' order by grp) filter (where status = 'match' and {own}) as grps,
  bool_or(status = 'match' and v.grp = 'P') as elsewhere, max(status) filter (where v.grp = 'C') as c_status, max(guard) filter (where v.grp = 'C') as c_guard from v group by src_id),
carved as (select docs.src_id, dropped, footer_lines::int as footer_lines, coalesce(terms, '') as terms, coalesce(grps, '') as grps, views,
  coalesce(terms is null and dropped is null and not elsewhere and c_status = 'match', false) as residual, case when terms is null and dropped is null and not elsewhere then c_guard end as residual_guard from docs left join t using (src_id))"""
    posts = "posts as (select id, post_date, json_extract_string(payload_json, '$.text') as text from posts_raw)"
    office_screen = rf"regexp_matches({{t}}, 'президент|верховн|владимирович|{_EDGE}ввп([^\p{{{{L}}}}\p{{{{N}}}}_]|$)|перво[ег][\p{{{{L}}}}\p{{{{N}}}}_]*[\t-\r\x{{{{85}}}}\p{{{{Z}}}}]+лиц|нацлидер|национальн[\p{{{{L}}}}\p{{{{N}}}}_]*[\t-\r\x{{{{85}}}}\p{{{{Z}}}}]+лидер|главковерх')".replace(_EDGE, _EDGE.replace("{", "{{").replace("}", "}}"))
    adjectives = R.token("x", places.ADJECTIVES)
    office = f"""{_texts("posts", "id", office_screen).replace("with l as", f"with {gaz}, {posts}, l as", 1)},
v as {R.verdicts(corpus.office(names), "docs", "id")},
t as (select id, string_agg(term, ',' order by term) filter (where status = 'match') as terms, bool_or(guarded or status = 'excluded') as guarded from v group by id),
office as (select docs.id, dropped, coalesce(terms, '') as terms, terms is not null and (guarded or len(list_filter(w, lambda x: {adjectives})) > 0) as mixed from docs left join t using (id))"""
    tokens = f"{posts}, docs as (select *, regexp_extract_all({_NORM}, '[\\p{{L}}\\p{{N}}]+') as w, case when left(post_date, 10) < '{START}' then null when left(post_date, 10) < '{CUTOFF}' then 'before' when left(post_date, 10) >= '{CUTOFF}' then 'after' end as period from posts, gaz)"
    counters = ", ".join(f"count(*) filter (where list_contains(string_split(grps, ','), '{g}')) as obj_{g}" for g in GROUPS)
    strata = f"with {gaz}, {tokens}, v as {R.verdicts(corpus.triggers(), 'docs', 'id')} select term, period, count(*) as posts_n from v join docs using (id) where status = 'match' and period is not null group by all"
    checks = f"""with {gaz}, {tokens}, v as (select * from {R.verdicts((*corpus.aliases(), *corpus.office_query()), 'docs', 'id')} where status = 'match')
select v.term as alias, period, count(*) as total_mentions, count(*) filter (where not exists (select 1 from v o where o.id = v.id and o.grp = 'P')) as uncovered from v join docs using (id) where grp = 'X' and period is not null group by all"""
    countries = f"""with {gaz}, {tokens}, n as (select id, unnest(list_distinct(flatten(list_transform(list_filter(generate_series(1, len(w)), lambda i: starts_with(w[i], 'министр')), lambda i: list_transform(list_filter(list_slice(w, greatest(1, i - 2), i + 2), lambda x: not starts_with(x, 'министр')), lambda x: map_extract(gaz, x)[1]))))) as country from docs)
select country, count(*) as posts_n from n where country is not null group by country"""
    return {
        "flt_corpus": f"{carved} select src_id, dropped, footer_lines, terms, grps, residual, residual_guard from carved",
        "flt_exclusions": f"{carved}, x as (select src_id as id, term, guard, row_number() over (partition by term, guard order by src_id) as k from v where status = 'excluded' and {own}) select term, guard, count(*) as n, string_agg(id, ',' order by id) filter (where k <= 8) as first_ids from x group by all",
        "flt_views": f"{carved} select src_id from carved where dropped is null and (terms <> '' or residual) and coalesce(views < 1, true)",
        "agg_corpus_counters": f"{carved} select count(*) as screened, count(*) filter (where dropped = 'footer_only') as footer_only, count(*) filter (where dropped = 'rating_list') as rating_lists, count(*) filter (where terms <> '' or residual) as written, count(*) filter (where residual) as residual, sum(footer_lines)::bigint as footer_lines, {counters} from carved",
        "flt_office": f"{office} select id, dropped, terms, mixed from office",
        "flt_mixed": f"{office} select id, terms from office where terms <> '' and not mixed",
        "flt_countries_near": countries,
        "agg_trigger_strata": strata,
        "agg_alias_checks": checks,
    }

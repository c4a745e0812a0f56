"""Queries of the small reports, and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import impact, reports, series
from tidemark.plans.analysis import CUTOFF, START, _docs
from tidemark.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


@query("select topic_name, count(*) as n from docs_topics group by topic_name order by n desc, topic_name limit 10")
def srt_most_common(spark, sf_dir):
    counts = _docs(spark, sf_dir).groupBy("topic_name").agg(F.count("*").alias("n"))
    return reports.most_common(counts, "n", ["topic_name"], 10)


@query("with b as (select topic_id, date_day, count(*) as n from docs_topics where date_day is not null group by all) select topic_id, sum(n)::bigint as total from b group by topic_id order by total desc, topic_id limit 5")
def srt_top_by_total(spark, sf_dir):
    return reports.top_by_total(series.binned_counts(_docs(spark, sf_dir), "day", ["topic_id"], 1), "topic_id", "n", 5)


@query("select topic_id, count(*) filter (where ensemble_label = 'negative') as negative, count(*) filter (where ensemble_label = 'neutral') as neutral, count(*) filter (where ensemble_label = 'positive') as positive from docs_topics group by topic_id")
def agg_pivot(spark, sf_dir):
    return reports.pivoted(_docs(spark, sf_dir), "topic_id", "ensemble_label", impact.LABELS, F.count(F.lit(1)))


@query("with n as (select relevance, count(*) as n from eval_items where relevance is not null group by all), o as (select unnest(generate_series(0, 2))::int as position, unnest(['no_stance', 'mixed', 'colored']) as relevance) select position, o.relevance, coalesce(n, 0) as n, round(coalesce(n, 0) / (select sum(n) from n), 6) as share from o left join n using (relevance)")
def agg_fixed_categories(spark, sf_dir):
    rows = reports.shares_in_order(table(spark, sf_dir, "eval_items"), "relevance", ["no_stance", "mixed", "colored"])
    return rows.withColumn("share", F.round("share", 6))


_END = "date '2025-12-31'"


@query(f"""with s as (select 'full' as scenario, date '{START}' as before_start, date '{CUTOFF}' - 1 as before_end, date '{CUTOFF}' as after_start, {_END} as after_end union all select 'symmetric', date '{CUTOFF}' - ({_END} - date '{CUTOFF}')::int - 1, date '{CUTOFF}' - 1, date '{CUTOFF}', {_END})
select scenario, before_start, before_end, after_start, after_end, ((after_end - after_start) + 1)::int as n_days_after, (select count(*) from docs_topics) as docs_in_scenario, (select count(*) from docs_topics where date_day between before_start and before_end) as docs_before, (select count(*) from docs_topics where date_day between after_start and after_end) as docs_after from s""")
def agg_scenario_summary(spark, sf_dir):
    return reports.scenario_summary(_docs(spark, sf_dir), "day", impact.scenarios(START, date(2025, 12, 31), CUTOFF))


@query("""with n as (select ensemble_label, count(*) as n from docs_topics group by all)
select case ensemble_label when 'negative' then 'негатив' when 'positive' then 'позитив' else ensemble_label end as label, format('{:.1f}', 100.0 * n / sum(n) over ()) || '% (n=' || n || ')' as share, replace(format('{:,}', n), ',', ' ') as n from n where n > 1""")
def txt_chart_labels(spark, sf_dir):
    from pyspark.sql import Window

    counts = _docs(spark, sf_dir).groupBy("ensemble_label").agg(F.count("*").alias("n"))
    share = F.col("n").cast("double") / F.sum("n").over(Window.partitionBy())
    rows = reports.supported(counts.withColumn("_share", share), "n", 2)
    return rows.select(reports.labelled(F.col("ensemble_label"), {"negative": "негатив", "positive": "позитив"}).alias("label"), reports.percent(F.col("_share"), F.col("n")).alias("share"), reports.grouped(F.col("n")).alias("n"))


@query("select row_id from docs_topics where regexp_matches(lower(topic_name), 'vpn|fines|mobile')")
def flt_topic_keywords(spark, sf_dir):
    return _docs(spark, sf_dir).filter(reports.topic_mask(F.col("topic_name"), ["VPN ", "fines", "mobile", " "])).select("row_id")


@query("select doc_id, i.relevance, i.stance_rkn from documents left join eval_items i on i.item_id = doc_id")
def join_codes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    codes = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("doc_id"), "relevance", "stance_rkn")
    return reports.attach_codes(docs, codes, "doc_id")

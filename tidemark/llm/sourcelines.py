"""Problem 1: lines repeated across one site's documents.

Method: the share of a source's records that hold a line is compared with the
share outside that source by a log-likelihood ratio; Benjamini-Hochberg keeps
the false-discovery rate; the significant excess lines are anti-joined from the
documents, which are put together again by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.lookalike import Alike, load
from tidemark.operators.treeagg import channel_name
from tidemark.tables import materialize, small

_SPACES = re.compile(r"\s+")
#: -ln p is cut into steps of 1/8, the last one open: the false-discovery cut is exact on p rounded up to a step.
STEPS, LAST_STEP = 8, 8192
#: Keys of a source in the join with its size.
SALTS = 16


def line_form(line: str, alike: Alike) -> str:
    """The form lines are compared in: look-alike form, lower case, white space runs as one space, none at the ends."""
    return _SPACES.sub(" ", alike.look(line).lower()).strip()


def lines(df: DataFrame, id_col: str = "src_id", source_col: str = "channel_username", text_col: str = "text") -> DataFrame:
    """Every line that isn't empty: ``id, source, line_no, line_key, first``.

    ``line_key`` is a 128-bit digest of :func:`line_form`; ``first`` marks its
    first occurrence in the record, so that records can be counted without a
    distinct.  Lines are numbered from 1 and blank ones are left out (they keep
    their number).  A null text has no lines; a null source stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, sources, texts = batch.columns
            row, number, key, first = [], [], [], []
            for i, text in enumerate(texts.to_pylist()):
                seen: set[bytes] = set()
                for n, raw in enumerate(text.split("\n"), 1):
                    form = line_form(raw, alike)
                    if form:
                        k = digest(form)
                        row.append(i)
                        number.append(n)
                        key.append(k)
                        first.append(k not in seen)
                        seen.add(k)
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(take), sources.take(take), pa.array(number, pa.int32()), pa.array(key, pa.binary()), pa.array(first, pa.bool_())], ["id", "source", "line_no", "line_key", "first"])

    alike, kind = load(), dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), channel_name(F.col(source_col).cast("string")).alias("source"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    return rows.mapInArrow(run, f"id {kind}, source string, line_no int, line_key binary, first boolean")


def log_likelihood_ratio(k_in: Column, n_in: Column, k_out: Column, n_out: Column) -> Column:
    """Signed G2 of two shares: positive if the first is the larger, 0 where either side is empty."""

    def term(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(F.lit(0.0))

    share = (k_in + k_out) / (n_in + n_out)
    g2 = 2 * (term(k_in, n_in * share) + term(n_in - k_in, n_in * (1 - share)) + term(k_out, n_out * share) + term(n_out - k_out, n_out * (1 - share)))
    sign = F.when(k_in * n_out > k_out * n_in, 1.0).otherwise(-1.0)
    return F.when((n_in > 0) & (n_out > 0), sign * F.greatest(g2, F.lit(0.0))).otherwise(F.lit(0.0))


def minus_log_p(g2: Column) -> Column:
    """-ln of the chi-square tail (one degree of freedom) of a signed G2; 0 for no excess.

    erfc in the Chebyshev form of Numerical Recipes (relative error < 1.2e-7), in
    logarithms so that it never underflows.
    """
    z = F.sqrt(F.greatest(g2, F.lit(0.0)) / 2)
    t = 1 / (1 + z / 2)
    # Coefficients of the approximation, from the constant term up.
    poly = F.lit(0.0)
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + F.lit(c)
    return F.when(g2 > 0, F.greatest(z * z - poly - F.log(t), F.lit(0.0))).otherwise(F.lit(0.0))


def line_statistics(occurrences: DataFrame, records: DataFrame, fdr: float = 0.01) -> DataFrame:
    """Every (source, line) with its counts and test: ``source, line_key, k_in, n_in, k_out, n_out, g2, significant``.

    ``records`` has one row ``source`` per record.  Counts are of records, over
    all of them; records without a source count as outside.  All aggregations
    combine map-side, so a source or a line that holds a third of all rows
    sends one partial row per task.  The sizes of sources, where they are too many to
    be broadcast, are joined under ``SALTS`` keys each, so that the lines of a large
    source are spread.
    """
    counts = occurrences.filter("first").groupBy("source", "line_key").agg(F.count("*").alias("k_in"))
    everywhere = counts.groupBy("line_key").agg(F.sum("k_in").alias("k_all"))
    sizes = records.groupBy("source").agg(F.count("*").alias("n_in"))
    total = records.agg(F.count("*").alias("n_all"))
    salt = F.pmod(F.xxhash64("line_key"), F.lit(SALTS))
    salted = sizes.filter("source is not null").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tested = counts.filter("source is not null").withColumn("salt", salt).join(everywhere, "line_key").join(small(salted, SALTS * 10_000), ["source", "salt"]).crossJoin(F.broadcast(total))
    d = {c: F.col(c).cast("double") for c in ("k_in", "n_in", "k_all", "n_all")}
    tested = tested.select("source", "line_key", "k_in", "n_in", (F.col("k_all") - F.col("k_in")).alias("k_out"), (F.col("n_all") - F.col("n_in")).alias("n_out"), log_likelihood_ratio(d["k_in"], d["n_in"], d["k_all"] - d["k_in"], d["n_all"] - d["n_in"]).alias("g2"))
    tested = tested.withColumn("step", F.least(F.floor(minus_log_p(F.col("g2")) * STEPS), F.lit(LAST_STEP)).cast("int"))
    # At most LAST_STEP + 1 rows from here to the cut, however large the input.
    steps = tested.groupBy("step").agg(F.count("*").alias("n"))
    steps = steps.select("step", F.sum("n").over(Window.orderBy(F.desc("step"))).alias("rank"), F.sum("n").over(Window.partitionBy()).alias("m"))
    cut = steps.filter(-F.col("step") / STEPS <= F.log(F.lit(fdr) * F.col("rank") / F.col("m"))).agg(F.min("step").alias("cut"))
    return tested.crossJoin(F.broadcast(cut)).withColumn("significant", F.coalesce(F.col("step") >= F.col("cut"), F.lit(False)) & (F.col("g2") > 0)).drop("step", "cut")


def repeated_lines(df: DataFrame, id_col: str = "src_id", source_col: str = "channel_username", text_col: str = "text", min_records: int = 10, fdr: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """``(occurrences, excess)``: all lines of all records, and the excess lines per source.

    A line is excess if it stands in at least ``min_records`` records of its
    source and significantly more often there than outside.
    """
    occurrences = materialize(lines(df, id_col, source_col, text_col), "lines")
    records = df.select(channel_name(F.col(source_col).cast("string")).alias("source"))
    stats = line_statistics(occurrences, records, fdr)
    return occurrences, stats.filter(F.col("significant") & (F.col("k_in") >= min_records))


def excess_occurrences(df: DataFrame, **options) -> DataFrame:
    """Each occurrence ``id, line_no`` of an excess line; repeated rows of ``df`` come as often as they are."""
    occurrences, excess = repeated_lines(df, **options)
    return occurrences.join(excess.select("source", "line_key"), ["source", "line_key"], "left_semi").select("id", "line_no")


def without_repeated_lines(df: DataFrame, id_col: str = "src_id", text_col: str = "text", **options) -> DataFrame:
    """One row ``id, text, n_removed`` per row of ``df``: its text without the excess lines.

    Kept lines keep their wording and order; null and empty texts come back as
    they are.  The join moves line numbers only; each text is moved once.  A
    repeated id is treated as one record whose copies get the same removal.
    """
    found = excess_occurrences(df, id_col=id_col, text_col=text_col, **options)
    removed = found.groupBy("id").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(removed, "id", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("removed", i + 1)), "\n")
    return rows.select("id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"))

"""Problem 10: per-document text quality statistics.

Method: length, symbol, punctuation, bullet and common-word statistics as JVM
expressions over the whole text, then fixed-threshold rules in the manner of the
published web-corpus filters, with the reason of every failure recorded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import let

#: More stop words than this are joined instead of being put into the plan; the results are the same.
MAX_LITERALS = 10_000

# The thresholds of the rules.
MIN_WORDS, MIN_MEAN, MAX_MEAN = 8, 3, 10
MAX_SYMBOLS, MIN_ENDED, MIN_COMMON, MAX_BULLETS = 0.3, 0.5, 0.1, 0.9
#: All rules, in the order in which failures are listed.
RULES = ("few_words", "short_words", "long_words", "symbols", "line_ends", "few_common", "bullets")
_WORD = r"[\p{L}\p{N}]+"
_SPACE = r"\p{IsWhite_Space}"


def _statistics(docs: DataFrame, stop_words: DataFrame, id_col: str, text_col: str, word_col: str, rules: Iterable[str]) -> DataFrame:
    """``doc_id`` and the struct ``s`` of all statistics, one expression that the optimiser can't take apart and repeat."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stops = stop_words.select(F.lower(F.col(word_col)).alias("word")).filter("word is not null").distinct()
    known = [r["word"] for r in stops.limit(MAX_LITERALS + 1).collect()]
    blank = F.col("text").rlike(f"^{_SPACE}*$")

    def judge(counts: Column) -> Column:
        return let(counts, lambda s: _judged(s, rules))

    if len(known) <= MAX_LITERALS:
        found = lambda words: F.size(F.filter(words, lambda w: F.lower(w).isin(known))) if known else F.lit(0)
        return rows.select("doc_id", F.when(~blank, judge(_counts(F.col("text"), found))).alias("s"))
    # One row number for each row, made once and carried along: the rows meet only their own words, and no text is moved.
    counted = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(~blank, _counts(F.col("text"), lambda words: F.lit(0))).alias("c"), F.transform(_words(F.col("text")), F.lower).alias("words"))
    words = counted.select("row", "doc_id", "c", F.explode_outer("words").alias("word")).join(stops.withColumn("stop", F.lit(1)), "word", "left")
    whole = words.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("c").alias("c"), F.count("stop").cast("int").alias("n"))
    return whole.select("doc_id", F.when(F.col("c").isNotNull(), judge(F.col("c").withField("n_common", F.col("n")))).alias("s"))


def text_statistics(docs: DataFrame, stop_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", word_col: str = "word", rules: Iterable[str] = RULES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and its counts, ratios and failed rules.

    Words are runs of letters and digits of the raw text; white space is Unicode
    white space; lines are parted by ``\\n``, stripped, blank ones ignored.  A null
    or blank text has null counts, null ``reasons`` and ``is_prose`` null: it isn't
    judged.  Ratios with an empty denominator are null.  Stop words are compared in
    lower case; null and repeated ones don't matter, and with none of them every
    text lacks common words.  ``rules`` are those that are applied.  No shuffle, unless
    there are more than ``MAX_LITERALS`` stop words: then the counts of each text, not
    the text, are shuffled once.  The results are the same.
    """
    return _statistics(docs, stop_words, id_col, text_col, word_col, rules).select("doc_id", "s.*")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def _counts(text: Column, common: Callable[[Column], Column]) -> Column:
    """Struct of the counts of one text; every pattern runs over it once."""
    ended = rf"[.!?…](?=[{_SPACE}&&[^\n]]*(?:\n|\z))"
    bullet = rf"(?:^|\n)[{_SPACE}]*(?:[•▪‣·*►–—-]|\d+[.)])[{_SPACE}]"

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).alias("n_words"), F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w)).alias("n_alnum"), common(words).alias("n_common"))

    def of_all(w: Column) -> Column:
        return F.struct(
            F.length(text).alias("n_chars"),
            w["n_words"].alias("n_words"),
            w["n_alnum"].alias("n_alnum"),
            F.length(F.regexp_replace(text, f"{_SPACE}+", "")).alias("n_visible"),
            F.regexp_count(text, F.lit(r"[^\n]*\P{IsWhite_Space}[^\n]*")).alias("n_lines"),
            F.regexp_count(text, F.lit(ended)).alias("n_ended"),
            F.regexp_count(text, F.lit(bullet)).alias("n_bullets"),
            w["n_common"].alias("n_common"),
        )

    return let(let(_words(text), of_words), of_all)


def _judged(s: Column, wanted: Iterable[str]) -> Column:
    """The counts with their ratios, the failed rules and the verdict."""

    def ratio(a: Column, b: str) -> Column:
        return F.round(F.try_divide(a.cast("double"), s[b]), 6)

    # Compared as whole numbers, so a ratio exactly at a threshold is no failure.
    rules = {
        "few_words": s["n_words"] < MIN_WORDS,
        "short_words": (s["n_words"] > 0) & (s["n_alnum"] < MIN_MEAN * s["n_words"]),
        "long_words": (s["n_words"] > 0) & (s["n_alnum"] > MAX_MEAN * s["n_words"]),
        "symbols": 10 * (s["n_visible"] - s["n_alnum"]) > round(10 * MAX_SYMBOLS) * s["n_visible"],
        "line_ends": 10 * s["n_ended"] < round(10 * MIN_ENDED) * s["n_lines"],
        "few_common": 10 * s["n_common"] < round(10 * MIN_COMMON) * s["n_words"],
        "bullets": 10 * s["n_bullets"] > round(10 * MAX_BULLETS) * s["n_lines"],
    }
    failed = F.array_compact(F.array(*(F.when(rules[name], name) for name in wanted)))
    ratios = {
        "mean_word": ratio(s["n_alnum"], "n_words"),
        "symbol_ratio": ratio(s["n_visible"] - s["n_alnum"], "n_visible"),
        "ended_share": ratio(s["n_ended"], "n_lines"),
        "bullet_share": ratio(s["n_bullets"], "n_lines"),
        "common_share": ratio(s["n_common"], "n_words"),
    }
    counts = [s[c].alias(c) for c in ("n_chars", "n_words", "n_alnum", "n_visible", "n_lines", "n_ended", "n_bullets", "n_common")]
    return let(failed, lambda f: F.struct(*counts, *(v.alias(k) for k, v in ratios.items()), f.alias("reasons"), (F.size(f) == 0).alias("is_prose")))


def not_prose(docs: DataFrame, stop_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", word_col: str = "word", rules: Iterable[str] = RULES) -> DataFrame:
    """``doc_id`` of the texts, neither null nor blank, that fail one of ``rules``."""
    return _statistics(docs, stop_words, id_col, text_col, word_col, rules).filter(~F.col("s.is_prose")).select("doc_id")

"""Problem 3: visually identical text with different characters.

Method: for every token the sets of scripts that can spell its letters are
intersected, mixed and whole-script confusables are told apart, the consistent
script spelling is chosen, and the remaining forms (width, accents, spaces,
invisible characters) are normalised -- see :mod:`tidemark.llm.lookalike`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.lookalike import _LETTERS, load
from tidemark.tables import materialize


def unify(df: DataFrame, id_col: str = "src_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id, form, changed, n_mixed, n_unresolved``.

    ``form`` is the consistent form (null for null, empty for empty text);
    ``n_mixed`` counts tokens whose letters are of several scripts,
    ``n_unresolved`` those of them that no single script can spell.  Repeated
    rows give repeated results; other columns of ``df`` are not touched, so
    their names cannot clash.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            forms, mixed, unresolved = [], [], []
            for text in texts.to_pylist():
                form = alike.look(text)
                kinds = Counter(alike.token_kind(t) for t in _LETTERS.findall(text) if not t.isascii()) if text and form != text else Counter()
                forms.append(form)
                mixed.append(kinds["mixed"] + kinds["mixed_resolved"])
                unresolved.append(kinds["mixed"])
            form = pa.array(forms, pa.string())
            changed = [a != b for a, b in zip(forms, texts.to_pylist())]
            yield pa.RecordBatch.from_arrays([ids, form, pa.array(changed, pa.bool_()), pa.array(mixed, pa.int32()), pa.array(unresolved, pa.int32())], ["id", "form", "changed", "n_mixed", "n_unresolved"])

    alike, kind = load(), dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, form string, changed boolean, n_mixed int, n_unresolved int")


def form_keys(df: DataFrame, id_col: str = "src_id", text_col: str = "text") -> DataFrame:
    """``id, form_key, text_key``: 128-bit digests of the consistent form and of the text itself.

    Rows with null text are left out: null looks like nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            raw = texts.to_pylist()
            form = pa.array([xxhash.xxh3_128_digest(alike.look(t)) for t in raw], pa.binary())
            text = pa.array([xxhash.xxh3_128_digest(t) for t in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, form, text], ["id", "form_key", "text_key"])

    alike, kind = load(), dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    return rows.mapInArrow(run, f"id {kind}, form_key binary, text_key binary")


def same_look_pairs(df: DataFrame, id_col: str = "src_id", text_col: str = "text") -> DataFrame:
    """Pairs ``id_a < id_b`` whose texts look the same but are different strings.

    Only digests are shuffled.  The different spellings of a form are paired first,
    and ids come in afterwards: a group of exact copies, however large, is one
    spelling, and costs no more than the pairs it is in.  Null texts are in no pair;
    equal strings (also repeated rows) make no pair.
    """
    keys = materialize(form_keys(df, id_col, text_col), "forms")
    spellings = keys.select("form_key", "text_key").distinct()
    several = spellings.groupBy("form_key").agg(F.count("*").alias("n")).filter("n > 1").select("form_key")
    spellings = materialize(spellings.join(several, "form_key"), "spellings")
    pairs = spellings.toDF("form_key", "a").join(spellings.toDF("form_key", "b"), "form_key").filter("a < b").select("a", "b")
    members = keys.join(spellings.select("text_key"), "text_key", "left_semi").select("text_key", "id")
    rows = pairs.join(members.toDF("a", "id_1"), "a").join(members.toDF("b", "id_2"), "b").filter("id_1 <> id_2")
    return rows.select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b")).distinct()

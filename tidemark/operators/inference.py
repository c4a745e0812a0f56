"""Model inference over texts: a plug-in scorer per worker, several models, one result per text."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.impact import LABELS

#: A scorer takes texts and gives an array (texts x labels) of probabilities.
Scorer = Callable[[Sequence[str]], np.ndarray]


def score(df: DataFrame, id_col: str, text_col: str, make: Mapping[str, Callable[[], Scorer]], labels: Sequence[str] = LABELS, batch: int = 128, shards: int | None = None, profile=None) -> DataFrame:
    """``id, model, probs, error`` for every row and model.

    ``make[name]()`` loads a model; it is called once in every task.  A model that
    fails to load or to score gives null for the texts concerned, and so does a
    scorer whose array has another shape; ``error`` then says why, and :func:`failures`
    counts it.  Null texts are scored as empty.  With ``shards`` rows go to so many
    tasks, each with a range of ids; ``profile`` is a resource profile for the tasks
    (:func:`gpu_profile`).
    """
    kind = dict(df.dtypes)[id_col]
    makers, n_labels = dict(make), len(labels)

    def run(frames):
        import pandas as pd

        scorers: dict[str, Scorer | None] = {}
        broken: dict[str, str] = {}
        for name, maker in makers.items():
            try:
                scorers[name] = maker()
            except Exception as e:
                scorers[name], broken[name] = None, f"loading: {type(e).__name__}: {e}"
        for pdf in frames:
            texts = pdf["text"].fillna("").tolist()
            for name, scorer in scorers.items():
                out: list = [None] * len(texts)
                errors: list = [broken.get(name)] * len(texts)
                for at in range(0, len(texts) if scorer else 0, batch):
                    part = texts[at : at + batch]
                    try:
                        probs = np.asarray(scorer(part), dtype=float)
                        if probs.shape == (len(part), n_labels):
                            out[at : at + batch] = probs.tolist()
                            continue
                        error = f"scoring: an array of shape {probs.shape}"
                    except Exception as e:
                        error = f"scoring: {type(e).__name__}: {e}"
                    errors[at : at + batch] = [error] * len(part)
                yield pd.DataFrame({"id": pdf["id"], "model": name, "probs": out, "error": errors})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows if shards is None else rows.repartitionByRange(shards, "id")
    return rows.mapInPandas(run, f"id {kind}, model string, probs array<double>, error string", profile=profile)


def gpu_profile(gpus: float = 1, cores: int = 1):
    """What a task of a model needs of a cluster that has GPUs."""
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores).resource("gpu", gpus)).build


def embed(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[Sequence[str]], np.ndarray]], width: int, batch: int = 128, profile=None) -> DataFrame:
    """``id, embedding``: one vector of length 1 for every row, of ``width`` numbers; zero vectors stay as they are.

    ``make()`` loads the model, once in every task.  A vector of another width fails the
    task: a corpus with holes in its vectors is worse than none.  Null texts count as empty.
    """
    kind = dict(df.dtypes)[id_col]

    def run(frames):
        import pandas as pd

        model = make()
        for pdf in frames:
            texts = pdf["text"].fillna("").tolist()
            parts = [np.asarray(model(texts[at : at + batch]), dtype=np.float32) for at in range(0, len(texts), batch)]
            vectors = np.concatenate(parts) if parts else np.zeros((0, width), np.float32)
            if vectors.shape != (len(texts), width):
                raise ValueError(f"vectors of shape {vectors.shape} for {len(texts)} texts of width {width}")
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.DataFrame({"id": pdf["id"], "embedding": list(vectors / np.where(length > 0, length, 1))})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, f"id {kind}, embedding array<float>", profile=profile)


def failures(scores: DataFrame) -> DataFrame:
    """``model, error, n``: texts without a result, by model and reason."""
    return scores.filter("error is not null").groupBy("model", "error").agg(F.count("*").alias("n"))


def ensemble_scores(scores: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """``id``, mean probability per label, ``label`` and ``score``: models without a result are left out; with none all are null."""
    means = [F.avg(F.get("probs", F.lit(i))).alias(x) for i, x in enumerate(labels)]
    mean = scores.groupBy("id").agg(*means)
    held = F.array(*map(F.col, labels))
    name = F.get(F.array(*map(F.lit, labels)), (F.array_position(held, F.array_max(held)) - 1).cast("int"))
    return mean.select("id", *labels, F.when(F.col(labels[0]).isNotNull(), name).alias("label"), F.array_max(held).alias("score"))


def stem_scorer(stems: Mapping[str, Sequence[str]], labels: Sequence[str] = LABELS) -> Callable[[], Scorer]:
    """A plain scorer for tests and demonstrations: softmax of how often a label's stems occur."""

    def make() -> Scorer:
        def scorer(texts: Sequence[str]) -> np.ndarray:
            counts = np.array([[sum(t.lower().count(s) for s in stems.get(x, ())) for x in labels] for t in texts], float).reshape(len(texts), len(labels))
            e = np.exp(counts - counts.max(axis=1, keepdims=True, initial=-np.inf))
            return e / e.sum(axis=1, keepdims=True)

        return scorer

    return make

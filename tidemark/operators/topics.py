"""Topics: ensembles of label probabilities, topic tables, words of topics, clusters of vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.components import connected
from tidemark.operators.impact import LABELS
from tidemark.operators.reports import most_common
from tidemark.tables import materialize, small


def ensemble(models: Sequence[Sequence[Column]], labels: Sequence[str] = LABELS) -> Column:
    """Struct of the mean probability per label, ``label`` (the first of the largest) and ``score``.

    ``models`` has one list of probabilities per model, in the labels' order.  A
    null of any model makes the mean null; with all means null the label is null.
    """
    if not models:
        raise ValueError("an ensemble needs at least one model")
    means = []
    for i in range(len(labels)):
        total = models[0][i].cast("double")
        for m in models[1:]:
            total = total + m[i].cast("double")
        means.append(total / len(models))
    held = F.array(*means)
    best = F.array_max(held)
    name = F.get(F.array(*map(F.lit, labels)), (F.array_position(held, best) - 1).cast("int"))
    return F.struct(*(m.alias(x) for m, x in zip(means, labels)), name.alias("label"), best.alias("score"))


def topic_table(df: DataFrame, topic: str, name: str, order: str) -> DataFrame:
    """``topic, topic_count, name``: rows per topic and the first name in order."""
    first = F.min(F.when(F.col(name).isNotNull(), F.struct(F.col(order).alias("o"), F.col(name).alias("v"))))
    return df.groupBy(topic).agg(F.count("*").alias("topic_count"), first["v"].alias(name))


def topic_label_stats(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """``keys, size`` and mean and exact median of every measure; nulls of a measure don't count.

    The median is found in the counts of different values by their running sum, a
    window that spills, so that no state grows with the values of a group.
    """
    out = df.groupBy(*keys).agg(F.count("*").alias("size"), *(F.avg(F.col(m).cast("double")).alias(f"{m}_mean") for m in measures))
    for m in measures:
        counts = df.select(*keys, F.col(m).cast("double").alias("_v")).filter("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v"))
        placed = counts.select(*keys, "_v", upto.alias("_upto"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
        middle = [F.min(F.when(F.col("_upto") >= F.floor((F.col("_all") + k) / 2), F.col("_v"))) for k in (1, 2)]
        medians = placed.groupBy(*keys).agg(((middle[0] + middle[1]) / 2).alias(f"{m}_median"))
        same = [F.equal_null(out[k], medians[k]) for k in keys]
        out = out.join(medians, same, "left").select(*(out[c] for c in out.columns), f"{m}_median")
    return out.select(*keys, "size", *(f"{m}_{x}" for m in measures for x in ("mean", "median")))


def normalised_crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """``row, column, n, share``: counts and their share of the column."""
    counts = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(column)))


def attach_vectors(docs: DataFrame, vectors: DataFrame, doc_key: str, vector_key: str, vector: str, width: int, strict: bool = True) -> DataFrame:
    """``docs`` with the vector of the same key -- never by position.

    ``strict`` first makes sure, in one pass over keys and lengths, that every text
    has exactly one vector of ``width`` numbers, and raises ``ValueError`` if not;
    otherwise texts without a vector have null.
    """
    side = vectors.select(F.col(vector_key).alias("_key"), F.col(vector).alias("vector"))
    if strict:
        sizes = side.select("_key", F.size("vector").alias("_w")).groupBy("_key").agg(F.count("*").alias("_n"), F.min("_w").alias("_lo"), F.max("_w").alias("_hi"))
        found = docs.select(F.col(doc_key).alias("_doc")).join(sizes, F.col("_doc") == F.col("_key"), "left")
        row = found.agg(F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if((F.col("_lo") != width) | (F.col("_hi") != width)).alias("wrong")).first()
        if any(row):
            raise ValueError(f"texts without a vector: {row.missing}, with several: {row.repeated}, with one of another width: {row.wrong}")
    return docs.join(side, F.col(doc_key) == F.col("_key"), "left").drop("_key")


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    """``df`` with its vectors scaled to length 1; zero vectors stay as they are."""
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.withColumn(vector, F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double"))))


def class_tf_idf(df: DataFrame, topic: str, tokens: Column, top: int | None = 10, min_docs: int = 1, max_share: float = 1.0) -> DataFrame:
    """``topic, word, tf, weight, rank``: the words that mark a topic, by class-based tf-idf.

    weight = tf * ln(1 + A / f), tf the word's share of the topic's words, f its
    count in all topics, A the mean number of words per topic.  Words in fewer
    than ``min_docs`` texts or in more than ``max_share`` of them are left out.  With
    ``top`` as None all words come, without a rank.

    With a bound the words that meet it are found first, by the texts they are in, without
    topics and numbers; only those words, mostly few, are then counted.
    """
    rows = df.select(F.col(topic).alias("topic"), F.explode(tokens).alias("word"))
    if min_docs > 1 or max_share < 1:
        counted = df.select(F.explode(F.array_distinct(tokens)).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))
        total = df.agg(F.count("*").alias("_all"))
        within = counted.crossJoin(F.broadcast(total)).filter((F.col("docs") >= min_docs) & (F.col("docs") <= F.col("_all") * max_share))
        vocabulary = materialize(within.select("word"), "vocabulary")
        words = materialize(rows.join(small(vocabulary, 200_000), "word", "left_semi").groupBy("topic", "word").agg(F.count("*").alias("n")), "words")
    else:
        words = materialize(rows.groupBy("topic", "word").agg(F.count("*").alias("n")), "words")
    kept = words.join(words.groupBy("word").agg(F.sum("n").alias("f")), "word")
    sizes = kept.groupBy("topic").agg(F.sum("n").alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    weight = (F.col("n") / F.col("size")) * F.log(1 + F.col("mean") / F.col("f"))
    scored = kept.join(sizes, F.equal_null(kept["topic"], sizes["topic"])).drop(sizes["topic"]).crossJoin(F.broadcast(mean)).select("topic", "word", (F.col("n") / F.col("size")).alias("tf"), weight.alias("weight"))
    if top is None:
        return scored
    w = Window.partitionBy("topic").orderBy(F.desc(F.round("weight", 9)), "word")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def topic_words_over_time(df: DataFrame, topic: str, bin_col: str, tokens: Column, top: int = 5) -> DataFrame:
    """``topic, bin, word, weight, rank``: class tf-idf per topic and bin, averaged with the bin before and with the topic's own."""
    both = F.struct(F.col(topic).alias("t"), F.col(bin_col).alias("b"))
    local = class_tf_idf(df.withColumn("_cell", both), "_cell", tokens, top=None).select(F.col("topic.t").alias("topic"), F.col("topic.b").alias("bin"), "word", "weight")
    overall = class_tf_idf(df, topic, tokens, top=None).select("topic", "word", F.col("weight").alias("overall"))
    bins = local.select("topic", "bin").distinct().withColumn("next", F.lead("bin").over(Window.partitionBy("topic").orderBy("bin")))
    before = local.join(bins, ["topic", "bin"]).filter("next is not null").select("topic", F.col("next").alias("bin"), "word", F.col("weight").alias("before"))
    merged = local.join(before, ["topic", "bin", "word"], "full").join(overall, ["topic", "word"], "left")
    smooth = (F.coalesce("weight", F.lit(0.0)) + F.coalesce("before", F.coalesce("weight", F.lit(0.0))) + F.coalesce("overall", F.lit(0.0))) / 3
    w = Window.partitionBy("topic", "bin").orderBy(F.desc(F.round(smooth, 9)), "word")
    return merged.select("topic", "bin", "word", smooth.alias("weight"), F.row_number().over(w).alias("rank")).filter(F.col("rank") <= top)


def reduced(df: DataFrame, vector: str, id_col: str, dims: int):
    """``(rows, model)``: unit vectors with their first principal components as ``low``, and the fitted model."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = unit_vectors(df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).filter("v is not null"), "v").withColumn("features", array_to_vector("v"))
    if rows.isEmpty():
        return rows, None
    model = PCA(k=dims, inputCol="features", outputCol="low").fit(rows)
    return model.transform(rows), model


def density_clusters(df: DataFrame, vector: str, id_col: str, dims: int = 3, width: float = 0.1, least: int = 5) -> DataFrame:
    """``id, topic``: clusters of any form and number by density; -1 for what lies where it is thin.

    Unit vectors are reduced to ``dims`` principal components and put on a grid of cells
    of ``width``.  Cells of at least ``least`` rows are dense; dense cells that touch are
    one cluster, and clusters are numbered by falling size.  Rows are only counted into
    their cells; what is joined and walked are dense cells, at most one for every
    ``least`` rows.
    """
    from itertools import product

    from pyspark.ml.functions import vector_to_array

    rows, model = reduced(df, vector, id_col, dims)
    if model is None:
        return rows.select("id", F.lit(-1).alias("topic"))
    cell = F.transform(vector_to_array("low"), lambda x: F.floor(x / width))
    placed = rows.select("id", cell.alias("cell"))
    dense = materialize(placed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") >= least).withColumn("label", F.monotonically_increasing_id()), "cells")
    steps = F.array(*(F.array(*map(F.lit, s)) for s in product((-1, 0, 1), repeat=dims) if any(s)))
    beside = dense.select("label", "cell", F.explode(steps).alias("step")).select("label", F.zip_with("cell", "step", lambda a, b: a + b).alias("cell"))
    edges = materialize(beside.join(dense.select("cell", F.col("label").alias("other")), "cell").select("label", "other"), "touching")
    roots = connected(dense.select("label"), edges)
    sizes = dense.join(roots, "label").groupBy("root").agg(F.sum("n").alias("size"))
    ranked = most_common(sizes, "size", ["root"])
    number = ranked.withColumn("topic", F.row_number().over(Window.orderBy(F.desc("size"), "root")) - 1)
    of_cell = dense.join(roots, "label").join(number.select("root", "topic"), "root").select("cell", "topic")
    return placed.join(of_cell, "cell", "left").select("id", F.coalesce("topic", F.lit(-1)).cast("int").alias("topic"))


def cluster_vectors(df: DataFrame, vector: str, id_col: str, k: int = 10, dims: int = 5, min_size: int = 3, seed: int = 42, save_to: str | None = None) -> DataFrame:
    """``id, topic``: clusters of vectors, numbered by size; -1 for those far from every centre or in a small cluster.

    Unit vectors, principal components, k-means, all fitted on all rows; with
    ``save_to`` the fitted models are stored there.  A row is an outlier if it is
    farther from its centre than 3 times the mean.  :func:`density_clusters` needs no
    number of clusters.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import vector_to_array

    rows, pca = reduced(df, vector, id_col, dims)
    if pca is None:
        return rows.select("id", F.lit(-1).alias("topic"))
    model = KMeans(k=k, seed=seed, featuresCol="low", predictionCol="cluster").fit(rows)
    if save_to:
        from pyspark.ml import PipelineModel

        PipelineModel([pca, model]).write().overwrite().save(save_to)
    centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))
    placed = model.transform(rows).select("id", "cluster", vector_to_array("low").alias("low"))
    gap = F.aggregate(F.zip_with("low", F.get(centres, F.col("cluster")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    placed = placed.select("id", "cluster", F.sqrt(gap).alias("distance"))
    mean = placed.agg(F.avg("distance").alias("mean"))
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("size"))
    ranked = sizes.filter(F.col("size") >= min_size).withColumn("topic", F.row_number().over(Window.orderBy(F.desc("size"), "cluster")) - 1)
    joined = placed.crossJoin(F.broadcast(mean)).join(F.broadcast(ranked), "cluster", "left")
    return joined.select("id", F.when(F.col("distance") > 3 * F.col("mean"), -1).otherwise(F.coalesce("topic", F.lit(-1))).cast("int").alias("topic"))

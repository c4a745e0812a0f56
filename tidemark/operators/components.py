"""Connected components of a graph that is too large for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.tables import materialize


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``label, root``: the smallest label of every node's component; ``edges`` has each in both directions.

    Every node takes the smallest root among its neighbours and then its root's root,
    so the paths halve; each round is written, until none changes anything.
    """
    state = materialize(nodes.select("label", F.col("label").alias("root")), "roots")
    while True:
        around = edges.join(state.select(F.col("label").alias("other"), "root"), "other").groupBy("label").agg(F.min("root").alias("_near"))
        taken = state.join(around, "label", "left").select("label", F.col("root").alias("_was"), F.least("root", F.coalesce("_near", "root")).alias("root"))
        above = taken.select(F.col("label").alias("_up"), F.col("root").alias("_top"))
        state = materialize(taken.join(above, F.col("root") == F.col("_up")).select("label", "_was", F.least("root", "_top").alias("root")), "roots")
        if state.filter("root <> _was").isEmpty():
            return state.select("label", "root")

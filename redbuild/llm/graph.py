"""Connected components of a large graph, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _settled(parents: DataFrame) -> DataFrame:
    """(node, label): follows parents, each less than its node, to their ends by pointer jumping."""
    while True:
        up = parents.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        parents = checkpointed(
            parents.join(up, "label", "left").select("node", F.coalesce("_up", "label").alias("label"), F.col("_up").isNotNull().alias("_moved"))
        )
        if not parents.filter("_moved").head(1):
            return parents.drop("_moved")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the least node that it is linked with, itself included.

    Each round hooks every node to its least neighbour if that is less, follows these hooks to their ends, and goes on
    with what edges then remain between different ends.  All state is in tables; the driver only asks whether any is left.
    """
    edges = checkpointed(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = checkpointed(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    while edges.head(1):
        hooks = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
        ends = _settled(hooks)
        to = ends.select(F.col("node").alias("label"), F.col("label").alias("_end"))
        labels = checkpointed(labels.join(to, "label", "left").select("node", F.coalesce("_end", "label").alias("label")))
        for end in ("a", "b"):
            to = ends.select(F.col("node").alias(end), F.col("label").alias("_end"))
            edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_end", end)).drop("_end")
        edges = checkpointed(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return labels

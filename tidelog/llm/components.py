"""Connected components of a graph given as edges, by contraction.

Each round every node takes as its label whichever of itself and its neighbours comes first in a
hashed order, and the graph shrinks to its labels. The order is unrelated to the ids, so a chain of
rising ids is no worse than any other: nodes that come before none of their neighbours drop out, a
good share of all in each round, and rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that each node of ``edges`` (a, b, both long) can reach, itself included.

    A hub costs no task more than its edges' share: labels are minima with partial aggregation, and
    the joins are sort-merge joins that Spark may split. Every round is a stored table. Loops and
    repeated edges are allowed; edges with a null end are left out.
    """
    placed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null").distinct()
    edges = common.stored(edges, "edges")
    labels = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        first = both.groupBy("node").agg(F.min(placed("near")).alias("m"))
        step = common.stored(first.select("node", F.least(placed("node"), "m")["id"].alias("label")), "labels")
        if labels is None:
            labels = step
        else:
            after = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = labels.join(after, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
            labels = common.stored(labels, "labels")
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(
            step.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b"
        )
        edges = ends.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        edges = common.stored(edges, "edges")
        if edges.isEmpty():
            least = labels.groupBy("label").agg(F.min("node").alias("least"))
            return labels.join(least, "label").select("node", F.col("least").alias("label"))

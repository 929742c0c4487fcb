"""Connected components of a graph given as a table of edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import stored


def _min_neighbours(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
    return both.groupBy("node").agg(F.least("node", F.min("to")).alias("root"))


def _flattened(parents: DataFrame) -> DataFrame:
    """Each node's root, by pointer jumping: every pass halves the depth."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = stored(parents.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "parents")
        if jumped.where("moved").isEmpty():
            return jumped.drop("moved")
        parents = jumped.drop("moved")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an edge can reach.

    Each round hooks every component to its smallest neighbour, flattens the
    trees and contracts the edges, so components at least halve; the number of
    rounds grows with the logarithm of the longest chain. Edges and labels stay
    in written tables, hubs are combined before they are shuffled.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        roots = _flattened(stored(_min_neighbours(edges), "parents"))
        labels = roots if labels is None else stored(labels.join(roots.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = stored(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return labels

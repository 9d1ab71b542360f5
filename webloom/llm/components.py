"""Connected components of a table of edges, by contraction in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import _store


def connected(edges: DataFrame, path: str) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with an edge. ``edges`` has (a, b), longs.

    In each round every root joins its smallest neighbour that is smaller than itself, chains are shortened
    by pointer jumping, and edges are renamed to roots; at most half the roots of a component are left. Each
    round is written to ``path``: nothing is gathered on the driver, and lost executors cost only a round.

    Edges in either direction, repeated or from a node to itself are the same; one with a null end is none; nodes without an
    edge to another don't come back; an empty table gives none.
    """
    at = iter(range(10**6))

    def kept(df: DataFrame) -> DataFrame:
        return _store.written(df, f"{path}/{next(at)}")

    edges = kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    roots = None
    while not edges.isEmpty():
        parent = kept(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("further"))
            jumped = kept(parent.join(up, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        named = parent.select(F.col("node").alias("x"), F.col("root").alias("y"))
        if roots is None:
            ends = edges.select("a").union(edges.select("b")).distinct().withColumnRenamed("a", "node")
            roots = ends.select("node", F.col("node").alias("root"))
        roots = kept(roots.join(named, F.col("root") == F.col("x"), "left").select("node", F.coalesce("y", "root").alias("root")))
        for c in ("a", "b"):
            edges = edges.join(named, F.col(c) == F.col("x"), "left").withColumn(c, F.coalesce("y", c)).drop("x", "y")
        edges = kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

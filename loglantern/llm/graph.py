"""Connected components of a graph kept as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglantern.llm.common import saved

MAX_ROUNDS = 60  # rounds grow with the logarithm of the longest path


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of edges (a, b), long ids.

    Each round points the larger neighbours of a node to its smallest one, then its
    smaller ones (large star, small star), until all edges are stars. A hot node is the
    centre of a star at most: what it sends are its edges, and the smallest neighbour
    comes from a partial aggregate. Rounds are written to the shared folder.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, both.where("b > a"))
        small = saved(_star(large, large).distinct(), "edges")
        now = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = small
        if now == before:
            return _labels(edges)
        before = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _star(around: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges from the ends b of ``moved``, and from a itself, to the smallest node of a."""
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    ends = moved.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return ends.union(own).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _labels(stars: DataFrame) -> DataFrame:
    labels = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).distinct()

"""Connected components of a large graph, by stars that shrink towards the smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidelog.session import durable


def _state(edges: DataFrame) -> tuple:
    """Two numbers that tell whether the set of edges has changed."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _smallest(edges: DataFrame) -> DataFrame:
    """Edges a -> b with ``low``: the smallest of a's neighbours and a itself. A node with very
    many edges is reduced before the shuffle, and its edges are split by the join."""
    lowest = edges.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("node"), F.least("a", "low").alias("low"))
    return edges.join(lowest, F.col("a") == F.col("node")).select("a", "b", "low")


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): of every node with a link, the smallest node that it can reach.

    Large and small stars in turn until nothing changes; the rounds grow with the logarithm of a
    component's size, not with its diameter. Each round is written to the shared folder, which
    cuts the lineage. Links to null or to the node itself are left out; repeated links count once.
    """
    a, b = F.col(left), F.col(right)
    edges = durable(links.filter(a.isNotNull() & b.isNotNull() & (a != b))
                    .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _smallest(both).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter(
            "a <> b").distinct()
        low = _smallest(large)
        small = low.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()
        edges = durable(small)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)

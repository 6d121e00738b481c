"""Connected components of an edge table, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, split_join, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, small: bool, n: int) -> DataFrame:
    """One contraction of n edges: each node's larger (or, if small, not larger) neighbours move to its least neighbour.

    Only a minimum is kept per node, so a hub's neighbours are never gathered in one row, nor, split_join, in one task.
    """
    if small:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    joined = split_join(pairs, least, "u", "n", n if small else 2 * n)
    if small:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the least node of its component.

    Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    cur = written(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "cc")
    before = _mark(cur)
    while before[0]:
        large = written(_star(cur, False, before[0]), "cc")
        nxt = written(_star(large, True, large.count()), "cc")
        drop_written(large)
        after = _mark(nxt)
        drop_written(cur)
        cur = nxt
        if after == before:
            break
        before = after
    return cur.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))

"""Connected components of an edge table, by alternating star operations.

Large-star links every larger neighbour of a node to the node's smallest
neighbour, small-star does the same for the smaller ones; both keep the
components and never lengthen a path, and repeated in turn they end in stars
around each component's smallest node. Every round is two joins and two
partial aggregates over the edges; no group is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (a, b) with a > b."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    lowest = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    both = near.join(lowest, "u")
    if large:
        moved = both.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = both.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"),
                            F.col("m").alias("b"))
    return moved.where("a > b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (a, b) of integer ids;
    the component is its smallest node. Self links and repeats are ignored; an
    empty edge table gives an empty result."""
    turned = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = scratch.save(turned.where("a > b").distinct(), "edges-0")
    mark, turn = None, 0
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == mark or not seen.n:
            break
        mark, turn = (seen.n, seen.h), turn + 1
        now = scratch.save(_star(_star(now, large=True), large=False), f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

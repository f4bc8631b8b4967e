"""Connected components of an edge list by alternating star operations, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _stars(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """One star operation on distinct edges (u > v), and the stored table that it reads beside them.

    The least neighbours are a table of their own, so that both sides of the join are shuffled and Spark may split a node with very
    many edges. Large: every neighbour above u moves to the least of u and its neighbours. Small: u and its neighbours below it move to
    the least of them.
    """
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # u's own edge to its least neighbour stays among the edges of that neighbour
        return moved.where("u <> v").distinct(), least
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), least


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """`(node, root)` for every node that has an edge; the root is the component's least node.

    `edges` has two columns of one orderable type. Each round is written to the shared folder, so the plan stays short;
    the rounds grow with the square of the logarithm of the longest component at most.
    """
    a, b = edges.columns
    kept = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    current = materialise(kept, "cc")
    before = _state(current)
    while before[0]:
        large, spent = _stars(current, True)
        large = materialise(large, "cc-large")
        small, spent_too = _stars(large, False)
        last, current = current, materialise(small, "cc")
        discard(last, large, spent, spent_too)
        after = _state(current)
        if after == before:
            break
        before = after
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relslice.scratch import discard, materialize


#: Edges of a node that one task may join without ado.
HOT = 1_000


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """node, root for every node of an edge; the root is its component's smallest node and has a row, too.

    Every step sends each node's neighbours to its smallest neighbour, by a grouped minimum (combined before the
    shuffle) and a join, in which the minima of nodes with more than HOT edges and a thousandth of all are broadcast;
    so no task gathers the neighbours of such a node. Edges with a null end and loops are ignored; repeats and directions don't
    matter. The number of rounds grows with the logarithm of the longest path.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now = materialize(now, "edges")
    before = _digest(now)
    for _ in range(max_rounds):
        # Large star: a node's larger neighbours move to its smallest neighbour (or itself).
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both.where("v > u"), least, max(HOT, before[0] // 1000) if before[2] > HOT else None).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them. A node may have many of these, too.
        smaller = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = _with_least(large, smaller, max(HOT, before[0] // 1000) if before[0] > HOT else None)
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u != v").distinct(), "edges")
        digest = _digest(after)
        discard(now)
        now = after
        if digest == before:
            break
        before = digest
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _with_least(edges: DataFrame, least: DataFrame, hot: int | None) -> DataFrame:
    """``edges`` with their node's minimum; minima of nodes with more than ``hot`` edges, of which there are fewer than 2000, are broadcast."""
    if hot is None:
        return edges.join(least.select("u", "m"), "u")
    few = least.where(F.col("n") > hot).select("u", F.col("m").alias("hot"))
    marked = edges.join(F.broadcast(few), "u", "left")
    cold = marked.where("hot is null").drop("hot").join(least.where(F.col("n") <= hot).select("u", "m"), "u")
    return cold.unionByName(marked.where("hot is not null").withColumnRenamed("hot", "m"))


def _digest(edges: DataFrame) -> tuple:
    """Number and digest of the edges, and the most that lead to one smaller end."""
    by_end = edges.groupBy("v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    return tuple(by_end.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("h"), F.coalesce(F.max("n"), F.lit(0))).first())

"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactweave.llm.base import BROADCAST_ROWS, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node
    of its component.

    Rounds of large-star and small-star linking (Kiveris and others, 2014): every
    node hangs its larger neighbours, then its smaller ones and itself, under its
    smallest neighbour, until nothing changes.  Each round ends in a written
    table.  Minima are found by partial aggregation, so a node with very many
    neighbours costs a row per task.  The join back broadcasts minima while the graph
    has at most ``BROADCAST_ROWS`` ends; beyond, adaptive execution splits hot nodes.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hinted = lambda nodes, n: F.broadcast(nodes) if 2 * n <= BROADCAST_ROWS else nodes
    shape = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "graph")
    before = shape(now)
    for _ in range(max_rounds):
        every = both(now)
        least = every.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = every.where("b > a").join(hinted(least, before["n"]), F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Every row of large has a > b: its a hangs b, and itself, under its least.
        least = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        met = large.join(hinted(least, before["n"]), F.col("a") == F.col("k"))
        now = written(met.select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct(), "graph")
        after = shape(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

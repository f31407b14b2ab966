"""Scratch tables and connected components in DataFrames."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Edges that one task takes at most when it labels components.
BLOCK_EDGES = 1 << 20

#: Setting under which Spark removes a job's shuffle files when the job ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all machines share.

    It is ``spark.checkpoint.dir`` of the session; where that is unset, a local
    session takes a folder below the warehouse and any other is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends there,
    losing an executor never repeats the work before it, and the shuffle files that led
    there are removed, as nothing reads them again."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **counts) -> tuple[DataFrame, dict[str, int]]:
    """``written(df)`` and the counts that the write saw; a count is never too small."""
    seen = Observation()
    table = written(df.observe(seen, *(c.alias(n) for n, c in counts.items())), name)
    # Spark drops the observation of a plan that it knows to be empty.
    return table, {n: seen.get.get(n) or 0 for n in counts}


def settle_blocks(size: int):
    """``settle_block`` for every ``size`` edges, or a few more, of a task."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= size:
                yield from settle_block(iter(held))
                held = []
        yield from settle_block(iter(held))

    return settle


def settle_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of the edges (a, b) of one task, each root hooked to the least root
    next to it until no edge joins two roots."""
    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return
    ends = np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b") for b in batches])
    nodes, at = np.unique(ends, return_inverse=True)
    x, y = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while len(x):
        x, y = label[x], label[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "label"])


def contracted(edges: DataFrame, block_edges: int) -> tuple[DataFrame, DataFrame, int]:
    """(node, end) for every node of ``edges``, and the edges (a, b) left between ends,
    with their number.

    Tasks settle blocks of edges by themselves first, so that each node has a label, of
    its component in a block, for every block that it is in.  A node hooks to its least
    label and follows the hooks of labels to their end, by doubling; edges are left
    where a node's labels end differently.
    """
    # Written, as blocks depend on how edges are dealt, which must not change below.
    forest = written(edges.mapInArrow(settle_blocks(block_edges), "node long, label long"), "forest")
    nodes = written(forest.groupBy("node").agg(F.min("label").alias("hook"), F.collect_set("label").alias("labels")), "nodes")
    # Every label is a node that some block has as its own label.
    hops = written(nodes.where("array_contains(labels, node)").select(F.col("node").alias("at"), F.col("hook").alias("end")), "hops")
    while True:
        further = hops.select(F.col("at").alias("n"), F.col("end").alias("next"))
        hops, n = counted(hops.join(further, F.col("end") == F.col("n")).select("at", F.col("next").alias("end"), (F.col("next") != F.col("end")).alias("moved")), "hops", moved=F.count_if("moved"))
        if not n["moved"]:
            break
    ends = nodes.join(hops, F.col("hook") == F.col("at")).select("node", "end", "labels")
    open_ = ends.where("size(labels) > 1").select(F.col("end").alias("a"), F.explode("labels").alias("l"))
    left = open_.join(hops, F.col("l") == F.col("at")).where("a <> end").select("a", F.col("end").alias("b")).distinct()
    left, n = counted(left, "edges", n=F.count(F.lit(1)))
    return ends.select("node", "end"), left, n["n"]


def component_labels(edges: DataFrame, count: int | None = None, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b) of long integers: the smallest
    node of its component.

    Up to ``block_edges`` edges, 16 bytes each, are settled by one task; ``count`` is
    their number, or more, where the caller knows it.  Beyond that rounds contract the
    graph until it is that small: only nodes without a smaller neighbour stay, and of
    edges that lie near each other in a task, only those between blocks."""
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    if count is None:
        edges, n = counted(edges, "edges", n=F.count(F.lit(1)))
        count = n["n"]
    levels = []
    while count > max(block_edges, 0):
        level, edges, count = contracted(edges, block_edges)
        levels.append(level)
    labels = edges.repartition(1).mapInArrow(settle_block, "node long, label long")
    for level in reversed(levels):
        of = written(labels, "labels").select(F.col("node").alias("n"), F.col("label").alias("l"))
        labels = level.join(of, F.col("end") == F.col("n"), "left").select("node", F.coalesce("l", "end").alias("label"))
    return labels

"""Places of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contactweave.functions.graph import written

#: Rows of a partition that monotonically_increasing_id() can tell apart.
ROW_BITS = 33


def ranked(df: DataFrame, order: list[str], name: str, keep: list[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with ``name``, 1 for the first row in ``order``
    and so on.

    Rows are dealt to range partitions and sorted there, which is written; a row's
    place is its partition's first place, from one count per partition, and its own in
    the partition.  Rows that are equal in ``order`` go in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(ordered.select(*(keep or df.columns), F.monotonically_increasing_id().alias("_at")), "ordered")
    part = F.shiftright("_at", ROW_BITS)
    # One number per partition reaches the driver.
    counts = {r["part"]: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}
    starts = [0, *accumulate(counts.get(p, 0) for p in range(max(counts, default=0)))]
    start = F.get(F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>"), part.cast("int"))
    place = start + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    return placed.withColumn(name, place).drop("_at")


def edges(rows: DataFrame, part: str, order: str, **last) -> DataFrame:
    """One row per split: its number, its first place, and for each of ``last`` the value
    of the nearest split before it that has one."""
    ends = rows.groupBy(part).agg(F.min(order).alias("_first"), *(c.alias(f"_{n}") for n, c in last.items()))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    carried = (F.last(f"_{n}", ignorenulls=True).over(before).alias(n) for n in last)
    return F.broadcast(ends.select(F.col(part).alias("_p"), "_first", *carried))


def with_previous(df: DataFrame, columns: list[str], name: str, order: str = "seq") -> DataFrame:
    """``df`` with ``name``, a struct of ``columns`` of the row before in ``order``, whose
    upper bits number input splits: a window within each, and their last rows between."""
    rows = df.withColumn("_part", F.shiftright(order, ROW_BITS)).withColumn("_own", F.struct(*columns))
    at = edges(rows, "_part", order, carried=F.max_by("_own", order))
    rows = rows.withColumn(name, F.lag("_own").over(W.partitionBy("_part").orderBy(order))).join(at, F.col("_part") == F.col("_p"))
    return rows.withColumn(name, F.when(F.col(order) == F.col("_first"), F.col("carried")).otherwise(F.col(name))).drop("_part", "_own", "_p", "_first", "carried")


def with_runs(df: DataFrame, column: str, name: str, order: str = "seq") -> DataFrame:
    """``df`` with ``name``, the place of the first row of its run of equal ``column``."""
    rows = with_previous(df, [column], "_before", order)
    new = F.col("_before").isNull() | ~F.col(column).eqNullSafe(F.col(f"_before.{column}"))
    rows = rows.withColumn("_start", F.when(new, F.col(order))).withColumn("_part", F.shiftright(order, ROW_BITS))
    at = edges(rows, "_part", order, begun=F.max("_start"))
    within = F.max("_start").over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn(name, within).join(at, F.col("_part") == F.col("_p"))
    return rows.withColumn(name, F.coalesce(name, "begun")).drop("_before", "_start", "_part", "_p", "_first", "begun")

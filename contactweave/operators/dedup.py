"""Duplicate marking by exact or near positions.

Transitive clusters come from grid cells of max_mismatch + 1 positions, without any
list of near pairs.  All rows of a cell are within reach of each other, so rows are
reduced to cells first, with map-side sums, and only cells are linked: side by side by
the cells' extents, cornerwise by the outermost rows of both.  Work grows with the
rows, whatever the reach and however many rows share a cell.  The sum metric is the
max metric over pos1 + pos2 and pos1 - pos2.

Greedy clusters depend on the order of rows.  Rows at equal positions are reduced to
their first one.  A cell holds one kept row at most, so a task that goes through a tile
of cells in order compares a row with nine others.  What depends on rows beyond the tile
waits for a round whose tiles lie elsewhere; pairs are listed only of what waits too long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactweave.functions.graph import component_labels, counted, written
from contactweave.model import UNMAPPED_CHROM, PairsError

KEYS = ("chrom1", "chrom2", "strand1", "strand2")
#: Cells that a cell's points are compared with: itself and half its neighbours.
HALF = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))

#: Cells along one side of the blocks in which cells meet their neighbours.
BLOCK = 64

#: Cells along one side of the tiles in which greedy outcomes are worked out.
TILE = 32

#: Pairs of cells whose rows are picked by a broadcast before they are reduced.
FEW_PAIRS = 100_000

#: Edges in a range of points that one task decides in order.
BLOCK_EDGES = 1 << 20


def mapped() -> Column:
    return (F.col("chrom1") != UNMAPPED_CHROM) & (F.col("chrom2") != UNMAPPED_CHROM)


def within(metric: str, m: int) -> Column:
    d1, d2 = F.abs(F.col("l.pos1") - F.col("r.pos1")), F.abs(F.col("l.pos2") - F.col("r.pos2"))
    if metric == "max":
        return (d1 <= m) & (d2 <= m)
    if metric == "sum":
        return d1 + d2 <= m
    raise PairsError(f"unknown metric {metric!r}")


def near_points(points: DataFrame, keys: list[str], m: int, metric: str) -> DataFrame:
    """(a, b) of points (keys, pos1, pos2, first) within reach, each pair once."""
    side = m + 1
    cells = points.withColumn("gx", F.expr(f"pos1 div {side}")).withColumn("gy", F.expr(f"pos2 div {side}"))
    offsets = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in HALF))
    spread = cells.select("*", F.explode(offsets).alias("o")).withColumn("gx", F.col("gx") + F.col("o.x")).withColumn("gy", F.col("gy") + F.col("o.y"))
    equal = lambda l, r, k: l == r if k in (*KEYS, "gx", "gy") else l.eqNullSafe(r)
    same = [equal(F.col(f"l.{k}"), F.col(f"r.{k}"), k) for k in (*keys, "gx", "gy")]
    own = (F.col("l.o.x") != 0) | (F.col("l.o.y") != 0) | (F.col("l.first") < F.col("r.first"))
    on = within(metric, m) & own
    for c in same:
        on = on & c
    return spread.alias("l").join(cells.alias("r"), on).select(F.col("l.first").alias("a"), F.col("r.first").alias("b"))


def settle_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, kept) for each ``late`` of a range of edges (early, late, kept) in order
    of late; kept says what is known of early, and is null where the range before
    must say it.  A range holds all edges of its nodes."""
    known: dict[int, bool | None] = {}
    node, hit, free, kind = None, False, True, None

    def close() -> None:
        if node is not None:
            known[node] = False if hit else True if free else None

    for b in batches:
        nodes, results, kind = [], [], b.schema.field("late").type
        for early, late, kept in zip(*(b.column(c).to_pylist() for c in ("early", "late", "kept"))):
            if late != node:
                close()
                if node is not None:
                    nodes.append(node)
                    results.append(known[node])
                node, hit, free = late, False, True
            if kept is None:
                kept = known.get(early)
            hit, free = hit or kept is True, free and kept is False
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(results, pa.bool_())], ["node", "kept"])
    if node is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array([node], kind), pa.array([known[node]], pa.bool_())], ["node", "kept"])


def greedy_parents(edges: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(node, parent) of the points that are within reach of an earlier kept one;
    parent is the first of those.

    The later points are dealt to ranges of about ``block_edges`` edges, each of which
    one task goes through in order.  A point waits for the next round only if an
    earlier range has yet to decide it.  The first range with undecided points always
    settles, so rounds are bounded by about the number of ranges, however long the
    chains.
    """
    edges = written(edges.select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late")), "edges")
    kind = edges.schema["late"].dataType.simpleString()
    late = edges.select(F.col("late").alias("l")).distinct()
    # What is never the later one is kept.
    first = F.when(F.col("l").isNull(), F.lit(True)).alias("kept")
    left = written(edges.join(late, F.col("early") == F.col("l"), "left").select("early", "late", first), "left")
    kept = left.where("kept").select(F.col("early").alias("node")).distinct()
    while n := left.count():
        parts = -(-n // block_edges)
        ordered = left.repartitionByRange(parts, "late") if parts > 1 else left.coalesce(1)
        round_ = written(ordered.sortWithinPartitions("late", "early").mapInArrow(settle_in_order, f"node {kind}, kept boolean"), "round")
        kept = kept.unionByName(round_.where("kept").select("node"))
        waiting = round_.where("kept is null").select(F.col("node").alias("w"))
        of = round_.where("kept is not null").select(F.col("node").alias("n"), F.col("kept").alias("k"))
        left = left.join(waiting, F.col("late") == F.col("w"), "left_semi").join(of, F.col("early") == F.col("n"), "left")
        left = written(left.select("early", "late", F.coalesce("kept", "k").alias("kept")), "left")
    parents = edges.join(kept, F.col("early") == F.col("node"), "left_semi").groupBy("late").agg(F.min("early").alias("parent"))
    return parents.select(F.col("late").alias("node"), "parent")


def floor_div(value: str, by: int) -> Column:
    return F.expr(f"({value} - pmod({value}, {by})) div {by}")


def mixed(*names: str) -> Column:
    """A number for a place.  As the first key of a sort it settles nearly all of the
    comparisons, which names of chromosomes leave to the columns after them."""
    return F.xxhash64(*KEYS, *names)


def with_cells(df: DataFrame, side: int, metric: str) -> DataFrame:
    """``df`` with the coordinates _u and _v, in which reach is a square, and the cell
    (_x, _y) of ``side`` places that they lie in."""
    u, v = {"max": ("pos1", "pos2"), "sum": ("pos1 + pos2", "pos1 - pos2")}[metric]
    at = df.withColumn("_u", F.expr(f"CAST({u} AS BIGINT)")).withColumn("_v", F.expr(f"CAST({v} AS BIGINT)"))
    return at.withColumn("_x", floor_div("_u", side)).withColumn("_y", floor_div("_v", side))


def tiled(rows: DataFrame, keys: list[str], shift: int) -> DataFrame:
    """``rows`` dealt to tiles of cells, and to those that they lie just outside of, in
    order of first; own says which tile is theirs, and code is their cell in the tile."""
    at = lambda c, d: floor_div(f"({c} + {shift + d})", TILE)
    for c in ("x", "y"):
        rows = rows.withColumn(f"_t{c}", F.explode(F.sequence(at(f"_{c}", -1), at(f"_{c}", 1))))
    own = (F.col("_tx") == at("_x", 0)) & (F.col("_ty") == at("_y", 0))
    inside = lambda c: f"(_{c} + {shift + 1} - _t{c} * {TILE})"
    rows = rows.withColumn("own", own).withColumn("code", F.expr(f"{inside('x')} * {TILE + 4} + {inside('y')}"))
    return rows.repartition(*keys, "_tx", "_ty").sortWithinPartitions(*keys, "_tx", "_ty", "first")


def settle_tiles(keys: list[str], columns: list[str], m: int, width: int):
    """A function that goes through tiles in order and gives out their own points, with
    kept and root; both are null, or root alone of a sure duplicate, where that depends
    on points which another tile must settle."""
    around = [x * width + y for x in (-1, 0, 1) for y in (-1, 0, 1)]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, taken, held = None, {}, {}
        for b in batches:
            lists = lambda *names: (b.column(c).to_pylist() for c in names)  # noqa: B023, E731
            mine, outcomes, roots = [], [], []
            for at, first, u, v, code, own, kept in zip(zip(*lists(*keys, "_tx", "_ty")), *lists("first", "_u", "_v", "code", "own", "kept")):
                if at != tile:
                    tile, taken, held = at, {}, {}
                mine.append(own and not kept)
                if kept:
                    taken[code] = first, u, v
                if kept or kept is False and not own:
                    continue
                best = root = None
                for c in around:
                    t = taken.get(code + c)
                    if t and -m <= t[1] - u <= m and -m <= t[2] - v <= m and (best is None or t[0] < best):
                        best = t[0]
                waits = False
                if held:
                    for c in around:
                        for h in held.get(code + c, ()):
                            if best is not None and h[0] > best:
                                break
                            if -m <= h[1] - u <= m and -m <= h[2] - v <= m:
                                waits = True
                                break
                if best is not None:
                    kept, root = False, None if waits else best
                elif own and not waits:
                    kept, root = True, first
                    taken[code] = first, u, v
                else:
                    held.setdefault(code, []).append((first, u, v))
                if own:
                    outcomes.append(kept)
                    roots.append(root)
            out = b.select(columns).filter(pa.array(mine, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(outcomes, pa.bool_()), pa.array(roots, b.schema.field("first").type)], [*columns, "kept", "root"])

    return settle


def greedy_roots(points: DataFrame, keys: list[str], m: int, metric: str) -> DataFrame:
    """``points`` (keys, pos1, pos2, first and others) with root: the first kept point
    before them that is within reach, or their own first where there is none.

    Tiles lie elsewhere in each round, so what is left has little to wait for in the
    next one, unless chains of points are long.  Once a round settles less than half of
    it, pairs are listed of what is left and the kept points next to it.
    """
    columns = [*points.columns, "_u", "_v", "_x", "_y"]
    kind = points.schema["first"].dataType.simpleString()
    left = with_cells(points, m + 1, metric).withColumn("kept", F.lit(None).cast("boolean")).withColumn("root", F.lit(None).cast(kind))
    schema, shifts, settled, kept, before = left.schema, (0, TILE // 2, TILE // 4, 3 * TILE // 4), [], None, None
    while True:
        rows = tiled(left if kept is None else left.unionByName(kept), keys, shifts[len(settled) % 4])
        done, n = counted(rows.mapInArrow(settle_tiles(keys, columns, m, TILE + 4), schema), "tiles", n=F.count_if(F.col("root").isNull()))
        settled.append(done.where("root is not null"))
        if not n["n"]:
            break
        left, taken = done.where("root is null"), done.where("kept and root is not null")
        spots = left.select(*(F.col(k).alias(f"n{k}") for k in (*keys, "_x", "_y"))).distinct()
        for c in ("n_x", "n_y"):
            spots = spots.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
        on = F.lit(True)
        for k in (*keys, "_x", "_y"):
            on = on & F.col(k).eqNullSafe(F.col(f"n{k}"))
        kept = written((taken if kept is None else kept.unionByName(taken)).join(spots.distinct(), on, "left_semi"), "kept")
        if before is not None and 2 * n["n"] > before:
            near = left.unionByName(kept).select(*keys, F.col("_u").alias("pos1"), F.col("_v").alias("pos2"), "first")
            found = greedy_parents(near_points(near, keys, m, "max"))
            settled.append(left.join(found, F.col("first") == F.col("node"), "left").withColumn("root", F.coalesce("parent", "first")).select(left.columns))
            break
        before = n["n"]
    return reduce(DataFrame.unionByName, settled).select(*points.columns, "root")


def touching_cells(cells: DataFrame, keys: list[str], m: int) -> DataFrame:
    """(a, b, sure, keys, _x, _y, dy) of cells (keys, _x, _y, first, u0, u1, v0, v1) that
    touch and may hold rows within reach; sure says that they do.  _x, _y and dy are of a
    pair whose second cell is (_x + 1, _y + dy).

    Cells meet in blocks of 64 by 64, with the cells just outside that follow one inside,
    so a block has at most 65 * 66 of them and few are copied.
    """
    width = BLOCK + 2
    before = ((0, 0), (-1, -1), (-1, 0), (-1, 1), (0, -1))
    blocks = F.array_distinct(F.array(*(F.struct(floor_div(f"(_x + {x})", BLOCK).alias("x"), floor_div(f"(_y + {y})", BLOCK).alias("y")) for x, y in before)))
    spread = cells.withColumn("own", F.struct(floor_div("_x", BLOCK).alias("x"), floor_div("_y", BLOCK).alias("y"))).withColumn("o", F.explode(blocks))
    spread = spread.select(*keys, "_x", "_y", "o.x", "o.y", (F.col("o") == F.col("own")).alias("inside"), "first", "u0", "u1", "v0", "v1", F.expr(f"(_x - o.x * {BLOCK}) * {width} + _y - o.y * {BLOCK}").alias("code"))
    spread = spread.withColumn("_h", mixed("x", "y"))
    ordered = W.partitionBy("_h", *keys, "x", "y").orderBy("code")
    cell = F.struct("code", "first", "u0", "u1", "v0", "v1")
    near = F.concat(F.collect_list(cell).over(ordered.rangeBetween(1, 1)), F.collect_list(cell).over(ordered.rangeBetween(width - 1, width + 1)))
    met = spread.withColumn("near", near).where("inside").withColumn("r", F.explode("near")).withColumn("step", F.col("r.code") - F.col("code"))
    # Extents of the gap between the two cells' rows: the least and the largest one.
    met = met.withColumn("dx", F.expr("CASE WHEN step = 1 THEN 0 ELSE 1 END")).withColumn("dy", F.expr(f"CASE WHEN step = 1 THEN 1 ELSE step - {width} END"))
    least_u, most_u = "CASE dx WHEN 0 THEN 0 ELSE r.u0 - u1 END", "CASE dx WHEN 0 THEN 0 ELSE r.u1 - u0 END"
    least_v, most_v = "CASE dy WHEN 0 THEN 0 WHEN 1 THEN r.v0 - v1 ELSE v0 - r.v1 END", "CASE dy WHEN 0 THEN 0 WHEN 1 THEN r.v1 - v0 ELSE v1 - r.v0 END"
    sure = F.expr(f"{most_u} <= {m} OR {most_v} <= {m}")
    return met.where(F.expr(f"{least_u} <= {m} AND {least_v} <= {m}")).select(F.col("first").alias("a"), F.col("r.first").alias("b"), sure.alias("sure"), *keys, "_x", "_y", "dy")


def corner_links(rows: DataFrame, pairs: DataFrame, keys: list[str], m: int, count: int) -> DataFrame:
    """(a, b) of those ``pairs``, ``count`` of them, of cells that touch at a corner and
    hold rows within reach.  A cell is reduced to its outermost rows, at most
    max_mismatch + 1 of them; each row of the second cell meets the best one of the first
    that its _u can reach.  Where pairs are few, only their cells' rows are dealt."""
    first = pairs.select("a", "b", "dy", F.lit(0).alias("second"), *keys, "_x", "_y")
    second = pairs.select("a", "b", "dy", F.lit(1).alias("second"), *keys, F.expr("_x + 1").alias("_x"), F.expr("_y + dy").alias("_y"))
    sides = first.unionByName(second)
    on = F.lit(True)
    for k in (*keys, "_x", "_y"):
        on = on & F.col(f"e.{k}").eqNullSafe(F.col(f"s.{k}"))
    if count <= FEW_PAIRS:
        rows = rows.alias("e").join(F.broadcast(sides.select(*keys, "_x", "_y").distinct()).alias("s"), on, "left_semi")
    edge = rows.groupBy(*keys, "_x", "_y", "_u").agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    met = edge.alias("e").join(sides.alias("s"), on)
    met = met.selectExpr("a", "b", "second", f"_u - second * {m} AS reach", "CASE WHEN (dy = 1) = (second = 0) THEN dy * high ELSE dy * low END AS height")
    best = F.max(F.when(F.col("second") == 0, F.col("height"))).over(W.partitionBy("a", "b").orderBy(F.desc("reach"), "second").rowsBetween(W.unboundedPreceding, 0))
    return met.withColumn("best", best).where(f"second = 1 AND height - best <= {m}").select("a", "b").distinct()


def near_cells(rows: DataFrame, cells: DataFrame, keys: list[str], m: int, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(node, parent) of the cells of ``rows`` that an earlier cell's cluster takes in.

    Rows are looked at only for pairs of cells that touch at a corner; where pairs are
    many, only for those that the other pairs have not linked already."""
    sure = F.col("sure")
    pairs, n = counted(touching_cells(cells, keys, m), "touching", sure=F.count_if(sure), open=F.count_if(~sure))
    links, total = pairs.where(sure).select("a", "b"), n["sure"] + n["open"]
    if n["open"] and total <= block_edges:
        links = links.unionByName(corner_links(rows, pairs.where(~sure), keys, m, n["open"]))
    # Written, so that its size is known: few of them spare the cells a shuffle.
    found = written(component_labels(links, total).where("label <> node").select("node", F.col("label").alias("parent")), "found")
    if not n["open"] or total <= block_edges:
        return found

    def ends(df: DataFrame) -> DataFrame:
        """``df`` (a, b) with the labels la and lb."""
        for c in ("a", "b"):
            of = found.select(F.col("node").alias(f"n{c}"), F.col("parent").alias(f"p{c}"))
            df = df.join(of, F.col(c) == F.col(f"n{c}"), "left").withColumn(f"l{c}", F.coalesce(f"p{c}", c))
        return df.where("la <> lb")

    apart, n = counted(ends(pairs.where(~sure)).select(pairs.columns), "apart", n=F.count(F.lit(1)))
    if not n["n"]:
        return found
    corners = written(component_labels(ends(corner_links(rows, apart, keys, m, n["n"])).select(F.col("la").alias("a"), F.col("lb").alias("b")), n["n"]).where("label <> node"), "corners")
    of = corners.select(F.col("node").alias("n"), F.col("label").alias("l"))
    moved = found.join(of, F.col("parent") == F.col("n"), "left").select("node", F.coalesce("l", "parent").alias("parent"))
    return written(moved.unionByName(corners.withColumnRenamed("label", "parent")), "found")


def mark_duplicates(df: DataFrame, max_mismatch: int = 3, metric: str = "max", clustering: str = "transitive", extra_pairs: list[tuple[str, str]] | None = None, order: str = "seq") -> DataFrame:
    """``df`` with outcome (``unmapped``, ``kept`` or ``dup``) and parent, the
    ``order`` value of the row that a duplicate repeats (null for other rows).

    ``order`` is a unique integer that says which row comes first.  Rows whose strands or
    positions are null are kept; nulls in extra columns are equal to each other.
    """
    if clustering not in ("transitive", "greedy"):
        raise PairsError(f"unknown clustering {clustering!r}")
    if metric not in ("max", "sum"):
        raise PairsError(f"unknown metric {metric!r}")
    extra = [c for a, b in extra_pairs or [] for c in dict.fromkeys((a, b))]
    keys = [*KEYS, *extra]
    near = max_mismatch > 0
    by_cell = near and clustering == "transitive"
    side, axes = (max_mismatch + 1, metric) if by_cell else (1, "max")
    known = mapped()
    for c in ("strand1", "strand2", "pos1", "pos2"):
        known = known & F.col(c).isNotNull()
    # Not for Spark a function of the row, so the filter stays above the row's columns
    # instead of repeating their expressions.
    rows = with_cells(df.withColumn("_known", known & (F.spark_partition_id() >= 0)).where("_known"), side, axes)
    extents = [F.min("_u").alias("u0"), F.max("_u").alias("u1"), F.min("_v").alias("v0"), F.max("_v").alias("v1")] if by_cell else []
    cells = rows.groupBy(*keys, "_x", "_y").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"), *extents)
    if near:
        cells = written(cells, "cells")
        if by_cell:
            found = near_cells(rows, cells, keys, max_mismatch)
            cells = cells.join(found, F.col("first") == F.col("node"), "left").withColumn("root", F.coalesce("parent", "first"))
        else:
            points = cells.withColumnsRenamed({"_x": "pos1", "_y": "pos2"})
            cells = greedy_roots(points, keys, max_mismatch, metric).withColumnsRenamed({"pos1": "_x", "pos2": "_y"})
    else:
        cells = cells.withColumn("root", F.col("first"))
    # Only cells with duplicates are joined back, so rows whose place is their own are
    # not dealt by it where those cells are few enough to broadcast.
    shared = written(cells.where("copies > 1 or root <> first").select(*keys, F.col("_x").alias("_sx"), F.col("_y").alias("_sy"), "root", mixed("_x", "_y").alias("_sh")), "shared")
    placed = F.coalesce(mapped(), F.lit(False))
    # Rows without a place would all be dealt to one task; their order spreads them.
    spot = with_cells(df.withColumn("_placed", placed), side, axes).drop("_u", "_v").withColumn("_x", F.when(F.col("_placed") & F.col("_y").isNotNull(), F.col("_x")).otherwise(F.col(order))).withColumn("_h", mixed("_x", "_y"))
    on = (F.col("l._h") == F.col("r._sh")) & F.col("l._placed") & (F.col("l._x") == F.col("r._sx")) & (F.col("l._y") == F.col("r._sy"))
    for k in keys:
        left, right = F.col(f"l.{k}"), F.col(f"r.{k}")
        on = on & (left.eqNullSafe(right) if k in extra else left == right)
    met = spot.alias("l").join(shared.alias("r"), on, "left")
    dup = F.coalesce(F.col("r.root") != F.col(f"l.{order}"), F.lit(False))
    outcome = F.when(~F.col("l._placed"), "unmapped").when(dup, "dup").otherwise("kept")
    return met.select(*(F.col(f"l.`{c}`") for c in df.columns), outcome.alias("outcome"), F.when(dup, F.col("r.root")).alias("parent"))

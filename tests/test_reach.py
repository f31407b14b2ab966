"""Near duplicates at any reach, against a loop over all pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from contactweave.functions.graph import component_labels
from contactweave.model import Header, Pairs
from contactweave.operators import dedup, routing

SCHEMA = "seq long, chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, note string"


def roots(rows, m, metric):
    """Least seq of each row's cluster, by a walk over all pairs."""
    root, todo = {}, sorted(rows)
    for r in todo:
        if r[0] in root:
            continue
        root[r[0]], stack = r[0], [r]
        while stack:
            a = stack.pop()
            for b in todo:
                d = abs(a[2] - b[2]), abs(a[4] - b[4])
                if b[0] not in root and a[1::2] == b[1::2] and a[6] == b[6] and (max(d) if metric == "max" else sum(d)) <= m:
                    root[b[0]] = r[0]
                    stack.append(b)
    return root


@pytest.mark.parametrize("metric", ["max", "sum"])
@pytest.mark.parametrize("m,span,block", [(1, 30, 2), (4, 60, 64), (50, 1_200, 2), (300, 9_000, 64)])
def test_clusters_at_any_reach(spark, monkeypatch, metric, m, span, block):
    monkeypatch.setattr(dedup, "BLOCK", block)
    rng = random.Random(m)
    rows = [(i, rng.choice(["chr1", "chr2"]), rng.randint(1, span), "chr2", rng.randint(1, span), "+", "-", rng.choice(["x", "x", None])) for i in range(700)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["seq"]: r["parent"] for r in dedup.mark_duplicates(df, m, metric, extra_pairs=[("note", "note")]).collect()}
    want = roots(rows, m, metric)
    assert got == {i: None if r == i else r for i, r in want.items()}
    assert 1 < len(set(want.values())) < 600


def test_corners(spark):
    """Cells that touch at a corner only, where the nearest rows are not the cells' extremes."""
    places = [(1, 99), (99, 1), (60, 60), (101, 160), (150, 101), (161, 161), (500, 420), (420, 330), (599, 499), (600, 300)]
    rows = [(i, "chr1", x, "chr1", y, "+", "+", "x") for i, (x, y) in enumerate(places)]
    for m in (99, 90, 60, 41, 40):
        got = {r["seq"]: r["parent"] for r in dedup.mark_duplicates(spark.createDataFrame(rows, SCHEMA), m).collect()}
        assert got == {i: None if r == i else r for i, r in roots(rows, m, "max").items()}, m


@pytest.mark.parametrize("few", [0, 10**5])
def test_corners_of_few_and_many_pairs(spark, monkeypatch, few):
    """Rows of the pairs' cells alone are reduced where pairs are few, all rows else."""
    monkeypatch.setattr(dedup, "FEW_PAIRS", few)
    reduced, links = [], dedup.corner_links
    monkeypatch.setattr(dedup, "corner_links", lambda *a: reduced.append(links(*a)._jdf.queryExecution().optimizedPlan().toString()) or links(*a))
    rng = random.Random(7)
    rows = [(i, "chr1", rng.randint(1, 900), "chr2", rng.randint(1, 900), "+", "-", "x") for i in range(700)]
    got = {r["seq"]: r["parent"] for r in dedup.mark_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), 25).collect()}
    assert got == {i: None if r == i else r for i, r in roots(rows, 25, "max").items()}
    assert reduced and ("LeftSemi" in reduced[0]) == (few > 0)


def test_parents_are_dealt_evenly(spark, monkeypatch):
    """Rows that repeat none have no parent to be dealt by; they don't meet in one task."""
    rows = spark.range(4_000).selectExpr("id AS seq", "concat('r', id) AS readID", "'chr1' AS chrom1", "1 + 10 * (id - id % 10) AS pos1", "'chr2' AS chrom2", "1 + CASE WHEN id % 10 = 1 THEN 0 ELSE 9 * (id % 10) END AS pos2", "'+' AS strand1", "'-' AS strand2", "'UU' AS pair_type")
    monkeypatch.setattr(type(rows), "orderBy", lambda self, *c: self)
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        df = routing.route(Pairs(Header.standard({"chr1": 10**6, "chr2": 10**6}), rows), "main", "main", keep_parent_id=True).main.df
        got = df.select("seq", F.get("_rest", F.lit(0)).alias("named"), F.spark_partition_id().alias("p")).collect()
    finally:
        for k in options:
            spark.conf.unset(k)
    assert {r["seq"]: r["named"] for r in got} == {i: f"r{i - 1 if i % 10 == 1 else i}" for i in range(4_000)}
    dealt = Counter(r["p"] for r in got)
    assert len(dealt) == 4 and max(dealt.values()) < 2_000


def test_a_crowded_cell_costs_rows(spark):
    """40,000 rows of one cell and its neighbours, 800 million near pairs."""
    df = spark.range(40_000).selectExpr("id AS seq", "'chr1' AS chrom1", "1 + id * 7919 % 9000 AS pos1", "'chr1' AS chrom2", "1 + id * 104729 % 9001 AS pos2", "'+' AS strand1", "'-' AS strand2")
    far = spark.range(40_000, 40_001).selectExpr("id AS seq", "'chr1' AS chrom1", "20000L AS pos1", "'chr1' AS chrom2", "30000L AS pos2", "'+' AS strand1", "'-' AS strand2")
    for metric in ("max", "sum"):
        rows = dedup.mark_duplicates(df.unionByName(far), 6_000, metric)
        assert {(r["outcome"], r["parent"]): r["count"] for r in rows.groupBy("outcome", "parent").count().collect()} == {("kept", None): 2, ("dup", 0): 39_999}


def test_rows_without_a_place(spark):
    rows = [(1, "!", 0, "!", 0, "-", "-", ""), (2, "!", 0, "!", 0, "-", "-", ""), (3, None, 5, "chr1", 5, "+", "+", ""), (4, "chr1", None, "chr1", 5, "+", "+", ""), (5, "chr1", None, "chr1", 5, "+", "+", ""),
            (6, "chr1", 5, "chr1", 5, None, "+", ""), (7, "chr1", 5, "chr1", 5, None, "+", ""), (8, "chr1", 5, "chr1", 5, "+", "+", ""), (9, "chr1", 5, "chr1", 5, "+", "+", "")]
    for options in ({}, {"max_mismatch": 0}, {"metric": "sum"}, {"clustering": "greedy"}):
        got = {r["seq"]: (r["outcome"], r["parent"]) for r in dedup.mark_duplicates(spark.createDataFrame(rows, SCHEMA), **options).collect()}
        assert got == {**dict.fromkeys((1, 2, 3), ("unmapped", None)), **dict.fromkeys((4, 5, 6, 7, 8), ("kept", None)), 9: ("dup", 8)}
        assert dedup.mark_duplicates(spark.createDataFrame([], SCHEMA), **options).count() == 0


@pytest.mark.parametrize("block_edges", [0, 10**6])
def test_labels(spark, block_edges):
    """Chains, stars and rings, in one task and in rounds."""
    rng, edges = random.Random(3), []
    for base in range(0, 4000, 1000):
        names = rng.sample(range(base, base + 1000), 300)
        edges += [(names[i], names[i + 1]) for i in range(99)] + [(names[100], n) for n in names[101:200]] + [(names[200 + i], names[200 + (i + 1) % 100]) for i in range(100)]
    best = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(best[a], best[b])
            changed |= best[a] != low or best[b] != low
            best[a] = best[b] = low
    got = component_labels(spark.createDataFrame(edges, "a long, b long"), block_edges=block_edges)
    assert {r["node"]: r["label"] for r in got.collect()} == best


@pytest.mark.parametrize("side", [170, 1])
def test_labels_of_long_graphs(spark, side):
    """A band 170 wide, or a path, of 28,900 nodes whose names are in no order: far more
    steps across than rounds, and more edges than a block."""
    rng = random.Random(side)
    names = rng.sample(range(10**6), 28_900)
    edges = [(names[i], names[i + 1]) for i in range(len(names) - 1) if side == 1 or (i + 1) % side] + [(names[i], names[i + side]) for i in range(len(names) - side)]
    got = component_labels(spark.createDataFrame(edges, "a long, b long").repartition(7), block_edges=1_000)
    assert {r["node"]: r["label"] for r in got.collect()} == dict.fromkeys(names, min(names))


@pytest.mark.parametrize("metric", ["max", "sum"])
@pytest.mark.parametrize("span", [60, 110])
def test_clusters_of_more_links_than_a_block(spark, monkeypatch, metric, span):
    """Links of cells that rounds contract, and corners that are looked at afterwards."""
    labels = dedup.component_labels
    monkeypatch.setattr(dedup.near_cells, "__defaults__", (20,))
    monkeypatch.setattr(dedup, "component_labels", lambda edges, count: labels(edges, count, 20))
    rng = random.Random(span)
    rows = [(i, "chr1", rng.randint(1, span), "chr2", rng.randint(1, span), "+", "-", "") for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["seq"]: r["parent"] for r in dedup.mark_duplicates(df, 2, metric).collect()}
    assert got == {i: None if r == i else r for i, r in roots(rows, 2, metric).items()}


def greedy(rows, m, metric):
    """Parent of each row: the first row before it that is kept and within reach."""
    kept, parents = [], {}
    for r in sorted(rows):
        near = (k for k in kept if k[1::2] == r[1::2] and k[6] == r[6] and {"max": max, "sum": lambda d: sum(d)}[metric]((abs(k[2] - r[2]), abs(k[4] - r[4]))) <= m)
        parents[r[0]] = next((k[0] for k in near), None)
        kept += [r] if parents[r[0]] is None else []
    return parents


@pytest.mark.parametrize("metric", ["max", "sum"])
@pytest.mark.parametrize("m,span,listed", [(1, 40, False), (3, 90, False), (40, 1_500, False), (1, 40, True)])
def test_greedy_by_tiles(spark, monkeypatch, metric, m, span, listed):
    """Tiles of four cells, over several rounds; sorted rows wait in chains, whose rest
    may be listed in pairs."""
    monkeypatch.setattr(dedup, "TILE", 4)
    calls = []
    near_points = dedup.near_points
    monkeypatch.setattr(dedup, "near_points", lambda *a: calls.append(1) or near_points(*a))
    rng = random.Random(m)
    places = [(rng.randint(1, span), rng.randint(1, span)) for _ in range(1_200)]
    places = sorted(places) if listed else places
    rows = [(i, "chr1", x, "chr2", y, "+", "-", rng.choice(["x", None]) if not listed else None) for i, (x, y) in enumerate(places)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["seq"]: r["parent"] for r in dedup.mark_duplicates(df, m, metric, "greedy", extra_pairs=[("note", "note")]).collect()}
    assert got == greedy(rows, m, metric)
    assert calls or not listed or metric == "sum"


def test_greedy_lists_no_pairs(spark, monkeypatch):
    """20,000 rows of a few cells, over 100 million near pairs."""
    monkeypatch.setattr(dedup, "near_points", None)
    df = spark.range(20_000).selectExpr("id AS seq", "'chr1' AS chrom1", "1 + id * 7919 % 9000 AS pos1", "'chr1' AS chrom2", "1 + id * 104729 % 9001 AS pos2", "'+' AS strand1", "'-' AS strand2")
    got = {r["seq"]: r["parent"] for r in dedup.mark_duplicates(df, 6_000, clustering="greedy").collect()}
    rows = [tuple(r) for r in df.collect()]
    assert got == greedy(rows, 6_000, "max")

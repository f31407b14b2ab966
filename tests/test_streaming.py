"""Duplicates of sorted pairs that arrive bit by bit, against the whole table and loops."""

import random

import pytest
from test_reach import SCHEMA, roots

from contactweave.model import NotSorted
from contactweave.operators import dedup
from contactweave.streaming.duplicates import DuplicateStream


def sorted_rows(n, span, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["chr1", "chr10", "chr2"]), rng.randint(1, span), "chr2", rng.randint(1, 12), "+", rng.choice("+-"), rng.choice(["x", None])) for _ in range(n)]
    rows.sort(key=lambda r: (r[0], r[2], r[1]))
    return [(i, *r) for i, r in enumerate(rows)]


def cut(rows, seed):
    rng = random.Random(seed)
    at = sorted(rng.sample(range(1, len(rows)), 3))
    return [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)])]


def result(df):
    return sorted((r["seq"], r["outcome"], r["parent"]) for r in df.collect())


@pytest.mark.parametrize("metric, m", [("max", 2), ("sum", 4)])
def test_clusters_that_span_batches(spark, tmp_path, metric, m):
    rows = sorted_rows(260, 240, m)
    # Which row of a cluster comes first need not be the order in which they arrive.
    rows = [(997 * r[0] % 260, *r[1:]) for r in rows]
    stream = DuplicateStream(f"file://{tmp_path}/s", m, metric)
    for k, part in enumerate(cut(rows, m)):
        random.Random(k).shuffle(part)
        stream.take(spark.createDataFrame(part, SCHEMA), k)
        if k == 1:  # a batch that fails after its commit is run again
            stream.take(spark.createDataFrame(part, SCHEMA), k)
        assert stream.open_rows(spark).count() < 60
        assert len(stream.batches(spark)) <= 2
    given = {r[0] for r in result(stream.outcomes(spark))}
    assert given.isdisjoint(r["seq"] for r in stream.open_rows(spark).collect())
    stream.finish(spark)
    stream.finish(spark)
    want = roots([(*r[:7], None) for r in rows], m, metric)
    assert result(stream.outcomes(spark)) == sorted((i, "kept" if r == i else "dup", None if r == i else r) for i, r in want.items())
    assert 20 < len(set(want.values())) < 250


def test_a_chain_stays_open_until_it_is_passed(spark, tmp_path):
    """A late row joins two clusters of earlier batches."""
    at = lambda i, x, y: (i, "chr1", x, "chr1", y, "+", "+", "x")
    stream = DuplicateStream(f"file://{tmp_path}/s")
    take = lambda k, *rows: stream.take(spark.createDataFrame(rows, SCHEMA), k)
    take(0, at(5, 10, 10), at(1, 11, 16))
    take(3, at(7, 12, 13))
    assert stream.outcomes(spark).count() == 0 and stream.open_rows(spark).count() == 3
    take(4, (8, "!", 0, "!", 0, "-", "-", "x"), (9, "chr1", 9, "chr1", None, "+", "+", "x"))
    assert result(stream.outcomes(spark)) == [(8, "unmapped", None), (9, "kept", None)]
    take(5)
    take(6, at(20, 16, 900))
    assert result(stream.outcomes(spark))[:3] == [(1, "kept", None), (5, "dup", 1), (7, "dup", 1)]
    with pytest.raises(NotSorted):
        take(7, at(21, 15, 1))
    with pytest.raises(NotSorted):
        take(7, (21, "chr0", 15, "chr1", 1, "+", "+", "x"))
    assert [r["seq"] for r in stream.open_rows(spark).collect()] == [20]


def test_greedy_rows_expire(spark, tmp_path):
    rows = sorted_rows(260, 240, 9)
    stream = DuplicateStream(f"file://{tmp_path}/s", clustering="greedy", extra_pairs=[("note", "note")])
    for k, part in enumerate(cut(rows, 9)):
        stream.take(spark.createDataFrame(part, SCHEMA), k)
        assert all(r["pos1"] >= max(p[2] for p in part if p[1] == part[-1][1]) - 3 for r in stream.open_rows(spark).collect())
    stream.finish(spark)
    kept, want = [], []
    for r in rows:
        near = [k for k in kept if k[1::2] == r[1::2] and k[6] == r[6] and max(abs(k[2] - r[2]), abs(k[4] - r[4])) <= 3]
        want.append((r[0], "dup", near[0][0]) if near else (r[0], "kept", None))
        kept += [] if near else [r]
    assert result(stream.outcomes(spark)) == want
    with pytest.raises(NotSorted):
        stream.take(spark.createDataFrame([(3, "chr3", 1, "chr3", 1, "+", "+", "x")], SCHEMA), 9)


def test_files_as_they_come(spark, tmp_path):
    rows = sorted_rows(120, 90, 4)
    source, stream = str(tmp_path / "in"), DuplicateStream(f"file://{tmp_path}/s")
    for part in cut(rows, 4):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(source)
        query = stream.start(spark.readStream.schema(SCHEMA).parquet(source))
        assert query.awaitTermination(120)
    stream.finish(spark)
    assert result(stream.outcomes(spark)) == result(dedup.mark_duplicates(spark.createDataFrame(rows, SCHEMA)))

"""Benchmark windows and the whole pipeline against plain loops."""

import random

import pytest

import corpus_pipeline
from contactweave.llm import decontam, neardup

WORDS = [c * (1 + i % 9) + str(i) for i in range(900) for c in "etaoin"[i % 6]]


def similarity(a, b):
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    weight = lambda s: sum(len(x) for t in s for x in t)
    return weight(cut(a) & cut(b)) / weight(cut(a) | cut(b))


def anchored(w, b):
    """Starts at which a five-word shingle of the item meets itself."""
    return {p - i for p in range(len(w) - 4) for i in range(len(b) - 4) if w[p : p + 5] == b[i : i + 5]}


def item_sized(w, b):
    return range(max(1, len(w) - len(b) + 1))


def best(text, item, starts=item_sized):
    """The highest similarity of the windows at these starts."""
    w, b = text.lower().split(), item.lower().split()
    return max((similarity(w[max(0, i) : i + len(b)], b) for i in starts(w, b)), default=0.0)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + rng.choice([0, 1, 1])] = rng.choice([[], ["Edit%d" % rng.randrange(99)]])
    return w


def passages():
    """Items, and documents that hold one with up to four edits or cut at its ends."""
    rng = random.Random(11)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(15, 59)))) for i in range(10)]
    docs = []
    for d in range(150):
        w = edited(rng, items[d % 10][1].split(), d // 10 % 5)
        w = w[rng.choice([0, 0, 2]) : len(w) - rng.choice([0, 0, 3])]
        docs.append((d, " ".join([*rng.choices(WORDS, k=rng.choice([0, 7, 60])), *w, *rng.choices(WORDS, k=rng.choice([0, 5, 40]))])))
    return items, docs


@pytest.fixture(scope="module")
def found(spark):
    items, docs = passages()
    of = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    return {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.leaks(of(docs, "doc_id"), of(items, "item_id")).collect()}


def wanted(starts):
    items, docs = passages()
    return {(d, i): s for d, t in docs for i, b in items if (s := best(t, b, starts)) >= 0.75}


def test_leaks_against_anchored_windows(found):
    """The radius loses none of the windows that are laid."""
    want = wanted(anchored)
    assert 30 < len(want) < 140 and sum(s < 0.85 for s in want.values()) > 8
    assert set(want) <= set(found) and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_leaks_against_all_item_sized_windows(found):
    """Windows at other starts are found too, and nothing else."""
    want = wanted(item_sized)
    assert set(found) == set(want) | set(wanted(anchored)) and len(set(want) - set(wanted(anchored))) == 1


def test_run_against_loops(spark, tmp_path):
    """Of 40 documents with a copy, an edited copy, an unusable text and two leaks,
    the run's tokens are those of the documents that loops leave."""
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["the", "of", "and", "to"]) if k % 4 == 0 else rng.choice(WORDS) for k in range(200)) + "."
    texts = [text() for _ in range(40)]
    item = " ".join(rng.choices(WORDS, k=40))
    texts += [texts[3], texts[4].replace(".", " end."), "# # # | |", texts[5][:300] + " " + item + " " + texts[6][:300], texts[7][:300] + " " + " ".join(edited(rng, item.split(), 1))]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = {i for i, t in enumerate(texts) if "|" not in t}
    sets = {i: set(neardup.shingles(texts[i]).tolist()) for i in good}
    first = {i for i in good if not any(j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in good)}
    want = {i for i in first if best(texts[i], item) < 0.75}
    assert want == set(range(40))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == want


ODD = "doc_id long, text string, lang string, source string, n_chars long, _k1 int, _row string, shard int"


@pytest.mark.parametrize("rows", [0, 1])
def test_run_on_odd_rows(spark, tmp_path, rows):
    """Nulls in any column, empty and long texts, repeated rows and ids, clashing names, and no rows at all."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    a, b, item = text(80), text(90), text(30)
    docs = [(1, a, "en", "s"), (1, b, None, None), (1, a, "en", "s"), (2, a, "en", "s"), (None, text(70), None, None), (None, b, None, "s"), (3, None, None, None), (4, "", "en", "s"), (5, text(60) + " " + item, "en", "s"), (None, text(60) + " " + item, "en", "s"), (6, text(20_000), "en", "s")]
    table = [(i, t, lang, s, None, 1, "x", None) for i, t, lang, s in docs] if rows else []
    spark.createDataFrame(table, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)] if rows else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == [c.split()[0] for c in ODD.split(", ")]
    left = sorted((str(r["doc_id"]), len(r["text"].split())) for r in kept.collect())
    assert left == ([("1", 80), ("1", 90), ("6", 20_000), ("None", 70)] if rows else [])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {str(r["doc_id"]) for r in got} <= {"1", "6", "None"} and bool(got) == bool(rows)

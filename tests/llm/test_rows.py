"""Rows that share ids or have none, hot groups' rules, shards, layouts and page differencing."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactweave.llm import base, chat, decontam, langid, mixing, neardup, pagetext, quality, tokenfile, urlfilter, warc

text = lambda k, n: " ".join(f"{k}{i}" for i in range(n))


def rows_of(spark, rows, kinds="doc_id long, text string, source string, n_chars long, _k1 int, k1 string"):
    return spark.createDataFrame(rows, kinds)


def docs_of(spark, pairs):
    return rows_of(spark, [(i, t, "s", 0, 1, "x") for i, t in pairs])


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_near_copies_go_by_row(spark):
    a, b, c = text("a", 60), text("b", 60), text("c", 60)
    given = docs_of(spark, [(3, a), (7, a), (7, b), (8, b), (8, b), (9, c), (9, c), (None, c), (None, text("d", 60)), (None, text("d", 59)), (5, None), (5, None), (6, " ")])
    got = neardup.without_near_duplicates(given)
    assert got.columns == given.columns
    one = [t for i, t in left(got) if i is None]
    assert len(one) == 1 and one[0].startswith("d0")
    assert left(got.where("doc_id is not null")) == sorted([(3, a), (7, b), (9, c), (5, None), (5, None), (6, " ")], key=str)


def test_leaks_go_by_row(spark):
    item = text("w", 30)
    bench = spark.createDataFrame([(1, item), (1, item), (2, item + " x")], "item_id long, text string")
    leak = "pad " * 9 + item
    given = docs_of(spark, [(1, leak), (1, text("c", 50)), (None, leak), (None, text("d", 50)), (2, text("e", 50)), (2, text("e", 50)), (4, leak), (4, leak), (3, None), (3, "")])
    got = decontam.without_leaks(given, bench)
    assert got.columns == given.columns
    assert left(got) == sorted([(1, text("c", 50)), (None, text("d", 50)), (2, text("e", 50)), (2, text("e", 50)), (3, None), (3, "")], key=str)
    found = sorted((str(r["doc_id"]), r["item_id"]) for r in decontam.leaks(given, bench).collect())
    assert found == sorted((d, i) for d in ("1", "None", "4") for i in (1, 2))


def test_fingerprints_within_the_radius_meet_once(spark):
    rng = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for n in range(300):
        x = rng.getrandbits(128)
        turned = rng.sample(range(128), 23 if n % 3 else rng.randrange(24))
        y = x ^ sum(1 << b for b in turned)
        rows.append((n, signed(x >> 64), signed(x & (1 << 64) - 1), signed(y >> 64), signed(y & (1 << 64) - 1)))
    df = spark.createDataFrame(rows, "n int, a0 long, a1 long, b0 long, b1 long")
    left_, right = (decontam.blocked(df.select("n", F.col(f"{s}0").alias("fp0"), F.col(f"{s}1").alias("fp1"))) for s in "ab")
    right = right.select(*(F.col(c).alias(f"i_{c}") for c in right.columns))
    x0, x1 = F.col("fp0").bitwiseXOR(F.col("i_fp0")), F.col("fp1").bitwiseXOR(F.col("i_fp1"))
    met = left_.join(right, (F.col("n") == F.col("i_n")) & (F.col("slot") == F.col("i_slot")) & decontam.met_here(x0, x1, F.col("block"), F.col("turn"), F.col("i_turn")))
    assert sorted(r["n"] for r in met.select("n").collect()) == list(range(300))
    with pytest.raises(ValueError):
        decontam.found_rows(df, df, decontam.Match(radius=24), "n", "n")


def test_a_bad_host_loses_its_documents(spark):
    """19 hosts fail at about a tenth; one fails at half: the prior's tail rejects it."""
    good = lambda k: text(k, 60)
    rows = [(100 * h + i, "few words" if i % 10 == 0 else good(f"h{h}d{i}w"), f"s{h}", 0, 1, "x") for h in range(19) for i in range(40)]
    rows += [(9000 + i, "few words" if i % 2 else good(f"b{i}w"), "bad", 0, 1, "x") for i in range(40)] + [(9999, good("n"), None, 0, 1, "x")]
    df = rows_of(spark, rows, "doc_id long, text string, source string, n_chars long, _n_words int, _text string")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    base_ok = {i for i, r in got.items() if not r["base_failed"]}
    assert {i for i, r in got.items() if r["kept"]} == {i for i in base_ok if i < 9000 or i == 9999}
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    no_tail = quality.judge(df, limits=quality.Limits(host_rate=1.0))
    assert no_tail.where("kept").count() == len(base_ok)


def laid(spark):
    rng = random.Random(4)
    return rows_of(spark, [(i, " ".join(f"t{i}w{k}" for k in range(rng.randrange(400))), ["a", "b", "c", None][i % 7 % 4], 0, 1, "x") for i in range(120)])


MIX = mixing.Mix(block=32, slots_per_shard=40)


def test_draws_fill_shards(spark):
    docs = laid(spark)
    _, plan = mixing.prepare(docs, MIX, "doc_id", "text", "source")
    counts: dict = {}
    for r in mixing.shard_counts(spark, plan, MIX).collect():
        counts.setdefault(r["shard"], {})[r["at"]] = r["slots"]
    total = sum(p["slots"] for p in plan)
    n = -(-total // 40)
    assert all(sum(counts[k].values()) == 40 for k in range(n - 1)) and sum(counts[n - 1].values()) == total - 40 * (n - 1)
    for k in range(n - 1):
        for p in plan:
            assert 0 <= counts[k].get(p["at"], 0) - 40 * p["slots"] // total <= len(plan)
    assert len({tuple(sorted(counts[k].items())) for k in range(n - 1)}) > 1
    slots = mixing.drawn_slots(mixing.shard_counts(spark, plan, MIX), plan, MIX).collect()
    for p in plan:
        mine = [r for r in slots if r["source"] == p["source"]]
        assert sorted(r["rank"] for r in mine) == list(range(p["slots"])) and sum(r["take"] for r in mine) == min(round(p["target"]), 3 * p["source_size"])
        first = sorted(r["block"] for r in mine if r["pass"] == 0)
        assert len(set(first)) == len(first)


def test_takes_and_blocks_against_a_loop(spark):
    """Every document's words, and every block's text, from the slots alone; other draws deal
    other shards."""
    docs = laid(spark)
    rows, plan = mixing.prepare(docs, MIX, "doc_id", "text", "source")
    slots = mixing.drawn_slots(mixing.shard_counts(spark, plan, MIX), plan, MIX).collect()
    streams: dict = {}
    words = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    for r in sorted(mixing.laid_out(rows, MIX).where("size > 0").collect(), key=lambda r: r["first"]):
        stream = streams.setdefault(r["source"], [])
        assert r["first"] == len(stream)
        stream += [(r["doc_id"], w) for w in words[r["doc_id"]]]
    want, shard_of, blocks = dict.fromkeys(words, 0), {}, {}
    for s in slots:
        cut = streams[s["source"]][32 * s["block"] :][: s["take"]]
        for d, _ in cut:
            want[d] += 1
            shard_of[d] = min(s["shard"], shard_of.get(d, s["shard"]))
        blocks.setdefault(s["shard"], []).append((s["source"], s["block"], [w for _, w in cut]))
    got = {r["doc_id"]: r for r in mixing.mix_report(docs, MIX).collect()}
    assert {d: r["taken"] for d, r in got.items()} == want and {d: r["first_shard"] for d, r in got.items() if r["taken"]} == shard_of
    made: dict = {}
    for r in mixing.mixed_blocks(docs, MIX).collect():
        made.setdefault(r["shard"], []).append((r["source"], r["block"], r["text"].split()))
        assert r["tokens"] == len(r["text"].split())
    key = lambda x: (str(x[0]), x[1], x[2])
    assert {k: sorted(v, key=key) for k, v in made.items()} == {k: sorted(v, key=key) for k, v in blocks.items()}
    other = {r["doc_id"]: r["first_shard"] for r in mixing.mix_report(docs, mixing.Mix(block=32, slots_per_shard=40, seed=21)).collect()}
    assert other != {d: r["first_shard"] for d, r in got.items()}


def test_written_shards(spark, tmp_path):
    back = mixing.write_blocks(laid(spark), f"{tmp_path}/blocks", MIX)
    sizes = {r["shard"]: (r["n"], r["m"]) for r in back.groupBy("shard").agg(F.count("place").alias("n"), F.max("place").alias("m")).collect()}
    assert len(sizes) > 5 and all(n == m <= 40 for n, m in sizes.values())


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.mix_report(laid(spark))


def test_extra_fields_and_parts_keep_their_turns(spark):
    records = [
        '{"conv_id":1,"meta":{"x":1},"messages":[{"role":"user","content":"hi","name":"n"},{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}]}',
        '{"conv_id":2,"prompt":"p","completion":"c","meta":{"messages":1}}', '{"conv_id":3,"messages":[]}', '{"id":4,"messages":[{"role":"user","content":null}],"tools":[]}',
        '{"conv_id":5,"instruction":"i","output":"o","input":"in"}', '{"conv_id":6,"turn":0,"role":"user","text":"t","score":1}', '{"conv_id":6,"turn":0,"role":"user","text":"t","score":1}',
        '{"conv_id":7,"x":1}', '{"conv_id":8,"x":2}', "no json", None, '{"conv_id":9,"question":"' + "q " * 50_000 + '","answer":"r"}',
    ]
    df = spark.createDataFrame([(r, "clash") for r in records], "record string, layout string")
    turns = [(r["conv_id"], r["layout"], r["turn"], r["role"], r["text"]) for r in chat.canonical_turns(df).collect()]
    by = lambda c: [t[1:] for t in turns if t[0] == c]
    assert by(1) == [("messages", 0, "user", "hi"), ("messages", 1, "assistant", "ab")]
    assert by(2) == [("prompt", 0, "user", "p"), ("prompt", 1, "assistant", "c")] and by(3) == [("messages", None, None, None)]
    assert by(4) == [("messages", 0, "user", None)] and by(5)[0][3] == "i\nin" and by(6) == [("turn rows", 0, "user", "t")] * 2
    assert by(7) == by(8) == [(None,) * 4] and len(by(None)) == 2 and len(by(9)[0][3]) == 100_000
    unknown = {tuple(r["paths"]): r["n"] for r in chat.unknown_layouts(df).collect()}
    assert unknown == {("conv_id", "x"): 2, (): 2}


def test_record_ids_are_unique_and_payloads_checked(spark, tmp_path):
    pages = spark.createDataFrame([(1, "A"), (1, "A"), (5, "A"), (5, "B"), (7, "B"), (None, "A"), (None, "A"), (None, None)], "page_id long, html string").withColumn("url", F.lit("u"))
    folder = f"file://{tmp_path}/w"
    names = warc.write_archives(pages, folder, date="2026-01-01T00:00:00Z")
    fields = [f for r in names.collect() for f, _ in warc.records_of((tmp_path / "w" / r["name"]).read_bytes())]
    ids = [f["warc-record-id"] for f in fields]
    assert len(set(ids)) == 8 and {f["warc-date"] for f in fields} == {"2026-01-01T00:00:00Z"}
    revisits = [f for f in fields if f["warc-type"] == "revisit"]
    assert sorted(f["warc-refers-to-page-id"] for f in revisits) == ["1", "1", "1", "5"]
    assert all(f["warc-refers-to"] in ids for f in revisits if "warc-refers-to" in f) and sum("warc-refers-to" in f for f in revisits) == 1
    one = warc.record(1, "u", b"A", warc.digest(b"B"), "2026-01-01T00:00:00Z")
    (tmp_path / "w" / "bad.warc.gz").write_bytes(__import__("gzip").compress(one))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_archives(spark.createDataFrame([("bad.warc.gz",)], "name string"), folder).collect()


def loop_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("cells", [1, 50, 1 << 28])
def test_alignments_are_longest(monkeypatch, cells):
    monkeypatch.setattr(pagetext, "CELLS", cells)
    rng = random.Random(cells)
    for _ in range(150):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(80))] for _ in range(2))
        shared = pagetext.common(a, b)
        assert len(shared) == len(a) and sum(shared) == loop_lcs(a, b)
        at = 0
        for x in (x for x, s in zip(a, shared) if s):  # what is shared is a subsequence of b
            at = b.index(x, at) + 1


def site(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def test_differencing_decides(spark):
    """Unmarked furniture goes from pages with and without an article; quotes and near copies stay."""
    own = lambda k: "".join(f"<p>{k} {i}</p>" for i in range(6))
    art = lambda k, quote="": f"<div>Top</div><article><p>Sign up now</p>{own(k)}{quote}<p>{k} end</p><p>Read more</p></article><div>Foot</div>"
    quote = "<p>A quote</p>"
    pages = [(i, f"http://h/{i}", art(f"k{i}", quote)) for i in range(5)]
    pages += [(10 + i, f"http://g/a/{i}", f"<div>Top</div>{own(f'g{i}')}<div>Foot</div>") for i in range(4)]
    pages += [(20 + i, f"http://n/{i}", f"<article>{own('same')}<p>other {i}</p></article>") for i in range(3)]
    pages += [(30, "http://h/2", art("k2", quote)), (31, "http://one/", art("z")), (32, None, None), (33, None, art("y")), (34, "http://x/" + "p" * 9000, "<p>" + "long " * 200_000)]
    got = {r["page_id"]: r["text"] for r in pagetext.main_text(site(spark, pages).withColumn("host", F.lit("clash"))).collect()}
    lines = lambda k, *more: "\n".join([*(f"{k} {i}" for i in range(6)), *more])
    for i in range(1, 4):
        assert got[i] == lines(f"k{i}", "A quote", f"k{i} end")
    assert got[0] == "Sign up now\n" + lines("k0", "A quote", "k0 end") + "\nRead more"  # it has one neighbour only
    assert got[30] == got[2]
    for i in range(4):
        assert got[10 + i] == lines(f"g{i}")
    for i in range(3):
        assert got[20 + i] == lines("same", f"other {i}")
    assert got[31].startswith("Sign up now") and got[32] == "" and len(got[34]) == 999_999
    alone = {r["page_id"]: r["text"] for r in pagetext.main_text(site(spark, pages[:5]).withColumn("url", F.concat(F.lit("http://"), F.col("page_id").cast("string"), F.lit("/")))).collect()}
    assert all(alone[i] != got[i] for i in range(1, 4))


def test_short_way_gives_the_tokenizers_ids():
    """All pairs of characters and random texts."""
    encoder = tokenfile.encoder_of(tokenfile.default_vocabulary())
    assert encoder.fast
    latin = [c for c in map(chr, range(33, 256)) if c.isprintable()]
    rng = random.Random(9)
    texts = [" ".join(a + b for b in latin) for a in latin]
    texts += ["".join(rng.choice(latin + [" "] * 40 + list("'st're\n\t") * 3) for _ in range(300)) for _ in range(300)]
    for t in texts:
        if not any(m in t for m in encoder.marks):
            assert encoder._short(t) == encoder._long(t), t
    encoder.parts.clear()


def test_coding_in_chunks(monkeypatch):
    monkeypatch.setattr(tokenfile, "CHUNK", 2)
    ids = np.random.default_rng(1).integers(0, 70_000, 9_001).astype(np.uint64)
    coder = tokenfile.Coder()
    for at in range(0, len(ids), 777):
        coder.add(ids[at : at + 777])
    words, offsets = coder.finish()
    assert (tokenfile.decode(words, offsets, len(ids)) == ids).all() and coder.n_ids == len(ids)
    monkeypatch.setattr(tokenfile, "CHUNK", 256)
    whole = tokenfile.encode(ids)
    assert (whole[0] == words).all() and (whole[1] == offsets).all()


def test_samples_of_copies_are_bounded(spark):
    rows = [(i, "der die das " * 9, "de") for i in range(500)] + [(i, f"the of {i} and", "en") for i in range(500, 540)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = langid.label(df, langid.Fit(docs_per_lang=20, words_per_lang=30, steps=60))
    assert got.where("lang_pred = 'de'").count() >= 500
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.select("doc_id", "held_out").collect())


def test_very_long_and_odd_urls(spark):
    pages = spark.createDataFrame([(1, "h://a.com/en/" + "x" * 100_000), (2, "://com/en/"), (3, "h://" + "a." * 5000 + "com/en/1")], "page_id long, url string")
    rules = spark.createDataFrame([("com/en/", "block")], "rule string, verdict string")
    assert {r["page_id"]: r["verdict"] for r in urlfilter.judge_urls(pages, rules).collect()} == {1: "block", 2: "block", 3: "block"}


def test_unused_names():
    assert base.unused(["a", "_A"], "A") == "__A"


@pytest.mark.parametrize("n", [0, 1, 1023, 1025, 262145])
@pytest.mark.parametrize("top, escapes", [(50_000, False), (3, False), (3, True)])
def test_ids_come_back_with_and_without_escapes(n, top, escapes):
    r = np.random.default_rng(n)
    ids = r.integers(0, top, n).astype(np.uint64)
    if escapes and n:
        ids[r.integers(0, n, 3)] = np.uint64(2**63 + 5)
    words, offsets = tokenfile.encode(ids)
    assert np.array_equal(tokenfile.decode(words, offsets, n), ids)
    if n and not escapes:
        assert np.array_equal(tokenfile.decode_plain(words[: offsets[256]] if len(offsets) > 256 else words, offsets[:256], min(n, 1 << 18)), ids[: 1 << 18])


def test_remembered_parts_stay_bounded():
    known = tokenfile._Known(str.encode, 3)
    assert [known[x] for x in "abcabdea"] == [x.encode() for x in "abcabdea"]
    assert len(known) <= 3

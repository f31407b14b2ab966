import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contactweave.llm import chat, decontam, langid, mixing, neardup, pagetext, quality, tokenfile, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rule string, bucket int"
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(f"x{i % 997}y{i % 13}" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows and clashing columns."""
    texts = [None, "", " \n\t", LONG, "one two", " ".join(WORDS[:60]), " ".join(WORDS[:60]), " ".join(WORDS[:58] + ["q", "r"]), "a b c " * 40]
    rows = [(i, t, [None, "en"][i % 2], ["s1", None, "s2"][i % 3], 0, "r", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, " ".join(WORDS[:60]), "en", "s1", 0, "r", 1)], DOCS)


def none_of(df):
    return df.where("1 = 0")


def test_mixing(docs):
    got = mixing.mix_report(docs).collect()
    assert len(got) == 11 and all(r["taken"] <= 3 * r["size"] for r in got)
    total, want = {}, {}
    for r in got:
        total[r["source"]] = total.get(r["source"], 0) + r["taken"]
        want[r["source"]] = r["target"]
    assert all(abs(total[s] - want[s]) <= 1 for s in want)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_report(docs).collect()), key=str)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("[^ \\t-\\r]+"))).alias("n")).collect()}
    assert words == {s: n for s, n in total.items() if n}
    assert mixing.mix_report(none_of(docs)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutations_are_bijections(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3), 20).alias("x")).collect()
    assert sorted(r["x"] for r in got) == list(range(n))


def test_shares_reshare_the_excess():
    got = mixing.shares({"a": 10, "b": 1000, "c": 1000, None: 0})
    assert got["a"] == 30 and got[None] == 0 and abs(sum(got.values()) - 2010) < 1e-9


def test_quality(docs):
    assert quality.measure("a b c a b c x\ny\ny # |") == (11, 11, 2, 0, 6)
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert got[0]["base_failed"] and not got[0]["kept"] and got[5]["kept"] and got[8]["base_failed"]
    assert quality.judge(docs).count() == 11 and quality.judge(none_of(docs)).count() == 0
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and good.where("doc_id = 5").count() == 2


def test_urls(spark):
    urls = ["http://a.example.com/en/7x", "https://COM/en/", None, "nothing", "x://xcom/en/", "h://q.example.net/de/8?z", "h://m.org/es/1#t", "h://m.org", "h://m.org/es/1#t"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame([("com/en/", "block"), ("example.com/en/7", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block")], "rule string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, rules).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[1] == ("com", "/en/", "com/en/", "block")
    assert got[2] == got[3] == ("", "", None, "allow") and got[4][2] is None
    assert got[5][2:] == ("example.net/de/8", "block") and got[6][3] == got[8][3] == "block" and got[7] == ("m.org", "", None, "allow")
    assert urlfilter.judge_urls(pages, rules.where("1 = 0")).count() == 9 and urlfilter.judge_urls(none_of(pages), rules).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [1] * 3000, [2**64 - 1, 5, 2**60, 2**60 - 1], list(range(5000)), [49407, 3, 70000] * 800])
def test_simple8b_round_trip(ids):
    a = np.array(ids, np.uint64)
    words, offsets = tokenfile.encode(a)
    assert (tokenfile.decode(words, offsets, len(a)) == a).all()


def test_token_files(docs):
    got = tokenfile.token_table(docs, tokenfile.default_vocabulary()).collect()
    encoder = tokenfile.Encoder(tokenfile.default_vocabulary())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == 11
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        raw = np.array([*(encoder.tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids if texts[r["doc_id"]] else []), 1], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    assert tokenfile.token_table(none_of(docs), tokenfile.default_vocabulary()).count() == 0


def test_near_duplicates(docs):
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert got[(0, 0)] == (0, True) and got[(4, 1)] == (4, True)
    assert got[(6, 56)] == (5, False) and got[(7, 56)] == (5, False) and got[(5, 56)] == (5, True)
    assert got[(None, 56)] == (None, True)
    assert neardup.near_duplicates(docs).count() == 11 and neardup.near_duplicates(none_of(docs)).count() == 0
    left = neardup.without_near_duplicates(docs)
    assert left.columns == docs.columns and left.where("doc_id in (6, 7)").count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = [[f"t{x}" for x in rng.integers(0, 5000, 80)] for _ in range(12)]
    rows = []
    for i in range(200):
        w = list(base[i % 12])
        for k in rng.integers(0, 80, rng.integers(0, 4)):
            w[k] = f"e{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [set(neardup.shingles(t).tolist()) for _, t in rows]
    root = list(range(200))
    for _ in range(200):
        new = [min(root[j] for j in range(200) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])) for i in range(200)]
        if new == root:
            break
        root = new
    assert [got[i] for i in range(200)] == root


def test_chat_round_trip_and_layouts(spark):
    records = [
        '{"conv_id":1,"turn":1,"role":"assistant","text":"a#<b>\\\\l </turn>"}', '{"conv_id":1,"turn":0,"role":"user","text":null}',
        '{"conv_id":2,"messages":[{"role":"user","content":"hi"},{"role":"a: b","content":"x"}]}', '{"id":3,"conversations":[{"from":"user","value":"q"}]}',
        '{"conv_id":4,"prompt":"p","completion":"c"}', '{"conv_id":5,"instruction":"i","input":"","output":"o"}', '{"conv_id":6,"other":1}',
    ]
    df = spark.createDataFrame([(r,) for r in records], "record string")
    out = chat.format_turns(chat.canonical_turns(df)).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("lost", chat.loss_text(F.col("formatted"), F.col("loss")))
    got = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["lost"], r["n_turns"]) for r in out.collect()}
    assert got[1] == ([("user", ""), ("assistant", "a#<b>\\l </turn>")], "a#<b>\\l </turn>", 2)
    assert got[2][0] == [("user", "hi"), ("a: b", "x")] and got[3][0] == [("user", "q")]
    assert got[4][0] == [("user", "p"), ("assistant", "c")] and got[5][0] == [("user", "i"), ("assistant", "o")] and got[6] == ([], "", 0)
    assert chat.format_turns(chat.canonical_turns(none_of(df))).count() == 0


def test_language_gradients_and_labels(spark, docs):
    net = langid.Network(["a", "b"], langid.Fit(hidden=3))
    x, mask = langid.padded([b"abc", b"z"])
    y = np.array([0, 1])
    loss = lambda: -float((np.log(net.probabilities(net.states(x, mask))[np.arange(2), :, y]) * mask).sum() / mask.sum())
    for params, grads in net.gradients(x, mask, y):
        for k, g in grads.items():
            i = np.unravel_index(np.abs(g).argmax(), g.shape)
            held, params[k] = params[k], params[k].astype(np.float64)
            params[k][i] += 1e-4
            up = loss()
            params[k][i] -= 2e-4
            assert abs((up - loss()) / 2e-4 - g[i]) < 2e-3
            params[k] = held
    rows = [(i, ("der die das und " if i % 2 else "the of and that ") * 5, "de" if i % 2 else "en") for i in range(60)]
    odd = [(100, None, None), (101, "12 %%", "en"), (102, LONG, None)]
    got = {r["doc_id"]: r for r in langid.label(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string"), langid.Fit(steps=40)).collect()}
    assert all(got[i]["lang_pred"] == ("de" if i % 2 else "en") for i in range(60))
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[100]["score"] == 0 and 0 <= got[102]["score"] <= 1
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert langid.label(none_of(docs)).count() == 0


def test_leaks(spark, docs):
    item = " ".join(WORDS[100:140])
    bench = spark.createDataFrame([(1, item), (2, "only three words"), (3, None), (4, "")], "item_id long, text string")
    more = spark.createDataFrame([(20, "pad " * 30 + item.upper() + " tail"), (21, "Only three words"), (22, "so only three words here"), (23, " ".join(WORDS[100:139]))], "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").unionByName(more)
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(all_docs, bench).collect()}
    assert set(got) == {(20, 1), (21, 2), (23, 1)} and got[(20, 1)]["similarity"] == 1 and got[(20, 1)]["start_word"] == 30
    assert decontam.leaks(none_of(all_docs), bench).count() == 0 and decontam.leaks(all_docs, none_of(bench)).count() == 0
    assert decontam.without_leaks(all_docs, bench).count() == all_docs.count() - 3


def test_archives(spark):
    pages = spark.createDataFrame([(3, "http://a/\u00e9\r\nx", "same", "z"), (1, "http://b", "same", "z"), (2, None, None, "z"), (5, "u", "", "z"), (4, "u", "caf\u00e9" * 50_000, "z"), (1, "http://b", "same", "z")], "page_id long, url string, html string, payload string")
    got = sorted(map(tuple, warc.archive_table(pages).collect()), key=lambda r: r[0])
    d = warc.digest
    assert got == [(1, 4, d(b"same"), "response", None)] * 2 + [(2, 0, d(b""), "response", None), (3, 4, d(b"same"), "revisit", 1), (4, 250_000, d("caf\u00e9".encode() * 50_000), "response", None), (5, 0, d(b""), "revisit", 2)]
    assert warc.archive_table(none_of(pages)).count() == 0


def test_page_text(spark):
    html = "<html><head><title>t</title></head><nav><p>menu</p></nav><div class='ad'>buy<article><h1>A &amp; B</h1><p><b>one<br>two<p>three  \n four<aside>no</aside><script>var x='<p>'</script></article><section id=comments><p>hey</section><footer>f"
    assert pagetext.lines_of(html) == (["A & B", "one two", "three four"], True)
    assert pagetext.lines_of(None) == ([], True) and pagetext.lines_of("a < b<p") == (["a < b"], False)
    assert pagetext.common([1, 2, 3, 4], [2, 9, 4]) == [False, True, False, True]
    plain = lambda own: f"<div>Site top</div><p>{own}</p><div>Site end</div>"
    pages = spark.createDataFrame([(1, "http://h/a", plain("own a")), (2, "http://h/b", plain("own b")), (3, "http://g/a", plain("own c")), (4, None, None), (5, "http://h/z", html)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pagetext.main_text(pages).collect()}
    assert got == {1: "own a", 2: "own b", 3: "Site top\nown c\nSite end", 4: "", 5: "A & B\none two\nthree four"}
    assert pagetext.main_text(none_of(pages)).count() == 0


def test_text_after_marked_inline_elements():
    lines = lambda body: pagetext.lines_of(f"<article>{body}</article>")[0]
    assert lines("<p>Hello <span class=ad>Buy</span> world.</p><p>More") == ["Hello world.", "More"]
    assert lines("<span class=share>x</span><p>One</p>two") == ["One", "two"]
    assert lines("a <span hidden>b <span>c</span> d</span> e <x-note class=ad>f</x-note>g") == ["a e g"]
    assert lines("<p>a <span class=ad><div>b</span>c</div></span> d</p>e") == ["a", "d", "e"]
    assert lines("<p>a <span class=ad>b<p>c <span class=ad>d</p>e <embed class=ad>f") == ["a", "c", "e f"]
    assert lines("<div class=ad>a <span class=ad>b</span> c</div>d</span> e") == ["d e"]
    assert pagetext.lines_of("a <span class=ad>b <article>c <span>d</span> e</article>") == (["c d e"], True)


@pytest.mark.parametrize("name", ["content has-sidebar", "social-science", "share-price", "related-work", "has-comments", "no-ads", "ad-hoc", "sidebar-wrapper"])
def test_wrappers_whose_names_hold_a_mark_stay(name):
    for attribute in (f'class="{name}"', f'id="{name.split()[-1]}"'):
        assert pagetext.lines_of(f"<div {attribute}><p>One</p></div>") == (["One"], False)
        assert pagetext.lines_of(f"<article><div {attribute}>One</div><p {attribute}>two</article>") == (["One", "two"], True)
        assert pagetext.lines_of(f"<div {attribute}><article>One</article></div>") == (["One"], True)


@pytest.mark.parametrize("name", ["ad", "x ad", "sidebar", "ad-slot", "top-ad", "ad_728x90", "ad-container-2", "share-buttons", "cookie-banner", "comments-section", "Social__Links"])
def test_names_made_of_marks_go(name):
    assert pagetext.lines_of(f'<article><p class="{name}">no<p>yes</article>') == (["yes"], True)


def test_archives_of_ids_with_several_payloads(spark):
    """Other payloads of a revisit's id stay, and no row is written twice."""
    pages = spark.createDataFrame([(1, "A"), (5, "A"), (5, "B"), (2, "C"), (5, "C"), (None, "A")], "page_id long, html string").withColumn("url", F.lit("u"))
    got = sorted(map(tuple, warc.archive_table(pages).collect()), key=str)
    a, b, c = (warc.digest(x) for x in (b"A", b"B", b"C"))
    assert got == sorted([(1, 1, a, "response", None), (5, 1, a, "revisit", 1), (5, 1, b, "response", None), (2, 1, c, "response", None), (5, 1, c, "revisit", 2), (None, 1, a, "revisit", 1)], key=str)


def test_near_duplicates_of_small_sets(spark):
    """Texts of 7 and 8 words, at exactly 0.75, that the estimates put below their floors."""
    coarse, fine = [226, 604, 1166, 1737, 2840, 3266], [25, 193, 684, 748]
    texts = {2 * i + k: " ".join(f"{x}{i}" for x in "abcdefgh"[: 7 + k]) for i in coarse + fine for k in (0, 1)}
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    assert got == {n: n - n % 2 for n in texts}
    for i in fine:
        sets = [neardup.shingles(texts[2 * i + k]) for k in (0, 1)]
        split = [neardup.sketch(s).reshape(neardup.BANDS, neardup.ROWS) for s in sets]
        band = int((split[0] == split[1]).all(axis=1).argmax())
        column = lambda *v: pa.array(v, pa.int32())
        table = pa.table({
            "node": pa.array([0, 1]), "root": pa.array([0, 1]), "top": pa.array([-1, -1]), "n_shingles": pa.array([len(s) for s in sets]), "block": column(0, 0),
            "registers": [s.tobytes() for s in split], "fine": pa.array([neardup.fine_sketch(s) for s in sets], pa.list_(pa.int32())),
            "band": column(band, band), "i": column(0, 0), "j": column(0, 0),
        })
        assert neardup.close_pairs(table).to_pylist() == [{"a": 0, "b": 1}]


def test_near_duplicates_of_ids_with_several_texts(spark):
    text = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, text("a", 60)), (1, text("b", 60)), (2, text("a", 58)), (3, text("b", 58)), (4, text("c", 60)), (9, text("c", 58)), (9, text("d", 60))]
    for order in (rows, rows[::-1]):
        got = {(r["doc_id"], t): r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect() for t in [r["n_shingles"]]}
        assert got == {(1, 56): 1, (2, 54): 1, (3, 54): 1, (4, 56): 4, (9, 54): 4, (9, 56): 9}

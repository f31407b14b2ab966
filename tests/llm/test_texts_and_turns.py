"""Repeated passages, repaired conversations and spelling variants against loops."""

import hashlib
import itertools
import random
import zlib

import pytest

from contactweave.llm import repair, spelling, substrings

DOCS = "doc_id long, text string, text_1 string, n long, h string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)


def cut_loop(rows):
    """Documents in order of id, as (id, text) pairs; equal pairs are one document."""
    texts = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), {}
    for i, t in texts:
        words = t.encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[i, t] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest(), [[a, b] for a, b in runs(gone)])
    return out


def runs(flags):
    edges = [k for k in range(len(flags) + 1) if (flags[k - 1] if k else False) != (flags[k] if k < len(flags) else False)]
    return list(zip(edges[::2], edges[1::2]))


def repeated(spark, rows):
    return {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, tuple(map(tuple, r.repeats))) for r in substrings.repeats(docs(spark, rows)).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_passages_equal_a_loop(spark, seed):
    """Few words, so that seeds recur in many contexts; passages of 18 to 60 words,
    copies, copies with a word changed, loops within a text."""
    rng = random.Random(seed)
    passages = [[rng.choice("abcdé") for _ in range(rng.randint(18, 60))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(["a", "b", f"w{rng.randint(0, 500)}"]) for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.3 and words:
            words[rng.randrange(len(words))] = "z"
        if rng.random() < 0.2:
            words = words * 3
        rows.append((i * 7 % 60, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(100 + k, rows[5][1]) for k in range(4)]
    want = {(i, *v[:3], tuple(map(tuple, v[3]))) for (i, _), v in cut_loop(rows).items()}
    assert repeated(spark, rows) == want
    assert any(w[2] for w in want)


def test_repeated_passages_of_odd_rows(spark):
    line = " ".join(f"w{k}" for k in range(25))
    rows = [(1, None), (2, ""), (3, " \n"), (4, line), (4, line), (None, line), (5, "a " * 19), (6, "a " * 21), (7, line.replace(" ", "\u00a0")), (8, line + " x")]
    got = sorted(substrings.repeats(docs(spark, rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_words, r.n_removed) for r in got] == [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 25, 0), (4, 25, 0), (5, 19, 0), (6, 21, 20), (7, 1, 0), (8, 25, 24), (None, 25, 25)]
    assert got[0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert substrings.repeats(docs(spark, [])).count() == 0


def test_a_very_long_text_is_hashed_in_pieces(spark):
    rng = random.Random(4)
    words = [f"word{rng.randint(0, 10**9)}" for _ in range(700_000)]
    text = " ".join(words)
    assert len(text) > 2 * substrings.PIECE
    got = {r.doc_id: r.n_removed for r in substrings.repeats(docs(spark, [(1, text), (2, " ".join(words[300_000:300_050]))])).collect()}
    assert got == {1: 0, 2: 50}


def test_a_seed_in_very_many_contexts(spark):
    """One gram in all texts, with different words around it, costs rows, not pairs."""
    seed = "the same eight words in every single text"
    rows = [(i, " ".join(f"{c}{i % 50}x{j}" for c, j in itertools.product("a", range(15))) + f" {seed} " + " ".join(f"b{i}y{j}" for j in range(15))) for i in range(3_000)]
    want = {i: v[1] for (i, _), v in cut_loop(rows).items()}
    assert {r.doc_id: r.n_removed for r in substrings.repeats(docs(spark, rows)).collect()} == want


def repair_loop(rows):
    """Cheapest edits by trying all of them, with at most two turns put in at a place."""
    best = None
    options = []
    seen = set()
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        gone = not bare or (role, text) in seen
        seen.add((role, text))
        extra = 5 if bare and bare[-1] not in ".!?" else 0
        options.append([(2, "D", None)] + ([] if gone else [(extra, "K", (role, text)), (1 + extra, "R", ("user", text)), (1 + extra, "R", ("assistant", text))]))
    gaps = [[()] + [c for n in (1, 2) for c in itertools.product(("user", "assistant"), repeat=n)] for _ in range(len(rows) + 1)]
    for picked in itertools.product(*options):
        for put in itertools.product(*gaps):
            cost, audit, out = sum(p[0] for p in picked), "", []
            for k, more in enumerate(put):
                cost += 5 * len(more)
                audit += "I" * len(more)
                out += [(r, "") for r in more]
                if k < len(rows):
                    audit += picked[k][1]
                    out += [picked[k][2]] if picked[k][2] else []
            initials = "".join(r[:1] or "?" for r, _ in out).removeprefix("s")
            if out and (initials != "ua" * (len(initials) // 2) or not initials):
                continue
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return best


TURNS = "conv_id long, turn long, role string, text string, audit string, cost int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)


def undamaged(df):
    from pyspark.sql import functions as F

    return repair.damage(df, F.lit(9))


def test_repairs_equal_trying_all_edits(spark):
    rng = random.Random(5)
    rows, by_conv = [], {}
    for conv in range(120):
        said = [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No!", "a b", "", "c?\n", "Never. "])) for _ in range(rng.randint(0, 3))]
        by_conv[conv] = said
        rows += [(conv, t, *s) for t, s in enumerate(said)]
    got = {r.conv_id: r for r in repair.repaired(undamaged(turns(spark, rows))).collect()}
    for conv, said in by_conv.items():
        if said:
            cost, audit, text = repair_loop(said)
            assert (got[conv].cost, got[conv].audit, got[conv].repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), said
    assert len({r.audit for r in got.values()}) > 15


def test_damage_faults_and_gaps(spark):
    def of(k):
        return zlib.crc32(k.encode()) % 20

    turn, at = {}, 0
    for code in (0, 3, 2, 7):
        at = turn[code] = next(t for t in range(at + 1, 9_999) if of(f"1:{t}") == code)
    alone = next(c for c in range(2, 90_000) if of(f"{c}:0") == 0)
    rows = [(1, turn[0], "user", "Gone."), (1, turn[3], "user", "Hi."), (1, turn[2], "assistant", "You. there!"), (1, turn[7], "user", None), (alone, 0, "user", "Gone."), (alone, 0, "user", "Gone.")]
    got = {r.conv_id: r for r in repair.repaired(repair.contract_damage(turns(spark, rows))).collect()}
    r = got[1]
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == (turn[7] - turn[3] - 2, 1, 1, 1, 1)
    assert (r.audit, r.cost, r.repaired_sha256) == ("DDDD", 8, hashlib.sha256(b"").hexdigest())
    r = got[alone]
    assert (r.gaps, r.cost, r.audit, r.repaired_sha256) == (0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repairs_of_odd_rows(spark):
    said = [(None, 0, "user", "A?"), (None, None, "assistant", "B."), (7, None, "user", "x."), (7, None, "user", "x."), (8, 3, None, None), (9, 2, "assistant", "b."), (9, -4, "user", "a.")]
    got = {r.conv_id: r for r in repair.repaired(repair.damage(turns(spark, said).na.fill(" ", ["role", "text"]), repair.F.lit(9))).collect()}
    assert (got[None].gaps, got[None].audit, got[None].cost) == (0, "RR", 2)
    assert (got[7].gaps, got[7].duplicate, got[7].audit, got[7].cost) == (0, 1, "DD", 4)
    assert (got[8].blank, got[8].audit) == (1, "D")
    assert (got[9].gaps, got[9].audit, got[9].repaired_sha256) == (5, "KK", hashlib.sha256(b"user:a.\nassistant:b.").hexdigest())
    assert repair.repaired(undamaged(turns(spark, []))).count() == 0


def test_a_long_conversation_with_a_long_text(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(20_000)] + [(1, 20_000, "user", "no " * 2_000_000)]
    r = repair.repaired(undamaged(turns(spark, rows))).first()
    assert (r.audit, r.cost, r.truncated) == ("K" * 20_000 + "D", 2, 1)
    text = "\n".join(f"{x[2]}:{x[3]}" for x in rows[:-1])
    assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def spell_loop(rows):
    from collections import Counter

    import regex

    n = Counter()
    for i, t in rows:
        for run in regex.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, count = {}, {}
    for w in n:
        of = [v for v in n if near(w, v)]
        count[w] = len(of)
        top = min(of, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top and n[top] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], count[w], form[w], n[form[w]] if form[w] else None, root)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_equals_a_loop(spark, seed):
    """Words of few letters have many neighbours, at both ends and in runs of a letter;
    chains of forms come from counts that grow tenfold."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÀÿ") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    words += [w[:k] + rng.choice(["", "b", "xà"]) + w[k + 1 :] for w in words for k in [rng.randrange(len(w))]]
    chain = ["chained", "chaineds", "xchaineds", "xchainedsy"]
    rows = [(i, " ".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(40))) for i in range(80)]
    rows += [(1_000, ", ".join([chain[0]] * 3000 + [chain[1]] * 300 + [chain[2]] * 30)), (1_001, " ".join([chain[3]] * 2)), (None, chain[0]), (None, None), (5, ""), (6, "ab1cdefgh_ijklmnop" * 3), (6, "aaaaaaaa aaaaaaaaa aaaaaaa " * 40)]
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs(spark, rows)).collect()}
    assert got == spell_loop(rows)
    assert got[chain[3]][4] == chain[0]


def test_spelling_of_odd_tables(spark):
    assert spelling.variants(docs(spark, [])).count() == 0
    assert spelling.variants(docs(spark, [(1, None), (2, "short words only")])).count() == 0
    long = " ".join(["repeated"] * 500_000)
    assert {r.word for r in spelling.variants(docs(spark, [(2, long)])).collect()} <= {"repeated"} | {"repeated"[:k] + "repeated"[k + 1 :] for k in range(8)}

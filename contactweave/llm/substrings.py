"""Passages that repeat across documents: seeds, extension both ways, maximal repeats.

A window is ``LENGTH`` consecutive words of one document.  A window repeats if its words
also start earlier: in a document of a smaller id, or in the same one at an earlier
start.  Words that repeating windows cover go; windows are judged on the input.

Seeds.  Winnowing picks the smallest of the hashed ``SEED``-word grams of each window
(the leftmost of equal ones), so equal windows pick the same gram at the same offset and
every window belongs to one seed.  Only seeds that occur twice or more go on.

Extension.  The occurrences of a seed are compared with the first of them, the centre, to
the left and to the right, up to the ends of the windows they answer for.  Windows within
the common stretch repeat.  What sticks out on the left waits with the occurrences that
leave the centre at the same place by the same word, and the same on the right, for a
centre of their own.  An occurrence's open windows only shrink, so ``LENGTH - SEED + 1``
rounds are enough, no two occurrences are paired but with a centre, and the result is
exact: two equal windows leave no centre apart.  Occurrences whose windows are all alike
go as one.

Exact copies of a text are reduced to their first document before any of this.

Defined results: null and empty texts have no words; rows with equal id and text are one
document and get equal results; rows with equal ids and different texts are documents in
the order of their hashes; null ids come last; further columns are ignored; an empty table
gives an empty result.  Words and grams are compared by 64-bit hashes.  Texts are hashed
in pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from contactweave.llm.base import bounded_batches, written

LENGTH, SEED = 20, 8
#: Offsets that a seed can have in a window: 0 to REACH.
REACH = LENGTH - SEED
PIECE = 4 << 20
_REMEMBERED = 500_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Odd multiplier of the second gram hash, which tells apart grams whose first ones meet.
_BASE2 = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """64-bit hashes of words, remembered within a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of ``text``, some at a time.  ``bytes.split`` parts at the six ASCII
    white-space characters and at no others."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].split()
        at = end


def _word_hashes(text: bytes, known: _Hashes) -> np.ndarray:
    parts = [np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) for words in _pieces(text)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _grams(words: np.ndarray, base: np.uint64) -> np.ndarray:
    n = len(words) - SEED + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(SEED if n > 0 else 0):
        out = out * base + words[i : i + n]
    return _mixed(out)


def _seeds(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Over documents laid end to end (``doc`` numbers each word's): grams, and the
    places, least and largest offsets of the seeds."""
    n = len(words) - LENGTH + 1
    grams = _grams(words, _BASE)
    if n <= 0:
        return grams, *(np.empty(0, np.int64) for _ in range(3))
    value, place, width = grams, np.arange(len(grams)), 1
    while width < REACH + 1:
        step = min(width, REACH + 1 - width)
        left = value[:-step] <= value[step:]
        value, place, width = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:]), width + step
    starts = np.flatnonzero(doc[:n] == doc[LENGTH - 1 :])
    place = place[starts]
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][: len(place)])
    ends = np.r_[new[1:], len(place)][: len(new)] - 1
    at = place[new]
    return grams, at, at - starts[ends], at - starts[new]


def _read_words(texts: pa.Array, known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the place of each text's first word."""
    parts = [_word_hashes(t.as_py() or b"", known) for t in texts.cast(pa.binary())]
    return np.concatenate([*parts, np.empty(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _binary(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words, digest of the whole text's words, and the seeds' grams."""
    known = _Hashes()
    for b in batches:
        text = b.column("text")
        words, at = _read_words(text, known)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        grams, place, _, _ = _seeds(words, doc)
        cut = np.searchsorted(place, at)
        seeds = grams[place].view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(seeds))
        digests = [_kept_digest(t.as_py() or b"", None) for t in text.cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "t1", "t2")), pa.array(np.diff(at)), pa.array(digests), lists], names=["doc_id", "t1", "t2", "n_words", "sha", "seeds"])


def _kept_digest(text: bytes, removed: np.ndarray | None) -> str:
    """Digest of the words that stay, joined by one space."""
    digest, at, said = hashlib.sha256(), 0, False
    for words in _pieces(text):
        left = words if removed is None else [w for w, gone in zip(words, removed[at : at + len(words)].tolist()) if not gone]
        at += len(words)
        if left:
            digest.update((b" " if said else b"") + b" ".join(left))
            said = True
    return digest.hexdigest()


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per occurrence of a repeated seed, with the words around it."""
    known = _Hashes()
    for b in batches:
        words, at = _read_words(b.column("text"), known)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        grams, place, lo, hi = _seeds(words, doc)
        again = _grams(words, _BASE2)
        cut = np.searchsorted(place, at)
        hits = [np.isin(grams[place[cut[i] : cut[i + 1]]].view(np.int64), np.asarray(hs.as_py(), np.int64)) for i, hs in enumerate(b.column("hits"))]
        pick = np.flatnonzero(np.concatenate([*hits, np.empty(0, bool)]))
        for some in np.array_split(pick, max(1, len(pick) // 20_000)):
            p, low, high, of = place[some], lo[some], hi[some], doc[place[some]]
            around = [_context(words, again, x, y, z) for x, y, z in zip(p.tolist(), low.tolist(), high.tolist())]
            keys = [b.column(c).take(pa.array(of)) for c in ("late", "doc_id", "t1", "t2")]
            yield pa.RecordBatch.from_arrays([pa.array(grams[p].view(np.int64)), *keys, pa.array(p - at[of]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), _binary(around)], names=["g", "late", "doc_id", "t1", "t2", "pos", "lo", "hi", "around"])


def _context(words: np.ndarray, again: np.ndarray, at: int, lo: int, hi: int) -> np.ndarray:
    """Second hash of the gram, the ``hi`` words before it from the nearest on, and the
    ``REACH - lo`` words after it: all that the windows it answers for hold."""
    return np.concatenate([again[at : at + 1], words[at - hi : at][::-1], words[at + SEED : at + LENGTH - lo]])


def _unpacked(around: pa.Array, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row per occurrence: the gram's second hash and its neighbours on the left, and
    the ones on the right; 0 stands beyond what is kept."""
    around = around.cast(pa.large_binary())
    offsets = np.frombuffer(around.buffers()[1], np.int64)[around.offset : around.offset + len(around) + 1]
    flat = np.frombuffer(around.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
    first = (offsets[:-1] - offsets[0]) // 8
    flat = np.r_[flat, np.uint64(0)]
    step = np.arange(REACH + 1)
    left = np.where(step <= hi[:, None], flat[np.minimum(first[:, None] + step, len(flat) - 1)], np.uint64(0))
    step = step[:-1]
    right = np.where(step < REACH - lo[:, None], flat[np.minimum((first + 1 + hi)[:, None] + step, len(flat) - 1)], np.uint64(0))
    return left, right


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row, where 0 equals nothing."""
    return np.cumprod((a == b) & (a != 0), axis=1).sum(axis=1).astype(np.int64)


_OPEN = "g long, late boolean, doc_id {id}, t1 long, t2 long, pos long, lo int, hi int, around binary, covered boolean"


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences next to their centres: covered offsets, and what stays open."""
    for b in batches:
        get = lambda c: b.column(c).to_numpy(zero_copy_only=False)
        lo, hi, g = get("lo").astype(np.int64), get("hi").astype(np.int64), get("g").view(np.uint64)
        left, right = _unpacked(b.column("around"), lo, hi)
        of_left, of_right = _unpacked(b.column("c_around"), get("c_lo").astype(np.int64), get("c_hi").astype(np.int64))
        same = left[:, 0] == of_left[:, 0]
        l, r = np.where(same, _common(left[:, 1:], of_left[:, 1:]), -1), _common(right, of_right)
        row = np.arange(len(l))
        out_left = left[row, np.minimum(l + 1, REACH)]
        out_right = right[row, np.minimum(r, REACH - 1)]
        found = (np.maximum(lo, REACH - r), np.minimum(hi, l), g, None)
        # A gram that only shares its first hash with the centre leaves at place -1.
        up = (np.where(same, np.maximum(lo, l + 1), lo), hi, _mixed(g ^ _mixed(out_left + (2 * l + 3).astype(np.uint64))), True)
        down = (lo, np.minimum(np.minimum(hi, l), REACH - 1 - r), _mixed(g ^ _mixed(out_right + (2 * r + 2).astype(np.uint64))), True)
        for low, high, group, still in (found, up, down):
            pick = np.flatnonzero(low <= high)
            if not len(pick):
                continue
            low, high = low[pick], high[pick]
            if still:
                a, z = left[pick], right[pick]
                around = pa.array([np.concatenate([x[: h + 1], y[: REACH - w]]).tobytes() for x, y, w, h in zip(a, z, low.tolist(), high.tolist())], pa.binary())
            else:
                around = pa.nulls(len(pick), pa.binary())
            keys = [b.column(c).take(pa.array(pick)) for c in ("late", "doc_id", "t1", "t2", "pos")]
            yield pa.RecordBatch.from_arrays([pa.array(group[pick].view(np.int64)), *keys, pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), around, pa.array([not still] * len(pick))], names=["g", "late", "doc_id", "t1", "t2", "pos", "lo", "hi", "around", "covered"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text"), *(F.xxhash64(F.lit(s), "text").alias(f"t{s}") for s in (1, 2)))


def _order(*more: str) -> Column:
    return F.struct("late", "doc_id", "t1", "t2", *more)


def _repeating(occurrences: DataFrame, id_type: str) -> DataFrame:
    """(t1, t2, pos, lo, hi): windows that repeat, as offsets before a seed."""
    # Occurrences that are alike as far as their windows reach are a class: all but the
    # first repeat as a whole, and only the first is compared with other classes.
    alike = ["g", *(F.xxhash64(F.lit(s), "lo", "hi", "around").alias(f"k{s}") for s in (1, 2))]
    classes = occurrences.groupBy(*alike).agg(F.min(_order("pos")).alias("at"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("around").alias("around"), F.count(F.lit(1)).alias("n"))
    classes = written(classes, "classes")
    of = classes.where("n > 1").select(*(F.col(c).alias(f"c_{c}") for c in ("g", "k1", "k2", "at")))
    others = occurrences.select(*alike, "late", "doc_id", "t1", "t2", "pos", "lo", "hi").join(of, (F.col("g") == F.col("c_g")) & (F.col("k1") == F.col("c_k1")) & (F.col("k2") == F.col("c_k2")))
    found = written(others.where(~_order("pos").eqNullSafe(F.col("c_at"))).select("t1", "t2", "pos", "lo", "hi"), "alike")
    now = classes.select("g", "at.*", "lo", "hi", "around")
    for k in range(REACH + 2):
        centres = now.groupBy("g").agg(F.min_by(F.struct("lo", "hi", "around"), _order("pos")).alias("c"), F.min(_order("pos")).alias("c_at"), F.count(F.lit(1)).alias("n")).where("n > 1")
        centres = centres.select(F.col("g").alias("c_g"), F.col("c.lo").alias("c_lo"), F.col("c.hi").alias("c_hi"), F.col("c.around").alias("c_around"), "c_at")
        pairs = now.join(centres, F.col("g") == F.col("c_g")).where(~_order("pos").eqNullSafe(F.col("c_at"))).drop("c_g", "c_at")
        seen = Observation()
        step = pairs.mapInArrow(_extended, _OPEN.format(id=id_type)).observe(seen, F.count_if(~F.col("covered")).alias("n"))
        step = written(step, f"extended{k}")
        found = found.unionByName(step.where("covered").select("t1", "t2", "pos", "lo", "hi"))
        if not seen.get["n"]:
            return found
        now = step.where("not covered").drop("covered")
    raise RuntimeError("open windows did not shrink")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed words and what stays of each text, and its maximal repeats."""
    for b in batches:
        rows = {"n_removed": [], "sha": [], "repeats": []}
        for text, spans in zip(b.column("text").cast(pa.binary()), b.column("spans")):
            data = text.as_py()
            n = sum(map(len, _pieces(data)))
            spans = spans.values
            first, last = (spans.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, first, 1)
            np.add.at(change, last + LENGTH, -1)
            gone = np.cumsum(change)[:n] > 0
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
            rows["n_removed"].append(int(gone.sum()))
            rows["sha"].append(_kept_digest(data, gone))
            rows["repeats"].append([{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
        yield pa.RecordBatch.from_arrays([b.column("t1"), b.column("t2"), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["sha"], pa.string()), pa.array(rows["repeats"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["t1", "t2", "n_removed", "sha", "repeats"])


def repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 of the
    words that stay, and ``repeats``, the maximal removed stretches (start, end) in words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keyed = _keyed(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = written(keyed.mapInArrow(_measure, f"doc_id {id_type}, t1 long, t2 long, n_words long, sha string, seeds array<long>"), "measured")
    late = F.col("doc_id").isNull().alias("late")
    firsts = rows.groupBy("t1", "t2").agg(F.min(F.struct(late, "doc_id")).alias("first"))
    # A text's seeds stand in the row of its first document; t1 alone leads back to the
    # text, as a wrong hit only means a seed looked at in vain.
    own = rows.select("t1", "t2", "seeds", late, "doc_id").where(F.size("seeds") > 0).groupBy("t1", "t2").agg(F.any_value("seeds").alias("seeds"))
    # Written, so that the join has a shuffle on either side and hot seeds can be split.
    twice = written(own.select(F.explode("seeds").alias("again")).groupBy("again").count().where("count > 1").select("again"), "twice")
    hits = own.select("t1", F.explode(F.array_distinct("seeds")).alias("h")).join(twice, F.col("h") == F.col("again")).groupBy(F.col("t1").alias("of")).agg(F.collect_set("h").alias("hits"))
    texts = keyed.groupBy("t1", "t2").agg(F.any_value("text").alias("text"), F.min(F.struct(late, "doc_id")).alias("first"))
    held = written(texts.join(hits, F.col("t1") == F.col("of")).select("t1", "t2", "first.*", "text", "hits"), "held")
    at = held.mapInArrow(_occurrences, f"g long, late boolean, doc_id {id_type}, t1 long, t2 long, pos long, lo int, hi int, around binary")
    covered = _repeating(written(at, "occurrences"), id_type)
    spans = covered.groupBy("t1", "t2").agg(F.collect_list(F.struct((F.col("pos") - F.col("hi")).alias("a"), (F.col("pos") - F.col("lo")).alias("b"))).alias("spans"))
    cut = held.select("t1", "t2", "text").join(spans, ["t1", "t2"]).mapInArrow(_cut, "t1 long, t2 long, n_removed long, sha string, repeats array<struct<start: long, end: long>>")
    # Written, so that the last join has a shuffle on either side, which adaptive
    # execution can split where one text has very many copies.
    verdicts = written(firsts.join(cut.withColumnRenamed("sha", "cut_sha"), ["t1", "t2"], "left"), "verdicts")
    judged = rows.drop("seeds").join(verdicts, ["t1", "t2"])
    copy = ~F.struct(late, "doc_id").eqNullSafe(F.col("first")) & (F.col("n_words") >= LENGTH)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    none = F.array().cast("array<struct<start: long, end: long>>")
    return judged.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("repeats", none)).alias("repeats"),
    )

"""Benchmark decontamination by SimHash windows.

Where a document shares a five-word shingle with any benchmark item, a window of
that item's length is laid over the document so that the shingles meet.  A window
that shares no shingle with an item can't be similar to it, so this places every
window that matters; a bit table of the benchmark's shingles is tested first, so
all other positions cost one lookup.

Every window gets a 128-bit SimHash of its words.  A multi-index finds the items of
the same length within the radius: fingerprints are cut into eight blocks of 16
bits, and two that differ in at most 23 bits have a block in which they differ in at
most two.  Both sides list each block as it is and with each one of its bits turned,
which meets all of those; two random fingerprints meet with a chance of 0.017.
Exact similarity of five-word shingles, weighted by their characters, verifies the
candidates.  Where a candidate's window falls short, the windows that begin up to a
quarter of the item's length before or after it are compared as well.

Defined results: null and empty texts match nothing; items without words are no
items; an item of fewer than five words matches only a document of the same words;
rows are looked at one by one, so a row that holds an item says nothing of others
with its id (or without one), and equal rows are reported once; a null document id
is reported as null; empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactweave.llm.base import BROADCAST_ROWS, let, row_print, small, unused, words_col, written

SHINGLE = 5
#: Blocks of a fingerprint, their bits, and the bits in which a block may differ.
N_BLOCKS, BLOCK_BITS, TURNED = 8, 16, 2


@dataclass(frozen=True)
class Match:
    """similarity: least weighted shingle similarity of a leak.  radius: most
    differing bits of 128, at most 23; windows at 0.75 to 0.85 differ by 9 in the
    median and 22 in one of a hundred.  refine: similarity from which a candidate's
    other windows are compared."""

    similarity: float = 0.75
    radius: int = 23
    refine: float = 0.5


#: Most 64-bit words of the table of benchmark shingles (512 KB of literal).
MAX_TABLE = 1 << 16


def lower_words(text: Column) -> Column:
    return words_col(F.lower(text))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def starts(n: Column) -> Column:
    """First words, from 1, of the shingles of n > 0 words."""
    return F.sequence(F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(1)))


def shingle_hashes(hashes: Column) -> Column:
    return let(hashes, lambda hs: F.transform(starts(F.size(hs)), lambda i: F.xxhash64(F.slice(hs, i, F.lit(SHINGLE)))))


def shingle_texts(words: Column) -> Column:
    return F.array_distinct(let(words, lambda ws: F.transform(starts(F.size(ws)), lambda i: F.array_join(F.slice(ws, i, F.lit(SHINGLE)), " "))))


def table_word(h: Column, n: int) -> Column:
    return F.pmod(h, F.lit(n)).cast("int")


def table_mask(h: Column) -> Column:
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, k).bitwiseAND(F.lit(63)).cast("int"))
    return bit(40).bitwiseOR(bit(50))


def shingle_table(anchors: DataFrame) -> list[int]:
    """Two bits per benchmark shingle; at most ``MAX_TABLE`` numbers reach the driver."""
    n = min(MAX_TABLE, max(64, 1 << max(1, anchors.count()).bit_length()))
    table = [0] * n
    for r in anchors.groupBy(table_word(F.col("h"), n).alias("w")).agg(F.bit_or(table_mask(F.col("h"))).alias("m")).collect():
        table[r["w"]] = r["m"]
    return table


def fingerprint(hashes: Column) -> Column:
    """64-bit SimHash of word hashes: bit b is 1 if most words have it set."""
    vote = lambda hs, b: F.aggregate(hs, F.lit(0), lambda n, h: n + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)).cast("int"))
    bit = lambda hs, b: F.when(vote(hs, b) * 2 > F.size(hs), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return let(hashes, lambda hs: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda x, b: x.bitwiseOR(bit(hs, b))))


def with_fingerprint(rows: DataFrame, hashes: Column) -> DataFrame:
    """``rows`` with fp0 and fp1, the halves of the 128-bit SimHash of word hashes."""
    other = F.transform(hashes, lambda h: F.xxhash64(h))
    return rows.withColumn("fp0", fingerprint(hashes)).withColumn("fp1", fingerprint(other))


def block_of(fp0: Column, fp1: Column, i: int) -> Column:
    half, at = (fp0, i) if i < N_BLOCKS // 2 else (fp1, i - N_BLOCKS // 2)
    return F.shiftright(half, at * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def blocked(rows: DataFrame) -> DataFrame:
    """``rows`` once per block and turned bit: block, turn (the mask of the bit, or
    0) and slot, the block's number and its bits so turned."""
    turns = F.array(F.lit(0), *(F.lit(1 << k) for k in range(BLOCK_BITS)))
    blocks = F.array(*(F.struct(F.lit(i).alias("block"), block_of(F.col("fp0"), F.col("fp1"), i).alias("bits")) for i in range(N_BLOCKS)))
    wide = rows.select("*", F.explode(blocks).alias("b")).select("*", F.explode(turns).alias("turn"))
    slot = F.col("b.bits").bitwiseXOR(F.col("turn")) + F.col("b.block") * (1 << BLOCK_BITS)
    return wide.select(*rows.columns, F.col("b.block").alias("block"), "turn", slot.alias("slot"))


def met_here(x0: Column, x1: Column, block: Column, turn: Column, item_turn: Column) -> Column:
    """True for one of the meetings of two fingerprints, of which x0 and x1 are the
    xor: in their first block that is near enough, and with their turned bits in order."""
    first = F.lit(-1)
    for i in reversed(range(N_BLOCKS)):
        first = F.when(F.bit_count(block_of(x0, x1, i)) <= TURNED, F.lit(i)).otherwise(first)
    return (first == block) & ((item_turn == 0) | ((turn > 0) & (turn < item_turn)))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of shingle sets; a shingle weighs its words'
    characters."""
    weight = lambda s: F.aggregate(s, F.lit(0), lambda n, x: n + F.length(F.replace(x, F.lit(" "), F.lit(""))))
    both = F.struct(F.array_intersect(a, b).alias("i"), F.array_union(a, b).alias("u"))
    return let(both, lambda s: weight(s["i"]) / weight(s["u"]))


def item_table(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    items = benchmark.select(F.col(item_col).alias("item_id"), lower_words(F.col(item_text_col)).alias("item_words")).where(F.size("item_words") > 0)
    return written(items.select("item_id", "item_words", F.size("item_words").alias("n"), word_hashes(F.col("item_words")).alias("item_hashes")), "items")


def laid_windows(given: DataFrame, items: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, start_word, n, window, before, after) of the windows of item
    length n that make a shingle of an item meet itself; before and after are the
    words beside the window, up to a quarter of n each."""
    anchors = written(items.select("n", F.posexplode(shingle_hashes(F.col("item_hashes"))).alias("at", "h")).distinct(), "anchors")
    table = shingle_table(anchors)
    bits = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    hashes = shingle_hashes(word_hashes(lower_words(F.col("text"))))
    known = F.element_at(bits, table_word(F.col("h"), len(table)) + 1).bitwiseAND(table_mask(F.col("h"))) == table_mask(F.col("h"))
    hits = given.where(F.col("text").isNotNull()).select("k1", "k2", F.posexplode(hashes).alias("p", "h")).where(known)
    met = hits.join(small(anchors), "h").select("k1", "k2", F.struct((F.col("p") - F.col("at")).alias("start"), "n").alias("w"))
    places = small(written(met.groupBy("k1", "k2").agg(F.collect_set("w").alias("windows")), "windows"))
    cut = given.join(places, ["k1", "k2"]).select("k1", "k2", "doc_id", lower_words(F.col("text")).alias("words"), F.explode("windows").alias("w"))
    cut = cut.select("k1", "k2", "doc_id", "words", "w.start", "w.n")
    first = F.greatest("start", F.lit(0))
    last = F.least(F.col("start") + F.col("n"), F.size("words"))
    cut = cut.where((last > first) & ((F.col("n") >= SHINGLE) | (F.size("words") == F.col("n"))))
    margin = F.ceil(F.col("n") / 4).cast("int")
    from_ = F.greatest(first - margin, F.lit(0))
    return cut.select(
        "k1", "k2", "doc_id", first.cast("long").alias("start_word"), "n",
        F.slice("words", first + 1, last - first).alias("window"),
        F.slice("words", from_ + 1, first - from_).alias("before"),
        F.slice("words", last + 1, margin).alias("after"),
    )


def found_rows(docs: DataFrame, benchmark: DataFrame, match: Match, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(k1, k2, doc_id, item_id, start_word, n_words, similarity) per row print and
    item that the row holds."""
    if not 0 <= match.radius < N_BLOCKS * (TURNED + 1):
        raise ValueError(f"radius must be below {N_BLOCKS * (TURNED + 1)}")
    items = item_table(benchmark, item_col, item_text_col)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_print(F.col(id_col), F.col(text_col)))
    windows = written(with_fingerprint(laid_windows(given, items), word_hashes(F.col("window"))), "fingerprints")
    of_items = blocked(with_fingerprint(items.select("item_id", "item_words", "n", "item_hashes"), F.col("item_hashes")).drop("item_hashes"))
    sides = of_items.select(*(F.col(c).alias(f"i_{c}") for c in of_items.columns))
    sides = F.broadcast(sides) if items.count() * N_BLOCKS * (BLOCK_BITS + 1) <= BROADCAST_ROWS else sides
    x0, x1 = F.col("fp0").bitwiseXOR(F.col("i_fp0")), F.col("fp1").bitwiseXOR(F.col("i_fp1"))
    near = (F.col("n") == F.col("i_n")) & (F.col("slot") == F.col("i_slot")) & (F.bit_count(x0) + F.bit_count(x1) <= match.radius)
    pairs = blocked(windows).join(sides, near & met_here(x0, x1, F.col("block"), F.col("turn"), F.col("i_turn")))
    pairs = pairs.withColumn("goal", shingle_texts(F.col("i_item_words")))
    scored = pairs.select("k1", "k2", "doc_id", F.col("i_item_id").alias("item_id"), "start_word", "window", "before", "after", "goal", similarity(shingle_texts(F.col("window")), F.col("goal")).alias("similarity"))
    scored = written(scored, "scored")
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("s"), F.size("window").cast("long").alias("n_words"))).alias("best")
    tops = scored.groupBy("k1", "k2", "doc_id", "item_id").agg(best).select("k1", "k2", "doc_id", "item_id", (-F.col("best.s")).alias("start_word"), "best.n_words", "best.similarity")
    tops = written(tops, "tops")
    short = tops.where((F.col("similarity") < match.similarity) & (F.col("similarity") >= match.refine)).select("k1", "k2", F.col("item_id").alias("i"))
    again = scored.where(F.col("similarity") >= match.refine).join(short, ["k1", "k2"]).where(F.col("item_id").eqNullSafe(F.col("i")))
    around, n = F.concat("before", "window", "after"), F.size("window")
    shifts = F.sequence(F.lit(0), F.size("before") + F.size("after"))
    at = lambda w, i: F.struct(similarity(shingle_texts(F.slice(w, i + 1, n)), F.col("goal")).alias("similarity"), (-(F.col("start_word") - F.size("before") + i)).alias("s"))
    other = let(around, lambda w: F.array_max(F.transform(shifts, lambda i: at(w, i))))
    other = again.select("k1", "k2", "doc_id", "item_id", F.struct(other.alias("o"), n.cast("long").alias("n_words")).alias("o"))
    other = other.groupBy("k1", "k2", "doc_id", "item_id").agg(F.max("o").alias("o")).select("k1", "k2", "doc_id", "item_id", (-F.col("o.o.s")).alias("start_word"), "o.n_words", "o.o.similarity")
    return tops.unionByName(other).where(F.col("similarity") >= match.similarity)


def leaks(docs: DataFrame, benchmark: DataFrame, match: Match = Match(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row and item that it holds: doc_id, item_id, start_word,
    n_words (of the window) and similarity, of the best window."""
    return found_rows(docs, benchmark, match, id_col, text_col, item_col, item_text_col).drop("k1", "k2")


def without_leaks(docs: DataFrame, benchmark: DataFrame, match: Match = Match(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    bad = written(found_rows(docs, benchmark, match, id_col, text_col).select("k1", "k2").distinct(), "leaks")
    n1, n2 = (unused(docs.columns, f"_{k}") for k in ("k1", "k2"))
    k1, k2 = row_print(F.col(id_col), F.col(text_col))
    bad = small(bad.select(F.col("k1").alias(unused(docs.columns, "_bad1")), F.col("k2").alias(unused(docs.columns, "_bad2"))))
    on = (F.col(n1) == F.col(bad.columns[0])) & (F.col(n2) == F.col(bad.columns[1]))
    return docs.select("*", k1.alias(n1), k2.alias(n2)).join(bad, on, "left_anti").drop(n1, n2)

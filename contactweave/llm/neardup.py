"""Near duplicates by HyperMinHash.

A text's set is that of its distinct shingles of five lower-cased words, as 64-bit
hashes.  HyperMinHash keeps, for each of ``REGISTERS`` buckets of the hash range,
the smallest hash as the number of leading zeros of its place in the bucket and
the ``MANTISSA`` bits after the first one; empty buckets borrow another bucket's
register along a fixed pseudorandom walk.  Bands of registers give candidates, an
estimate of the Jaccard similarity, corrected for registers that agree by chance,
drops most of the false ones, and the full sets confirm the rest.

Copies never meet in pairs.  Documents of equal sets form a class first, and only
classes go on.  In each bucket of a band the classes are compared with a few
centres, components are formed, and only then are classes compared that share a
bucket and still lie in different components: those pairs are all looked at, so
no link found by any band is lost.

A pair at exactly 0.75 shares no band with probability (1 - 0.75 ** 4) ** 48, about
1e-8, and less above; the estimate's slack of 0.15 is nearly five standard
deviations.  That holds for large sets; pairs whose smaller set has fewer than
``SMALL_SET`` shingles skip the estimates and are tested on the full sets.

Defined results: null, empty and wordless texts have an empty set and are linked
with nothing; texts of fewer than five words have one shingle, the whole sequence;
a row is one document, whatever its id: rows that repeat an id each give a row and
are linked by their own sets; ``near_duplicates`` reports by id, so rows without one
have a null component there and are not told apart, while ``without_near_duplicates``
keeps one row of each group, rows without ids coming last; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from contactweave.llm.base import WORD_RE, bounded_batches, lower_ascii, row_print, small, unused, written
from contactweave.llm.components import components

WORDS = 5
PERCENT = 75
BANDS, ROWS = 48, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
ZERO_CAP = 50
#: Estimated similarity below which a candidate is not verified.
ESTIMATE_FLOOR = 0.6
#: Rounds of centres before the remaining pairs of components are compared.
CENTRE_ROUNDS = 2
#: Pairs with a set of fewer shingles are verified whatever the estimates say.
SMALL_SET = 32
#: Bins of the finer sketch of candidates, and the estimate below which a pair of
#: components' members is not verified: five standard deviations under 0.75 for
#: large sets.
BINS = 1024
FINE_FLOOR = 0.68
#: Classes in a block of a bucket; a task holds two blocks at a time.
BLOCK = 512
#: Most distinct words whose hashes a worker remembers.
CACHED_WORDS = 200_000

_U = np.uint64
_EDGES = np.array([(i << 64) // REGISTERS for i in range(REGISTERS)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Where empty bucket i looks for a register: its walk over all buckets.
_WALK = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64).reshape(REGISTERS, REGISTERS) + _U(1)), axis=1)


class Words(dict):
    """Hashes of words, remembered within a task."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str | None, known: Words | None = None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    known = Words() if known is None else known
    if len(known) > CACHED_WORDS:
        known.clear()
    words = WORD_RE.findall(lower_ascii(text)) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    width = min(WORDS, len(h))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def set_digest(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers, as int16, of a non-empty sorted set."""
    at = np.searchsorted(hashes, _EDGES)
    full = at < len(hashes)
    value = hashes[np.minimum(at, len(hashes) - 1)]
    full[:-1] &= value[:-1] < _EDGES[1:]
    # Place within the bucket, scaled to 56 bits.
    place = (np.where(full, value - _EDGES, 0).astype(np.float64) * (REGISTERS * 2.0**-8)).astype(np.int64)
    bits = np.frexp(np.maximum(place, 1).astype(np.float64))[1]
    zeros = np.minimum(56 - bits, ZERO_CAP)
    mantissa = np.where(bits > MANTISSA, place >> np.maximum(bits - 1 - MANTISSA, 0), place) & ((1 << MANTISSA) - 1)
    register = ((zeros << MANTISSA) | mantissa).astype(np.uint16)
    if not full.all():
        empty = np.flatnonzero(~full)
        nearest = full[_WALK[empty]].argmax(axis=1)
        register[empty] = register[_WALK[empty, nearest]]
    return register.view(np.int16)


def fine_sketch(hashes: np.ndarray) -> np.ndarray:
    """bin << 16 | 16 bits of its smallest hash, for every bin with one."""
    bins = (hashes >> _U(54)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    return (bins[first] << 16 | (mix(hashes[first]) & _U(0xFFFF)).astype(np.int64)).astype(np.int32)


SKETCHED = "doc_id bigint, k1 bigint, k2 bigint, set_digest binary, n_shingles bigint, registers binary"


def sketched(given: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, set_digest, n_shingles, registers) per row of (doc_id, k1,
    k2, text)."""
    bounded_batches(given.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            digests, counts, registers = [], [], []
            for t in b.column(3).to_pylist():
                h = shingles(t, known)
                counts.append(len(h))
                digests.append(set_digest(h))
                registers.append(sketch(h).tobytes() if len(h) >= 3 else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(registers, pa.binary())], ["doc_id", "k1", "k2", "set_digest", "n_shingles", "registers"])

    return given.select("doc_id", "k1", "k2", "text").mapInArrow(work, SKETCHED)


def full_sets(texts: DataFrame) -> DataFrame:
    """(node, shingles, fine): the sets, as arrays of 64-bit hashes, and their finer
    sketches, of (node, text)."""
    bounded_batches(texts.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            sets = [shingles(t, known) for t in b.column(1).to_pylist()]
            arrays = [pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([fine_sketch(x) for x in sets], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["node", "shingles", "fine"])

    return texts.select("node", "text").mapInArrow(work, "node bigint, shingles array<bigint>, fine array<int>")


def equal_registers(a: Column, b: Column) -> Column:
    """How many registers of two sketches agree."""
    part = lambda x, i: F.call_function("substring", x, i * 2 + 1, F.lit(2))
    return F.aggregate(F.sequence(F.lit(0), F.lit(REGISTERS - 1)), F.lit(0), lambda n, i: n + F.when(part(a, i) == part(b, i), 1).otherwise(0))


def estimate(a: Column, b: Column) -> Column:
    """Jaccard similarity from agreeing registers less the expected share of
    chance agreements: two unrelated minima agree with about 2 ** -MANTISSA / 3
    (equal zeros with 1/3, then equal mantissas)."""
    chance = 2.0**-MANTISSA / 3
    return (equal_registers(a, b) / F.lit(float(REGISTERS)) - F.lit(chance)) / F.lit(1 - chance)


def band_key(registers: Column, i: Column) -> Column:
    """Hash of band i's compressed registers."""
    return F.xxhash64(i, F.call_function("substring", registers, i * (ROWS * 2) + 1, F.lit(ROWS * 2)))


def bands(classes: DataFrame) -> DataFrame:
    """(band, key, node) rows; key hashes the band's compressed registers."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: band_key(F.col("registers"), i))
    return classes.where("registers is not null").select("node", F.posexplode(keys).alias("band", "key"))


def close_pairs(block: pa.Table) -> pa.Table:
    """(a, b) of two blocks of a bucket (or of one block with itself) whose
    components, sizes and both sketches let them pass, if this bucket is the first
    that the two share."""
    node, root, top, size, side = (block.column(c).to_numpy() for c in ("node", "root", "top", "n_shingles", "block"))
    registers = np.frombuffer(b"".join(block.column("registers").to_pylist()), np.int16).reshape(-1, REGISTERS)
    band, one, two = (block.column(c)[0].as_py() for c in ("band", "i", "j"))
    right = np.flatnonzero(side == two)
    chance = 2.0**-MANTISSA / 3
    least = (ESTIMATE_FLOOR * (1 - chance) + chance) * REGISTERS
    left_of, right_of = [], []
    for x in np.flatnonzero(side == one):
        y = right[root[right] != root[x]]
        if one == two:
            y = y[node[y] > node[x]]
        y = y[100 * np.minimum(size[y], size[x]) >= PERCENT * np.maximum(size[y], size[x])]
        equal = registers[y] == registers[x]
        likely = (np.count_nonzero(equal, axis=1) >= least) | (np.minimum(size[y], size[x]) < SMALL_SET)
        y, equal = y[likely], equal[likely].reshape(-1, BANDS, ROWS).all(axis=2)
        y = y[equal[:, band] & (equal.argmax(axis=1) == band)]
        left_of.append(np.full(len(y), x))
        right_of.append(y)
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left_of, right_of))
    if len(x):
        fine = np.full((len(node), BINS), -1, np.int32)
        for n, values in enumerate(block.column("fine")):
            values = values.values.to_numpy()
            fine[n, values >> 16] = values
        good = np.zeros(len(x), bool)
        for at in range(0, len(x), 4096):
            a, b = fine[x[at : at + 4096]], fine[y[at : at + 4096]]
            agree = np.count_nonzero((a == b) & (a >= 0), axis=1)
            good[at : at + 4096] = agree >= FINE_FLOOR * np.count_nonzero((a >= 0) | (b >= 0), axis=1)
        good |= np.minimum(size[x], size[y]) < SMALL_SET
        x, y = x[good], y[good]
    return pa.table({"a": np.minimum(node[x], node[y]), "b": np.maximum(node[x], node[y])})


def remaining(placed: DataFrame, seen: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs of buckets that hold several components: each class outside
    the bucket's largest component meets all classes of others.

    Both parts of a bucket are dealt to blocks of about ``BLOCK`` classes, and a
    task holds two blocks; classes of the largest component go only to blocks
    outside it.
    """
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("n", "root")).alias("t"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    largest = largest.select("k", F.col("t.root").alias("top"), blocks(F.col("t.n")).alias("inside"), blocks(F.col("all") - F.col("t.n")).alias("outside"))
    rows = placed.join(largest, F.col("key") == F.col("k"))
    within = F.col("root") == F.col("top")
    deal = F.xxhash64(F.lit(7), "node")
    rows = rows.withColumn("block", F.when(within, F.col("outside") + F.pmod(deal, F.col("inside"))).otherwise(F.pmod(deal, F.col("outside"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(within, F.col("outside")).otherwise(F.col("outside") + F.col("inside")) - 1)
    wide = written(rows.join(seen, "node").join(sets.select("node", "fine"), "node"), "mixed")
    met = wide.select("key", "band", "node", "root", "top", "n_shingles", "registers", "fine", "block", F.explode(others).alias("other"))
    met = met.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return met.groupBy("key", "i", "j").applyInArrow(close_pairs, "a bigint, b bigint")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    one = lambda n: sets.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}"))
    met = pairs.join(one("a"), "a").join(one("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return met.where(100 * common >= PERCENT * union).select("a", "b")


def links(classes: DataFrame, sets_of) -> DataFrame | None:
    """Confirmed pairs of classes that connect all that any band connects.

    ``classes`` has node, n_shingles and registers; ``sets_of(nodes)`` gives the
    full sets of a table of nodes.
    """
    rows = bands(classes)
    held = rows.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k")
    members = written(rows.join(held, F.col("key") == F.col("k"), "left_semi"), "members")
    if members.isEmpty():
        return None
    nodes = members.select("node").distinct()
    seen = written(classes.join(nodes, "node", "left_semi").select("node", "n_shingles", "registers"), "candidates")
    sets = written(sets_of(nodes), "sets")
    sides = lambda p: seen.select(*(F.col(c).alias(f"{p}_{c}") for c in seen.columns))

    def tested(pairs: DataFrame) -> DataFrame:
        """Pairs that size and estimate let pass, confirmed on full sets."""
        a, b = sides("l"), sides("r")
        size = (100 * F.least("l_n_shingles", "r_n_shingles") >= PERCENT * F.greatest("l_n_shingles", "r_n_shingles"))
        likely = (F.least("l_n_shingles", "r_n_shingles") < SMALL_SET) | (estimate(F.col("l_registers"), F.col("r_registers")) >= ESTIMATE_FLOOR)
        met = pairs.join(a, F.col("a") == F.col("l_node")).join(b, (F.col("b") == F.col("r_node")) & size & likely)
        return confirmed(met.select("a", "b"), sets)

    found: DataFrame | None = None
    placed = members.select("key", "band", "node", F.col("node").alias("root"))
    for r in range(CENTRE_ROUNDS):
        # First one centre for all buckets of a group, then one for each bucket, so
        # that a member of a large group meets many centres.
        salt = F.xxhash64(F.lit(r), "node") if r == 0 else F.xxhash64(F.lit(r), "key", "node")
        order = F.struct(salt.alias("h"), F.col("node").alias("node"), F.col("root").alias("root"))
        centre = placed.groupBy(F.col("key").alias("k")).agg(F.min(order).alias("c"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("k", F.col("c.node").alias("centre"), F.col("c.root").alias("centre_root"))
        star = placed.join(centre, F.col("key") == F.col("k")).where(F.col("root") != F.col("centre_root"))
        star = star.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        new = written(tested(star), "links")
        found = new if found is None else found.unionByName(new)
        roots = components(found)
        placed = written(members.join(roots, "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root")), "placed")
    rest = written(remaining(placed, seen, sets), "rest")
    return found.unionByName(written(confirmed(rest, sets), "links"))


def placed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, root, first) per row of ``docs``: k1 and k2 stand
    for the row's id and text, root for its component (null for an empty set), and
    first is the component's smallest id."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("*", *row_print(F.col("doc_id"), F.col("text")))
    rows = written(sketched(given), "sketches")
    # Rows of equal sets are a class; one of its rows lends its text.
    lender = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("lender")
    classes = rows.where("set_digest is not null").groupBy("set_digest").agg(lender, F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    # Classes are numbered, as an id may stand for several texts.
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def sets_of(nodes: DataFrame) -> DataFrame:
        held = classes.join(nodes, "node", "left_semi").select("node", F.col("lender.k1").alias("k1"), F.col("lender.k2").alias("k2"))
        return full_sets(given.join(held, ["k1", "k2"])).dropDuplicates(["node"])

    found = links(classes, sets_of)
    of_class = classes.select(F.col("set_digest").alias("d"), "node", F.col("lender.doc_id").alias("first"))
    if found is None:
        of_class = of_class.select("d", F.col("node").alias("root"), "first")
    else:
        roots = components(found).select(F.col("node").alias("x"), F.col("root").alias("r"))
        of_class = written(of_class.join(roots, F.col("node") == F.col("x"), "left").select("d", F.coalesce("r", "node").alias("root"), "first"), "roots")
        firsts = of_class.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
        of_class = of_class.join(firsts, F.col("root") == F.col("r"), "left").select("d", "root", F.coalesce("least", "first").alias("first"))
    return rows.join(of_class, F.col("set_digest") == F.col("d"), "left").select("doc_id", "k1", "k2", "n_shingles", "root", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    component = F.when(F.col("root").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("first"))
    return placed_rows(docs, id_col, text_col).select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that with the smallest id (of equal ids, that with the
    smallest hash of its text), with all its columns; rows with empty sets stay.  Of
    rows with equal ids and texts one stays."""
    columns = docs.columns
    rows = written(placed_rows(docs, id_col, text_col).select("doc_id", "k1", "k2", "root"), "placed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    alike = rows.where("root is not null").groupBy("root").agg(F.min(order).alias("w"), F.count(F.lit(1)).alias("c")).where("c > 1")
    alike = written(alike.select(F.col("root").alias("r"), F.col("w.k1").alias("w1"), F.col("w.k2").alias("w2")), "alike")
    met = rows.join(small(alike), F.col("root") == F.col("r"))
    winner = (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))
    gone = written(met.where(~winner).select("k1", "k2").distinct(), "gone")
    twice = written(met.where(winner).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k1", "k2"), "twice")
    n1, n2, g1, g2 = (unused(columns, x) for x in ("_k1", "_k2", "_g1", "_g2"))
    k1, k2 = row_print(F.col(id_col).cast("long"), F.col(text_col))
    keyed = docs.select("*", k1.alias(n1), k2.alias(n2))
    named = lambda t: t.select(F.col("k1").alias(g1), F.col("k2").alias(g2))
    on = (F.col(n1) == F.col(g1)) & (F.col(n2) == F.col(g2))
    left = keyed.join(named(gone), on, "left_anti")
    if not twice.isEmpty():
        again = small(named(twice))
        left = left.join(again, on, "left_anti").unionByName(left.join(again, on, "left_semi").dropDuplicates([n1, n2]))
    return left.select(*(F.col(f"`{c}`") for c in columns))

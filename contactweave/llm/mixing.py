"""Mixing sources to target weights.

Each source's texts are laid end to end in a hashed order and cut into blocks of
a fixed number of tokens (words here).  A source's target gives the number of its
slots.  Every output shard draws how many of its slots each source gets: the whole
part of the source's expected count, and a multinomial draw over the fractions for the
slots that are left.  A slot's rank within its source, counted over the shards, maps
through that source's pseudorandom permutation of block indices, one permutation for
each pass over the source, and blocks are joined by (source, index).  The draws' totals
stray from the targets by about half the square root of the number of shards, so ranks
past a source's slots are left out, and a closing shard holds what the draws left
short: totals equal the targets to a word.

The permutations are swap-or-not shuffles: a bijection of 0..n-1 for any n,
computed per row from hashes, so nothing is sorted and nothing is gathered.

Running token offsets come from two-level sums (hashed buckets, then rows of a
bucket), so a hot source is spread over as many tasks as its rows need.

Defined results: null texts have no tokens and are never taken; null is a source
of its own, ordered last; rows that repeat are laid out as they stand; a source
without tokens has target 0; an empty table gives an empty result; more than
``MAX_SOURCES`` sources are an error, as weights and targets are one row per source.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contactweave.llm.base import WORD_PATTERN, let, n_words_col, small, written, unused


#: Most sources of a mix; their sizes and targets are held by the driver.
MAX_SOURCES = 10_000
#: Shards whose counts are summed together before the sums are.
SHARDS_PER_BUCKET = 4096


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in code-point order; a source gives at
    most ``max_repeat`` times its size."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    max_repeat: int = 3
    block: int = 512
    slots_per_shard: int = 512
    rounds: int = 20
    seed: int = 20
    rows_per_bucket: int = 2000


def permuted(x: Column, n: Column, key: Column, rounds: int) -> Column:
    """Image of ``x`` under a swap-or-not permutation of 0..n-1 chosen by ``key``."""

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - at + n, n)
        swap = F.xxhash64(key, r, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), step)


def shares(sizes: dict[str | None, int], mix: Mix = Mix()) -> dict[str | None, float]:
    """Target tokens by source: weighted shares of the whole, the excess over
    ``max_repeat`` times a source's size reshared until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(names)}
    cap = {s: float(mix.max_repeat * sizes[s]) for s in names}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in names if s in open_)
        over = {s for s in names if s in open_ and left * weight[s] / total > cap[s]}
        if not over:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in names:
            if s in over:
                target[s] = cap[s]
                left -= cap[s]
        open_ -= over
    return target


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words_col(F.col(text_col)).alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("print"))


def laid_out(rows: DataFrame, mix: Mix, n_rows: int | None = None) -> DataFrame:
    """``rows`` (doc_id, source, size, print, ...) with first, their first token's
    place in their source's stream."""
    columns = rows.columns
    buckets = max(1, (rows.count() if n_rows is None else n_rows) // mix.rows_per_bucket)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(mix.seed), "doc_id", "print"), F.lit(buckets)))
    order = [F.xxhash64("print", "doc_id"), F.col("doc_id"), F.col("print")]
    in_bucket = W.partitionBy("source", "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    sums = sums.withColumn("offset", F.sum("sum").over(before) - F.col("sum")).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "offset")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    inner = rows.withColumn("first", F.sum("size").over(in_bucket) - F.col("size"))
    return inner.join(small(sums), same).select(*columns, (F.col("first") + F.col("offset")).alias("first"))


def source_plan(sizes: dict[str | None, int], mix: Mix) -> list[dict]:
    """Per source: target, slots, whole passes and the tokens of the partial one.  One
    row per source: the only thing here that the driver holds."""
    target, plan = shares(sizes, mix), []
    for s in target:
        size, want = sizes[s], min(round(target[s]), mix.max_repeat * sizes[s])
        n_blocks = -(-size // mix.block)
        whole, rest = divmod(want, size) if size else (0, 0)
        plan.append({"at": len(plan), "source": s, "source_size": size, "target": target[s], "n_blocks": n_blocks, "slots": whole * n_blocks + -(-rest // mix.block), "passes": whole, "rest": rest})
    return plan


def numbers(values: list, kind: str) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def shard_counts(spark: SparkSession, plan: list[dict], mix: Mix) -> DataFrame:
    """(shard, at, slots): the draw of every output shard, ``at`` being the source's
    place in the plan, and the closing shard's slots."""
    quotas = [p["slots"] for p in plan]
    total = sum(quotas)
    if not total:
        return spark.createDataFrame([], "shard long, at int, slots long")
    n_shards = -(-total // mix.slots_per_shard)

    def drawn(n: int) -> Column:
        """Counts by source of a shard of n slots."""
        whole = [n * q // total for q in quotas]
        steps = list(accumulate(n * q % total / total for q in quotas))
        left = n - sum(whole)
        if not left:
            return numbers(whole, "bigint")
        uniform = lambda j: F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed), F.col("id"), j), 11) * F.lit(2.0**-53 * steps[-1])
        pick = lambda j: F.least(F.size(F.filter(numbers(steps, "double"), lambda c: c <= uniform(j))), F.lit(len(plan) - 1))
        picks = F.transform(F.sequence(F.lit(1), F.lit(left)), pick)
        return let(picks, lambda d: F.transform(numbers(whole, "bigint"), lambda w, i: w + F.size(F.filter(d, lambda x: x == i))))

    last = total - (n_shards - 1) * mix.slots_per_shard
    counts = F.when(F.col("id") < n_shards - 1, drawn(mix.slots_per_shard)).otherwise(drawn(last))
    drawn_ = spark.range(n_shards).select(F.col("id").alias("shard"), F.posexplode(counts).alias("at", "slots")).where("slots > 0")
    due = spark.createDataFrame([(p["at"], p["slots"]) for p in plan if p["slots"]], "i int, due long")
    got = drawn_.groupBy("at").agg(F.sum("slots").alias("got"))
    short = F.col("due") - F.coalesce("got", F.lit(0))
    closing = due.join(F.broadcast(got), F.col("i") == F.col("at"), "left").where(short > 0)
    return drawn_.unionByName(closing.select(F.lit(n_shards).cast("long").alias("shard"), F.col("i").alias("at"), short.alias("slots")))


def drawn_slots(counts: DataFrame, plan: list[dict], mix: Mix) -> DataFrame:
    """(shard, source, rank, pass, block, take) per slot.

    A source's ranks run through the shards; a rank gives the pass and, through the
    source's permutation for that pass, the block."""
    spark = counts.sparkSession
    rows = counts.withColumn("bucket", F.expr(f"shard div {SHARDS_PER_BUCKET}"))
    sums = rows.groupBy("at", "bucket").agg(F.sum("slots").alias("sum"))
    before = W.partitionBy("at").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.select(F.col("at").alias("a"), F.col("bucket").alias("b"), (F.sum("sum").over(before) - F.col("sum")).alias("offset"))
    within = W.partitionBy("at", "bucket").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("first", F.sum("slots").over(within) - F.col("slots")).join(sums, (F.col("at") == F.col("a")) & (F.col("bucket") == F.col("b")))
    first = F.col("first") + F.col("offset")
    # A few counts make many slots, whose permutations are the work: as many tasks as
    # a shuffle has, however few bytes the counts are.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "at")
    ranked = rows.select("shard", "at", F.explode(F.sequence(first, first + F.col("slots") - 1)).alias("rank"))
    info = spark.createDataFrame([tuple(p[c] for c in ("at", "source", "source_size", "n_blocks", "slots", "passes", "rest")) for p in plan], "i int, source string, source_size long, n_blocks long, slots long, passes long, rest long")
    slots = ranked.join(F.broadcast(info), F.col("at") == F.col("i")).where("rank < slots")
    slots = slots.withColumn("pass", F.expr("rank div n_blocks")).withColumn("turn", F.expr("rank % n_blocks"))
    # A source's short last block closes every pass.
    full = F.expr(f"source_size div {mix.block}")
    key = F.xxhash64(F.lit(mix.seed), "at", "pass")
    slots = slots.withColumn("block", F.when(F.col("turn") < full, permuted(F.col("turn"), F.greatest(full, F.lit(1)), key, mix.rounds)).otherwise(F.col("turn")))
    length = F.least(F.lit(mix.block).cast("long"), F.col("source_size") - F.col("block") * mix.block)
    left = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, F.col("rest") - F.col("turn") * mix.block))
    return slots.select("shard", "source", "rank", "pass", "block", left.alias("take"))


def fragments(rows: DataFrame, mix: Mix) -> DataFrame:
    """Laid-out rows cut at block edges: block, and the tokens [lo, hi) of the
    block that lie in the document."""
    b = mix.block
    cut = rows.where("size > 0").select("*", F.explode(F.sequence(F.expr(f"first div {b}"), F.expr(f"(first + size - 1) div {b}"))).alias("block"))
    return cut.withColumn("lo", F.greatest(F.col("first") - F.col("block") * b, F.lit(0))).withColumn("hi", F.least(F.col("first") + F.col("size") - F.col("block") * b, F.lit(b)))


def prepare(docs: DataFrame, mix: Mix, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, list[dict]]:
    rows = written(sized(docs, id_col, text_col, source_col), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return rows, source_plan({r["source"]: r["n"] for r in sums}, mix)


def same_block() -> Column:
    return F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))


def mix_report(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, first_shard (the
    first output shard that holds words of it, or null) and source."""
    spark = docs.sparkSession
    rows, plan = prepare(docs, mix, id_col, text_col, source_col)
    placed = written(laid_out(rows, mix), "placed")
    # Blocks are taken up to max_repeat times; collecting the takes of a block first
    # leaves one row per block for the join.
    slots = drawn_slots(shard_counts(spark, plan, mix), plan, mix)
    takes = slots.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.collect_list(F.struct("shard", "take")).alias("takes"))
    met = fragments(placed, mix).join(takes, same_block())
    got = F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + F.greatest(F.least(F.col("hi"), t["take"]) - F.col("lo"), F.lit(0)))
    shard = F.array_min(F.transform("takes", lambda t: F.when(t["take"] > F.col("lo"), t["shard"])))
    # first and source name a row: places in a stream are unique but for empty texts.
    taken = met.groupBy("source", "first").agg(F.sum(got).alias("taken"), F.min(shard).alias("first_shard")).select(F.col("source").alias("ts"), F.col("first").alias("tf"), "taken", "first_shard")
    info = spark.createDataFrame([(p["source"], p["source_size"], p["target"]) for p in plan], "ps string, source_size long, target double")
    return (
        placed.join(taken, F.col("source").eqNullSafe(F.col("ts")) & (F.col("first") == F.col("tf")) & (F.col("size") > 0), "left")
        .join(F.broadcast(info), F.col("source").eqNullSafe(F.col("ps")), "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "source")
    )


def tokens_of(text: Column) -> Column:
    """A text's words, each with the white space after it."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN + r"[\x20\x09-\x0D]*"), F.lit(0))


def mixed_blocks(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as blocks: shard, place in the shard, source, block, tokens and text;
    the words of a block that the partial pass's last slot leaves over are cut off."""
    spark = docs.sparkSession
    rows, plan = prepare(docs, mix, id_col, text_col, source_col)
    held = laid_out(sized(docs, id_col, text_col, source_col, F.col(text_col).alias("text")), mix, rows.count()).where("size > 0")
    b = mix.block
    blocks = F.sequence(F.expr(f"first div {b}"), F.expr(f"(first + size - 1) div {b}"))
    lo = lambda k: F.greatest(F.col("first") - k * b, F.lit(0))
    n = lambda k: F.least(F.col("first") + F.col("size") - k * b, F.lit(b)) - lo(k)
    start = lambda k: F.greatest(k * b - F.col("first"), F.lit(0))
    cut = lambda t, k: F.struct(k.alias("block"), lo(k).alias("lo"), F.array_join(F.slice(t, (start(k) + 1).cast("int"), n(k).cast("int")), "").alias("piece"))
    pieces = let(tokens_of(F.col("text")), lambda t: F.transform(blocks, lambda k: cut(t, k)))
    pieces = held.select("source", F.explode(pieces).alias("p")).select(F.col("source").alias("s"), F.col("p.block").alias("b"), F.struct("p.lo", "p.piece").alias("p"))
    # A block has at most mix.block pieces.
    packed = pieces.groupBy("s", "b").agg(F.array_sort(F.collect_list("p")).alias("pieces"))
    slots = drawn_slots(shard_counts(spark, plan, mix), plan, mix)
    order = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(mix.seed), "shard", "source", "rank"), "source", "rank")
    met = slots.join(packed, same_block()).withColumn("place", F.row_number().over(order))
    text = F.array_join(F.transform("pieces", lambda p: F.rtrim(p["piece"])), "\n")
    whole = F.least(F.lit(b).cast("long"), F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + F.regexp_count(p["piece"], F.lit(WORD_PATTERN))))
    cut = F.array_join(F.slice(tokens_of(text), F.lit(1), F.col("take").cast("int")), "")
    return met.select("shard", "place", "source", "block", F.col("take").alias("tokens"), F.when(F.col("take") == whole, text).otherwise(cut).alias("text"))


def write_blocks(docs: DataFrame, folder: str, mix: Mix = Mix()) -> DataFrame:
    """Write ``mixed_blocks`` by shard, in order of place, and read them again."""
    mixed_blocks(docs, mix).repartition("shard").sortWithinPartitions("shard", "place").write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def mixed_documents(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows with the columns of ``docs``: a row for each whole pass
    that takes a document, with its text as it is, and one for the part of it
    that the last, partial pass takes.  Documents not taken are absent.  A column
    n_chars, if there is one, is counted anew.

    Rows are dealt and ordered by output shard: a row goes with the shard that drew the
    first of its blocks in that pass, and shards are in one partition each, in order, with
    their rows shuffled.
    """
    columns = docs.columns
    shard, place = unused(columns, "shard"), unused(columns, "place")
    # Written first, so the shuffles of texts that led there are gone when they are dealt.
    rows = written(sharded_documents(docs, mix, id_col, text_col, source_col), "sharded")
    return rows.repartition(F.col(shard)).sortWithinPartitions(shard, place).select(*(F.col(f"`{c}`") for c in columns))


def sharded_documents(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``mixed_documents`` with ``shard`` and ``place``, a random number by
    which the rows of a shard go; both get underscores if ``docs`` has such columns."""
    spark = docs.sparkSession
    columns = docs.columns
    rows, plan = prepare(docs, mix, id_col, text_col, source_col)
    placed = written(laid_out(rows, mix), "placed")
    info = F.broadcast(spark.createDataFrame([(p["source"], p["passes"]) for p in plan], "ps string, passes long"))
    slots = drawn_slots(shard_counts(spark, plan, mix), plan, mix).select(F.col("source").alias("s"), F.col("block").alias("b"), "pass", "shard", "take")
    met = fragments(placed, mix).join(slots, same_block()).where(F.col("take") > F.col("lo"))
    start = F.col("block") * mix.block + F.col("lo") - F.col("first")
    piece = F.struct(start.cast("int").alias("start"), (F.least("hi", "take") - F.col("lo")).cast("int").alias("n"), "shard")
    # A document has a list of pieces for each pass, of which there are a few.
    passes = met.groupBy("source", "first", "pass").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    taken = passes.groupBy(F.col("source").alias("s"), F.col("first").alias("f")).agg(F.array_sort(F.collect_list(F.struct("pass", "pieces"))).alias("takes"))
    # Texts go through the same layout as the slim rows did, so (source, first)
    # names a row even where rows repeat.
    whole_row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")
    held = laid_out(sized(docs, id_col, text_col, source_col, whole_row), mix, rows.count()).where("size > 0")
    held = held.join(info, F.col("source").eqNullSafe(F.col("ps")), "left")
    held = held.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("first") == F.col("f")))
    text = F.col(f"row.`{text_col}`")
    out = held.select("row", "source", "first", "size", "passes", F.explode("takes").alias("t"))
    n = F.aggregate("t.pieces", F.lit(0), lambda a, p: a + p["n"])
    cut = let(tokens_of(text), lambda w: F.array_join(F.flatten(F.transform("t.pieces", lambda p: F.slice(w, p["start"] + 1, p["n"]))), ""))
    out = out.select("row", F.when((F.col("t.pass") < F.col("passes")) | (n == F.col("size")), text).otherwise(cut).alias("_taken"), F.element_at("t.pieces", 1)["shard"].alias("_shard"), F.xxhash64(F.lit(mix.seed), "source", "first", "t.pass").alias("_place"))
    new = {text_col: F.col("_taken")} | ({"n_chars": F.length("_taken").cast("long")} if "n_chars" in columns else {})
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns), F.col("_shard").alias(unused(columns, "shard")), F.col("_place").alias(unused(columns, "place")))

"""URL filters: a blocked Bloom filter in front of an exact hash join.

Listed canonical URLs are host-and-path prefixes.  Every page URL yields its
candidate keys (its host's suffixes of as many labels as listed hosts have, with
its path's prefixes of as many characters as listed paths have).  A Bloom filter
of 64-bit blocks lets possible hits pass; an exact hash join on the key removes
false positives; the longest listed key decides.  Pages whose candidates all miss
the filter are never shuffled.

Defined results: null URLs and URLs without ``://`` have empty host and path and
match nothing; repeated rows each get their own verdict; an empty list gives
everything the default verdict; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactweave.llm.base import BROADCAST_ROWS, lower_ascii_col

#: Most 64-bit blocks of the filter: 512 KB of driver-built literal at most.
MAX_BLOCKS = 1 << 16
KEYS_PER_BLOCK = 4
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, URL_PARTS, i), F.lit(""))
    return lower_ascii_col(part(1)), part(2)


def labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def block_of(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def mask_of(key: Column) -> Column:
    """Four bits of a 64-bit block, from a second hash of the key."""
    h = F.xxhash64(F.lit("bits"), key)
    at = lambda k: F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), at(k))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def listed_keys(rules: DataFrame) -> DataFrame:
    """Canonical rows (key, rule, verdict, n_labels, path_len) of a list with
    columns rule (``host[/path]``) and verdict; null rules are no rules, and of a
    rule listed twice, block wins."""
    key = F.concat(lower_ascii_col(F.substring_index("rule", "/", 1)), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)"))
    rows = rules.where(F.col("rule").isNotNull()).select("rule", "verdict", key.alias("key"))
    rows = rows.groupBy("key").agg(F.max(F.struct("verdict", "rule")).alias("r"))
    host = F.substring_index("key", "/", 1)
    return rows.select("key", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"), labels(host).alias("n_labels"), (F.length("key") - F.length(host)).alias("path_len"))


def bloom_blocks(keys: DataFrame, n_keys: int) -> list[int]:
    """The filter's blocks, OR-ed together per block by Spark; the driver gets at
    most ``MAX_BLOCKS`` numbers.  Larger lists fill it up, which costs filtering,
    never correctness."""
    n_blocks = min(MAX_BLOCKS, max(16, 1 << (max(1, n_keys) // KEYS_PER_BLOCK).bit_length()))
    blocks = [0] * n_blocks
    for r in keys.groupBy(block_of(F.col("key"), n_blocks).alias("b")).agg(F.bit_or(mask_of(F.col("key"))).alias("m")).collect():
        blocks[r["b"]] = r["m"]
    return blocks


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: its id, host, path, the longest rule that
    fits (or null) and its verdict (or ``default``)."""
    keys = listed_keys(rules)
    stats = keys.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.struct("n_labels", "path_len")).alias("shapes")).first()
    n_keys, shapes = stats["n"], sorted((s["n_labels"], s["path_len"]) for s in stats["shapes"])
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    none = F.lit(None).cast("string")
    if not shapes:
        return rows.select("page_id", "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    blocks = bloom_blocks(keys, n_keys)
    words = F.split(F.lit(",".join(map(str, blocks))), ",").cast("array<bigint>")
    shape_list = F.from_json(F.lit("[" + ",".join(f'{{"l":{a},"p":{b}}}' for a, b in shapes) + "]"), "array<struct<l:int,p:int>>")
    fits = F.filter(shape_list, lambda s: (s["l"] <= labels(F.col("host"))) & (s["p"] <= F.length("path")))
    candidates = F.transform(fits, lambda s: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["l"]), F.call_function("substring", F.col("path"), F.lit(1), s["p"])))
    may_hit = lambda k: F.element_at(words, block_of(k, len(blocks)) + 1).bitwiseAND(mask_of(k)) == mask_of(k)
    probed = rows.withColumn("possible", F.filter(candidates, may_hit))
    missed = probed.where(F.size("possible") == 0).select("page_id", "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    exact = keys.select("key", F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("verdict")).alias("hit"))
    exact = F.broadcast(exact) if n_keys <= BROADCAST_ROWS else exact
    hits = probed.where(F.size("possible") > 0).withColumn("row", F.monotonically_increasing_id())
    best = (
        hits.select("row", "page_id", "host", "path", F.explode("possible").alias("key"))
        .join(exact, "key", "left")
        .groupBy("row", "page_id", "host", "path")
        .agg(F.max("hit").alias("hit"))
        .select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
    )
    return missed.unionByName(best)

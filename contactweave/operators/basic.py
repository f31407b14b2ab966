"""Sorting, flipping, filtering and generating pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactweave.functions.expr import compile_condition
from contactweave.functions.fields import named, once, with_fields, with_only
from contactweave.model import STANDARD, UNMAPPED_CHROM, Header, Pairs


def sort_keys(df: DataFrame, extra: list[str] | None = None) -> list[str]:
    """chrom1, chrom2 (bytewise), pos1, pos2, pair_type, extra columns, input order."""
    keys = ["chrom1", "chrom2", "pos1", "pos2", *(["pair_type"] if "pair_type" in df.columns else []), *(extra or [])]
    return [*keys, *(["seq"] if "seq" in df.columns else [])]


def sort_pairs(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return df.orderBy(*sort_keys(df, extra))


def column_pairs(columns: list[str]) -> list[str]:
    return [c[:-1] for c in columns if c.endswith("1") and c[:-1] + "2" in columns]


def side_places(chroms: list[str]) -> tuple[Column, Column]:
    """Places of both sides' names in (``!``, *chroms), null where they aren't listed."""
    listed = F.array(*map(F.lit, [UNMAPPED_CHROM, *chroms]))
    return tuple(F.nullif(F.array_position(listed, F.col(c)), F.lit(0).cast("long")) for c in ("chrom1", "chrom2"))


def needs_flip(chroms: list[str], places: tuple[Column, Column] | None = None) -> Column:
    """Whether a row is out of order: sides go by place in (``!``, *chroms) and then
    position; a listed side goes before an unlisted one; of two unlisted sides the
    bytewise smaller name goes first, and equal names count as out of order.
    ``places`` are the ``side_places`` where they are columns of the row already."""
    e1, e2 = places or side_places(chroms)
    return (
        F.when(e1.isNotNull() & e2.isNotNull(), (e1 > e2) | ((e1 == e2) & (F.col("pos1") > F.col("pos2"))))
        .when(e1.isNotNull(), F.lit(False))
        .when(e2.isNotNull(), F.lit(True))
        .otherwise(~(F.col("chrom1") < F.col("chrom2")))
    )


def flip_pairs(df: DataFrame, chroms: list[str]) -> DataFrame:
    """Swap the sides, in every column pair, of rows that are out of order."""
    swap = {}
    for c in column_pairs(df.columns):
        swap |= {f"{c}1": f"{c}2", f"{c}2": f"{c}1"}
    at = {c: i for i, c in enumerate(named(df))}
    raw = lambda c: lambda f: F.get(f, F.lit(at[c]))
    changes = {c: raw(swap[c]) for c in swap}
    if "pair_type" in at:
        changes["pair_type"] = lambda f: once(raw("pair_type")(f), lambda t: F.concat(F.reverse(F.substring(t, 1, 2)), F.substr(t, F.lit(3))))
    flipped = with_fields(df, changes, needs_flip(chroms))
    # Columns, as a row's order names the places several times, and they would be looked
    # for each time.
    for c, e in zip(("_e1", "_e2"), side_places(chroms)):
        flipped = flipped.withColumn(c, e)
    flipped = flipped.withColumn("_flip", needs_flip(chroms, (F.col("_e1"), F.col("_e2"))))

    def column(c: str) -> Column:
        if c in swap:
            return F.when(F.col("_flip"), F.col(swap[c])).otherwise(F.col(c)).alias(c)
        if c == "pair_type":
            turned = F.concat(F.reverse(F.substring(c, 1, 2)), F.expr(f"substring({c}, 3)"))
            return F.when(F.col("_flip"), turned).otherwise(F.col(c)).alias(c)
        return F.col(f"`{c}`")

    return flipped.select(*(column(c) for c in df.columns))


def select_pairs(df: DataFrame, condition: str, types: dict[str, str] | None = None, chrom_subset: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that meet the condition, the rest)."""
    keep = F.coalesce(compile_condition(condition, df, types), F.lit(False))
    if chrom_subset is not None:
        keep = keep & F.col("chrom1").isin(chrom_subset) & F.col("chrom2").isin(chrom_subset)
    # A column that Spark doesn't take for a function of the row is worked out after the
    # row's columns and once; a plain filter would repeat their expressions wherever the
    # condition names them, until the code is too long to be compiled.
    met = df.withColumn("_keep", keep & (F.spark_partition_id() >= 0))
    return met.where("_keep").drop("_keep"), met.where("NOT _keep").drop("_keep")


def without_columns(pairs: Pairs, names: list[str]) -> Pairs:
    """``pairs`` without these columns, in the header too; names that aren't there are
    passed over."""
    header = Header(list(pairs.header.lines))
    header.set_columns([c for c in header.columns() if c not in names])
    gone = [c for c in names if c in pairs.header.columns()]
    return Pairs(header, with_only(pairs.df, header.columns()).drop(*gone) if gone else pairs.df)


def subset_header(header: Header, names: list[str]) -> Header:
    """``header`` with these chromosomes only."""
    out = Header(list(header.lines))
    out.subset_chromosomes(set(names))
    return out


def generated_header(chromosomes: int = 24, chrom_length: int = 100_000_000, extra_columns: int = 0, in_order: bool = False) -> Header:
    header = Header.standard({f"chr{i}": chrom_length for i in range(1, chromosomes + 1)}, [*STANDARD, *(f"extra{i}" for i in range(1, extra_columns + 1))])
    if in_order:
        header.mark_sorted()
    return header


def generate_pairs(spark: SparkSession, records: int = 1_000_000, seed: int = 42, chromosomes: int = 24, chrom_length: int = 100_000_000, cis_fraction: float = 0.75, duplicate_rate: float = 0.1, duplicate_radius: int = 2, unmapped_fraction: float = 0.02, extra_columns: int = 0, readid_length: int = 0, in_order: bool = False) -> DataFrame:
    """Synthetic pairs: log-uniform cis distances, near copies of earlier rows, and
    unmapped sides.  All numbers are hashes of (seed, row), so any partitioning
    gives the same rows.  Read names are ``r`` and the row's number, or have
    ``readid_length`` letters and digits; extra columns are small numbers as text; with
    ``in_order``, sides are in order and rows sorted.
    """
    u = lambda row, k: F.pmod(F.xxhash64(F.lit(seed), row, F.lit(k)), F.lit(1 << 40)) / float(1 << 40)
    copied = (u(F.col("id"), 0) < duplicate_rate) & (F.col("id") > 0)
    back = F.least(F.col("id"), F.lit(1) + F.floor(u(F.col("id"), 1) * 1024))
    rows = spark.range(records).withColumn("of", F.when(copied, F.col("id") - back).otherwise(F.col("id")))
    of = F.col("of")
    c1, cis = F.floor(u(of, 2) * chromosomes), u(of, 3) < cis_fraction
    c2 = F.when(cis, c1).otherwise(F.floor(u(of, 4) * chromosomes))
    p1 = F.floor(u(of, 5) * chrom_length) + 1
    p2 = F.when(cis, F.least(p1 + F.floor(F.pow(10.0, u(of, 6) * 8)), F.lit(chrom_length))).otherwise(F.floor(u(of, 7) * chrom_length) + 1)
    jitter = lambda p, k: F.least(F.greatest(p + F.when(copied, F.floor(u(F.col("id"), k) * (2 * duplicate_radius + 1)) - duplicate_radius).otherwise(0), F.lit(1)), F.lit(chrom_length)).cast("long")
    lost1, lost2 = u(of, 10) < unmapped_fraction, u(of, 11) < unmapped_fraction
    name = lambda c: F.concat(F.lit("chr"), (c + 1).cast("string"))
    strand = lambda k: F.when(u(of, k) < 0.5, "+").otherwise("-")
    side = lambda lost, value, none: F.when(lost, F.lit(none)).otherwise(value)
    letter = lambda k: F.substring(F.conv(F.floor(u(F.col("id"), 100 + k) * 36).cast("string"), 10, 36), 1, 1)
    name_of = F.concat(*map(letter, range(readid_length))) if readid_length else F.concat(F.lit("r"), F.col("id").cast("string"))
    out = rows.select(
        F.col("id").alias("seq"),
        name_of.alias("readID"),
        side(lost1, name(c1), "!").alias("chrom1"),
        side(lost1, jitter(p1, 8), 0).cast("long").alias("pos1"),
        side(lost2, name(c2), "!").alias("chrom2"),
        side(lost2, jitter(p2, 9), 0).cast("long").alias("pos2"),
        side(lost1, strand(12), "-").alias("strand1"),
        side(lost2, strand(13), "-").alias("strand2"),
        F.concat(F.when(lost1, "N").otherwise("U"), F.when(lost2, "N").otherwise("U")).alias("pair_type"),
        *(F.floor(u(F.col("id"), 20 + i) * 61).cast("string").alias(f"extra{i + 1}") for i in range(extra_columns)),
    )
    return sort_pairs(flip_pairs(out, [f"chr{i}" for i in range(1, chromosomes + 1)])) if in_order else out

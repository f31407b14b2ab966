"""Sparse contact matrices at one or more resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactweave.model import UNMAPPED_CHROM, ArgumentError, PairsError
from contactweave.sources.pairs import write_lines

#: What becomes of a row.
OUTCOMES = ("accepted", "rejected", "unknown_chrom", "out_of_range")


def layout(df: DataFrame, chromsizes: dict[str, int], resolutions: list[int]) -> DataFrame:
    """(resolution, chrom, offset, n_bins, size): one row per chromosome and
    resolution, from the driver's short list."""
    rows = []
    for r in resolutions:
        at = 0
        for c, n in chromsizes.items():
            if n <= 0:
                raise PairsError(f"chromosome {c} has no length")
            rows.append((r, c, at, -(-n // r), n))
            at += -(-n // r)
    return df.sparkSession.createDataFrame(rows, "resolution long, chrom string, offset long, n_bins long, size long")


def acceptable(df: DataFrame, pair_types: list[str] | None = None, min_mapq: int | None = None) -> Column:
    """Whether both sides of a row are mapped and its type and qualities will do."""
    good = (F.col("chrom1") != UNMAPPED_CHROM) & (F.col("chrom2") != UNMAPPED_CHROM)
    if pair_types is not None:
        good = good & F.substring("pair_type", 1, 8).isin([p[:8] for p in pair_types])
    if min_mapq is not None:
        if not {"mapq1", "mapq2"} <= set(df.columns):
            raise PairsError("min_mapq needs mapq1 and mapq2")
        for c in ("mapq1", "mapq2"):
            good = good & (F.col(c).cast("string").try_cast("bigint") >= min_mapq)
    return F.coalesce(good, F.lit(False))


def accepted(df: DataFrame, pair_types: list[str] | None = None, min_mapq: int | None = None, zero_based: bool = False) -> DataFrame:
    out = df.where(acceptable(df, pair_types, min_mapq))
    return out if zero_based else out.where("pos1 > 0 and pos2 > 0")


def bin_contacts(df: DataFrame, chromsizes: dict[str, int], resolutions: list[int], zero_based: bool = False) -> DataFrame:
    """(resolution, bin1_id, bin2_id, count) with bin1_id <= bin2_id; rows on
    chromosomes that aren't listed are left out."""
    bins = layout(df, chromsizes, resolutions)
    side = lambda s: F.broadcast(bins.select(*(F.col(c).alias(f"{c}_{s}") for c in bins.columns)))
    met = df.join(side("a"), F.col("chrom1") == F.col("chrom_a")).join(side("b"), (F.col("chrom2") == F.col("chrom_b")) & (F.col("resolution_a") == F.col("resolution_b")))
    shift = 0 if zero_based else 1
    place = lambda p, s: F.col(f"offset_{s}") + F.least(F.expr(f"({p} - {shift}) div resolution_{s}"), F.col(f"n_bins_{s}") - 1)
    ids = met.select(F.col("resolution_a").alias("resolution"), place("pos1", "a").alias("x"), place("pos2", "b").alias("y"))
    return ids.groupBy("resolution", F.least("x", "y").alias("bin1_id"), F.greatest("x", "y").alias("bin2_id")).agg(F.count(F.lit(1)).alias("count"))


def bin_table(df: DataFrame, chromsizes: dict[str, int], resolution: int) -> DataFrame:
    """(bin_id, chrom, start, end) of all bins; the last end is the chromosome's."""
    rows = layout(df, chromsizes, [resolution]).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("i"))
    return rows.select((F.col("offset") + F.col("i")).alias("bin_id"), "chrom", (F.col("i") * resolution).alias("start"), F.least((F.col("i") + 1) * resolution, F.col("size")).alias("end"))


def bedgraph(contacts: DataFrame, bins: DataFrame) -> DataFrame:
    """Contacts of one resolution with both bins' places."""
    side = lambda s: bins.select(F.col("bin_id").alias(f"id{s}"), *(F.col(c).alias(f"{c}{s}") for c in ("chrom", "start", "end")))
    met = contacts.join(side(1), F.col("bin1_id") == F.col("id1")).join(side(2), F.col("bin2_id") == F.col("id2"))
    return met.select("chrom1", "start1", "end1", "chrom2", "start2", "end2", "count")


def binned(df: DataFrame, chromsizes: dict[str, int], resolutions: list[int], pair_types: list[str] | None = None, min_mapq: int | None = None, zero_based: bool = False) -> DataFrame:
    """``bin_contacts`` of the accepted rows, and with them the counts of all rows by
    what becomes of them, at resolution 0 with a place in ``OUTCOMES`` as both bins.

    One aggregate gives both, so the input is read once, and a task that runs again
    doesn't count twice, as an observation before a shuffle would."""
    layout(df, chromsizes, resolutions)  # for its errors
    rows, at = [], [0] * len(resolutions)
    for chrom, size in chromsizes.items():
        rows.append((chrom, size, list(at)))
        at = [a + -(-size // r) for a, r in zip(at, resolutions)]
    places = df.sparkSession.createDataFrame(rows, "chrom string, size long, offsets array<long>")
    side = lambda n: F.broadcast(places.select(*(F.col(c).alias(f"_{c}{n}") for c in places.columns)))
    met = df.select("chrom1", "pos1", "chrom2", "pos2", acceptable(df, pair_types, min_mapq).alias("_good"))
    met = met.join(side(1), F.col("chrom1") == F.col("_chrom1"), "left").join(side(2), F.col("chrom2") == F.col("_chrom2"), "left")
    shift = 0 if zero_based else 1
    bin_of = lambda n, r: F.expr(f"(pos{n} - {shift}) div {r}")
    last = lambda n, r: F.expr(f"(_size{n} + {r - 1}) div {r} - 1")
    beyond = F.lit(False)
    for r in resolutions:
        for n in (1, 2):
            beyond = beyond | (bin_of(n, r) > last(n, r))
    known = F.col("_chrom1").isNotNull() & F.col("_chrom2").isNotNull()
    placed = F.lit(True) if zero_based else F.coalesce((F.col("pos1") > 0) & (F.col("pos2") > 0), F.lit(False))
    code = lambda name: F.lit(OUTCOMES.index(name)).cast("long")
    kind = F.when(~F.col("_good"), code("rejected")).when(~known, code("unknown_chrom")).when(~placed, code("rejected")).when(beyond, code("out_of_range")).otherwise(code("accepted"))
    met = met.withColumn("_kind", kind)
    kept = F.col("_kind").isin(OUTCOMES.index("accepted"), OUTCOMES.index("out_of_range"))
    entry = lambda r, x, y: F.struct(F.lit(r).cast("long").alias("resolution"), F.least(x, y).alias("bin1_id"), F.greatest(x, y).alias("bin2_id"))
    spot = lambda n, i, r: F.get(f"_offsets{n}", F.lit(i)) + F.least(bin_of(n, r), last(n, r))
    own = F.array(entry(0, F.col("_kind"), F.col("_kind")))
    whole = F.concat(own, F.array(*(entry(r, spot(1, i, r), spot(2, i, r)) for i, r in enumerate(resolutions))))
    return met.select(F.explode(F.when(kept, whole).otherwise(own)).alias("e")).groupBy("e.resolution", "e.bin1_id", "e.bin2_id").agg(F.count(F.lit(1)).alias("count"))


def counters_of(table: DataFrame) -> dict[str, int]:
    """The counters in a ``binned`` table; rows beyond the last bin are accepted too."""
    n = {OUTCOMES[r["bin1_id"]]: r["count"] for r in table.where("resolution = 0").collect()}
    out = {k: n.get(k, 0) for k in OUTCOMES}
    return out | {"accepted": out["accepted"] + out["out_of_range"]}


def bin_counters(df: DataFrame, chromsizes: dict[str, int], resolutions: list[int], pair_types: list[str] | None = None, min_mapq: int | None = None, zero_based: bool = False) -> dict[str, int]:
    """How many rows were accepted, rejected (a filter, or position 0), on unknown
    chromosomes, and accepted beyond their chromosome's last bin."""
    return counters_of(binned(df, chromsizes, resolutions, pair_types, min_mapq, zero_based))


def output_paths(paths: list[str], resolutions: list[int]) -> list[str]:
    """A path for every resolution: as many as there are, one that holds ``{res}``, or
    none (standard output) for a single resolution."""
    if len(paths) == 1 and "{res}" in paths[0]:
        return [paths[0].replace("{res}", str(r)) for r in resolutions]
    paths = paths or (["-"] if len(resolutions) == 1 else [])
    if len(paths) != len(resolutions):
        raise ArgumentError(f"{len(paths)} path(s) for {len(resolutions)} resolution(s); give one each, or one with {{res}}")
    return paths


def write_table(df: DataFrame, order: list[str], path: str) -> int:
    """Tab-separated lines of all columns in ``order``."""
    value = F.array_join(F.array(*(F.col(c).cast("string") for c in df.columns)), "\t")
    return write_lines(df.orderBy(*order).select(value.alias("value")), path)


def write_contacts(contacts: DataFrame, chromsizes: dict[str, int], resolutions: list[int], paths: list[str], form: str = "coo") -> None:
    """``bin_contacts`` as a file for each resolution: bin ids and counts (coo), or both
    bins' places and counts (bg2)."""
    if form not in ("coo", "bg2"):
        raise ArgumentError(f"unknown format {form!r}")
    for r, path in zip(resolutions, output_paths(paths, resolutions), strict=True):
        ids = contacts.where(F.col("resolution") == r).select("bin1_id", "bin2_id", "count")
        if form == "coo":
            write_table(ids, ["bin1_id", "bin2_id"], path)
        else:
            # Bins go by the ids that they came from.
            side = lambda n: bin_table(contacts, chromsizes, r).select(F.col("bin_id").alias(f"bin{n}_id"), *(F.col(c).alias(f"{c}{n}") for c in ("chrom", "start", "end")))  # noqa: B023, E731
            met = ids.join(side(1), "bin1_id").join(side(2), "bin2_id").orderBy("bin1_id", "bin2_id")
            value = F.array_join(F.array(*(F.col(c).cast("string") for c in ("chrom1", "start1", "end1", "chrom2", "start2", "end2", "count"))), "\t")
            write_lines(met.select(value.alias("value")), path)


def write_bins(df: DataFrame, chromsizes: dict[str, int], resolutions: list[int], paths: list[str]) -> None:
    """Chromosome, start and end of every bin, a file for each resolution."""
    for r, path in zip(resolutions, output_paths(paths, resolutions), strict=True):
        table = bin_table(df, chromsizes, r)
        value = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"))
        write_lines(table.orderBy("bin_id").select(value.alias("value")), path)

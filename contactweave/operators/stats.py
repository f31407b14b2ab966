"""Library statistics: counters, distributions and summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactweave.model import UNMAPPED_CHROM

#: Cis thresholds in kb, strand orders, deviation that counts as unconverged.
CIS_KB = (1, 2, 4, 10, 20, 40)
DIRECTIONS = ("+-", "-+", "--", "++")
CONVERGENCE_ORDER = ("++", "--", "-+", "+-")
DEVIATION = 0.05


def bin_edges(per_decade: int = 8) -> list[int]:
    """Distance-bin edges: 0 and 10 ** (i / n) rounded half to even, up to 9 decades."""
    edges, i = {0}, 0
    while i / per_decade < 9.001:
        edges.add(round(10 ** (i / per_decade)))
        i += 1
    return sorted(edges)


def lower_edge(distance: Column, per_decade: int = 8) -> Column:
    """The largest bin edge that is not above a distance: the power that its logarithm
    names, or one of the two beside it, as edges are rounded."""
    powers = [round(10 ** (i / per_decade)) for i in range(9 * per_decade + 1)]
    held = F.split(F.lit(",".join(map(str, [powers[0], *powers, 1 << 62]))), ",").cast("array<bigint>")
    i = F.least(F.floor(F.log10(distance.cast("double")) * per_decade), F.lit(len(powers) - 1)).cast("int")
    at = lambda k: F.get(held, i + k)
    found = F.when(distance >= at(2), at(2)).when(distance >= at(1), at(1)).otherwise(at(0))
    return F.when(distance < 1, F.lit(0).cast("bigint")).otherwise(found)


def sides_mapped() -> Column:
    one = lambda c: F.when(F.col(c) != UNMAPPED_CHROM, 1).otherwise(0)
    return one("chrom1") + one("chrom2")


def with_classes(df: DataFrame, per_decade: int = 8) -> DataFrame:
    """Counting columns; ``dup`` (boolean) may be among the input's columns."""
    dup = F.col("dup") if "dup" in df.columns else F.lit(False)
    counted = (sides_mapped() == 2) & ~dup
    cis = counted & (F.col("chrom1") == F.col("chrom2"))
    distance = F.abs(F.col("pos2") - F.col("pos1"))
    strands = F.concat("strand1", "strand2")
    return df.select(
        F.substring("pair_type", 1, 8).alias("pair_type"), "chrom1", "chrom2", dup.alias("dup"), sides_mapped().alias("sides"), cis.alias("cis"), counted.alias("counted"),
        F.when(cis, distance).alias("distance"),
        F.when(cis, F.when(strands.isin("+-", "-+", "--"), strands).otherwise("++")).alias("direction"),
        F.when(cis, lower_edge(distance, per_decade)).cast("long").alias("bin"),
    )


def counters(classes: DataFrame) -> DataFrame:
    """One row of totals."""
    n = lambda c, name: F.count_if(c).cast("long").alias(name)
    both = F.col("sides") == 2
    return classes.agg(
        F.count(F.lit(1)).alias("total"),
        n(F.col("sides") == 0, "total_unmapped"), n(F.col("sides") == 1, "total_single_sided_mapped"), n(both, "total_mapped"),
        n(both & F.col("dup"), "total_dups"), n(F.col("counted"), "total_nodups"), n(F.col("cis"), "cis"), n(F.col("counted") & ~F.col("cis"), "trans"),
        *(n(F.col("distance") >= 1000 * k, f"cis_{k}kb") for k in CIS_KB),
    )


def pair_types(classes: DataFrame) -> DataFrame:
    return classes.groupBy("pair_type").agg(F.count(F.lit(1)).alias("n"))


def chrom_freq(classes: DataFrame) -> DataFrame:
    return classes.where("counted").groupBy("chrom1", "chrom2").agg(F.count(F.lit(1)).alias("n"))


def dist_freq(classes: DataFrame) -> DataFrame:
    """(bin, direction, n) of the bins that occur."""
    return classes.where("cis").groupBy("bin", "direction").agg(F.count(F.lit(1)).alias("n"))


def lambert_w(x: float) -> float:
    """The principal branch, by Halley's iteration, for x >= -1/e."""
    w = math.log1p(x) if x > -0.2 else -1 + math.sqrt(max(0.0, 2 * (1 + math.e * x)))
    for _ in range(100):
        e = math.exp(w)
        f = w * e - x
        if w == -1:
            return w
        step = f / (e * (w + 1) - (w + 2) * f / (2 * w + 2))
        w -= step
        if abs(step) <= 1e-15 * (1 + abs(w)):
            break
    return w


def complexity(total_mapped: int, total_dups: int) -> float:
    """Estimated number of distinct molecules; NaN without duplicates, 0 if nothing
    was mapped or everything is a duplicate."""
    unique = 1 - total_dups / total_mapped if total_mapped else 0
    if not unique:
        return 0
    if unique == 1:
        return math.nan
    return total_mapped / (lambert_w(-math.exp(-1 / unique) / unique) + 1 / unique)


def convergence(freq: dict[tuple[int, str], int], edges: list[int]) -> dict[str, object]:
    """The distance beyond which all four strand directions agree; a difference in
    the first bin alone doesn't count."""
    last: dict[str, int] = {}
    for d in CONVERGENCE_ORDER:
        last[d] = 0
        for i, b in enumerate(edges):
            counts = [freq.get((b, x), 0) for x in DIRECTIONS]
            mean = sum(counts) / 4
            if mean and abs(freq.get((b, d), 0) - mean) / mean > DEVIATION:
                last[d] = i
    worst = max(CONVERGENCE_ORDER, key=lambda d: last[d])
    at = last[worst]
    if at == 0:
        return {"convergence_dist": "0", "strands_w_max_convergence_dist": "??"}
    return {"convergence_dist": edges[at + 1] if at + 1 < len(edges) else (1 << 63) - 1, "strands_w_max_convergence_dist": worst}


def summary(counts: dict[str, int]) -> dict[str, float]:
    """Ratios; 0 where nothing was counted."""
    rate = lambda a, b: a / b if b else 0
    out = {"frac_cis": rate(counts["cis"], counts["total_nodups"])}
    out |= {f"frac_cis_{k}kb+": rate(counts[f"cis_{k}kb"], counts["total_nodups"]) for k in CIS_KB}
    return out | {"frac_dups": rate(counts["total_dups"], counts["total_mapped"]), "complexity_naive": complexity(counts["total_mapped"], counts["total_dups"])}

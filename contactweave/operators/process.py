"""Alignments to pairs, sorted, without duplicates, counted and binned, in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactweave.functions.graph import written
from contactweave.model import Pairs
from contactweave.operators import basic, binning, dedup
from contactweave.operators.parse import ParseOptions, parse_sam
from contactweave.sources import statsfile


@dataclass
class Processed:
    """Three sets of pairs in sorted order (by ``seq``), and what was asked for
    besides: statistics of all rows and contacts of the kept ones."""

    kept: Pairs
    dups: Pairs
    unmapped: Pairs
    stats: statsfile.Snapshot
    contacts: DataFrame | None


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``seq`` as its place in sorted order.  Rows are dealt by ranges of
    the sort keys, so numbers grow from one task to the next without a window; the
    table is written, which fixes them."""
    return written(basic.sort_pairs(df).withColumn("seq", F.monotonically_increasing_id()), "sorted")


def process_sam(spark: SparkSession, path: str, chromsizes: dict[str, int], options: ParseOptions | None = None, max_mismatch: int = 3, metric: str = "max", clustering: str = "transitive", mark_dups: bool = True, resolutions: list[int] | None = None, name_grouped: bool = False) -> Processed:
    """Pairs of a SAM text file; of duplicates the first in sorted order stays, and
    the others get the type DD if ``mark_dups``.  An empty file gives empty results."""
    parsed = parse_sam(spark, path, chromsizes, options, name_grouped=name_grouped)
    parsed.header.mark_sorted()
    rows = dedup.mark_duplicates(numbered(parsed.df), max_mismatch, metric, clustering)
    dup = F.col("outcome") == "dup"
    if mark_dups:
        rows = rows.withColumn("pair_type", F.when(dup, "DD").otherwise(F.col("pair_type")))
    rows = written(rows, "processed")
    part = lambda name: Pairs(parsed.header, rows.where(F.col("outcome") == name).drop("outcome", "parent"))
    kept = part("kept")
    contacts = binning.bin_contacts(binning.accepted(kept.df), chromsizes, resolutions) if resolutions else None
    return Processed(kept, part("dup"), part("unmapped"), statsfile.gather(rows.withColumn("dup", dup)), contacts)

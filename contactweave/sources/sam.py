"""SAM text and BAM as a DataFrame of alignment records.

Mates are consecutive lines of one name, so a read's records can straddle two input
splits.  Runs of equal names are found within every split, and the few rows at the
splits' edges carry a run from one to the next.  Of input that is grouped by name,
``name_grouped=True`` says that equal names are one read, and no run is looked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactweave.functions.ordering import with_runs
from contactweave.model import PairsError, Unsupported
from contactweave.sources.pairs import place
from contactweave.sources.raw import Bytes, bam_head, bam_records, head_lines, inflated, sniff, text_lines

#: Names and types of the mandatory SAM fields that are kept.
FIELDS = (("name", "string"), ("flag", "int"), ("ref", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"))


def is_bam(path: str) -> bool:
    """By content: compressed alignments are BAM, others SAM text."""
    if path.endswith(".cram"):
        raise Unsupported("CRAM can't be read; give SAM text or BAM")
    kind = sniff(path)
    if kind == "lz4":
        raise Unsupported("alignments in LZ4 frames can't be read; give SAM text or BAM")
    return kind != "plain"


def sam_header(spark: SparkSession, path: str) -> list[str]:
    """The leading ``@`` lines, in order."""
    if is_bam(path):
        return bam_head(Bytes(inflated(path), path))[0]
    return head_lines(spark, path, "@")


def references(header: list[str]) -> dict[str, int]:
    """Names and lengths of the reference sequences, in header order."""
    out: dict[str, int] = {}
    for line in header:
        if line.startswith("@SQ\t"):
            tags = dict(t.split(":", 1) for t in line.split("\t")[1:] if ":" in t)
            if "SN" not in tags or not tags.get("LN", "").isdigit():
                raise PairsError(f"bad @SQ line: {line!r}")
            out[tags["SN"]] = int(tags["LN"])
    if not out:
        raise PairsError("the SAM header has no @SQ reference sequences")
    return out


def read_sam(spark: SparkSession, path: str, name_grouped: bool = False) -> DataFrame:
    """(seq, run, name, flag, ref, pos, mapq, cigar, tags, line) per record; ``run``
    tells reads of equal names that are not consecutive apart."""
    lines = bam_records(spark, path) if is_bam(path) else text_lines(spark, path).where((F.col("line") != "") & ~F.col("line").rlike("^@[A-Z][A-Z]\t"))
    f = F.split("line", "\t", -1)
    body = lines.select("seq", "line", F.when(F.size(f) >= 11, f).otherwise(F.raise_error(F.concat(place(path), F.lit(": too few SAM fields: "), "line"))).alias("f"))
    records = body.select("seq", *(F.col("f")[i].cast(t).alias(n) for i, (n, t) in enumerate(FIELDS)), F.slice("f", 12, F.size("f")).alias("tags"), "line")
    if name_grouped:
        return records.withColumn("run", F.lit(0).cast("long"))
    return with_runs(records, "name", "run")

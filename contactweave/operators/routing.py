"""What becomes of kept, duplicate and unmapped pairs: marking, parents and outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactweave.functions.fields import with_appended, with_fields
from contactweave.functions.graph import written
from contactweave.functions.ordering import with_previous
from contactweave.model import ArgumentError, Header, NotSorted, Pairs
from contactweave.operators import dedup
from contactweave.sources import statsfile

#: Names of other tools' clustering backends, and the clustering that each one does.
BACKENDS = {"scipy": "transitive", "sklearn": "transitive", "cython": "greedy"}
HEADERS_TO = ("dups", "dedup", "both", "none")


def check_sorted(df: DataFrame, path: str = "input") -> None:
    """An error unless mapped rows of read pairs are in blocks of (chrom1, chrom2), each
    in one piece, with ascending pos1."""
    rows = with_previous(df.where(dedup.mapped()).select("seq", "chrom1", "chrom2", "pos1"), ["chrom1", "chrom2", "pos1"], "before")
    same = F.col("before").isNotNull() & (F.col("chrom1") == F.col("before.chrom1")) & (F.col("chrom2") == F.col("before.chrom2"))
    rows = rows.select("seq", "chrom1", "chrom2", (same & (F.col("pos1") < F.col("before.pos1"))).alias("back"), (~same).alias("begins"))
    back = F.min(F.when(F.col("back"), F.col("seq"))).alias("back")
    blocks = rows.groupBy("chrom1", "chrom2").agg(back, F.count_if("begins").alias("n"), F.max(F.when(F.col("begins"), F.col("seq"))).alias("again"))
    bad = blocks.select(F.least("back", F.when(F.col("n") > 1, F.col("again"))).alias("at"), "chrom1", "chrom2").where("at is not null").orderBy("at").first()
    if bad:
        raise NotSorted(f"{path}: not sorted at line {(bad['at'] & (1 << 33) - 1) + 1}, block {bad['chrom1']} {bad['chrom2']}")


@dataclass
class Outputs:
    """Pairs by output; None where rows of a kind are dropped.  ``main`` may hold other
    kinds too; within an output, rows keep the input's order."""

    main: Pairs
    dups: Pairs | None
    unmapped: Pairs | None
    stats: statsfile.Snapshot | None
    counters: dict[str, int]


def route(pairs: Pairs, dups_to: str = "drop", unmapped_to: str = "drop", mark_dups: bool = True, keep_parent_id: bool = False, with_stats: bool = False, max_mismatch: int = 3, metric: str = "max", clustering: str = "transitive", extra_pairs: list[tuple[str, str]] | None = None) -> Outputs:
    """Find duplicates and deal the rows to outputs.

    ``dups_to`` is drop, main or own, ``unmapped_to`` drop, main, dups or own.  With
    ``keep_parent_id`` duplicates name the read that they repeat.  Transitive clustering
    then gives unmapped rows an empty field, and kept rows their own name if duplicates
    share the main output; other rows have one field less.
    """
    if dups_to not in ("drop", "main", "own") or unmapped_to not in ("drop", "main", "dups", "own"):
        raise ArgumentError("outputs are drop, main, own, or dups for unmapped pairs")
    clustering = BACKENDS.get(clustering, clustering)
    columns = pairs.header.columns()
    # Rows that input splits don't number in order are numbered by the reader's seq.
    marked = written(dedup.mark_duplicates(pairs.df, max_mismatch, metric, clustering, extra_pairs), "marked")
    out = marked
    if keep_parent_id:
        parents = marked.join(marked.select(F.col("parent").alias("p")).distinct(), F.col("seq") == F.col("p"), "left_semi").select(F.col("seq").alias("p"), F.col("readID").alias("named"))
        # Rows that repeat none would all be dealt to one task; their order spreads them.
        out = out.join(parents, F.col("parent").isNotNull() & (F.coalesce("parent", "seq") == F.col("p")), "left")
        whole = clustering == "transitive"
        own = F.when(F.lit(whole and dups_to == "main") & (F.col("outcome") == "kept"), F.col("readID"))
        field = F.when(F.col("outcome") == "dup", F.col("named")).when(F.lit(whole) & (F.col("outcome") == "unmapped"), F.lit("")).otherwise(own)
        rest = F.col("_rest") if "_rest" in out.columns else F.array().cast("array<string>")
        out = out.withColumn("_rest", F.when(field.isNull(), rest).otherwise(F.concat(rest, F.array(field))))
        out = with_appended(out, field).drop("p", "named")
    if mark_dups and "pair_type" in columns:
        out = with_fields(out, {"pair_type": lambda f: F.lit("DD")}, F.col("outcome") == "dup")
        out = out.withColumn("pair_type", F.when(F.col("outcome") == "dup", "DD").otherwise(F.col("pair_type")))
    header = Header(list(pairs.header.lines))
    longer = Header(list(header.lines))
    if keep_parent_id:
        longer.append_columns(["parent_readID"])
    main_header = longer if dups_to == "main" else header
    kinds = {"main": ["kept"], "dups": [], "unmapped": []}
    if dups_to != "drop":
        kinds["main" if dups_to == "main" else "dups"].append("dup")
    if unmapped_to != "drop":
        at = {"own": "unmapped", "dups": "dups" if dups_to == "own" else "main", "main": "main"}[unmapped_to]
        kinds[at].append("unmapped")

    def part(name: str, head: Header) -> Pairs | None:
        if not kinds[name]:
            return None
        return Pairs(head, out.where(F.col("outcome").isin(kinds[name])).drop("outcome", "parent").orderBy("seq"))

    counted = {r["outcome"]: r["count"] for r in marked.groupBy("outcome").count().collect()}
    counters = {"records": sum(counted.values()), "unmapped": counted.get("unmapped", 0), "duplicates": counted.get("dup", 0)}
    stats = statsfile.gather(out.withColumn("dup", F.col("outcome") == "dup")) if with_stats else None
    return Outputs(part("main", main_header), part("dups", longer), part("unmapped", main_header), stats, counters)

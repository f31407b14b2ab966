"""From alignments to contact pairs, one pair per read.

The CIGAR fold, flags and ends of every record are Catalyst expressions; only the
choice of the two reported alignments of a read, which inserts gaps into a list
while walking it, runs in Python, over Arrow batches of whole reads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactweave.model import STANDARD, UNMAPPED_CHROM, Header, Pairs, PairsError, Unsupported
from contactweave.sources.sam import read_sam, references, sam_header

POLICIES = ("mask", "5any", "5unique", "3any", "3unique")
#: Rank of a reference that the chromosome list doesn't have.
LAST = 2**31 - 1
#: Columns that an alignment has besides its tags, and the separators
#: in columns that hold SAM records.
ALIGNMENT_COLUMNS = ("mapq", "pos5", "pos3", "cigar", "read_len", "matched_bp", "algn_ref_span", "algn_read_span", "dist_to_5", "dist_to_3", "seq", "mismatches", "read_side", "algn_idx", "same_side_algn_count")
FIELD_SEPARATOR, RECORD_SEPARATOR = "\x19", "\x19NEXT_SAM\x19"
#: Those named otherwise here.
_HELD_AS = {"algn_ref_span": "ref_span", "algn_read_span": "span", "dist_to_5": "dist5", "dist_to_3": "dist3", "seq": "bases"}


@dataclass(frozen=True)
class ParseOptions:
    min_mapq: int = 1
    max_molecule_size: int = 750
    max_inter_align_gap: int | None = 20
    policy: str = "5unique"
    report_end: int = 5
    flip: bool = True
    drop_readid: bool = False
    #: Columns sam1 and sam2, the records of either side, without bases if drop_seq.
    add_sam: bool = False
    drop_seq: bool = False
    add_pair_index: bool = False
    #: Of ``ALIGNMENT_COLUMNS`` or names of SAM tags; each gives a column a side.
    add_columns: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.policy == "all":
            raise Unsupported("walks policy 'all'")
        if self.policy not in POLICIES:
            raise PairsError(f"unknown walks policy {self.policy!r}")
        if self.report_end not in (3, 5):
            raise PairsError("the reported end is 3 or 5")
        for c in self.add_columns:
            if c not in ALIGNMENT_COLUMNS and not re.fullmatch("[A-Za-z][A-Za-z0-9]", c):
                raise PairsError(f"unknown column {c!r}")

    def extra(self) -> list[str]:
        """Names of the columns after the standard ones."""
        out = ["sam1", "sam2"] * self.add_sam + ["walk_pair_index", "walk_pair_type"] * self.add_pair_index
        return out + [f"{c}{side}" for c in self.add_columns for side in (1, 2)]


def alignments(records: DataFrame, min_mapq: int) -> DataFrame:
    """``records`` with kind (U, M or N), strand, pos5, pos3, dist5, dist3, span,
    ref_span, matched_bp, read_len and lead (soft-clipped bases before the first other operation)."""
    ops = F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0)), lambda t: F.struct(F.substring(t, -1, 1).alias("op"), F.regexp_extract(t, r"^\d+", 0).cast("long").alias("n")))
    total = lambda kinds: F.aggregate("ops", F.lit(0).cast("long"), lambda s, o: s + F.when(o["op"].isin(*kinds), o["n"]).otherwise(0))
    first_m = F.array_position(F.transform("ops", lambda o: (o["op"] == "M") & (o["n"] > 0)), True).cast("int")
    clip = lambda part: F.coalesce(F.try_element_at(F.filter(part, lambda o: o["op"].isin("S", "H")), F.lit(-1))["n"], F.lit(0).cast("long"))
    before = F.when(F.col("m") > 0, F.slice("ops", 1, F.col("m"))).otherwise(F.col("ops"))
    after = F.when(F.col("m") > 0, F.slice("ops", F.col("m"), F.size("ops"))).otherwise(F.slice("ops", 1, 0))
    head = F.array_position(F.transform("ops", lambda o: ~o["op"].isin("S", "H")), True).cast("int")
    leading = F.when(head > 0, F.slice("ops", 1, F.greatest(head - 1, F.lit(0)))).otherwise(F.col("ops"))
    mapped = F.col("flag").bitwiseAND(4) == 0
    sure = F.col("mapq") >= min_mapq
    unique = mapped & sure
    plus = F.col("flag").bitwiseAND(16) == 0
    out = records.withColumn("ops", ops).withColumn("m", first_m)
    out = out.withColumn("clip5", clip(before)).withColumn("clip3", clip(after)).withColumn("ref_span", total(("M", "D")))
    at = lambda end: F.when(unique, F.when(plus == F.lit(end == 5), F.col("pos")).otherwise(F.col("pos") - 1 + F.col("ref_span"))).otherwise(0)
    return out.select(
        "*",
        mapped.alias("mapped"),
        sure.alias("unique"),
        F.when(~mapped, "N").when(unique, "U").otherwise("M").alias("kind"),
        F.when(unique & plus, "+").otherwise("-").alias("strand"),
        F.when(unique, F.col("ref")).alias("chrom"),
        at(5).cast("long").alias("pos5"),
        at(3).cast("long").alias("pos3"),
        F.when(~mapped, 0).when(plus, F.col("clip5")).otherwise(F.col("clip3")).cast("long").alias("dist5"),
        F.when(~mapped, 0).when(plus, F.col("clip3")).otherwise(F.col("clip5")).cast("long").alias("dist3"),
        total(("M",)).alias("matched_bp"),
        total(("M", "I")).alias("span"),
        total(("M", "I", "S", "H")).alias("read_len"),
        F.aggregate(leading, F.lit(0).cast("long"), lambda s, o: s + F.when(o["op"] == "S", o["n"]).otherwise(0)).alias("lead"),
    ).drop("ops", "m", "clip5", "clip3")


_EMPTY = {"mapped": False, "unique": False, "kind": "N", "strand": "-", "chrom": None, "pos5": 0, "pos3": 0, "dist5": 0, "dist3": 0, "span": 0, "ref_span": 0, "matched_bp": 0, "read_len": 0, "mapq": 0, "cigar": "*", "tags": [], "bases": ""}


def with_gaps(side: list[dict], longest: int | None) -> list[dict]:
    """A side in order along the read, with an empty alignment for every stretch
    of over ``longest`` bases that none covers.  As many places are looked at as
    there were alignments at first: those that a gap moves beyond are not."""
    out = sorted(side, key=lambda a: a["dist5"])
    if longest is None or (len(out) == 1 and out[0]["kind"] == "N"):
        return out
    reached = 0
    for i in range(len(out)):
        here = out[i]
        end = here["dist5"] + here["span"]
        if here["dist5"] - reached > longest:
            out.insert(i, _EMPTY | {"dist5": reached, "dist3": max(0, here["read_len"] - here["dist5"]), "span": here["dist5"] - reached, "read_len": here["read_len"]})
            reached = end
        else:
            reached = max(reached, end)
    return out


def rescued(a: list[dict], b: list[dict], molecule: int) -> int:
    """1 or 2, the side whose two alignments are one ligation read through, and 0
    if there is none; types become X (the inner one) and R (the linear side)."""
    if sorted((len(a), len(b))) != [1, 2]:
        return 0
    walk, (linear,) = (a, b) if len(a) == 2 else (b, a)
    outer, inner = walk
    if linear["kind"] != "U":
        return 0
    if inner["mapped"] and outer["unique"]:
        ahead = inner["pos5"] - linear["pos5"] if linear["strand"] == "+" else linear["pos5"] - inner["pos5"]
        facing = inner["chrom"] == linear["chrom"] and inner["strand"] != linear["strand"] and ahead > 0
        if not facing or ahead + inner["dist5"] + linear["dist5"] > molecule:
            return 0
    inner["kind"], linear["kind"] = "X", "R"
    return 1 if walk is a else 2


def reported(side: list[dict], policy: str) -> dict:
    """The alignment that stands for a side of a walk."""
    if policy == "mask":
        return side[0] | {"kind": "W", "strand": "-", "chrom": None, "pos5": 0, "pos3": 0}
    ordered = side if policy[0] == "5" else side[::-1]
    if policy.endswith("any"):
        return ordered[0]
    return next((x for x in ordered if x["kind"] == "U"), ordered[0])


def read_pair(records: list[dict], o: ParseOptions, rank: dict[str, int]) -> tuple[dict, dict, str, bool]:
    """The two reported alignments of a read, in order, the pair's place, and
    whether the sides were swapped."""
    records = sorted(records, key=lambda r: (bool(r["flag"] & 0x80), r["lead"], r["seq"]))
    one = [dict(r) for r in records if r["flag"] & 0x40]
    two = [dict(r) for r in records if not r["flag"] & 0x40]
    place = "R1-2"
    if not one or not two:
        first, second = _EMPTY | {"kind": "X"}, _EMPTY | {"kind": "X"}
    else:
        one, two = with_gaps(one, o.max_inter_align_gap), with_gaps(two, o.max_inter_align_gap)
        for side, of in ((1, one), (2, two)):
            for i, a in enumerate(of):
                a |= {"read_side": side, "algn_idx": i, "same_side_algn_count": len(of)}
        first, second = one[0], two[0]
        if len(one) > 1 or len(two) > 1:
            side = rescued(one, two, o.max_molecule_size)
            if side:
                place = f"R{side}"
            else:
                first, second = reported(one, o.policy), reported(two, o.policy)
    end, swapped = f"pos{o.report_end}", False
    if o.flip:
        if first["chrom"] is not None and second["chrom"] is not None:
            ordered = (rank.get(first["chrom"], LAST), first[end]) <= (rank.get(second["chrom"], LAST), second[end])
        else:
            ordered = (first["mapped"], first["unique"]) <= (second["mapped"], second["unique"])
        if not ordered:
            first, second, swapped = second, first, True
    return first, second, place, swapped


def column_text(a: dict, name: str) -> str:
    """An alignment's value of an added column; empty where it has none."""
    if name in ALIGNMENT_COLUMNS:
        value = a.get(_HELD_AS.get(name, name), "")
        return "None" if name == "cigar" and a["cigar"] == "*" and "flag" in a else "" if name == "seq" and value == "*" else str(value)
    return next((t[5:] for t in a["tags"] if t.startswith(f"{name}:")), "")


def side_text(records: list[dict], pair_type: str, drop_seq: bool) -> str:
    """The records of a side in one field."""
    out = []
    for r in records:
        fields = r["line"].split("\t")
        if drop_seq:
            fields[9:11] = "*", "*"
        out.append(FIELD_SEPARATOR.join([*fields, f"Yt:Z:{pair_type}"]))
    return RECORD_SEPARATOR.join(out)


OUT = "readID string, chrom1 string, pos1 bigint, chrom2 string, pos2 bigint, strand1 string, strand2 string, pair_type string, walk_pair_type string, seq bigint"


def pairs_of(records: DataFrame, options: ParseOptions, rank: dict[str, int]) -> DataFrame:
    """One row per read, ``seq`` being that of its first record."""
    held = ["seq", "flag", "mapped", "unique", "kind", "strand", "chrom", "pos5", "pos3", "dist5", "span", "read_len", "lead"]
    held += ["dist3", "ref_span", "matched_bp", "mapq", "cigar", "tags", "bases"] * bool(options.add_columns) + ["line"] * options.add_sam
    records = records.withColumn("bases", F.split("line", "\t", -1)[9])
    reads = alignments(records, options.min_mapq).groupBy("run", "name").agg(F.collect_list(F.struct(*held)).alias("records"))
    end = f"pos{options.report_end}"
    names = options.extra()
    kinds = OUT + "".join(f", `{c}` string" for c in names if c != "walk_pair_type")
    schema = pa.schema([(c.strip("`"), pa.int64() if t == "bigint" else pa.string()) for c, t in map(str.split, kinds.split(", "))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b, place, swapped = read_pair(records, options, rank)
                extra = []
                if options.add_sam:
                    ordered = sorted(records, key=lambda r: (r["lead"], r["seq"]))
                    sides = [[r for r in ordered if bool(r["flag"] & 0x40) == one] for one in (not swapped, swapped)]
                    extra += [side_text(x, a["kind"] + b["kind"], options.drop_seq) for x in sides]
                extra += ["1"] * options.add_pair_index + [column_text(x, c) for c in options.add_columns for x in (a, b)]
                rows.append(("." if options.drop_readid else name, a["chrom"] or UNMAPPED_CHROM, a[end], b["chrom"] or UNMAPPED_CHROM, b[end], a["strand"], b["strand"], a["kind"] + b["kind"], place, min(r["seq"] for r in records), *extra))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return reads.select("name", "records").mapInArrow(work, kinds)


def chromosome_order(sizes: dict[str, int], refs: dict[str, int]) -> list[str]:
    """References in the order of the size list, then the others by name."""
    return [c for c in sizes if c in refs] + sorted((c for c in refs if c not in sizes), key=str.encode)


def parse_sam(spark: SparkSession, path: str, chromsizes: dict[str, int], options: ParseOptions | None = None, assembly: str | None = None, name_grouped: bool = False) -> Pairs:
    """The pairs of a SAM text file, in the order of its reads, with a header that
    holds the SAM header."""
    options = options or ParseOptions()
    head = sam_header(spark, path)
    refs = references(head)
    names = chromosome_order(chromsizes, refs)
    header = Header.standard({c: refs[c] for c in names}, [*STANDARD, *options.extra()], assembly)
    if not options.flip:
        header.lines[1] = "#shape: whole matrix"
    header.insert_samheader(head)
    rows = pairs_of(read_sam(spark, path, name_grouped), options, {c: i for i, c in enumerate(names)})
    return Pairs(header, rows)

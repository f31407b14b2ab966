"""Statistics as a value: gathered from pairs, merged, written as TSV, YAML or JSON
and read back from TSV or YAML."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactweave.model import PairsError
from contactweave.operators import stats

#: The scalar counters in file order, the strand order of the summary
#: and the words that YAML would not read as text.
SCALARS = ("total", "total_unmapped", "total_single_sided_mapped", "total_mapped", "total_dups", "total_nodups", "cis", "trans")
NEAR = tuple(f"cis_{k}kb" for k in stats.CIS_KB)
YAML_WORDS = {"true", "false", "null", "~", "yes", "no", "on", "off", ".nan", ".inf", "-.inf"}


@dataclass
class Snapshot:
    """Counts of one or more inputs.  ``dist_freq`` is keyed by (lower edge, strands)
    and ``chrom_freq`` by the two names."""

    counts: dict[str, int]
    pair_types: dict[str, int] = field(default_factory=dict)
    chrom_freq: dict[tuple[str, str], int] = field(default_factory=dict)
    dist_freq: dict[tuple[int, str], int] = field(default_factory=dict)
    edges: list[int] = field(default_factory=stats.bin_edges)
    chromsizes: dict[str, int] = field(default_factory=dict)


def gather(df: DataFrame, per_decade: int = 8, chromsizes: dict[str, int] | None = None) -> Snapshot:
    """Statistics of pairs, from one pre-aggregation: its rows are combinations of
    classes, so what reaches the driver doesn't grow with the rows."""
    keys = ["pair_type", "chrom1", "chrom2", "dup", "sides", "cis", "counted", "direction", "bin", "near"]
    near = F.size(F.filter(F.array(*(F.lit(1000 * k) for k in stats.CIS_KB)), lambda e: e <= F.col("distance")))
    rows = stats.with_classes(df, per_decade).withColumn("near", F.when(F.col("cis"), near).otherwise(0)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = Snapshot(dict.fromkeys(SCALARS + NEAR, 0), edges=stats.bin_edges(per_decade), chromsizes=dict(chromsizes or {}))

    def count(to: dict, key, n: int) -> None:
        to[key] = to.get(key, 0) + n

    for r in rows.toLocalIterator():
        c, n = out.counts, r["n"]
        for name, holds in (("total", True), ("total_unmapped", r["sides"] == 0), ("total_single_sided_mapped", r["sides"] == 1), ("total_mapped", r["sides"] == 2), ("total_dups", r["sides"] == 2 and r["dup"]), ("total_nodups", r["counted"]), ("cis", r["cis"]), ("trans", r["counted"] and not r["cis"])):
            c[name] += n if holds else 0
        for name in NEAR[: r["near"]]:
            c[name] += n
        if r["pair_type"] is not None:
            count(out.pair_types, r["pair_type"], n)
        if r["counted"]:
            count(out.chrom_freq, (r["chrom1"], r["chrom2"]), n)
        if r["cis"]:
            count(out.dist_freq, (r["bin"], r["direction"]), n)
    return out


def merged(parts: list[Snapshot]) -> Snapshot:
    """The sum of snapshots with equal bins and equal (or no) chromosome sizes."""
    if not parts:
        raise PairsError("nothing to merge")
    out = Snapshot(dict.fromkeys(SCALARS + NEAR, 0), edges=parts[0].edges)
    for p in parts:
        if p.edges != out.edges:
            raise PairsError("distance bins differ")
        if p.chromsizes and out.chromsizes and p.chromsizes != out.chromsizes:
            raise PairsError("chromosome sizes differ")
        out.chromsizes = out.chromsizes or dict(p.chromsizes)
        for to, of in ((out.counts, p.counts), (out.pair_types, p.pair_types), (out.chrom_freq, p.chrom_freq), (out.dist_freq, p.dist_freq)):
            for k, n in of.items():
                to[k] = to.get(k, 0) + n
    return out


def convergence_table(s: Snapshot) -> dict:
    """Where the strand directions start to agree, and how many cis pairs lie below
    and above."""
    found = stats.convergence(s.dist_freq, s.edges)
    far = found["convergence_dist"]
    limit = s.edges[0] if far == "0" else s.edges[s.edges.index(far) - 1] if far in s.edges else s.edges[-1]
    at = lambda d, below: sum(n for (b, x), n in s.dist_freq.items() if x == d and (b <= limit) == below)
    below = {d: at(d, True) for d in stats.CONVERGENCE_ORDER}
    above = sum(at(d, False) for d in stats.CONVERGENCE_ORDER)
    out = found | {"convergence_rel_diff_threshold": stats.DEVIATION}
    name = "cis_pairs_{}_convergence_dist"
    out |= {"n_" + name.format("below"): below, "n_" + name.format("below") + "_all_strands": sum(below.values()), "n_" + name.format("above") + "_all_strands": above}
    rate = lambda n, of: n / of if of else math.inf if n else math.nan
    for norm in ("cis", "total_mapped", "total_nodups"):
        of = s.counts[norm]
        rates = {d: rate(n, of) for d, n in below.items()}
        label = f"frac_{norm}_in_cis_{{}}_convergence_dist"
        out |= {label.format("below"): rates, label.format("below") + "_all_strands": reduce(add, rates.values()), label.format("above") + "_all_strands": rate(above, of)}
    return out


def sections(s: Snapshot) -> dict:
    """Nested values in file order; distances by bin and then strands."""
    out: dict = {k: s.counts[k] for k in SCALARS}
    out["pair_types"] = dict(sorted(s.pair_types.items()))
    out |= {f"{k}+": s.counts[k] for k in NEAR}
    out["summary"] = stats.summary(s.counts) | {"dist_freq_convergence": convergence_table(s)}
    out["chrom_freq"] = {f"{a}/{b}": n for (a, b), n in sorted(s.chrom_freq.items())}
    label = [f"{a}-{b}" for a, b in zip(s.edges, s.edges[1:])] + [f"{s.edges[-1]}+"]
    out["dist_freq"] = {x: {d: s.dist_freq.get((e, d), 0) for d in stats.DIRECTIONS} for x, e in zip(label, s.edges, strict=True)}
    return out | {"chromsizes": s.chromsizes}


def by_strand(s: Snapshot) -> dict:
    """``sections`` with distances by strands and then lower edge."""
    return sections(s) | {"dist_freq": {d: {str(e): s.dist_freq.get((e, d), 0) for e in s.edges} for d in stats.DIRECTIONS}}


def flat(tree: dict, prefix: str = "") -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    for k, v in tree.items():
        out += flat(v, f"{prefix}{k}/") if isinstance(v, dict) else [(prefix + k, v)]
    return out


def to_tsv(s: Snapshot) -> str:
    """key, tab, value per line; Python writes floats as the format wants them."""
    return "".join(f"{k}\t{v}\n" for k, v in flat(sections(s)))


def yaml_text(x: str, key: bool = False) -> str:
    number = not key and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", x)
    plain = x and x.lower() not in YAML_WORDS and not number and not re.search(r": | #|:$|[\t\n'\"]", x) and re.match(r"[A-Za-z0-9_/+\-?]", x)
    return x if plain else "'" + x.replace("'", "''") + "'"


def yaml_lines(tree: dict, depth: int = 0) -> list[str]:
    out = []
    for k, v in tree.items():
        head = "  " * depth + yaml_text(k, key=True) + ":"
        if isinstance(v, dict):
            out += [head, *yaml_lines(v, depth + 1)]
        elif isinstance(v, float) and not math.isfinite(v):
            out.append(f"{head} {'.nan' if math.isnan(v) else '.inf' if v > 0 else '-.inf'}")
        else:
            out.append(f"{head} {yaml_text(v) if isinstance(v, str) else v}")
    return out


def to_yaml(s: Snapshot) -> str:
    """Zero counters and empty sections are left out."""
    tree = {k: v for k, v in by_strand(s).items() if v or isinstance(v, float)}
    return "\n".join(yaml_lines({"no_filter": tree})) + "\n"


def to_json(s: Snapshot) -> str:
    """All sections; floats that aren't finite are strings."""
    plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else str(v) if isinstance(v, float) and not math.isfinite(v) else v
    return json.dumps({"no_filter": {"filter_expression": ""} | plain(by_strand(s))}, indent=2, ensure_ascii=False) + "\n"


def from_pairs(rows: list[tuple[list[str], str]]) -> Snapshot:
    """A snapshot of (path, value) rows; summaries are computed anew."""
    out, edges = Snapshot(dict.fromkeys(SCALARS + NEAR, 0)), set()
    for path, value in rows:
        top = path[0]
        if top in ("summary", "filter_expression"):
            continue
        if not re.fullmatch(r"\d+", value):
            raise PairsError(f"bad count of {'/'.join(path)}: {value!r}")
        n = int(value)
        if len(path) == 1 and top.removesuffix("+") in out.counts:
            out.counts[top.removesuffix("+")] = n
        elif top == "pair_types":
            out.pair_types["/".join(path[1:])] = n
        elif top == "chromsizes":
            out.chromsizes["/".join(path[1:])] = n
        elif top == "chrom_freq":
            out.chrom_freq[tuple("/".join(path[1:]).split("/", 1))] = n
        elif top == "dist_freq" and len(path) == 3:
            place, strands = path[1:] if path[1] not in stats.DIRECTIONS else path[:0:-1]
            lower = int(re.match(r"\d+", place)[0])
            edges.add(lower)
            if n:
                out.dist_freq[lower, strands] = n
        else:
            raise PairsError(f"unknown key {'/'.join(path)}")
    out.edges = sorted(edges) or out.edges
    return out


def from_tsv(text: str) -> Snapshot:
    rows = [x.split("\t") for x in text.splitlines() if x]
    if bad := [r for r in rows if len(r) != 2]:
        raise PairsError(f"bad statistics line: {bad[0]!r}")
    return from_pairs([(k.split("/"), v) for k, v in rows])


def from_yaml(text: str) -> Snapshot:
    """Reads nested ``key: value`` lines, of the first filter."""
    rows, at = [], []
    bare = lambda x: x[1:-1].replace("''", "'") if len(x) > 1 and x[0] == x[-1] == "'" else x
    for line in text.splitlines():
        if not line.strip():
            continue
        depth = (len(line) - len(line.lstrip(" "))) // 2
        m = re.fullmatch(r"('(?:[^']|'')*'|.+?):(?: (.*))?", line.strip())
        if not m:
            raise PairsError(f"bad statistics line: {line!r}")
        if depth == 0 and at:
            break
        at = [*at[:depth], bare(m[1])]
        if m[2] is not None:
            rows.append((at[1:], bare(m[2])))
    return from_pairs(rows)

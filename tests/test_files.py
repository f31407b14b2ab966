"""Files in every compression, BAM, headers, routed duplicates, bins and the command line, on
small inputs of our own and against plain loops."""

import gzip
import math
import random
import re
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contactweave import cli
from contactweave.functions import ordering
from contactweave.model import STANDARD, ArgumentError, Header, InputError, NotSorted, Pairs, PairsError, Unsupported, pg_chains, read_chrom_names
from contactweave.operators import basic, binning, routing, stats
from contactweave.operators.parse import ParseOptions, parse_sam
from contactweave.sources import raw, statsfile
from contactweave.sources.pairs import BGZF_END, as_lines, bgzf, read_pairs, write_pairs
from contactweave.sources.sam import is_bam

HEADER = ["## pairs format v1.0.0", "#shape: upper triangle", "#chromsize: chr1 5000", "#chromsize: chr2 3000", "#columns: " + " ".join(STANDARD)]


def made(n=400, seed=3):
    """Rows in file order: near copies, unmapped sides, ties."""
    rng, out = random.Random(seed), []
    for i in range(n):
        if out and rng.random() < 0.3:
            _, c1, p1, c2, p2, s1, s2, t = rng.choice(out)
            p1, p2 = (max(1, p + rng.randint(-3, 3)) if p else 0 for p in (p1, p2))
        else:
            c1, c2 = rng.choice(["chr1", "chr2", "!"]), rng.choice(["chr1", "chr2", "!"])
            p1, p2 = (rng.randint(1, 3000) if c != "!" else 0 for c in (c1, c2))
            s1, s2 = (rng.choice("+-") if c != "!" else "-" for c in (c1, c2))
            t = "".join("N" if c == "!" else "U" for c in (c1, c2))
        out.append((f"r{i}", c1, p1, c2, p2, s1, s2, t))
    return out


def text_of(rows, header=HEADER):
    return "".join(f"{x}\n" for x in header) + "".join("\t".join(map(str, r)) + "\n" for r in rows)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1], r[3], r[2], r[4], r[7]))


def lines_of(path):
    data = path.read_bytes()
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    return data.decode().splitlines()


def body(path):
    return [tuple(x.split("\t")) for x in lines_of(path) if not x.startswith("#")]


def as_text(rows):
    return [tuple(map(str, r)) for r in rows]


@pytest.mark.parametrize("name", ["a.pairs", "a.pairs.gz", "named", "b.bgz", "plain.gz.txt", "c.lz4"])
def test_every_compression(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(raw, "RANGE", 700)
    rows = made(900)
    data = text_of(rows).replace("\nr7\t", "\r\n\nr7\t").encode()
    parts = [data[i : i + 997] for i in range(0, len(data), 997)]  # lines straddle members
    packed = {"a.pairs": data, "a.pairs.gz": gzip.compress(data), "named": b"".join(map(bgzf, parts)) + BGZF_END, "b.bgz": b"".join(map(bgzf, parts)), "plain.gz.txt": b"".join(map(gzip.compress, parts)), "c.lz4": b"".join(pa.compress(x, codec="lz4", asbytes=True) for x in parts)}
    (tmp_path / name).write_bytes(packed[name])
    p = read_pairs(spark, str(tmp_path / name))
    assert p.header.lines == HEADER
    assert [tuple(r) for r in p.df.orderBy("seq").select(*STANDARD).collect()] == rows


def test_ranges_own_every_line_once(tmp_path):
    rng = random.Random(1)
    for case in range(30):
        lines = [b"x" * rng.choice([0, 1, 30, 900]) for _ in range(rng.randrange(1, 60))]
        data = b"\n".join(lines) + (b"\n" if case % 2 else b"")
        at, members = 0, []
        while at < len(data):
            n = rng.choice([1, 7, 300, 2000])
            members.append(bgzf(data[at : at + n]))
            at += n
        path = tmp_path / f"{case}.bgz"
        path.write_bytes(b"".join(members) + BGZF_END * (case % 3))
        size = path.stat().st_size
        step = rng.choice([40, 111, 4000])
        got = [x for start in range(0, size, step) for x in raw.range_lines(str(path), start, start + step)]
        assert got == data.split(b"\n")[: None if data[-1:] != b"\n" else -1]


def test_broken_files(spark, tmp_path):
    data = text_of(made()).encode()
    for name, raw_data in (("cut.bgz", bgzf(data)[:-40]), ("cut.gzip", gzip.compress(data)[:-40])):
        (tmp_path / name).write_bytes(raw_data)
        with pytest.raises(Exception, match="(?i)cut off|corrupt"):
            read_pairs(spark, str(tmp_path / name)).df.collect()
    wrong = bytearray(bgzf(data))
    wrong[-5] ^= 1
    (tmp_path / "crc.bgz").write_bytes(bytes(wrong))
    with pytest.raises(InputError, match="corrupt"):
        list(raw.range_lines(str(tmp_path / "crc.bgz"), 0, 1 << 30))
    (tmp_path / "x.lz4").write_bytes(b"\x04\x22\x4d\x18aaaa")
    (tmp_path / "cut.lz4").write_bytes(pa.compress(data, codec="lz4", asbytes=True)[:-40])
    for name in ("x.lz4", "cut.lz4"):
        with pytest.raises(InputError):
            read_pairs(spark, str(tmp_path / name))
    with pytest.raises(Unsupported):
        is_bam(str(tmp_path / "x.lz4"))
    with pytest.raises(InputError):
        read_pairs(spark, str(tmp_path / "none"))
    (tmp_path / "h").write_bytes(b"## pairs\n#x: \xff\n")
    with pytest.raises(InputError, match="line 2"):
        read_pairs(spark, str(tmp_path / "h"))


def test_lz4_round_trip(spark, tmp_path):
    rows = made(50)
    (tmp_path / "a.pairs").write_text(text_of(rows))
    p = read_pairs(spark, str(tmp_path / "a.pairs"))
    path = str(tmp_path / "b.pairs.LZ4")
    assert write_pairs(Pairs(p.header, p.df.orderBy("seq")), path) == 50
    assert open(path, "rb").read(4) == b"\x04\x22\x4d\x18"
    back = read_pairs(spark, path)
    assert back.header.lines == HEADER
    assert [tuple(r) for r in back.df.orderBy("seq").select(*STANDARD).collect()] == rows


def test_errors_say_where(spark, tmp_path):
    good = made(3)
    for bad, what in ((("r", "chr1", "x1", "chr1", 1, "+", "-", "UU"), "line 9, column pos1: bad value x1"), (("r", "chr1", 1, "chr1", 1, "?", "-", "UU"), "column strand1"), (("r", "", 1, "chr1", 1, "+", "-", "UU"), "column chrom1"), (("r", "chr1"), "too few fields")):
        (tmp_path / "x.pairs").write_text(text_of([*good, bad]))
        with pytest.raises(Exception, match=what):
            read_pairs(spark, str(tmp_path / "x.pairs")).df.collect()
    (tmp_path / "seq.pairs").write_text(text_of([], [*HEADER[:-1], HEADER[-1] + " seq"]))
    with pytest.raises(PairsError, match="seq"):
        read_pairs(spark, str(tmp_path / "seq.pairs"))


def test_headers():
    h = Header([*HEADER[:-1], "#samheader: @CO\tz", "#samheader: @PG\tID:b\tPP:a", "#samheader: @HD\tVN:1", "#samheader: @PG\tID:a", "#samheader: @PG\tID:c\tPP:lost", HEADER[-1]])
    assert h.append_pg("tool_sort", "tool sort x", "1") and h.lines[-1] == HEADER[-1]
    sam = h.fields("samheader")
    assert sam[0] == "@HD\tVN:1" and sam[-1] == "@CO\tz"
    assert [x.split("\t")[1] for x in sam[1:-1]] == ["ID:a", "ID:b", "ID:tool_sort-1.3", "ID:c", "ID:tool_sort-2.2"]
    assert sam[3] == "@PG\tID:tool_sort-1.3\tPN:tool\tCL:tool sort x\tPP:b\tVN:1"
    plain = Header(list(HEADER))
    assert plain.append_pg("t", "t", "1") and plain.lines == HEADER
    odd = Header(["#columns: a"])
    assert not odd.append_pg("t", "t", "1")
    odd.mark_sorted()
    assert odd.lines == ["#sorted: chr1-chr2-pos1-pos2", "#columns: a"]
    odd.set_field("sorted", "x")
    assert odd.lines[0] == "#sorted: x" and pg_chains([]) == []
    assert basic.subset_header(Header(list(HEADER)), ["chr2"]).chromsizes() == {"chr2": 3000}


def components(rows, m, metric):
    """Root and all nearer rows of mapped rows, by a plain loop."""
    live = [i for i, r in enumerate(rows) if "!" not in (r[1], r[3])]

    def near(a, b):
        d = abs(rows[a][2] - rows[b][2]), abs(rows[a][4] - rows[b][4])
        return rows[a][1::2] [:2] + rows[a][5:7] == rows[b][1::2][:2] + rows[b][5:7] and (max(d) if metric == "max" else sum(d)) <= m

    root = {i: i for i in live}
    changed = True
    while changed:
        changed = False
        for a in live:
            for b in live:
                if root[b] < root[a] and near(a, b):
                    root[a], changed = root[b], True
    return root


def test_sort_flip_and_select_against_loops(spark, tmp_path):
    rows = made()
    (tmp_path / "a.pairs").write_text(text_of(rows))
    run = lambda *a: cli.main([*map(str, a)])
    assert run("sort", tmp_path / "a.pairs", "-o", tmp_path / "s.pairs.gz") == 0
    assert body(tmp_path / "s.pairs.gz") == as_text(in_order(rows)) and lines_of(tmp_path / "s.pairs.gz")[1] == "#sorted: chr1-chr2-pos1-pos2"
    assert run("sort", tmp_path / "a.pairs", "--extra-col", "readID", "-o", tmp_path / "e.pairs") == 0
    assert body(tmp_path / "e.pairs") == as_text(sorted(rows, key=lambda r: (r[1], r[3], r[2], r[4], r[7], r[0])))
    (tmp_path / "sizes").write_text("chr2\t3000\nchr1\t5000\n")
    assert run("flip", tmp_path / "a.pairs", "-c", tmp_path / "sizes", "-o", tmp_path / "f.pairs") == 0
    rank = {"!": 0, "chr2": 1, "chr1": 2}
    turn = lambda r: (r[0], r[3], r[4], r[1], r[2], r[6], r[5], r[7][::-1]) if (rank[r[1]], r[2]) > (rank[r[3]], r[4]) else r
    assert body(tmp_path / "f.pairs") == as_text([turn(r) for r in rows])
    (tmp_path / "names").write_text("chr1\n")
    assert read_chrom_names(str(tmp_path / "names")) == ["chr1"]
    assert run("select", "pos1 % 2 == 1 && !(strand1 == '+')", tmp_path / "a.pairs", "--chrom-subset", tmp_path / "names", "--remove-columns", "strand2,pair_type", "-o", tmp_path / "k.pairs", "--output-rest", tmp_path / "r.pairs") == 0
    keep = [r for r in rows if r[2] % 2 and r[5] != "+" and r[1] == r[3] == "chr1"]
    short = lambda rs: as_text([r[:6] for r in rs])
    assert body(tmp_path / "k.pairs") == short(keep) and body(tmp_path / "r.pairs") == short([r for r in rows if r not in keep])
    assert [x for x in lines_of(tmp_path / "k.pairs") if x.startswith("#c")] == ["#chromsize: chr1 5000", "#columns: readID chrom1 pos1 chrom2 pos2 strand1"]


@pytest.mark.parametrize(("metric", "m"), [("max", 3), ("sum", 4), ("max", 0)])
def test_dedup_outputs(spark, tmp_path, metric, m):
    rows = in_order(made(250, seed=m + 1))
    root = components(rows, m, metric)
    (tmp_path / "a.pairs").write_text(text_of(rows))
    run = lambda *a: cli.main(["dedup", str(tmp_path / "a.pairs"), "--max-mismatch", str(m), "--method", metric, *map(str, a)])
    dup = lambda i: i in root and root[i] != i
    dd = lambda r: (*r[:7], "DD")
    assert any(map(dup, root)) and run("-o", tmp_path / "k", "--output-dups", tmp_path / "d.gz", "--output-unmapped", tmp_path / "u", "--send-header-to", "dedup", "--output-stats", tmp_path / "t") == 0
    assert body(tmp_path / "k") == as_text([r for i, r in enumerate(rows) if root.get(i) == i])
    assert body(tmp_path / "d.gz") == as_text([dd(r) for i, r in enumerate(rows) if dup(i)]) == [tuple(x.split("\t")) for x in lines_of(tmp_path / "d.gz")]
    assert body(tmp_path / "u") == as_text([r for i, r in enumerate(rows) if i not in root])
    got = statsfile.from_tsv((tmp_path / "t").read_text())
    n = sum(map(dup, root))
    assert (got.counts["total"], got.counts["total_mapped"], got.counts["total_dups"], got.pair_types["DD"]) == (250, len(root), n, n)
    assert abs(stats.summary(got.counts)["frac_dups"] - n / len(root)) < 1e-12
    assert run("-o", tmp_path / "p", "--output-dups", tmp_path / "p", "--output-unmapped", tmp_path / "p", "--keep-parent-id") == 0
    want = [(*(dd(r) if dup(i) else r), rows[root[i]][0] if i in root else "") for i, r in enumerate(rows)]
    assert body(tmp_path / "p") == as_text(want) and lines_of(tmp_path / "p")[-251].endswith("pair_type parent_readID")
    assert run("-o", tmp_path / "q", "--output-dups", tmp_path / "qd", "--output-unmapped", tmp_path / "qd", "--keep-parent-id", "--no-mark-dups", "--backend", "cython") == 0
    assert {len(r) for r in body(tmp_path / "q")} == {8} and {len(r) for r in body(tmp_path / "qd")} == {8, 9}


def test_dedup_needs_order(spark, tmp_path):
    def check(rows):
        (tmp_path / "x.pairs").write_text(text_of(rows))
        routing.check_sorted(read_pairs(spark, str(tmp_path / "x.pairs")).df, "x")

    row = lambda c, p, d="chr1": ("r", c, p, d, 5, "+", "-", "UU")
    check([row("chr1", 1), row("chr1", 1), ("u", "chr1", 0, "!", 0, "+", "-", "UN"), row("chr1", 9), row("chr2", 1)])
    check([])
    for rows, line in (([row("chr1", 4), row("chr1", 2)], 7), ([row("chr1", 4), row("chr2", 9), row("chr1", 5)], 8)):
        with pytest.raises(NotSorted, match=f"not sorted at line {line}"):
            check(rows)
    assert cli.main(["dedup", str(tmp_path / "x.pairs"), "-o", str(tmp_path / "o")]) == 4
    with pytest.raises(ArgumentError):
        routing.route(Pairs(Header(), spark.range(1)), "nowhere")


def test_bins_and_their_files(spark, tmp_path):
    rows = made(600)
    (tmp_path / "a.pairs").write_text(text_of(rows))
    (tmp_path / "sizes").write_text("chr2\t2500\n\nchr1\t5000\n")
    run = lambda *a: cli.main(["--metrics", "bin", str(tmp_path / "a.pairs"), "-c", str(tmp_path / "sizes"), *map(str, a)])
    assert run("-r", 1000, "-r", 700, "-o", tmp_path / "{res}.coo", "--bins-out", tmp_path / "{res}.bins") == 0
    size = {"chr2": 2500, "chr1": 5000}
    for r in (1000, 700):
        bins = [(c, i * r, min((i + 1) * r, n)) for c, n in size.items() for i in range(-(-n // r))]
        assert [tuple(x.split("\t")) for x in lines_of(tmp_path / f"{r}.bins")] == as_text(bins)
        at = lambda c, p: next(i for i, b in enumerate(bins) if b[0] == c) + min((p - 1) // r, -(-size[c] // r) - 1)  # noqa: B023, E731
        want: dict = {}
        for x in rows:
            if "!" not in (x[1], x[3]):
                k = tuple(sorted((at(x[1], x[2]), at(x[3], x[4]))))
                want[k] = want.get(k, 0) + 1
        coo = [tuple(map(int, x.split("\t"))) for x in lines_of(tmp_path / f"{r}.coo")]
        assert coo == sorted((*k, n) for k, n in want.items())
        if r == 1000:
            assert run("-r", 1000, "-o", tmp_path / "x.bg2", "--format", "bg2") == 0
            assert [tuple(x.split("\t")) for x in lines_of(tmp_path / "x.bg2")] == as_text((*bins[a], *bins[b], n) for a, b, n in coo)
    assert run("-r", 10, "-r", 20, "-o", tmp_path / "one") == 2 and run("-r", 10, "-o", tmp_path / "x", "--min-mapq", 3) == 4
    df = read_pairs(spark, str(tmp_path / "a.pairs")).df
    got = binning.bin_counters(df, {"chr1": 2000}, [1000])
    live = [x for x in rows if "!" not in (x[1], x[3])]
    ok = [x for x in live if x[1] == x[3] == "chr1"]
    assert got == {"accepted": len(ok), "rejected": 600 - len(live), "unknown_chrom": len(live) - len(ok), "out_of_range": sum(max(x[2], x[4]) > 2000 for x in ok)}


CODES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


def bam_bytes(lines):
    """SAM lines as BAM, by the format's layout."""
    head, records = [x for x in lines if x.startswith("@")], [x for x in lines if not x.startswith("@")]
    refs = [dict(t.split(":", 1) for t in x.split("\t")[1:]) for x in head if x.startswith("@SQ")]
    ids = {r["SN"]: i for i, r in enumerate(refs)} | {"*": -1}
    text = "".join(f"{x}\n" for x in head).encode()
    out = [b"BAM\1", struct.pack("<i", len(text)), text, struct.pack("<i", len(refs))]
    for r in refs:
        out += [struct.pack("<i", len(r["SN"]) + 1), r["SN"].encode() + b"\0", struct.pack("<i", int(r["LN"]))]
    for line in records:
        name, flag, ref, pos, mapq, cigar, mate, mate_pos, length, bases, quality, *tags = line.split("\t")
        ops = [(int(n) << 4) | OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
        n = 0 if bases == "*" else len(bases)
        codes = [CODES.index(b) for b in bases[:n]] + [0] * (n % 2)
        body = struct.pack("<iiBBHHHiiii", ids[ref], int(pos) - 1, len(name) + 1, int(mapq), 0, len(ops), int(flag), n, ids[ref] if mate == "=" else ids[mate], int(mate_pos) - 1, int(length))
        body += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
        body += b"\xff" * n if quality == "*" else bytes(ord(q) - 33 for q in quality)
        for tag in tags:
            t, kind, value = tag.split(":", 2)
            body += t.encode() + {"i": b"i" + struct.pack("<i", int(value)) if kind == "i" else b"", "Z": b"Z" + value.encode() + b"\0", "A": b"A" + value.encode(), "B": b"BS" + struct.pack("<I2H", 2, 3, 4)}[kind]
        out += [struct.pack("<i", len(body)), body]
    data = b"".join(out)
    return b"".join(bgzf(data[i : i + 333]) for i in range(0, len(data), 333)) + BGZF_END


SAM = ["@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:5000", "@SQ\tSN:chr2\tLN:3000", "@SQ\tSN:chr3\tLN:900", "@PG\tID:aligner"] + [
    "\t".join(map(str, x))
    for x in (
        # A walk: three alignments on one side and two on the other.
        ("w", 65, "chr1", 100, 60, "30M60S", "=", 500, 0, "ACGTN", "IIII#", "NM:i:1", "XA:Z:a:b", "XT:A:U", "XB:B:S,3,4"),
        ("w", 2113, "chr2", 200, 60, "30S30M30S", "chr1", 500, 0, "*", "*"),
        ("w", 2113, "chr3", 300, 0, "60S30M", "chr1", 500, 0, "*", "*"),
        ("w", 145, "chr1", 500, 0, "30S30M", "=", 100, 0, "*", "*"),
        ("w", 2193, "chr2", 900, 60, "30M30S", "chr1", 100, 0, "*", "*"),
        ("p", 65, "chr2", 50, 60, "40M", "chr1", 70, 0, "*", "*"),
        ("p", 129, "chr1", 70, 60, "40M", "chr2", 50, 0, "*", "*"),
        ("n", 77, "*", 0, 0, "*", "*", 0, 0, "AC", "*"),
        ("n", 141, "*", 0, 0, "*", "*", 0, 0, "AC", "*"),
        # One end read through the ligation: the walk is rescued.
        ("s", 65, "chr1", 1000, 60, "30M30S", "=", 1300, 0, "*", "*"),
        ("s", 2113, "chr1", 1200, 60, "30S30M", "=", 1300, 0, "*", "*"),
        ("s", 145, "chr1", 1271, 60, "60M", "=", 1000, 0, "*", "*"),
    )
]
POLICY_ROWS = {
    "mask": ("!", 0, "!", 0, "-", "-", "WW"),
    "5any": ("chr1", 100, "!", 0, "+", "-", "UM"),
    "5unique": ("chr1", 100, "chr2", 929, "+", "-", "UU"),
    "3any": ("!", 0, "chr2", 929, "-", "-", "MU"),
    "3unique": ("chr2", 200, "chr2", 929, "+", "-", "UU"),
}


@pytest.mark.parametrize("policy", POLICY_ROWS)
def test_walk_policies(spark, tmp_path, policy):
    (tmp_path / "x.sam").write_text("\n".join(SAM) + "\n")
    rows = {r["readID"]: tuple(r[c] for c in STANDARD[1:]) for r in parse_sam(spark, str(tmp_path / "x.sam"), {"chr2": 3000}, ParseOptions(policy=policy, flip=False)).df.collect()}
    assert rows["w"] == POLICY_ROWS[policy] and rows["n"] == ("!", 0, "!", 0, "-", "-", "NN")
    assert rows["s"] == ("chr1", 1000, "chr1", 1330, "+", "-", "UR") and rows["p"] == ("chr2", 50, "chr1", 70, "+", "+", "UU")
    far = {r["readID"]: (r["chrom1"], r["pos1"]) for r in parse_sam(spark, str(tmp_path / "x.sam"), {"chr2": 3000}, ParseOptions(policy=policy, flip=False, report_end=3)).df.collect()}
    assert far["p"] == ("chr2", 89)


def test_bam_is_its_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text("\n".join(SAM) + "\n")
    (tmp_path / "x.any").write_bytes(bam_bytes(SAM))
    assert raw.bam_head(raw.Bytes(raw.inflated(str(tmp_path / "x.any")), "x"))[0] == SAM[:5]
    assert [x.decode() for x in raw.bam_lines(str(tmp_path / "x.any"))] == SAM[5:]
    o = ParseOptions(add_sam=True, add_pair_index=True, add_columns=("mapq", "NM", "cigar"))
    both = [parse_sam(spark, str(tmp_path / n), {"chr2": 3000, "chr1": 5000}, o) for n in ("x.sam", "x.any")]
    assert both[0].header.lines == both[1].header.lines
    assert [r.asDict() for r in both[0].df.orderBy("seq").drop("seq").collect()] == [r.asDict() for r in both[1].df.orderBy("seq").drop("seq").collect()]
    run = lambda *a: cli.main([*map(str, a)])
    (tmp_path / "sizes").write_text("chr2\t3000\nchr1\t5000\nchr3\t900\n")
    assert run("parse", tmp_path / "x.any", "-c", tmp_path / "sizes", "-o", tmp_path / "p.pairs", "--output-stats", tmp_path / "s", "--drop-sam") == 0
    got = {r[0]: r[1:] for r in body(tmp_path / "p.pairs")}
    assert got["p"] == ("chr2", "50", "chr1", "70", "+", "+", "UU") and got["w"] == ("chr2", "929", "chr1", "100", "-", "+", "UU")
    assert [x for x in lines_of(tmp_path / "p.pairs") if "ID:contactweave_parse" in x] and statsfile.from_tsv((tmp_path / "s").read_text()).counts["total"] == 4
    assert run("process", tmp_path / "x.any", "-c", tmp_path / "sizes", "--output-pairs", tmp_path / "q.pairs", "--output-stats", tmp_path / "t", "--output-bins", tmp_path / "b", "-r", 100, "--drop-sam") == 0
    assert len(body(tmp_path / "q.pairs")) == 3 and sum(int(x.split("\t")[2]) for x in lines_of(tmp_path / "b")) == 3
    assert run("process", tmp_path / "x.any", "-c", tmp_path / "sizes") == 2 and run("parse", tmp_path / "x.any", "-c", tmp_path / "sizes", "--walks-policy", "all") == 6
    assert run("parse", tmp_path / "none", "-c", tmp_path / "sizes") == 3


def test_runs_across_splits(spark):
    names = "aabbbacccccca"
    for cuts in ([0], [1, 4], [2, 3, 4, 5, 6], list(range(1, 13))):
        rows = [((sum(i >= c for c in cuts) << 33) + i, n) for i, n in enumerate(names)]
        got = [r["run"] for r in ordering.with_runs(spark.createDataFrame(rows, "seq long, name string"), "name", "run").orderBy("seq").collect()]
        starts = [i if i == 0 or names[i] != names[i - 1] else None for i in range(len(names))]
        want, last = [], None
        for i, s in enumerate(starts):
            last = rows[i][0] if s is not None else last
            want.append(last)
        assert got == want
    assert ordering.ranked(spark.createDataFrame([], "a int"), ["a"], "n").count() == 0


def test_generated_options_and_statistics_files(spark, tmp_path):
    run = lambda *a: cli.main([*map(str, a)])
    assert run("generate", "--records", 3000, "--chromosomes", 3, "--chrom-length", 2000, "--extra-columns", 2, "--readid-length", 7, "--sorted", "--duplicate-rate", 0.4, "-o", tmp_path / "g.pairs") == 0
    rows = body(tmp_path / "g.pairs")
    typed = [(r[0], r[1], int(r[2]), r[3], int(r[4]), *r[5:]) for r in rows]
    assert len(rows) == 3000 and {len(r) for r in rows} == {10} and {len(r[0]) for r in rows} == {7} and typed == in_order(typed)
    assert lines_of(tmp_path / "g.pairs")[-3001].endswith("extra1 extra2")
    for form in ("--yaml", "--json"):
        assert run("stats", tmp_path / "g.pairs", form, "-o", tmp_path / "s") == 0
    for name in ("a", "b"):
        assert run("stats", tmp_path / "g.pairs", "-o", tmp_path / name, *(["--yaml"] if name == "b" else [])) == 0
    assert run("stats", "--merge", tmp_path / "a", tmp_path / "b", "-o", tmp_path / "m") == 0
    one, two = (statsfile.from_tsv((tmp_path / n).read_text()) for n in "am")
    assert two.counts == {k: 2 * n for k, n in one.counts.items()} and one.chromsizes == two.chromsizes
    assert run("select", "pos1 ==", tmp_path / "g.pairs") == 2 and run("sort", tmp_path / "g.pairs", "--extra-col", "none") == 2
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_conservation_of_statistics(spark):
    df = basic.generate_pairs(spark, 3000, chromosomes=3, chrom_length=20_000)
    s = statsfile.gather(df)
    c = s.counts
    assert c["total"] == 3000 == c["total_unmapped"] + c["total_single_sided_mapped"] + c["total_mapped"] == sum(s.pair_types.values())
    assert c["cis"] + c["trans"] == c["total_nodups"] == sum(s.chrom_freq.values()) and c["cis"] == sum(s.dist_freq.values())
    # So many molecules, drawn 1000 times, are expected to show the distinct ones seen.
    for dups in (1, 100, 500, 900):
        n = stats.complexity(1000, dups)
        assert abs(n * -math.expm1(-1000 / n) - (1000 - dups)) < 1e-6


@pytest.mark.parametrize("per_decade", [1, 3, 8, 20])
def test_distances_fall_into_their_bins(spark, per_decade):
    edges = stats.bin_edges(per_decade)
    at = sorted({max(0, e + k) for e in edges for k in (-1, 0, 1)} | {2**40})
    got = spark.createDataFrame([(d,) for d in at], "d long").select("d", stats.lower_edge(F.col("d"), per_decade).alias("e")).collect()
    assert {r["d"]: r["e"] for r in got} == {d: max(e for e in edges if e <= d) for d in at}

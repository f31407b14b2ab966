"""Rows that carry their lines, files written in parts and read by ranges."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from contactweave import cli
from contactweave.functions.graph import shared_folder
from contactweave.model import Header, Pairs
from contactweave.operators import basic, binning, routing
from contactweave.sources import parts, raw
from contactweave.sources.pairs import read_header, read_pairs, write_lines, write_pairs

COLUMNS = "#columns: readID chrom1 pos1 chrom2 pos2 strand1 strand2 pair_type mapq1 mapq2"
HEAD = ["## pairs format v1.0.0", "#sorted: none", "#chromsize: chr1 1000", "#chromsize: chr2 1000", COLUMNS]
#: Padded and signless numbers, blanks, a tail beyond the columns, empty fields.
ODD = [
    "r1\tchr1\t007\tchr1\t0000100\t+\t-\tUU\t 30\t+5",
    "r 2\tchr2\t12\tchr1\t9\t-\t+\tURx\t\t60\ttail\t",
    "r3\t!\t0\tchr1\t0008\t-\t+\tNU\tx\ty",
    "#r4\tchr1\t007\tchr1\t100\t+\t-\tUU\t31\t05",
]


@pytest.fixture
def odd(tmp_path):
    path = tmp_path / "odd.pairs"
    path.write_text("\n".join([*HEAD, *ODD]) + "\n")
    return str(path)


def body(path):
    text = gzip.open(path).read().decode() if str(path).endswith(".gz") else open(path).read()
    return [x for x in text.split("\n")[:-1] if not x.startswith("##") and not x.startswith(("#sorted", "#chrom", "#columns", "#samheader", "#shape", "#genome"))]


def test_select_leaves_lines_alone(spark, odd, tmp_path):
    out, rest = str(tmp_path / "a.pairs"), str(tmp_path / "b.pairs")
    assert cli.main(["select", "True", odd, "-o", out]) == 0
    assert body(out) == ODD
    assert cli.main(["select", "pos1 == 7 and mapq2 == 5", odd, "-o", out, "--output-rest", rest, "-t", "mapq1", "str"]) == 0
    assert body(out) == [ODD[0], ODD[3]]
    assert body(rest) == ODD[1:3]
    assert cli.main(["select", "pos1 == '007'", odd, "-o", out, "-t", "pos1", "str"]) == 0
    assert body(out) == [ODD[0], ODD[3]]


def test_select_checks_only_what_it_reads(spark, odd, tmp_path):
    bad = tmp_path / "bad.pairs"
    bad.write_text("\n".join([*HEAD, "r1\tchr1\tx7\tchr1\t-1\t*\t?\tUU\t1\t2", ODD[0]]) + "\n")
    out = str(tmp_path / "o.pairs")
    assert cli.main(["select", "chrom1 == 'chr1'", str(bad), "-o", out]) == 0
    assert body(out)[0].split("\t")[2] == "x7"
    assert cli.main(["select", "pos1 > 0", str(bad), "-o", out]) == 4
    assert cli.main(["sort", str(bad), "-o", out]) == 4
    strand = tmp_path / "strand.pairs"
    strand.write_text("\n".join([*HEAD, "r1\tchr1\t7\tchr1\t1\t*\t+\tUU\t1\t2"]) + "\n")
    assert cli.main(["sort", str(strand), "-o", out]) == 4


def test_removed_columns_leave_the_other_fields_alone(spark, odd, tmp_path):
    out = str(tmp_path / "a.pairs")
    assert cli.main(["select", "True", odd, "-o", out, "--remove-columns", "mapq1,pair_type"]) == 0
    assert body(out) == ["\t".join([*x.split("\t")[:7], x.split("\t")[9]]) for x in ODD]
    assert read_header(out).columns()[-1] == "mapq2" and len(read_header(out).columns()) == 8


def test_sort_and_flip_keep_fields_as_they_came(spark, odd, tmp_path):
    out = str(tmp_path / "a.pairs.gz")
    assert cli.main(["sort", odd, "-o", out]) == 0
    assert body(out) == [ODD[2], ODD[0], ODD[3], ODD[1]]
    sizes = tmp_path / "sizes"
    sizes.write_text("chr1\t1000\nchr2\t1000\n")
    assert cli.main(["flip", odd, "-c", str(sizes), "-o", out]) == 0
    turned = "r 2\tchr1\t9\tchr2\t12\t+\t-\tRUx\t60\t\ttail\t"
    assert body(out) == [ODD[0], turned, ODD[2], ODD[3]]


def test_marks_and_parents_are_spliced_in(spark, tmp_path):
    rows = ["a\tchr1\t07\tchr1\t010\t+\t-\tUU\t1\t01\tmore", "b\tchr1\t8\tchr1\t010\t+\t-\tUU\t1\t01"]
    path = tmp_path / "d.pairs"
    path.write_text("\n".join([*HEAD, *rows]) + "\n")
    out = str(tmp_path / "o.pairs")
    assert cli.main(["dedup", str(path), "-o", out, "--output-dups", out, "--keep-parent-id"]) == 0
    assert body(out) == [rows[0] + "\ta", rows[1].replace("UU", "DD") + "\ta"]


@pytest.mark.parametrize("name", ["x.pairs", "x.pairs.gz", "x.pairs.lz4"])
def test_many_parts_make_one_file(spark, tmp_path, name):
    lines = spark.range(0, 20_000, 1, 200).select(F.format_string("line %d", "id").alias("value"))
    root = parts.shared_folder(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    path = str(tmp_path / name)
    assert write_lines(lines, path, ["#a", "#b"]) == 20_000
    got = list(raw.split_lines(raw.inflated(path)))
    assert [x.decode() for x in got] == ["#a", "#b", *(f"line {k}" for k in range(20_000))]
    assert not [x for x in os.listdir(root) if x.startswith("parts-")]


def test_parts_of_failed_attempts_are_not_taken(spark, tmp_path):
    folder = shared_folder(spark, "parts")
    writer = parts.LineWriter({"parts": folder, "target": str(tmp_path / "t"), "coding": "plain", "head": "[\"#h\"]"})
    local = folder.removeprefix("file://")
    os.makedirs(local)
    for name, text in (("0-1", "lost\n"), ("0-2", "first\n"), ("1-3", "second\n")):
        (open(f"{local}/{name}", "w")).write(text)
    writer.commit([parts.Part(1, f"{folder}/1-3"), None, parts.Part(0, f"{folder}/0-2")])
    assert open(tmp_path / "t").read() == "#h\nfirst\nsecond\n"
    assert not os.path.exists(local)
    writer.abort([])


def test_an_error_leaves_no_parts(spark, odd, tmp_path):
    root = parts.shared_folder(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    df = spark.range(10).select(F.when(F.col("id") < 9, F.lit("x")).otherwise(F.raise_error(F.lit("no"))).alias("value"))
    with pytest.raises(Exception, match="no"):
        write_lines(df, str(tmp_path / "t"))
    assert not [x for x in os.listdir(root) if x.startswith("parts-")]


@pytest.mark.parametrize("name", ["r.pairs", "r.pairs.gz"])
def test_ranges_hold_every_line_once(spark, tmp_path, name, monkeypatch):
    rng = random.Random(3)
    rows = [f"r{i}\tchr1\t{rng.randint(1, 999):05}\tchr2\t{i}\t+\t-\tUU\t{'x' * rng.randint(0, 300)}\t1" for i in range(4_000)]
    path = str(tmp_path / name)
    write_lines(spark.createDataFrame([(x,) for x in rows], "value string").coalesce(3), path, HEAD)
    size = os.path.getsize(path)
    for step in (997, 65_536, size, 3 * size):
        got = [x.decode() for a, b in raw.file_ranges(path, step) for x in raw.read_range(path, a, b)]
        assert got == [*HEAD, *rows]
    parts.register(spark)
    df = spark.read.format(parts.PAIRS_FORMAT).load(path)
    assert df.columns == ["seq", *COLUMNS.split()[1:], "_line"]
    assert sorted(r["_line"] for r in df.select("_line").collect()) == sorted(rows)
    some = spark.read.format(parts.PAIRS_FORMAT).schema("pos1 bigint, readID string").load(path)
    assert {(r.readID, r.pos1) for r in some.collect()} == {(x.split("\t")[0], int(x.split("\t")[2])) for x in rows}


def test_frames_without_lines_are_still_rendered(spark, tmp_path):
    df = spark.createDataFrame([(0, "r", "chr1", 7, "chr1", 9, "+", "-", "UU")], "seq long, readID string, chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, pair_type string")
    header = Header.standard({"chr1": 1000})
    out = str(tmp_path / "o.pairs")
    assert write_pairs(Pairs(header, basic.flip_pairs(df, ["chr1"])), out) == 1
    assert body(out) == ["r\tchr1\t7\tchr1\t9\t+\t-\tUU"]
    routed = routing.route(read_pairs(spark, out))
    assert write_pairs(routed.main, out) == 1


def bam_of(n, rng):
    """A BAM file of ``n`` records of many sizes, in members of many sizes, and its lines."""
    import struct

    from contactweave.sources.pairs import BGZF_END, bgzf

    header = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:99999999\n@SQ\tSN:chr2\tLN:99999\n"
    refs = b"".join(struct.pack("<i", 5) + name + b"\0" + struct.pack("<i", size) for name, size in ((b"chr1", 99_999_999), (b"chr2", 99_999)))
    out = [b"BAM\1" + struct.pack("<i", len(header)) + header.encode() + struct.pack("<i", 2) + refs]
    lines = []
    for i in range(n):
        bases = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 30, 151, 4000])))
        name, pos, flag = f"read{i // 2}", rng.randint(1, 90_000_000), rng.choice([65, 129, 4])
        long = i % 50 == 7 and bool(bases)
        real = [(1 << 4), (len(bases) << 4) | 4] if long else [(len(bases) << 4)] if bases else []
        cigar = [(len(bases) << 4) | 4, (100 << 4) | 3] if long else real
        tags = b"NMi" + struct.pack("<i", i) + (b"CGBI" + struct.pack("<I2I", 2, *real) if long else b"")
        code = ["=ACMGRSVTWYHKDBN".index(c) for c in bases] + [0]
        packed = bytes(code[k] << 4 | code[k + 1] for k in range(0, len(bases), 2))
        record = struct.pack("<iiBBHHHiiii", i % 2, pos - 1, len(name) + 1, 60, 0, len(cigar), flag, len(bases), -1, -1, 0) + name.encode() + b"\0" + struct.pack(f"<{len(cigar)}I", *cigar) + packed + bytes(rng.randint(0, 40) for _ in bases) + tags
        out.append(struct.pack("<i", len(record)) + record)
        shown = "".join(f"{x >> 4}{'MIDNSHP=X'[x & 15]}" for x in real) or "*"
        lines.append((name, str(flag), f"chr{i % 2 + 1}", str(pos), "60", shown, bases or "*", f"NM:i:{i}"))
    data, packed, at = b"".join(out), [], 0
    while at < len(data):
        size = rng.randint(1, 9_000)
        packed.append(bgzf(data[at : at + size]))
        at += size
    return b"".join(packed) + BGZF_END, lines


def shown(line):
    f = line.split("\t")
    return (*f[:6], f[9], f[11])


def test_bam_is_read_in_many_ranges(spark, tmp_path):
    data, want = bam_of(600, random.Random(8))
    path = str(tmp_path / "x.bam")
    open(path, "wb").write(data)
    whole = [x.decode() for x in raw.bam_lines(path)]
    assert [shown(x) for x in whole] == want
    assert any(x.split("\t")[5].startswith("1I") is False and "CG:B" not in x for x in whole)
    names, first = raw.bam_start(path)
    for step in (500, 3_001, 20_000, len(data), 2 * len(data)):
        got = [x.decode() for a, b in raw.file_ranges(path, step) for x in raw.bam_range_lines(path, a, b, first, names)]
        assert got == whole
    rows = raw.bam_records(spark, path, 10_000)
    assert rows.rdd.getNumPartitions() == -(-len(data) // 10_000)
    assert [r.line for r in rows.orderBy("seq").collect()] == whole


def test_a_cut_off_bam_is_an_error(spark, tmp_path):
    data, _ = bam_of(100, random.Random(9))
    path = str(tmp_path / "x.bam")
    open(path, "wb").write(data[: len(data) * 2 // 3])
    with pytest.raises(Exception, match="cut off|no compressed block"):
        raw.bam_records(spark, path, 5_000).collect()
    head, _ = bam_of(0, random.Random(1))
    open(path, "wb").write(head)
    assert raw.bam_records(spark, path, 5_000).collect() == []


def test_options_stand_on_either_side(spark, tmp_path):
    a = cli.parser().parse_args(["--threads", "3", "-v", "sort", "x", "--memory", "1.5GiB", "--compression-level", "9", "--io-threads", "2", "--compression-threads", "2", "--max-fan-in", "8", "--no-compress-runs", "--metrics"])
    assert (a.threads, a.memory, a.compression_level, a.verbose, a.metrics, a.quiet, a.tmpdir) == (3, 3 << 29, 9, 1, True, False, None)
    for name in ("flip", "dedup", "stats", "bin", "parse", "process", "generate", "select"):
        more = {"flip": ["-c", "x"], "bin": ["-c", "x", "-r", "5"], "parse": ["-c", "x"], "process": ["-c", "x"], "select": ["True"]}.get(name, [])
        a = cli.parser().parse_args(["--quiet", name, *more, "--threads", "2", "-vv", "--progress", "--tmpdir", "t"])
        assert (a.threads, a.verbose, a.quiet, a.progress, a.tmpdir, a.memory) == (2, 2, True, True, "t", 2 << 30)
    for bad in (["--memory", "x"], ["--memory", "1X"], ["--memory", ""], ["--threads", "0"], ["--compression-level", "10"], ["--compression-level", "0"]):
        with pytest.raises(SystemExit) as e:
            cli.parser().parse_args(["sort", "x", *bad])
        assert e.value.code == 2
    assert cli.main(["sort", "x", "--memory", "1M"]) == 5


def test_compression_levels(spark, tmp_path):
    path = tmp_path / "x.pairs"
    path.write_text("## pairs format v1.0.0\n" + "".join(f"r{i}\tchr1\t{i * 7919 % 10007}\tchr1\t{i}\t+\t-\tUU\n" for i in range(20_000)))
    sizes = {}
    for level in ("1", "9"):
        out = tmp_path / f"{level}.pairs.gz"
        assert cli.main(["sort", str(path), "-o", str(out), "--compression-level", level]) == 0
        sizes[level] = out.stat().st_size
        assert gzip.open(out).read().count(b"\n") > 20_000
    assert sizes["9"] < sizes["1"]
    assert cli.main(["sort", str(path), "-o", str(tmp_path / "o.gz")]) == 0 and sizes["9"] < (tmp_path / "o.gz").stat().st_size < sizes["1"]


def test_spent_resources_have_a_code():
    assert cli.exit_code(OSError(28, "No space left on device")) == 5 and cli.exit_code(OSError(2, "none")) == 3


def test_bins_and_counters_read_once(spark, tmp_path):
    """One scan for all resolutions and counters; the counters against a loop."""
    rng = random.Random(4)
    rows = [(rng.choice(["chr1", "chr2", "chr3", "!", None]), rng.randint(0, 130), rng.choice(["chr1", "chr2", "chr9"]), rng.randint(0, 130), rng.choice(["UU", "UR", "NN"]), rng.choice(["3", "60", "x", None]), "60") for _ in range(2000)]
    spark.createDataFrame(rows, "chrom1 string, pos1 long, chrom2 string, pos2 long, pair_type string, mapq1 string, mapq2 string").write.parquet(str(tmp_path / "t"))
    df, sizes = spark.read.parquet(str(tmp_path / "t")), {"chr2": 100, "chr1": 120}
    for zero in (False, True):
        table = binning.binned(df, sizes, [7, 50], ["UU", "UR"], 5, zero)
        assert table._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
        want = dict.fromkeys(binning.OUTCOMES, 0)
        for c1, p1, c2, p2, t, q, _ in rows:
            if c1 in ("!", None) or t == "NN" or q != "60":
                want["rejected"] += 1
            elif c1 not in sizes or c2 not in sizes:
                want["unknown_chrom"] += 1
            elif not zero and not (p1 and p2):
                want["rejected"] += 1
            else:
                want["accepted"] += 1
                far = any((p - (not zero)) // r >= -(-sizes[c] // r) for c, p in ((c1, p1), (c2, p2)) for r in (7, 50))
                want["out_of_range"] += far
        assert binning.counters_of(table) == want and all(want.values())
        key = lambda r: tuple(r[c] for c in ("resolution", "bin1_id", "bin2_id", "count"))
        plain = binning.bin_contacts(binning.accepted(df, ["UU", "UR"], 5, zero), sizes, [7, 50], zero)
        assert sorted(map(key, table.where("resolution > 0").collect())) == sorted(map(key, plain.collect()))


def test_flip_and_select_need_no_shuffle(spark, tmp_path):
    path = tmp_path / "x.pairs"
    path.write_text("## pairs format v1.0.0\n" + "".join(f"r{i}\tchr1\t{i * 7919 % 10007}\tchr1\t{i}\t+\t-\tUU\n" for i in range(20_000)))
    (tmp_path / "sizes").write_text("chr1\t100000\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        assert cli.main(["flip", str(path), "-c", str(tmp_path / "sizes"), "-o", str(tmp_path / "f")]) == 0
        assert cli.main(["select", "pos1 % 2 == 0", str(path), "-o", str(tmp_path / "s"), "--output-rest", str(tmp_path / "r")]) == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    names = lambda f: [x.split("\t")[0] for x in (tmp_path / f).read_text().splitlines() if x[0] != "#"]
    assert names("f") == [f"r{i}" for i in range(20_000)]
    even = [i * 7919 % 10007 % 2 == 0 for i in range(20_000)]
    assert names("s") == [f"r{i}" for i in range(20_000) if even[i]] and names("r") == [f"r{i}" for i in range(20_000) if not even[i]]

"""Reading and writing ``.pairs`` text, plain, gzip, LZ4 or BGZF."""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from contactweave.functions.fields import LINE, OWN, named
from contactweave.model import STANDARD, Header, Pairs, PairsError, filesystem
from contactweave.sources import parts
from contactweave.sources.raw import head_lines, sniff, text_lines  # noqa: F401

BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BGZF_BLOCK = 0xFF00
_COMPRESSED = (".gz", ".bgz", ".bgzf")


def read_header(path: str, spark: SparkSession | None = None) -> Header:
    """The leading ``#`` lines."""
    return Header(head_lines(spark, path, "#"))


def place(path: str) -> Column:
    """Where a row of ``seq`` stands in the file: its line, or its split and line there."""
    line = F.concat(F.lit("line "), (F.col("seq").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("string"))
    split = F.concat(F.lit("split "), F.shiftright("seq", 33).cast("string"), F.lit(", "))
    return F.concat(F.lit(f"{path}: "), F.when(F.shiftright("seq", 33) > 0, split).otherwise(F.lit("")), line)


def _checked(column: Column, pattern: str, what: str, path: str) -> Column:
    said = F.concat(place(path), F.lit(f", column {what}: bad value "), F.coalesce(column, F.lit("(missing)")))
    return F.when(column.rlike(pattern), column).otherwise(F.raise_error(said))


def read_pairs(spark: SparkSession, path: str, wide_positions: bool = False, strict: bool = True) -> Pairs:
    """Rows typed by the header's columns, with ``seq`` (order in the file), ``_rest``
    (fields beyond the named ones) and ``_line`` (the line, which is what writers write).
    Positions are BIGINT, or DECIMAL(20,0) if ``wide_positions``; all further columns are
    strings.  Of a ``strict`` reading every line's required fields are checked when it is
    written; otherwise only what is asked for is parsed."""
    header = read_header(path, spark)
    lines = text_lines(spark, path)
    # Only the leading # lines are the header, and they are the file's first lines.
    body = lines.where((F.col("line") != "") & ~(F.col("line").startswith("#") & (F.col("seq") < len(header.lines))))
    return Pairs(header, typed_lines(body, header, path, wide_positions, strict))


def typed_lines(body: DataFrame, header: Header, path: str = "input", wide_positions: bool = False, strict: bool = True) -> DataFrame:
    """The rows of lines (line, seq), as ``read_pairs`` has them."""
    names = header.columns()
    taken = {c for c in names if c in OWN}
    if taken:
        raise PairsError(f"{path}: a column can't be named {', '.join(sorted(taken))}")
    for need in STANDARD[:7]:
        if need not in names:
            raise PairsError(f"column {need} is missing")
    split = F.split("line", "\t", -1)
    least = max(names.index(c) for c in STANDARD if c in names and (c != "pair_type" or header.fields("columns"))) + 1
    body = body.select("seq", "line", F.when(F.size(split) >= least, split).otherwise(F.raise_error(F.concat(place(path), F.lit(": too few fields: "), "line"))).alias("f"))
    kind = "decimal(20,0)" if wide_positions else "bigint"

    def column(i: int, name: str) -> Column:
        value = F.get("f", F.lit(i))
        if name in ("pos1", "pos2"):
            return _checked(value, r"\A[0-9]{1,20}\z", name, path).cast(kind)
        if name in ("strand1", "strand2"):
            return _checked(value, r"\A[+.\-]\z", name, path)
        return _checked(value, r"(?s)\A.+\z", name, path) if name in ("chrom1", "chrom2") else value

    rest = F.when(F.size("f") > len(names), F.slice("f", len(names) + 1, F.size("f") - len(names))).otherwise(F.array().cast("array<string>"))
    whole = F.col("line")
    if strict:
        of = {n: column(names.index(n), n) for n in STANDARD[:7]}
        marks = F.length(F.concat(*(of[c] for c in ("chrom1", "chrom2", "strand1", "strand2"))))
        whole = F.when((marks > 0) & (of["pos1"] >= 0) & (of["pos2"] >= 0), whole)
    return body.select("seq", *(column(i, n).alias(n) for i, n in enumerate(names)), rest.alias("_rest"), whole.alias(LINE))


def as_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """One ``value`` per row: its line, if rows carry it and ``columns`` are all of its
    fields; else the columns that aren't null, and ``_rest`` if there is one, joined by
    tabs."""
    if LINE in df.columns and columns == named(df):
        return df.select(F.col(LINE).alias("value"))
    fields = F.array(*(F.col(f"`{c}`").cast("string") for c in columns))
    if "_rest" in df.columns:
        fields = F.concat(fields, F.col("_rest"))
    return df.select(F.array_join(fields, "\t").alias("value"))


def bgzf(data: bytes, level: int = 6) -> bytes:
    """``data`` as BGZF members without the end marker."""
    out = []
    for i in range(0, len(data), BGZF_BLOCK):
        part = data[i : i + BGZF_BLOCK]
        z = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(struct.pack("<4BI2BH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def coding_of(path: str) -> str:
    """How a file of this name is compressed."""
    name = path.lower()
    return "bgzf" if name.endswith(_COMPRESSED) else "lz4" if name.endswith(".lz4") else "plain"


def encoded(data: bytes, coding: str, level: int = 6) -> bytes:
    """Bytes that can be strung together with others of their coding."""
    return bgzf(data, level) if coding == "bgzf" else pa.compress(data, codec="lz4", asbytes=True) if coding == "lz4" else data


def write_lines(lines: DataFrame, path: str, head: list[str] | None = None) -> int:
    """One file of ``value`` lines in the DataFrame's order, after the ``head`` lines, by
    path, URI or ``-`` for standard output; the name's ending says whether it is BGZF or
    LZ4 frames, one for each piece.  Tasks write coded parts, all at once, and the commit
    strings them together; only standard output, and targets or shared folders that
    Spark alone can reach, get one partition after the other through the driver.
    Returns the number of lines after the head."""
    coding, level = coding_of(path), int(lines.sparkSession.conf.get(parts.LEVEL, "6"))
    if path != "-" and parts.can_write(lines.sparkSession, path):
        seen = Observation()
        parts.write_in_parts(lines.observe(seen, F.count(F.lit(1)).alias("n")), path, head or [], coding)
        return seen.get["n"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = "".join(f"{x}\n" for x in b.column(0).to_pylist()).encode()
            yield pa.RecordBatch.from_arrays([pa.array([encoded(data, coding, level)], pa.binary()), pa.array([b.num_rows], pa.int64())], ["data", "n"])

    first, n = "".join(f"{x}\n" for x in head or []).encode(), 0

    def pieces() -> Iterator[bytes]:
        nonlocal n
        yield encoded(first, coding, level)
        for row in lines.select("value").mapInArrow(work, "data binary, n bigint").toLocalIterator():
            n += row["n"]
            yield bytes(row["data"])
        if coding == "bgzf":
            yield BGZF_END

    if path == "-":
        for x in pieces():
            sys.stdout.buffer.write(x)
        sys.stdout.buffer.flush()
        return n
    files, at = filesystem(path)
    with files.open_output_stream(at, compression=None) as f:
        for x in pieces():
            f.write(x)
    return n


def write_pairs(pairs: Pairs, path: str, columns: list[str] | None = None, header: bool = True) -> int:
    """One file of a header and rows in the DataFrame's order; the number of rows.
    Large results are better written as parts, by ``write_parts``."""
    return write_lines(as_lines(pairs.df, columns or pairs.header.columns()), path, pairs.header.lines if header else None)


def write_parts(pairs: Pairs, folder: str, columns: list[str] | None = None) -> None:
    """Text part files in the DataFrame's order; the header is not in them."""
    as_lines(pairs.df, columns or pairs.header.columns()).write.text(folder)

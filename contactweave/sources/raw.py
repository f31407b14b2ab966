"""Lines of plain, gzip, LZ4 and BGZF text by content, and BAM files as SAM lines.

Plain text, and what only Spark can open, goes through Spark's own reader.  BGZF, gzip
and LZ4 files are dealt to tasks by byte ranges: a task inflates the members that begin in
its range and owns the lines after the first line break there, as text splits do, so lines
may straddle members and ranges.  A file of one member is one task's work.  BAM records
are found in the same ranges by looking for a place from which several records follow
each other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactweave.model import InputError, filesystem
from contactweave.sources.members import bgzf_data, bgzf_size, first_member, pieces

#: Bytes of a compressed file whose members a task inflates.
RANGE = 32 << 20
BATCH = 4096
#: Fixed values of the BAM format: base codes, CIGAR operations and tag value layouts.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def sniff(path: str) -> str:
    """Compression by content: ``plain``, ``gzip``, ``bgzf`` or ``lz4``; by name where only
    Spark can open the path."""
    try:
        files, at = filesystem(path)
    except pa.ArrowInvalid:
        return "gzip" if path.endswith(".gz") else "plain"
    try:
        with files.open_input_stream(at, compression=None) as f:
            head = f.read(18)
    except OSError as e:
        raise InputError(f"{path}: {e}") from e
    if head[:4] == b"\x04\x22\x4d\x18":
        return "lz4"
    if head[:2] != b"\x1f\x8b":
        return "plain"
    return "bgzf" if len(head) == 18 and head[3] & 4 and head[12:14] == b"BC" else "gzip"


def inflated(path: str) -> Iterator[bytes]:
    """The bytes of a plain, gzip or LZ4 file, of any number of members, in pieces."""
    kind = sniff(path)
    packed = kind in ("gzip", "bgzf")
    files, at = filesystem(path)
    if kind == "lz4":
        try:
            with files.open_input_stream(at, compression="lz4") as f:
                while piece := f.read(1 << 20):
                    yield piece
        except OSError as e:
            raise InputError(f"{path}: {e}") from e
        return
    with files.open_input_stream(at, compression=None) as f:
        unzip, held = None, b""
        while piece := held or f.read(1 << 20):
            held = b""
            if not packed:
                yield piece
                continue
            unzip = unzip or zlib.decompressobj(31)
            try:
                yield unzip.decompress(piece)
            except zlib.error as e:
                raise InputError(f"{path}: {e}") from e
            if unzip.eof:
                unzip, held = None, unzip.unused_data
        if unzip is not None:
            raise InputError(f"{path}: the compressed file is cut off")


def split_lines(pieces: Iterator[bytes]) -> Iterator[bytes]:
    rest = b""
    for piece in pieces:
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole
    if rest:
        yield rest


def range_lines(path: str, start: int, stop: int, kind: str = "bgzf") -> Iterator[bytes]:
    """The lines that follow a line break in the members that begin in [start, stop),
    and the file's first line in its first range."""
    files, name = filesystem(path)
    with files.open_input_file(name) as f:
        at = first_member(f, start, min(stop, f.size()), kind) if start else 0
        owned, rest = start == 0, b""
        for member, data in pieces(f, at, path, kind) if at is not None else ():
            if not owned:
                if member >= stop:
                    return
                _, broken, data = data.partition(b"\n")
                owned = bool(broken)
            elif member >= stop:  # only the line that the range left open
                line, broken, _ = data.partition(b"\n")
                rest += line
                if broken:
                    yield rest
                    return
                continue
            if owned:
                *whole, rest = (rest + data).split(b"\n")
                yield from whole
        if owned and rest:
            yield rest


def plain_range_lines(path: str, start: int, stop: int) -> Iterator[bytes]:
    """The lines of a plain file that begin in [start, stop)."""
    files, name = filesystem(path)
    with files.open_input_file(name) as f:
        at = max(0, start - 1)
        f.seek(at)
        rest, owned = b"", start == 0
        while piece := f.read(1 << 20):
            lines = (rest + piece).split(b"\n")
            rest = lines.pop()
            for x in lines:
                if not owned:
                    owned, at = True, at + len(x) + 1
                    continue
                if at >= stop:
                    return
                yield x
                at += len(x) + 1
        if owned and rest and at < stop:
            yield rest


def file_ranges(path: str, size: int) -> list[tuple[int, int]]:
    """Byte ranges of a file for as many tasks."""
    files, at = filesystem(path)
    n = max(1, -(-files.get_file_info(at).size // size))
    return [(k * size, (k + 1) * size) for k in range(n)]


def read_range(path: str, start: int, stop: int) -> Iterator[bytes]:
    """The lines of one of a file's ranges."""
    kind = sniff(path)
    return plain_range_lines(path, start, stop) if kind == "plain" else range_lines(path, start, stop, kind)


def as_batches(lines: Iterator[bytes], part: int) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    n = part << 33

    def batch() -> pa.RecordBatch:
        nonlocal n, held
        out = pa.RecordBatch.from_arrays([pa.array([x.decode() for x in held], pa.string()), pa.array(range(n, n + len(held)), pa.int64())], ["line", "seq"])
        n, held = n + len(held), []
        return out

    for x in lines:
        held.append(x[:-1] if x.endswith(b"\r") else x)
        if len(held) >= BATCH:
            yield batch()
    if held:
        yield batch()


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, seq) of a text file, without carriage returns at the ends; ``seq``
    ascends along the file."""
    kind = sniff(path)
    try:
        files, at = filesystem(path)
    except pa.ArrowInvalid:
        files = None
    if kind == "plain" or files is None:
        return spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"), F.monotonically_increasing_id().alias("seq"))
    n = max(1, -(-files.get_file_info(at).size // RANGE))
    step = RANGE

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                yield from as_batches(range_lines(path, part * step, (part + 1) * step, kind), part)

    return spark.range(0, n, 1, n).mapInArrow(work, "line string, seq bigint")


def head_lines(spark: SparkSession | None, path: str, mark: str) -> list[str]:
    """The leading lines that begin with ``mark``."""
    out: list[str] = []
    try:
        filesystem(path)
        lines = (x.decode() for x in split_lines(inflated(path)))
    except pa.ArrowInvalid:
        lines = (r["value"] for r in spark.read.text(path).toLocalIterator())
    try:
        for x in lines:
            if not x.startswith(mark):
                break
            out.append(x.rstrip("\r"))
    except UnicodeDecodeError as e:
        raise InputError(f"{path}: header line {len(out) + 1} is no UTF-8") from e
    return out


class Bytes:
    """Exact reads from a stream of pieces."""

    def __init__(self, pieces: Iterator[bytes], path: str):
        self.pieces, self.path, self.held = pieces, path, bytearray()

    def take(self, n: int, optional: bool = False) -> bytes:
        while len(self.held) < n:
            piece = next(self.pieces, None)
            if piece is None:
                if optional and not self.held:
                    return b""
                raise InputError(f"{self.path}: the file is cut off")
            self.held += piece
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def bam_head(data: Bytes) -> tuple[list[str], list[str]]:
    """(SAM header lines, reference names) from the beginning of a BAM file."""
    if data.take(4) != b"BAM\1":
        raise InputError(f"{data.path}: not a BAM file")
    text = data.take(data.number()).rstrip(b"\0").decode()
    names = []
    for _ in range(data.number()):
        names.append((data.take(data.number())[:-1].decode(), data.number()))
    lines = [x for x in text.split("\n") if x]
    if not any(x.startswith("@SQ") for x in lines):
        lines += [f"@SQ\tSN:{n}\tLN:{size}" for n, size in names]
    return lines, [n for n, _ in names]


def tag_texts(raw: bytes) -> Iterator[str]:
    at = 0
    value = lambda kind, at: struct.unpack_from("<" + NUMBERS[kind], raw, at)[0]
    shown = lambda kind, x: f"{x:g}" if kind == "f" else str(x)
    while at + 3 <= len(raw):
        name, kind, at = raw[at : at + 2].decode(), chr(raw[at + 2]), at + 3
        if kind == "A":
            yield f"{name}:A:{chr(raw[at])}"
            at += 1
        elif kind in "ZH":
            end = raw.index(b"\0", at)
            yield f"{name}:{kind}:{raw[at:end].decode()}"
            at = end + 1
        elif kind == "B":
            of, n = chr(raw[at]), struct.unpack_from("<I", raw, at + 1)[0]
            size = struct.calcsize(NUMBERS[of])
            yield f"{name}:B:{of}" + "".join("," + shown(of, value(of, at + 5 + i * size)) for i in range(n))
            at += 5 + n * size
        else:
            yield f"{name}:{'f' if kind == 'f' else 'i'}:{shown(kind, value(kind, at))}"
            at += struct.calcsize(NUMBERS[kind])


def bam_line(raw: bytes, names: list[str]) -> str:
    """A BAM record as a SAM line."""
    ref, pos, n_name, mapq, _, n_cigar, flag, n_bases, mate, mate_pos, length = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32 + n_name
    cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", raw, at))
    at += 4 * n_cigar
    packed = raw[at : at + (n_bases + 1) // 2]
    bases = "".join(BASES[x >> 4] + BASES[x & 15] for x in packed)[:n_bases]
    at += len(packed)
    quality = raw[at : at + n_bases]
    shown = "*" if not n_bases or quality[0] == 255 else "".join(chr(33 + q) for q in quality)
    named = lambda i: names[i] if i >= 0 else "*"
    other = "=" if mate >= 0 and mate == ref else named(mate)
    tags = list(tag_texts(raw[at + n_bases :]))
    # CIGARs of over 65,535 operations stand in a tag, behind a stand-in of two.
    if n_cigar == 2 and cigar.startswith(f"{n_bases}S") and cigar.endswith("N") and (long := [t for t in tags if t.startswith("CG:B:I,")]):
        cigar = "".join(f"{int(x) >> 4}{OPERATIONS[int(x) & 15]}" for x in long[0].split(",")[1:])
        tags.remove(long[0])
    fields = [raw[32 : 31 + n_name].decode(), flag, named(ref), pos + 1, mapq, cigar or "*", other, mate_pos + 1, length, bases or "*", shown]
    return "\t".join([*map(str, fields), *tags])


def bam_lines(path: str) -> Iterator[bytes]:
    data = Bytes(inflated(path), path)
    _, names = bam_head(data)
    while size := data.take(4, optional=True):
        yield bam_line(data.take(struct.unpack("<i", size)[0]), names).encode()


class Members:
    """The inflated bytes from one BGZF member on, as they are asked for, and the member
    that each of them came from."""

    def __init__(self, f: pa.NativeFile, at: int, path: str):
        self.f, self.at, self.path, self.size = f, at, path, f.size()
        self.held, self.start, self.members = bytearray(), 0, []

    def __len__(self) -> int:
        return self.start + len(self.held)

    def has(self, end: int) -> bool:
        """Whether there are bytes up to ``end``; members are inflated for it."""
        while len(self) < end and self.at < self.size:
            n = bgzf_size(self.f, self.at)
            if n is None:
                raise InputError(f"{self.path}: no compressed block at {self.at}")
            self.members.append((len(self), self.at))
            self.held += bgzf_data(self.f, self.at, n, self.path)
            self.at += n
        return len(self) >= end

    def get(self, at: int, n: int) -> bytes:
        return bytes(self.held[at - self.start : at - self.start + n])

    def member(self, at: int) -> int:
        """Where the member of a byte begins in the file."""
        while len(self.members) > 1 and self.members[1][0] <= at:
            del self.members[0]
        return self.members[0][1]

    def forget(self, at: int) -> None:
        if at - self.start > 1 << 20:
            del self.held[: at - self.start]
            self.start = at


#: Records in a row that must look right for a record to be taken as found, and the
#: largest one that may.
CHAIN, LARGEST = 6, 1 << 27


def looks_like_record(data: Members, at: int, references: int) -> int:
    """Size of what could be a BAM record, or 0: lengths that add up, references that
    exist, a printable name that ends in a zero."""
    if not data.has(at + 36):
        return 0
    size, ref, pos, n_name, _, _, n_cigar, _, n_bases, mate, mate_pos = struct.unpack("<iiiBBHHHiii", data.get(at, 32))
    if not 34 <= size <= LARGEST or n_name < 2 or n_bases < 0 or 32 + n_name + 4 * n_cigar + (n_bases + 1) // 2 + n_bases > size:
        return 0
    if not (-1 <= ref < references and -1 <= mate < references and pos >= -1 and mate_pos >= -1):
        return 0
    if not data.has(at + 36 + n_name):
        return 0
    name = data.get(at + 36, n_name)
    return 4 + size if name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1]) else 0


def starts_record(data: Members, at: int, references: int) -> bool:
    """Whether records follow each other from here on, for ``CHAIN`` records or to the
    file's end."""
    for k in range(CHAIN):
        if k and not data.has(at + 1):
            return True
        n = looks_like_record(data, at, references)
        if not n or not data.has(at + n):
            return False
        at += n
    return True


def _first_block(f: pa.NativeFile, start: int) -> int:
    at = first_member(f, start, f.size(), "bgzf")
    return f.size() if at is None else at


def bam_range_lines(path: str, start: int, stop: int, first: tuple[int, int], names: list[str]) -> Iterator[bytes]:
    """The records that begin in the members that begin in [start, stop), as SAM text.
    ``first`` is the first record's member and place in it."""
    files, name = filesystem(path)
    with files.open_input_file(name) as f:
        known = start <= first[0] < stop
        if stop <= first[0]:
            return
        data = Members(f, first[0] if known else _first_block(f, start), path)
        if data.at >= stop:
            return
        at = first[1] if known else 0
        while data.has(at + 1) and data.member(at) < stop:
            if known:
                break
            if starts_record(data, at, len(names)):
                known = True
            else:
                at += 1
                data.forget(at)
        while data.has(at + 1) and data.member(at) < stop:
            if not data.has(at + 4):
                raise InputError(f"{path}: the file is cut off")
            size = struct.unpack("<i", data.get(at, 4))[0]
            if size < 32 or not data.has(at + 4 + size):
                raise InputError(f"{path}: the file is cut off")
            yield bam_line(data.get(at + 4, size), names).encode()
            at += 4 + size
            data.forget(at)


def bam_start(path: str) -> tuple[list[str], tuple[int, int]]:
    """Reference names, and where the first record of a BGZF BAM file is."""
    files, name = filesystem(path)
    with files.open_input_file(name) as f:
        data, at = Members(f, 0, path), 0

        def pieces() -> Iterator[bytes]:
            nonlocal at
            while data.has(at + 1):
                piece = data.get(at, len(data) - at)
                at = len(data)
                yield piece

        source = Bytes(pieces(), path)
        names = bam_head(source)[1]
        place = at - len(source.held)
        if not data.has(place + 1):
            return names, (data.at, 0)
        begun, member = [m for m in data.members if m[0] <= place][-1]
        return names, (member, place - begun)


def bam_records(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(line, seq) of a BAM file's records as SAM text.  BGZF files are dealt to tasks by
    byte ranges: a task looks for the first place in its range from which records follow
    each other, and reads on to the first one that begins beyond it."""
    if sniff(path) != "bgzf":

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _ in range(b.num_rows):
                    yield from as_batches(bam_lines(path), 0)

        return spark.range(0, 1, 1, 1).mapInArrow(whole, "line string, seq bigint")
    names, first = bam_start(path)
    ranges = file_ranges(path, size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                yield from as_batches(bam_range_lines(path, *ranges[part], first, names), part)

    return spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(work, "line string, seq bigint")

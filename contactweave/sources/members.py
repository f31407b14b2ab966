"""Members of compressed files: where they begin, and what they hold.

BGZF, gzip and LZ4 files are strings of members that can be inflated on their own.  A
task that is given a range of bytes looks for the first member that begins there and
proves it: a BGZF block by the next block's head, a gzip member by inflating it to its
checksum, an LZ4 frame by walking its blocks to the end mark.  What follows must be
another member or the file's end.  Each function reads at offsets of an open file.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa

from contactweave.model import InputError

PIECE = 1 << 20
#: Fixed values of the three formats.
GZIP, BGZF, LZ4 = b"\x1f\x8b\x08", b"\x1f\x8b\x08\x04", b"\x04\x22\x4d\x18"
SKIPPED = range(0x184D2A50, 0x184D2A60)


def bgzf_size(f: pa.NativeFile, at: int) -> int | None:
    """Size of the BGZF member that begins here, or None if none does."""
    head = f.read_at(18, at)
    if len(head) < 18 or head[:4] != BGZF:
        return None
    extra = f.read_at(struct.unpack_from("<H", head, 10)[0], at + 12)
    while len(extra) >= 4:
        n = struct.unpack_from("<H", extra, 2)[0]
        if extra[:2] == b"BC" and n == 2:
            return struct.unpack_from("<H", extra, 4)[0] + 1
        extra = extra[4 + n :]
    return None


def bgzf_data(f: pa.NativeFile, at: int, n: int, path: str) -> bytes:
    raw = f.read_at(n, at)
    start = 12 + struct.unpack_from("<H", raw, 10)[0] if len(raw) == n else 0
    if not start:
        raise InputError(f"{path}: the compressed file is cut off")
    crc, length = struct.unpack_from("<II", raw, n - 8)
    try:
        data = zlib.decompress(raw[start : n - 8], -15)
    except zlib.error as e:
        raise InputError(f"{path}: {e}") from e
    if len(data) != length or zlib.crc32(data) != crc:
        raise InputError(f"{path}: a compressed block at {at} is corrupt")
    return data


def bgzf_pieces(f: pa.NativeFile, at: int, path: str) -> Iterator[tuple[int, bytes]]:
    size = f.size()
    while at < size:
        n = bgzf_size(f, at)
        if n is None:
            raise InputError(f"{path}: no compressed block at {at}")
        yield at, bgzf_data(f, at, n, path)
        at += n


def gzip_pieces(f: pa.NativeFile, at: int, path: str) -> Iterator[tuple[int, bytes]]:
    """Inflates member after member; ``held`` is what was read and not inflated yet."""
    size, read, member, held = f.size(), at, at, b""
    while member < size:
        unzip = zlib.decompressobj(31)
        while not unzip.eof:
            if not held:
                held = f.read_at(PIECE, read)
                read += len(held)
            if not held:
                raise InputError(f"{path}: the compressed file is cut off")
            try:
                data, held = unzip.decompress(held, PIECE), unzip.unconsumed_tail
            except zlib.error as e:
                raise InputError(f"{path}: {e}") from e
            yield member, data
        held = unzip.unused_data
        member = read - len(held)


def lz4_size(f: pa.NativeFile, at: int) -> int | None:
    """Size of the whole LZ4 frame, or skipped one, that begins here, or None."""
    size, head = f.size(), f.read_at(8, at)
    if len(head) < 8:
        return None
    if struct.unpack_from("<I", head)[0] in SKIPPED:
        n = 8 + struct.unpack_from("<I", head, 4)[0]
        return n if at + n <= size else None
    flags, block = head[4], head[5]
    if head[:4] != LZ4 or flags >> 6 != 1 or flags & 2 or block & 0x8F or block >> 4 < 4:
        return None
    largest = 1 << 8 + 2 * (block >> 4)
    end = at + 7 + (8 if flags & 8 else 0) + (4 if flags & 1 else 0)
    while len(mark := f.read_at(4, end)) == 4:
        n = struct.unpack("<I", mark)[0]
        if n == 0:
            end += 8 if flags & 4 else 4
            return end - at if end <= size else None
        if n & 0x7FFFFFFF > largest:
            return None
        end += 4 + (n & 0x7FFFFFFF) + (4 if flags & 16 else 0)
    return None


class Part(io.RawIOBase):
    """Bytes [at, stop) of an open file as a stream."""

    def __init__(self, f: pa.NativeFile, at: int, stop: int):
        self.f, self.at, self.stop = f, at, stop

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        got = self.f.read_at(min(len(out), self.stop - self.at), self.at)
        out[: len(got)], self.at = got, self.at + len(got)
        return len(got)


def lz4_pieces(f: pa.NativeFile, at: int, path: str) -> Iterator[tuple[int, bytes]]:
    size = f.size()
    while at < size:
        n = lz4_size(f, at)
        if n is None:
            raise InputError(f"{path}: no whole LZ4 frame at {at}")
        if f.read_at(4, at) == LZ4:
            try:
                with pa.CompressedInputStream(pa.PythonFile(io.BufferedReader(Part(f, at, at + n), PIECE), mode="r"), "lz4") as data:
                    while piece := data.read(PIECE):
                        yield at, piece
            except OSError as e:
                raise InputError(f"{path}: {e}") from e
        at += n


def _bgzf_here(f: pa.NativeFile, at: int) -> bool:
    n = bgzf_size(f, at)
    return bool(n) and (at + n == f.size() or bgzf_size(f, at + n) is not None)


def _gzip_here(f: pa.NativeFile, at: int) -> bool:
    head = f.read_at(10, at)
    if len(head) < 10 or head[3] & 0xE0 or head[8] not in (0, 2, 4):
        return False
    try:
        # The member's checksum is right once the next one's first piece, or the end, comes.
        for member, _ in gzip_pieces(f, at, ""):
            if member > at:
                break
    except InputError:
        return False
    return True


def _lz4_here(f: pa.NativeFile, at: int) -> bool:
    n = lz4_size(f, at)
    return bool(n) and (at + n == f.size() or lz4_size(f, at + n) is not None)


#: By compression: what members begin with, whether one begins here, members' data.
KINDS = {"bgzf": (BGZF, _bgzf_here, bgzf_pieces), "gzip": (GZIP, _gzip_here, gzip_pieces), "lz4": (LZ4, _lz4_here, lz4_pieces)}


def first_member(f: pa.NativeFile, start: int, stop: int, kind: str) -> int | None:
    """Where the first member that begins in [start, stop) does so, or None."""
    mark, here, _ = KINDS[kind]
    for at in range(start, stop, PIECE):
        near = f.read_at(min(PIECE, stop - at) + len(mark) - 1, at)
        i = near.find(mark)
        while i >= 0:
            if here(f, at + i):
                return at + i
            i = near.find(mark, i + 1)
        if len(near) < len(mark):
            break
    return None


def pieces(f: pa.NativeFile, at: int, path: str, kind: str) -> Iterator[tuple[int, bytes]]:
    """(where the member begins, some of its data) from the member at ``at`` to the end."""
    return KINDS[kind][2](f, at, path)

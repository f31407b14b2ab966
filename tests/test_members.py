"""Compressed files of many members, read by byte ranges."""

import gzip
import random
import struct

import pyarrow as pa
import pytest

from contactweave.model import InputError
from contactweave.sources import raw
from contactweave.sources.members import KINDS
from contactweave.sources.pairs import BGZF_END, bgzf, read_pairs

HEAD = b"## pairs format v1.0.0\n#columns: readID chrom1 pos1 chrom2 pos2 strand1 strand2 pair_type\n"


def lz4(data: bytes) -> bytes:
    return pa.compress(data, codec="lz4", asbytes=True)


def packed(kind: str, data: bytes, rng: random.Random) -> bytes:
    """``data`` cut anywhere, lines included, into members of all sizes."""
    cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(40))})
    parts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
    if kind == "bgzf":
        return b"".join(map(bgzf, parts)) + BGZF_END
    if kind == "gzip":
        # An empty member, and members with a name in their head.
        named = lambda x: b"\x1f\x8b\x08\x08" + b"\0" * 6 + b"name\0" + gzip.compress(x)[10:]
        return b"".join(rng.choice([gzip.compress, named])(x) for x in parts) + gzip.compress(b"")
    skipped = struct.pack("<II", 0x184D2A53, 5) + b"\x04\x22\x4d\x18!"
    return b"".join(lz4(x) + rng.choice([b"", skipped]) for x in parts)


@pytest.fixture
def data():
    rng = random.Random(1)
    lines = [f"r{i}\tchr1\t{rng.randint(1, 10**6)}\tchr2\t{rng.randint(1, 10**6)}\t+\t-\tUU" + "x" * rng.choice([0, 0, 0, 3000]) for i in range(3000)]
    return "".join(f"{x}\n" for x in lines).encode()


@pytest.mark.parametrize("kind", list(KINDS))
def test_ranges_give_every_line_once(tmp_path, data, kind):
    path = str(tmp_path / "x")
    for seed, text in ((1, data), (2, data[:-1]), (3, b"one line"), (4, b"x" * 5000 + b"\n" + b"y" * 5000)):
        content = packed(kind, text, random.Random(seed))
        (tmp_path / "x").write_bytes(content)
        assert raw.sniff(path) == kind
        want = text.split(b"\n") if text[-1:] != b"\n" else text[:-1].split(b"\n")
        for step in (97, 1000, 4096, 50_000, 1 << 30):
            if step < 1000 and len(content) > 20_000:
                continue
            ranges = raw.file_ranges(path, step)
            assert ranges[-1][1] >= len(content)
            assert [x for a, b in ranges for x in raw.read_range(path, a, b)] == want, (seed, step)


@pytest.mark.parametrize("kind", list(KINDS))
def test_tasks_share_a_file(spark, tmp_path, monkeypatch, data, kind):
    path = tmp_path / {"bgzf": "x.pairs.gz", "gzip": "y.pairs.gz", "lz4": "z.lz4"}[kind]
    path.write_bytes(packed(kind, HEAD + data, random.Random(5)))
    whole = [r["readID"] for r in read_pairs(spark, str(path)).df.orderBy("seq").collect()]
    monkeypatch.setattr(raw, "RANGE", path.stat().st_size // 6)
    df = read_pairs(spark, str(path)).df
    assert df.select("seq").where("readID is not null").rdd.getNumPartitions() >= 6
    assert [r["readID"] for r in df.orderBy("seq").collect()] == whole == [f"r{i}" for i in range(3000)]


def test_one_member_is_one_task(tmp_path, data):
    for name, content in (("a", gzip.compress(data)), ("b", lz4(data))):
        (tmp_path / name).write_bytes(content)
        found = [len(list(raw.read_range(str(tmp_path / name), a, b))) for a, b in raw.file_ranges(str(tmp_path / name), 3000)]
        assert found[0] == 3000 and len(found) > 2 and not any(found[1:])


def test_broken_members_are_errors(tmp_path, data):
    for kind in KINDS:
        content = packed(kind, data, random.Random(6))
        for broken in (content[:-1] if kind != "bgzf" else content[: -len(BGZF_END) - 1], content + b"rubbish"):
            (tmp_path / "x").write_bytes(broken)
            with pytest.raises(InputError):
                [x for a, b in raw.file_ranges(str(tmp_path / "x"), 1 << 30) for x in raw.read_range(str(tmp_path / "x"), a, b)]

"""The pairs data set: a header (metadata) and a DataFrame of rows."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyarrow import fs as pafs
from pyspark.sql import DataFrame

STANDARD = ("readID", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "pair_type")
UNMAPPED_CHROM, UNMAPPED_POS, UNMAPPED_STRAND = "!", 0, "-"


class PairsError(ValueError):
    """Malformed input; ``code`` is what the command line exits with."""

    code = 4


class ArgumentError(PairsError):
    """Arguments that can't be used."""

    code = 2


class InputError(PairsError):
    """Input that can't be opened or decompressed."""

    code = 3


class NotSorted(PairsError):
    """Input that is not in sorted order."""


class ResourceError(PairsError):
    """Memory or disk that doesn't suffice."""

    code = 5


class Unsupported(PairsError):
    """A feature that this library names and does not offer."""

    code = 6


@dataclass
class Header:
    """Ordered ``#`` lines, kept verbatim."""

    lines: list[str] = field(default_factory=list)

    def fields(self, name: str) -> list[str]:
        """Values of all lines ``#name: value`` (any number of leading ``#``)."""
        found = (x.lstrip("#") for x in self.lines)
        return [x[len(name) + 1 :].lstrip() for x in found if x.startswith(f"{name}:")]

    def columns(self) -> list[str]:
        named = self.fields("columns")
        return [c for c in named[0].split(" ") if c] if named else list(STANDARD)

    def set_columns(self, columns: list[str]) -> None:
        line = "#columns: " + " ".join(columns)
        at = [i for i, x in enumerate(self.lines) if x.startswith("#columns:")]
        if at:
            self.lines[at[0]] = line
        else:
            self.lines.append(line)

    def append_columns(self, columns: list[str]) -> None:
        self.lines = [f"{x} {' '.join(columns)}" if x.startswith("#columns: ") else x for x in self.lines]

    def is_valid(self) -> bool:
        return bool(self.lines) and self.lines[0].startswith("##")

    def set_field(self, name: str, value: str) -> None:
        """Give every line of the field this value; a new line goes before a last
        ``#columns`` line, or at the end."""
        line = f"#{name}: {value}"
        places = [i for i, x in enumerate(self.lines) if x.startswith(f"#{name}")]
        for i in places:
            self.lines[i] = line
        if not places:
            at = len(self.lines) - (bool(self.lines) and self.lines[-1].startswith("#columns"))
            self.lines.insert(at, line)

    def insert_samheader(self, lines: list[str]) -> None:
        """Add SAM header lines before ``#columns``."""
        at = next((i for i, x in enumerate(self.lines) if x.startswith("#columns")), len(self.lines))
        self.lines[at:at] = [f"#samheader: {x}" for x in lines]

    def append_pg(self, program: str, command_line: str, version: str) -> bool:
        """End every chain of program records with one of this program, and put the SAM
        header, programs after references and before comments, right before
        ``#columns``.  A header that has no program records gets none; False if the
        header isn't valid, which leaves it as it is."""
        if not self.is_valid():
            return False
        sam = [x.strip() for x in self.fields("samheader")]
        chains = pg_chains([x for x in sam if x.startswith("@PG")])
        for n, chain in enumerate(chains, 1):
            name = program if len(chains) == 1 else f"{program}-{n}.{len(chain) + 1}"
            chain.append("\t".join(["@PG", f"ID:{name}", f"PN:{program.split('_')[0]}", f"CL:{command_line}", f"PP:{pg_tags(chain[-1])['ID']}", f"VN:{version}"]))
        ahead = [x for x in sam if x[:3] in ("@HD", "@SQ", "@RG")]
        rest = [x for x in sam if x not in ahead and not x.startswith("@PG")]
        own = [x for x in self.lines if not x.lstrip("#").startswith("samheader:")]
        columns = [x for x in own if x.startswith("#columns")]
        sam = [*ahead, *(x for chain in chains for x in chain), *rest]
        self.lines = [x for x in own if x not in columns] + [f"#samheader: {x}" for x in sam] + columns
        return True

    def chromsizes(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for v in self.fields("chromsize"):
            name, _, size = v.partition(" ")
            if not size.strip().isdigit() or name in out:
                raise PairsError(f"bad #chromsize line: {v!r}")
            out[name] = int(size)
        return out

    def is_sorted(self) -> bool:
        return any(x.startswith("#sorted") for x in self.lines)

    def mark_sorted(self) -> None:
        """Note the order as the second line, and sort ``#chromosomes:`` names.  A
        header that isn't valid gets a plain field."""
        if not self.is_valid():
            self.set_field("sorted", "chr1-chr2-pos1-pos2")
        elif not self.is_sorted():
            self.lines.insert(min(1, len(self.lines)), "#sorted: chr1-chr2-pos1-pos2")
        for i, x in enumerate(self.lines):
            if x.startswith("#chromosomes:"):
                self.lines[i] = "#chromosomes: " + " ".join(sorted(x.split(":", 1)[1].split(), key=lambda c: c.encode()))

    def subset_chromosomes(self, names: set[str]) -> None:
        kept = []
        for x in self.lines:
            if x.startswith("#chromsize:") and x.split(":", 1)[1].split()[:1] and x.split(":", 1)[1].split()[0] not in names:
                continue
            if x.startswith("#chromosomes:"):
                x = "#chromosomes: " + " ".join(c for c in x.split(":", 1)[1].split() if c in names)
            kept.append(x)
        self.lines = kept

    @classmethod
    def standard(cls, chromsizes: dict[str, int], columns: list[str] | None = None, assembly: str | None = None) -> Header:
        lines = ["## pairs format v1.0.0", "#shape: upper triangle", f"#genome_assembly: {assembly or 'unknown'}"]
        lines += [f"#chromsize: {c} {n}" for c, n in chromsizes.items()]
        return cls([*lines, "#columns: " + " ".join(columns or STANDARD)])


@dataclass
class Pairs:
    header: Header
    df: DataFrame


def pg_tags(line: str) -> dict[str, str]:
    return dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x)


def pg_chains(records: list[str]) -> list[list[str]]:
    """Program records in chains, each record after its parent; one whose parent is
    not there begins a chain."""
    chains: list[list[str]] = []
    waiting = [x for x in records if "ID" in pg_tags(x)]
    ends = lambda parent: [c for c in chains if pg_tags(c[-1])["ID"] == parent]
    while waiting:
        ready = [x for x in waiting if pg_tags(x).get("PP") is None or ends(pg_tags(x)["PP"])]
        one = (ready or waiting)[0]
        waiting.remove(one)
        home = ends(pg_tags(one).get("PP")) if "PP" in pg_tags(one) else []
        if home:
            home[0].append(one)
        else:
            chains.append([one])
    return chains


def read_chromsizes(path: str) -> dict[str, int]:
    """Names and sizes, in the order of the file."""
    out: dict[str, int] = {}
    for n, line in enumerate(small_text(path).splitlines(), 1):
        if not line.strip():
            continue
        parts = line.split("\t")
        if len(parts) < 2 or not parts[1].isdigit() or parts[0] in out:
            raise PairsError(f"{path}:{n}: bad chromosome size line {line!r}")
        out[parts[0]] = int(parts[1])
    return out


def read_chrom_names(path: str) -> list[str]:
    """Names of a chromosome list, with sizes or without."""
    return [x.split("\t")[0] for x in small_text(path).splitlines() if x.strip()]


def small_text(path: str) -> str:
    """A short text file, by path or URI."""
    files, at = filesystem(path)
    try:
        with files.open_input_stream(at, compression=None) as f:
            return f.read().decode()
    except (OSError, UnicodeDecodeError) as e:
        raise InputError(f"{path}: {e}") from e


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))

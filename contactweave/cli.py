"""The command line: ``python -m contactweave COMMAND``.

Exit codes: 0; 2 for arguments and conditions; 3 for input that can't be opened or
decompressed; 4 for malformed or unsorted data; 5 for memory or disk that doesn't
suffice; 6 for what isn't supported.
"""

from __future__ import annotations

import argparse
import errno
import os
import re
import shutil
import sys
from importlib.metadata import PackageNotFoundError, version

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from contactweave.functions.graph import shared_folder, written
from contactweave.metrics import Metrics
from contactweave.model import ArgumentError, Header, Pairs, PairsError, ResourceError, Unsupported, filesystem, read_chrom_names, read_chromsizes, small_text
from contactweave.operators import basic, binning, routing
from contactweave.operators.parse import POLICIES, ParseOptions, parse_sam
from contactweave.operators.process import process_sam
from contactweave.sources import parts, statsfile
from contactweave.sources.pairs import read_pairs, write_lines, write_pairs

try:
    VERSION = version("contactweave")
except PackageNotFoundError:
    VERSION = "0.2"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="contactweave")
    run_options(top)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, source: bool = True, output: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        if source:
            p.add_argument("input", nargs="?", default="-")
        if output:
            p.add_argument("-o", "--output", default="-")
        return p

    p = command("sort")
    p.add_argument("--extra-col", action="append", default=[])
    p.add_argument("--max-fan-in", type=number, default=64, help="no effect: Spark merges its own runs")
    p.add_argument("--no-compress-runs", action="store_true", help="no effect: see spark.shuffle.spill.compress")
    p = command("flip")
    p.add_argument("-c", "--chroms-path", required=True)
    p = command("dedup")
    for name in ("--output-dups", "--output-unmapped", "--output-stats"):
        p.add_argument(name)
    dedup_options(p)
    p.add_argument("--backend", choices=sorted(routing.BACKENDS))
    p.add_argument("--keep-parent-id", action="store_true")
    p.add_argument("--extra-col-pair", nargs=2, action="append", default=[])
    p.add_argument("--send-header-to", choices=routing.HEADERS_TO, default="both")
    stats_options(p)
    p = sub.add_parser("stats")
    p.add_argument("inputs", nargs="*", default=["-"])
    p.add_argument("-o", "--output", default="-")
    p.add_argument("--merge", action="store_true")
    p.add_argument("--no-chromsizes", action="store_true")
    stats_options(p)
    p = sub.add_parser("select")
    p.add_argument("condition")
    p.add_argument("input", nargs="?", default="-")
    p.add_argument("-o", "--output", default="-")
    p.add_argument("--output-rest")
    p.add_argument("--chrom-subset")
    p.add_argument("-t", "--type-cast", nargs=2, action="append", default=[])
    p.add_argument("--remove-columns", default="")
    p = command("bin", output=False)
    p.add_argument("-o", "--output", action="append", default=[])
    p.add_argument("-c", "--chroms-path", required=True)
    p.add_argument("-r", "--resolution", type=int, action="append", required=True)
    p.add_argument("--min-mapq", type=int)
    p.add_argument("--pair-types")
    p.add_argument("--format", choices=("coo", "bg2"), default="coo")
    p.add_argument("--zero-based", action="store_true")
    p.add_argument("--bins-out", action="append", default=[])
    p = command("parse")
    parse_options(p)
    p.add_argument("--output-stats")
    p = command("process", output=False)
    parse_options(p)
    dedup_options(p)
    for name in ("--output-pairs", "--output-dups", "--output-unmapped", "--output-stats"):
        p.add_argument(name)
    p.add_argument("--output-bins", action="append", default=[])
    p.add_argument("--output-bin-table", action="append", default=[])
    p.add_argument("-r", "--resolution", type=int, action="append", default=[])
    p.add_argument("--bin-format", choices=("coo", "bg2"), default="coo")
    p = command("generate", source=False)
    for name, kind, default in (("records", int, 1_000_000), ("seed", int, 42), ("chromosomes", int, 24), ("chrom-length", int, 100_000_000), ("cis-fraction", float, 0.75), ("duplicate-rate", float, 0.1), ("duplicate-radius", int, 2), ("unmapped-fraction", float, 0.02), ("extra-columns", int, 0), ("readid-length", int, 24)):
        p.add_argument(f"--{name}", type=kind, default=default)
    p.add_argument("--sorted", action="store_true")
    for p in sub.choices.values():
        run_options(p, argparse.SUPPRESS)
    return top


def number(text: str) -> int:
    """A whole number of at least 1."""
    if not re.fullmatch(r"[0-9]+", text) or int(text) < 1:
        raise argparse.ArgumentTypeError(f"{text!r} is no number of at least 1")
    return int(text)


def size(text: str) -> int:
    """Bytes of a size like 512M, 1.5g or 2GiB."""
    found = re.fullmatch(r"\s*([0-9]+\.?[0-9]*|\.[0-9]+)\s*([kmgt]?)(?:i?b)?\s*", text, re.IGNORECASE)
    if not found:
        raise argparse.ArgumentTypeError(f"{text!r} is no size")
    return int(float(found[1]) * 1024 ** " kmgt".index(found[2].lower() or " "))


def run_options(p: argparse.ArgumentParser, default: str | None = None) -> None:
    """Options that may stand before or after the command; ``default`` keeps what is
    set already."""
    of = lambda value: value if default is None else default
    p.add_argument("-v", "--verbose", action="count", default=of(0), help="Spark's errors on standard error; twice: its warnings")
    p.add_argument("-q", "--quiet", action="store_true", default=of(False))
    p.add_argument("--metrics", action="store_true", default=of(False), help="counts and times on standard error")
    p.add_argument("--progress", action="store_true", default=of(False), help="Spark's progress bar")
    p.add_argument("--threads", type=number, default=of(os.cpu_count()), help="threads of a local session")
    p.add_argument("--memory", type=size, default=of(2 << 30), help="memory of a local driver; below 1G counts as 1G")
    p.add_argument("--tmpdir", default=of(None), help="shared folder for intermediate tables")
    p.add_argument("--compression-level", type=int, choices=range(1, 10), default=of(6), help="of BGZF output")
    p.add_argument("--io-threads", type=number, default=of(None), help="no effect: tasks read as they run")
    p.add_argument("--compression-threads", type=number, default=of(None), help="no effect: tasks compress what they write")


def dedup_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--max-mismatch", type=int, default=3)
    p.add_argument("--method", choices=("max", "sum"), default="max")
    p.add_argument("--clustering", choices=("transitive", "greedy"), default="transitive")
    p.add_argument("--mark-dups", action=argparse.BooleanOptionalAction, default=True)


def stats_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--yaml", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--n-dist-bins-decade", type=int, default=8)


def parse_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("-c", "--chroms-path", required=True)
    p.add_argument("--assembly")
    p.add_argument("--min-mapq", type=int, default=1)
    p.add_argument("--max-molecule-size", type=int, default=750)
    p.add_argument("--max-inter-align-gap", type=int, default=20)
    p.add_argument("--walks-policy", choices=(*POLICIES, "all"), default="5unique")
    p.add_argument("--report-alignment-end", choices=("3", "5"), default="5")
    for name in ("--no-flip", "--drop-readid", "--drop-seq", "--drop-sam", "--add-pair-index"):
        p.add_argument(name, action="store_true")
    p.add_argument("--add-columns", default="")


def parse_choice(a: argparse.Namespace) -> ParseOptions:
    added = tuple(x for x in a.add_columns.split(",") if x)
    return ParseOptions(a.min_mapq, a.max_molecule_size, a.max_inter_align_gap, a.walks_policy, int(a.report_alignment_end), not a.no_flip, a.drop_readid, not a.drop_sam, a.drop_seq, a.add_pair_index, added)


#: Bytes of memory that a command asks for at least.
LEAST_MEMORY = 64 << 20
#: What Spark says when memory or disk runs out.
SPENT = ("OutOfMemoryError", "UNABLE_TO_ACQUIRE_MEMORY", "No space left on device", "ExecutorLostFailure")


class Run:
    """One command: its session, its input and its provenance."""

    def __init__(self, a: argparse.Namespace, argv: list[str]):
        self.a, self.argv, self.metrics, self.spools = a, argv, Metrics(), []
        if a.memory < LEAST_MEMORY:
            raise ResourceError(f"--memory: at least {LEAST_MEMORY >> 20}M are needed")
        # Spark needs room of its own before a job can begin.
        memory = f"{max(a.memory >> 20, 1024)}m"
        builder = SparkSession.builder.appName("contactweave").config("spark.ui.showConsoleProgress", str(a.progress).lower()).config("spark.driver.memory", memory)
        if "SPARK_ENV_LOADED" not in os.environ and not SparkSession.getActiveSession():
            builder = builder.master(f"local[{a.threads}]").config("spark.sql.session.timeZone", "UTC").config("spark.log.level", ("FATAL", "ERROR", "WARN")[min(a.verbose, 2)])
        if a.tmpdir:
            builder = builder.config("spark.checkpoint.dir", a.tmpdir)
        self.spark = builder.getOrCreate()
        self.spark.conf.set(parts.LEVEL, str(a.compression_level))

    def path(self, given: str) -> str:
        """A path to read; standard input is spooled to the shared folder, where all
        machines find it."""
        if given != "-":
            return given
        path = shared_folder(self.spark, "stdin")
        files, at = filesystem(path)
        files.create_dir(os.path.dirname(at), recursive=True)
        self.spools.append(path)
        with files.open_output_stream(at, compression=None) as f:
            shutil.copyfileobj(sys.stdin.buffer, f, 1 << 20)
        return path

    def close(self) -> None:
        for path in self.spools:
            files, at = filesystem(path)
            if files.get_file_info(at).is_file:
                files.delete_file(at)

    def note(self, text: str) -> None:
        if not self.a.quiet:
            print(text, file=sys.stderr)

    def read(self, given: str, strict: bool = True) -> Pairs:
        path = self.path(given)
        pairs = read_pairs(self.spark, path, strict=strict)
        if not pairs.header.lines:
            self.note(f"{given}: no header; standard columns are taken")
        return pairs

    def signed(self, header: Header) -> None:
        if not header.append_pg(f"contactweave_{self.a.command}", " ".join(self.argv), VERSION) and header.lines:
            self.note("the header is not valid; no program record is added")

    def stats_text(self, s: statsfile.Snapshot) -> str:
        return statsfile.to_yaml(s) if self.a.yaml else statsfile.to_json(s) if self.a.json else statsfile.to_tsv(s)

    def put(self, text: str, path: str) -> None:
        rows = self.spark.createDataFrame([(x,) for x in text.splitlines()], "value string").coalesce(1)
        write_lines(rows, path)

    def sort(self) -> None:
        p = self.read(self.a.input)
        if missing := [c for c in self.a.extra_col if c not in p.header.columns()]:
            raise ArgumentError(f"no column {missing[0]}")
        p.header.mark_sorted()
        self.signed(p.header)
        self.metrics.add(records=write_pairs(Pairs(p.header, basic.sort_pairs(p.df, self.a.extra_col)), self.a.output))

    def flip(self) -> None:
        p = self.read(self.a.input)
        self.signed(p.header)
        flipped = basic.flip_pairs(p.df, list(read_chromsizes(self.a.chroms_path)))
        # Rows are in the file's order still, as nothing shuffles them.
        self.metrics.add(records=write_pairs(Pairs(p.header, flipped), self.a.output))

    def dedup(self) -> None:
        a = self.a
        p = self.read(a.input)
        routing.check_sorted(p.df, a.input)
        self.signed(p.header)
        same = lambda x, y: x == y
        dups_to = "drop" if a.output_dups is None else "main" if a.output_dups == "-" or same(a.output_dups, a.output) else "own"
        unmapped_to = "drop" if a.output_unmapped is None else "main" if a.output_unmapped == "-" or same(a.output_unmapped, a.output) else "dups" if same(a.output_unmapped, a.output_dups) else "own"
        clustering = routing.BACKENDS.get(a.backend, a.clustering)
        out = routing.route(p, dups_to, unmapped_to, a.mark_dups, a.keep_parent_id, a.output_stats is not None, a.max_mismatch, a.method, clustering, [tuple(x) for x in a.extra_col_pair])
        columns = p.header.columns()
        write_pairs(out.main, a.output, columns, a.send_header_to in ("both", "dedup"))
        if out.dups:
            write_pairs(out.dups, a.output_dups, columns, a.send_header_to in ("both", "dups"))
        if out.unmapped:
            write_pairs(out.unmapped, a.output_unmapped, columns)
        if out.stats:
            self.put(self.stats_text(out.stats), a.output_stats)
        self.metrics.add(**out.counters)

    def stats(self) -> None:
        a = self.a
        if a.merge:
            texts = [small_text(self.path(x)) for x in a.inputs]
            parts = [statsfile.from_yaml(t) if re.match(r"\S+:\s*$", t.split("\n")[0]) else statsfile.from_tsv(t) for t in texts]
        else:
            read = [self.read(x) for x in a.inputs]
            parts = [statsfile.gather(p.df, a.n_dist_bins_decade, None if a.no_chromsizes else p.header.chromsizes()) for p in read]
        whole = statsfile.merged(parts)
        self.put(self.stats_text(whole), a.output)
        self.metrics.add(records=whole.counts["total"])

    def select(self) -> None:
        a = self.a
        # Only what the condition asks for is parsed.
        p = self.read(a.input, strict=False)
        subset = None
        if a.chrom_subset:
            try:
                subset = list(read_chromsizes(a.chrom_subset))
            except PairsError:
                subset = read_chrom_names(a.chrom_subset)
            p = Pairs(basic.subset_header(p.header, subset), p.df)
        try:
            parts = basic.select_pairs(p.df, a.condition, dict(a.type_cast), subset)
        except PairsError as e:
            raise e if isinstance(e, Unsupported) else ArgumentError(str(e)) from e
        self.signed(p.header)
        gone = [x for x in a.remove_columns.split(",") if x]
        for df, path in zip(parts, (a.output, a.output_rest)):
            if path:
                out = basic.without_columns(Pairs(p.header, df), gone)
                self.metrics.add(**{"records" if path == a.output else "rest": write_pairs(out, path)})

    def bin(self) -> None:
        a = self.a
        p, sizes = self.read(a.input), read_chromsizes(a.chroms_path)
        kinds = [x for x in a.pair_types.split(",") if x] if a.pair_types else None
        if min(a.resolution) < 1:
            raise ArgumentError("a resolution is at least 1")
        binning.output_paths(a.output, a.resolution)
        # Written once for all resolutions and counters.
        table = written(binning.binned(p.df, sizes, a.resolution, kinds, a.min_mapq, a.zero_based), "binned")
        binning.write_contacts(table.where("resolution > 0"), sizes, a.resolution, a.output, a.format)
        if a.bins_out:
            binning.write_bins(p.df, sizes, a.resolution, a.bins_out)
        if a.metrics:
            self.metrics.add(**binning.counters_of(table))

    def parse(self) -> None:
        a = self.a
        p = parse_sam(self.spark, self.path(a.input), read_chromsizes(a.chroms_path), parse_choice(a), a.assembly)
        self.signed(p.header)
        self.metrics.add(records=write_pairs(Pairs(p.header, p.df.orderBy("seq")), a.output))
        if a.output_stats:
            self.put(statsfile.to_tsv(statsfile.gather(p.df)), a.output_stats)

    def process(self) -> None:
        a = self.a
        if not (a.output_pairs or a.output_stats or a.output_bins):
            raise ArgumentError("nothing to do: give --output-pairs, --output-stats or --output-bins")
        if a.output_bins and not a.resolution:
            raise ArgumentError("--output-bins needs --resolution")
        sizes = read_chromsizes(a.chroms_path)
        out = process_sam(self.spark, self.path(a.input), sizes, parse_choice(a), a.max_mismatch, a.method, a.clustering, a.mark_dups, a.resolution if a.output_bins else None)
        self.signed(out.kept.header)
        for part, path in ((out.kept, a.output_pairs), (out.dups, a.output_dups), (out.unmapped, a.output_unmapped)):
            if path:
                write_pairs(Pairs(out.kept.header, part.df.orderBy("seq")), path)
        if a.output_stats:
            self.put(statsfile.to_tsv(out.stats), a.output_stats)
        if a.output_bins:
            binning.write_contacts(out.contacts, sizes, a.resolution, a.output_bins, a.bin_format)
        if a.output_bin_table:
            binning.write_bins(out.kept.df, sizes, a.resolution, a.output_bin_table)
        self.metrics.add(records=out.stats.counts["total"], duplicates=out.stats.counts["total_dups"])

    def generate(self) -> None:
        a = self.a
        if a.readid_length < 1:
            raise ArgumentError("a read name has at least one character")
        df = basic.generate_pairs(self.spark, a.records, a.seed, a.chromosomes, a.chrom_length, a.cis_fraction, a.duplicate_rate, a.duplicate_radius, a.unmapped_fraction, a.extra_columns, a.readid_length, a.sorted)
        header = basic.generated_header(a.chromosomes, a.chrom_length, a.extra_columns, a.sorted)
        self.metrics.add(records=write_pairs(Pairs(header, df if a.sorted else df.orderBy("seq")), a.output))


def exit_code(e: BaseException) -> int:
    """The code of an error; errors of tasks carry the text of the one that they met."""
    if isinstance(e, PairsError):
        return e.code
    if isinstance(e, PySparkException):
        text = str(e)
        if any(x in text for x in SPENT):
            return ResourceError.code
        return 3 if "PATH_NOT_FOUND" in text or "InputError" in text or "EOFException" in text or "ZipException" in text else 2 if "COLUMN" in text and "UNRESOLVED" in text else 4
    return ResourceError.code if isinstance(e, OSError) and e.errno == errno.ENOSPC else 3 if isinstance(e, OSError) else 1


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    a = parser().parse_args(argv)
    run = None
    try:
        run = Run(a, ["contactweave", *argv])
        getattr(run, a.command)()
        if a.metrics:
            run.metrics.report()
        return 0
    except BrokenPipeError:
        return 141
    except (PairsError, PySparkException, OSError) as e:
        said = re.search(r"\[USER_RAISED_EXCEPTION\] (.*)|(InputError: .*)", str(e))
        print(f"contactweave: {next(filter(None, said.groups())) if said else e}", file=sys.stderr)
        return exit_code(e)
    finally:
        if run:
            run.close()


if __name__ == "__main__":
    sys.exit(main())

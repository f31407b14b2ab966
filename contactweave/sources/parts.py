"""A Spark data source for files of lines.

Writing: every task codes its partition into a part file of its own in the shared folder,
plain, as BGZF members or as LZ4 frames; these can be strung together as they are.  The
commit copies the parts, in the order of partitions, into the one file that the format
asks for, and removes them; no line goes through the driver's heap.  A part is named by
its attempt, and only the parts of attempts that Spark reports are taken, so repeated and
speculative tasks leave nothing behind.

Reading: ``.pairs`` files by byte ranges, BGZF or plain, other compressions in one task.
Only the columns of the schema that is asked for are kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from contactweave.functions.fields import LINE
from contactweave.functions.graph import shared_folder
from contactweave.model import Header, PairsError, filesystem
from contactweave.sources.raw import BATCH, RANGE, file_ranges, head_lines, read_range

LINES_FORMAT, PAIRS_FORMAT = "contactweave_lines", "contactweave_pairs"
#: Session setting for the compression level of BGZF files, 1 to 9; 6 where it is unset.
LEVEL = "contactweave.compression.level"
_COPY = 8 << 20
_registered: set[str] = set()


def register(spark: SparkSession) -> None:
    """Make both formats known to the session's application."""
    if spark.sparkContext.applicationId not in _registered:
        spark.dataSource.register(LineSink)
        spark.dataSource.register(PairsFiles)
        _registered.add(spark.sparkContext.applicationId)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str


class LineWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.target, self.coding = options["parts"], options["target"], options["coding"]
        self.head, self.level = json.loads(options["head"]), int(options.get("level", "6"))

    def coded(self, lines: list[str]) -> bytes:
        from contactweave.sources.pairs import encoded

        return encoded("".join(f"{x}\n" for x in lines).encode(), self.coding, self.level)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        path = f"{self.folder}/{task.partitionId():08d}-{task.taskAttemptId()}"
        files, at = filesystem(path)
        with files.open_output_stream(at, compression=None) as f:
            for b in iterator:
                if b.num_rows:
                    f.write(self.coded(b.column(0).to_pylist()))
        return Part(task.partitionId(), path)

    def commit(self, messages: list) -> None:
        from contactweave.sources.pairs import BGZF_END

        files, at = filesystem(self.target)
        with files.open_output_stream(at, compression=None) as out:
            out.write(self.coded(self.head))
            for part in sorted((m for m in messages if m), key=lambda m: m.partition):
                theirs, name = filesystem(part.path)
                with theirs.open_input_stream(name, compression=None) as f:
                    while piece := f.read(_COPY):
                        out.write(piece)
            if self.coding == "bgzf":
                out.write(BGZF_END)
        self.clear()

    def abort(self, messages: list) -> None:
        self.clear()

    def clear(self) -> None:
        cleared(self.folder)


def cleared(folder: str) -> None:
    """Remove a folder, if it is there."""
    files, at = filesystem(folder)
    if files.get_file_info(at).type != pafs.FileType.NotFound:
        files.delete_dir(at)


class LineSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return LINES_FORMAT

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> LineWriter:
        return LineWriter(self.options)


def can_write(spark: SparkSession, path: str) -> bool:
    """Whether tasks can reach the shared folder and the driver the target by themselves."""
    try:
        filesystem(path)
        filesystem(shared_folder(spark, "parts"))
        return True
    except (pa.ArrowInvalid, RuntimeError, OSError):
        return False


def write_in_parts(lines: DataFrame, path: str, head: list[str], coding: str) -> None:
    """One file of ``head`` and the ``value`` lines, in the DataFrame's order."""
    spark = lines.sparkSession
    register(spark)
    folder = shared_folder(spark, "parts")
    files, at = filesystem(folder)
    files.create_dir(at, recursive=True)
    options = {"parts": folder, "target": path, "coding": coding, "level": spark.conf.get(LEVEL, "6"), "head": json.dumps(head)}
    try:
        lines.select("value").write.format(LINES_FORMAT).options(**options).mode("append").save()
    finally:  # a job that fails before its tasks start calls no abort
        cleared(folder)


@dataclass
class Range(InputPartition):
    number: int
    start: int
    stop: int


class PairsReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], head: int, schema: StructType):
        self.path, self.names, self.head, self.fields = path, names, head, [(f.name, f.dataType.simpleString()) for f in schema.fields]

    def partitions(self) -> list[Range]:
        return [Range(k, a, b) for k, (a, b) in enumerate(file_ranges(self.path, RANGE))]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        at = {n: i for i, n in enumerate(self.names)}
        held: list[tuple[int, str]] = []
        for n, raw in enumerate(read_range(self.path, part.start, part.stop)):
            line = (raw[:-1] if raw.endswith(b"\r") else raw).decode()
            if not line or (part.start == 0 and n < self.head):
                continue
            held.append(((part.number << 33) + n, line))
            if len(held) >= BATCH:
                yield self.batch(held, at)
                held = []
        if held:
            yield self.batch(held, at)

    def batch(self, held: list[tuple[int, str]], at: dict[str, int]) -> pa.RecordBatch:
        rows = [x.split("\t") for _, x in held] if any(n not in (LINE, "seq") for n, _ in self.fields) else []
        columns = []
        for name, kind in self.fields:
            if name == LINE:
                columns.append(pa.array([x for _, x in held], pa.string()))
            elif name == "seq":
                columns.append(pa.array([n for n, _ in held], pa.int64()))
            else:
                values = [r[at[name]] if at[name] < len(r) else None for r in rows]
                columns.append(pa.array([self.number(v, name) for v in values], pa.int64()) if kind == "bigint" else pa.array(values, pa.string()))
        return pa.RecordBatch.from_arrays(columns, [n for n, _ in self.fields])

    def number(self, value: str | None, name: str) -> int:
        if value is None or not re.fullmatch("[0-9]{1,19}", value):
            raise PairsError(f"{self.path}, column {name}: bad value {value or '(missing)'}")
        return int(value)


class PairsFiles(DataSource):
    """``spark.read.format("contactweave_pairs").load(path)``; give a schema of some of the
    header's columns, ``seq`` and ``_line`` to read those only."""

    @classmethod
    def name(cls) -> str:
        return PAIRS_FORMAT

    def header(self) -> Header:
        return Header(head_lines(None, self.options["path"], "#"))

    def schema(self) -> str:
        kinds = {"pos1": "bigint", "pos2": "bigint"}
        return ", ".join(["seq bigint", *(f"`{c}` {kinds.get(c, 'string')}" for c in self.header().columns()), f"{LINE} string"])

    def reader(self, schema: StructType) -> PairsReader:
        header = self.header()
        if missing := [f.name for f in schema.fields if f.name not in (*header.columns(), "seq", LINE)]:
            raise PairsError(f"no column {missing[0]}")
        return PairsReader(self.options["path"], header.columns(), len(header.lines), schema)

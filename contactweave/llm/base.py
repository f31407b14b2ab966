"""What the operators share: word rules, scratch tables and bounded batches."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactweave.functions.graph import shared_folder, written  # noqa: F401

#: A word is a run of characters other than the six ASCII white-space ones.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD_PATTERN)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_LOWER_TABLE = str.maketrans(UPPER, LOWER)
#: Rows that one Arrow batch hands to a Python worker.
BATCH_ROWS = 256
#: Largest table, in rows, that an operator may broadcast after counting it.
BROADCAST_ROWS = 100_000


def lower_ascii(text: str) -> str:
    """``text`` with A-Z, and nothing else, in lower case."""
    return text.translate(_LOWER_TABLE) if not text.isascii() else text.lower()


def lower_ascii_col(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def n_words_col(col: Column) -> Column:
    """Number of words of a text; null counts as 0."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def words_col(col: Column) -> Column:
    """The words of a text, in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(col, F.lit(WORD_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, even where ``body`` uses it
    inside lambdas (there it would be computed once per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_print(*columns: Column) -> list[Column]:
    """Two 64-bit hashes, ``k1`` and ``k2``, that stand for a row's values; equal
    rows have equal ones, and null values are values like others."""
    return [F.xxhash64(F.lit(s), *columns).alias(f"k{s}") for s in (1, 2)]


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: long texts meet Python in at most
    ``BATCH_ROWS`` rows or 16 MB at a time, whichever comes first.  The two
    settings stay on the session, as a lazy DataFrame reads them when it runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it has at most
    ``limit`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df

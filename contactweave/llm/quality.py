"""Quality rules with host-level verdicts.

Every text is measured once by rules of its own.  Failures are added up by
domain, each domain's failure rate is shrunk by a beta prior fitted to all
domains (method of moments), and domains whose shrunk rate lies in the prior's upper
tail and passes a least rate lose all their documents.  Domains are summed by partial aggregation, so a hot one
costs a row per task.

Defined results: a null or empty text has no words and fails as too short;
documents without a domain are judged by their own rules alone; repeated rows
are judged and counted as they stand; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contactweave.llm.base import WORD_RE, bounded_batches, small, written

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Limits:
    """min_words and max_repeat_percent make the base rule; the others only
    count against a document's domain."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 100
    max_dup_line_percent: int = 30
    #: Least shrunk failure rate of a rejected domain, and the standard deviations of
    #: the prior by which it must pass the prior's mean.
    host_rate: float = 0.35
    host_tail: float = 3.0
    max_prior_strength: float = 1000.0


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = WORD_RE.findall(text)
    lines = [x for x in text.split("\n") if WORD_RE.search(x)]
    grams = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(grams)) < len(grams):
        seen: set = set()
        again = {g for g in grams if g in seen or seen.add(g)}
        covered_to = 0
        for i, g in enumerate(grams):
            if g in again:
                repeated += i + 3 - max(i, covered_to)
                covered_to = i + 3
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def with_measures(rows: DataFrame, text_col: str | None = None, in_row: str | None = None) -> DataFrame:
    """``rows`` without ``text_col``, beside ``_n_words`` and the other measures of that
    column's texts, or of those in field ``in_row`` of the column ``_row``."""
    bounded_batches(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_row").field(in_row) if in_row else b.column(text_col)
            values = list(zip(*map(measure, texts.to_pylist()))) or [()] * len(MEASURES)
            kept = [(n, c) for n, c in zip(b.schema.names, b.columns) if n != text_col]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *(pa.array(v, pa.int64()) for v in values)], [*(n for n, _ in kept), *(f"_{m}" for m in MEASURES)])

    schema = StructType([f for f in rows.schema.fields if f.name != text_col])
    for m in MEASURES:
        schema = schema.add(f"_{m}", "long")
    return rows.mapInArrow(work, schema)


def base_failed(limits: Limits) -> Column:
    return (F.col("_n_words") < limits.min_words) | (100 * F.col("_n_repeat_words") > limits.max_repeat_percent * F.col("_n_words"))


def any_rule_failed(limits: Limits) -> Column:
    symbols = 100 * F.col("_n_symbols") > limits.max_symbol_percent * F.col("_n_words")
    lines = 100 * F.col("_n_dup_lines") > limits.max_dup_line_percent * F.col("_n_words")
    return base_failed(limits) | symbols | lines


def host_verdicts(measured: DataFrame, host_col: str, limits: Limits) -> DataFrame:
    """(host, host_docs, host_failed, host_rate, host_rejected) per domain.

    The prior is Beta(mu * k, (1 - mu) * k): mu and s2 are the mean and the
    population variance of the domains' rates, k = mu (1 - mu) / s2 - 1, held
    between 1 and ``max_prior_strength``.  Only these two numbers reach the driver.
    A domain is rejected if its shrunk rate is over ``host_rate`` and over mu by more
    than ``host_tail`` standard deviations of the prior.
    """
    hosts = written(
        measured.where(F.col(host_col).isNotNull())
        .groupBy(F.col(host_col).alias("host"))
        .agg(F.count(F.lit(1)).alias("host_docs"), F.count_if(any_rule_failed(limits)).alias("host_failed")),
        "hosts",
    )
    rate = F.col("host_failed") / F.col("host_docs")
    m = hosts.agg(F.avg(rate).alias("mu"), F.var_pop(rate).alias("s2")).first()
    mu, s2 = m["mu"] or 0.0, m["s2"] or 0.0
    k = min(limits.max_prior_strength, max(1.0, mu * (1 - mu) / s2 - 1)) if s2 > 0 else limits.max_prior_strength
    shrunk = (F.col("host_failed") + F.lit(mu * k)) / (F.col("host_docs") + F.lit(k))
    limit = max(limits.host_rate, mu + limits.host_tail * sqrt(mu * (1 - mu) / (k + 1)))
    return hosts.select("*", shrunk.alias("host_rate"), (shrunk > limit).alias("host_rejected"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """Per row of ``docs``: id, the five measures, base_failed, host_rate, kept."""
    given = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).alias("text"))
    measured = written(with_measures(given, "text"), "measures")
    hosts = small(host_verdicts(measured, "_host", limits)).select("host", "host_rate", "host_rejected")
    out = measured.join(hosts, F.col("_host") == F.col("host"), "left")
    failed = base_failed(limits)
    return out.select(
        F.col("_id").alias("doc_id"),
        *(F.col(f"_{m}").alias(m) for m in MEASURES),
        failed.alias("base_failed"),
        F.col("host_rate"),
        (~failed & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Texts are measured twice, once for the domains' counts and once for the
    rows themselves: cheaper than storing a second copy of the corpus.
    """
    verdicts = host_verdicts(with_measures(docs.select(F.col(host_col).alias("_host"), F.col(text_col).alias("text")), "text"), "_host", limits)
    bad = small(verdicts.where("host_rejected").select(F.col("host").alias("_bad")))
    # Rows travel as one column, whatever their own columns are called.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    measured = with_measures(rows, in_row=text_col).where(~base_failed(limits))
    kept = measured.join(bad, F.col(f"_row.`{host_col}`") == F.col("_bad"), "left_anti")
    return kept.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))

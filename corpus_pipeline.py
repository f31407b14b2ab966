"""From raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All but the last return the columns
of ``documents``.

1. quality rules: documents that the rules or their domain's verdict reject go;
2. MinHash near-dedup: of each group the document with the smallest id stays;
3. benchmark decontamination: documents that hold a benchmark item go;
4. mixing: documents are taken whole, in part or more than once, to source targets;
5. token ids: the mix is written as Simple-8b files; a row says what they hold of it.

Defined results: the first three stages judge rows, not ids, so rows that repeat an id,
or have none, stay or go by themselves, and of equal rows one stays; null and empty texts
fail the quality rules; further columns are carried through all stages but the last; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contactweave.llm import decontam, mixing, neardup, quality, tokenfile
from contactweave.llm.base import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenfile.token_table(docs, tokenfile.default_vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
    ("token ids", token_ids),
]

#: SQL can't express the tokenizer, so there is none.  The tests hold the ids that a
#: run leaves of 45 documents against loops over pairs and windows, the rows that odd
#: tables leave against lists, and stages 2 to 5 against brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read
    again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        folder = shared_folder(spark, f"stage{i + 1}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs

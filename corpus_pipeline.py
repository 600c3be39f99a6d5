"""A training corpus from the table of documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a
DataFrame; ``run`` writes each result as Parquet and rereads it for the next one. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import decontamination, language, queries, secret_scan, simhash
from ledgerlake.llm.common import documents, held_out
from ledgerlake.workspace import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model of the labelled ones accepts."""
    labelled = docs.select("doc_id", "text", "lang")
    return language.keep_accepted(docs, language.fit(labelled, held_out(4, 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into sequences."""
    return queries.packed(docs)


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_free),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

#: Language prediction, XXH64 fingerprints and token ids have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

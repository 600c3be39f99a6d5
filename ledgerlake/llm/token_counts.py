"""Token counts through a cache of digests.

A text's digest is that of its normalised content: the UTF-8 bytes, null as empty, as the tokenizer
itself neither normalises nor drops anything. Counts are stored by (digest, tokenizer version). Only
distinct digests that the cache lacks are encoded, each once, and their counts are appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.llm.tokens import TokenCounts, of_worker, version
from ledgerlake.workspace import written

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def stored(spark: SparkSession, cache: str) -> DataFrame:
    """The counts of a cache folder; a folder that doesn't exist yet has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if not there:
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def encoded(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of (digest, text) rows; a digest that a task meets again is not encoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = of_worker(TokenCounts, tokenizer), set()
        for batch in batches:
            new: dict[bytes, str] = {}
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest not in seen:
                    seen.add(digest)
                    new[digest] = text
            for begin in range(0, len(new), 200):
                digests = list(new)[begin : begin + 200]
                counts = count([new[d] for d in digests])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"]
                )

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``, by the tokenizer file ``tokenizer``.

    ``cache`` is a folder of stored counts that all executors share; misses are appended to it. Null
    texts count as empty, with 0 bytes and 0 tokens. Repeated rows each get their count. Other columns
    are not returned; an empty table gives no rows and leaves the cache as it is.
    """
    spark = docs.sparkSession
    named = version(tokenizer)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = written(keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-rows")
    known = stored(spark, cache).where(F.col("version") == named).select("digest")
    misses = rows.join(known, "digest", "left_anti").groupBy("digest").agg(F.min("doc_id").alias("__id"))
    # the row with the least id stands for its digest; the few columns of the misses are the hashed side
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    wanted = misses.withColumnRenamed("digest", "__digest").hint("shuffle_hash")
    texts = keyed.join(wanted, same, "left_semi")
    new = encoded(texts, tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    new.select("digest", F.lit(named).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    counts = stored(spark, cache).where(F.col("version") == named).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted = rows.join(written(counts, "token-counts"), "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

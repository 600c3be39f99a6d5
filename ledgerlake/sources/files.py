"""File sources and sinks: change feed, markdown folder, embedding store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerlake import schemas


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema; a malformed row fails the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CHANGE_EVENT)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CUSTOMER_SNAPSHOT)


def write_changes(changes: DataFrame, path: str) -> None:
    """Change feed in time order: a range shuffle, so files and rows within them are sorted."""
    columns = schemas.CHANGE_EVENT.names
    (
        changes.select(*columns)
        .orderBy("change_timestamp", "customer_id", "change_type")
        .write.mode("overwrite").option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    )


def _stem(name: str, suffix: str):
    return F.regexp_replace(F.col(name), rf"\.{suffix}$", "")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ``*.md`` file: document_name (file stem) and text with ``\\n`` line ends."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return files.select(
        F.col("value"), F.col("_metadata.file_name").alias("file_name")
    ).select(
        _stem("file_name", "md").alias("document_name"),
        F.regexp_replace("value", r"\r\n?", "\n").alias("text"),
    )


def read_embedding_store(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ``*.json`` file: content_hash (file stem) and the vector."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return files.select(
        F.col("value"), F.col("_metadata.file_name").alias("file_name")
    ).select(
        _stem("file_name", "json").alias("content_hash"),
        F.from_json("value", "array<double>").alias("embedding"),
    )

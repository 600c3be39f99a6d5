"""Incremental silver transactions and running category totals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.functions.moments import clock_time, utc_instant
from ledgerlake.operators.silver import clean_transactions


def _timed(transactions: DataFrame, lateness: str) -> DataFrame:
    return transactions.withColumn("event_time", utc_instant(F.col("timestamp"))).withWatermark("event_time", lateness)


def silver_stream(
    transactions: DataFrame, path: str, checkpoint: str, lateness: str = "1 day", as_of: dt.datetime | None = None
) -> StreamingQuery:
    """Append new transactions to the month-partitioned table, dropping repeats within ``lateness``."""
    once = _timed(transactions, lateness).dropDuplicatesWithinWatermark(["transaction_id"]).drop("event_time")
    return (
        clean_transactions(once, as_of)
        .writeStream.format("parquet").partitionBy("year", "month")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def totals_stream(
    transactions: DataFrame, path: str, checkpoint: str, lateness: str = "1 day", window: str = "1 day"
) -> StreamingQuery:
    """Count and sum per day and category; every micro-batch writes the groups it changed.

    A batch writes to a folder of its own and replaces it when repeated, so retries do no harm.
    """
    totals = (
        _timed(transactions, lateness)
        .groupBy(F.window("event_time", window).alias("period"), "category")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("total_cents"))
        .select(clock_time(F.col("period.start")).alias("period_start"), "category", "n", "total_cents")
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        totals.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The newest totals of every day and category."""
    return (
        spark.read.parquet(path).groupBy("period_start", "category")
        .agg(F.max_by(F.struct("n", "total_cents"), "batch").alias("newest"))
        .select("period_start", "category", "newest.*")
    )

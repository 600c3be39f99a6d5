"""Invocation log totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlake.operators.ranges import range_scan


def running_totals(log: DataFrame) -> DataFrame:
    """client_id, called_at, call_id, tokens -> calls and tokens so far, per client."""
    rows = log.withColumn("__one", F.lit(1))
    running = {"calls_so_far": "__one", "tokens_so_far": "tokens"}
    return range_scan(rows, ["client_id"], ["called_at", "call_id"], running=running).drop("__one")


def totals(log: DataFrame) -> DataFrame:
    return log.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens")
    )

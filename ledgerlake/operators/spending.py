"""Most recent transactions per key and category spend, over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlake.functions.money import dollars


def latest_per_key(
    rows: DataFrame, keys: Sequence[str], time: str, tie_break: str, n: int
) -> DataFrame:
    """The ``n`` newest rows of every key, numbered by ``rn``.

    The filter sits right on the window, so Spark keeps ``n`` rows per key inside each map task
    before the shuffle and a hot key arrives as a few rows per task.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc(time), F.asc(tie_break))
    return rows.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= n)


def latest_as_list(
    rows: DataFrame, keys: Sequence[str], time: str, tie_break: str, n: int, item: Sequence[str | Column]
) -> DataFrame:
    """One row per key with ``items``, at most ``n`` structs, newest first."""
    return (
        latest_per_key(rows, keys, time, tie_break, n)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("rn", *item))).alias("items"))
    )


def category_spend_full(transactions: DataFrame, by_month: bool = False) -> DataFrame:
    """Whole spend per account and category, without the row limit of the request form."""
    month = [F.year("timestamp").alias("year"), F.month("timestamp").alias("month")] if by_month else []
    return (
        transactions.groupBy("account_id", "category", *month)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("total_cents"))
        .withColumn("total_dollars", dollars(F.col("total_cents")))
    )

"""Bronze to silver: light cleaning, derived columns, partitioned and versioned writes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ledgerlake.functions.moments import clock_time
from ledgerlake.functions.money import dollars
from ledgerlake.sources.versions import VersionedTable


def _ingested(as_of: dt.datetime | None) -> Column:
    if as_of is None:
        return clock_time(F.current_timestamp())
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def clean_customers(customers: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    return customers.withColumns({"email": F.lower("email"), "ingested_at": _ingested(as_of)})


def clean_accounts(accounts: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    return accounts.withColumns(
        {"ingested_at": _ingested(as_of), "balance_dollars": dollars(F.col("balance_cents"))}
    )


def clean_transactions(transactions: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    return transactions.withColumns(
        {
            "ingested_at": _ingested(as_of),
            "amount_dollars": dollars(F.col("amount_cents")),
            "year": F.year("timestamp"),
            "month": F.month("timestamp"),
        }
    )


CLEANERS = {
    "customers": clean_customers,
    "accounts": clean_accounts,
    "transactions": clean_transactions,
}

PARTITIONS = {"transactions": ("year", "month")}


def by_month_files(transactions: DataFrame) -> DataFrame:
    """Group rows of a month into few files without giving a month to one task.

    ``rebalance`` lets adaptive execution split a large month and coalesce small ones by size;
    sorting inside a task narrows the account range of every row group for later skipping, and starts
    with the partition columns, so the writer keeps that order.
    """
    return transactions.hint("rebalance", "year", "month").sortWithinPartitions(
        "year", "month", "account_id", "timestamp"
    )


def write_silver(
    name: str, source: DataFrame, table: VersionedTable, as_of: dt.datetime | None = None
) -> dict[str, int]:
    """Full refresh of one silver table as a new version; source and written counts in one pass."""
    loaded = Observation(f"{name}_loaded")
    cleaned = CLEANERS[name](source.observe(loaded, F.count(F.lit(1)).alias("rows")), as_of)
    partitions = PARTITIONS.get(name, ())
    if partitions:
        cleaned = by_month_files(cleaned)
    commit = table.overwrite(cleaned, partition_by=partitions, allow_schema_change=True)
    return {"loaded": loaded.get["rows"], "written": commit.num_rows, "version": commit.version}


def write_all_silver(
    sources: Mapping[str, DataFrame], tables: Mapping[str, VersionedTable], as_of: dt.datetime | None = None
) -> dict[str, dict[str, int]]:
    """Refresh the silver tables in order; running it again publishes the same content once more."""
    return {name: write_silver(name, sources[name], tables[name], as_of) for name in CLEANERS if name in sources}


def transactions_between(silver: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Rows with ``start <= timestamp < end``, with the month predicates that prune partitions."""
    month = F.col("year") * 12 + F.col("month")
    return silver.filter(
        (F.col("year").between(start.year, end.year))
        & (month.between(start.year * 12 + start.month, end.year * 12 + end.month))
        & (F.col("timestamp") >= F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz"))
        & (F.col("timestamp") < F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz"))
    )


def totals_by_category(transactions: DataFrame) -> DataFrame:
    return (
        transactions.groupBy("category")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("total_cents"))
        .orderBy("category")
    )


def add_reference_data(rows: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Left join of a reference table with unique keys; Spark broadcasts it when its size allows."""
    return rows.join(reference, key, "left")

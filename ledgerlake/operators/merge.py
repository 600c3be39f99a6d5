"""Upserts as DataFrames: matched rows updated, unmatched rows inserted, the rest kept."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.operators.skew import few_keys, restrict_to


def merge_upsert(
    target: DataFrame,
    source: DataFrame,
    key: str,
    update: Sequence[str],
    insert: Sequence[str],
    on_insert: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The target after an upsert.

    Matched rows take the ``update`` columns from the source and keep everything else, so derived
    columns stay as they were. Inserted rows get the ``insert`` columns, ``on_insert`` expressions,
    and null elsewhere. Two source rows with one key fail the job.

    Whether the source is broadcast to the target scan is left to Spark's size estimates and adaptive
    execution; otherwise target and source are shuffled by key.
    """
    few = few_keys(source, key)
    changes = _one_row_per_key(source, key)
    cast = {f.name: f.dataType for f in target.schema}
    offered = changes.select(key, F.struct(*changes.columns).alias("__new"))
    updated = target.join(offered, key, "left").select(
        *[
            F.when(F.col("__new").isNotNull(), F.col("__new")[c].cast(cast[c])).otherwise(F.col(c)).alias(c)
            if c in update
            else F.col(c)
            for c in target.columns
        ]
    )
    on_insert = on_insert or {}
    fresh = changes.join(restrict_to(target.select(key), few, key), key, "left_anti")
    inserted = fresh.select(
        *[
            (F.col(c) if c in insert else on_insert.get(c, F.lit(None))).cast(cast[c]).alias(c)
            for c in target.columns
        ]
    )
    return updated.unionByName(inserted)


def _one_row_per_key(source: DataFrame, key: str) -> DataFrame:
    """Aggregated with map-side combining, so even a hot duplicate key is found cheaply."""
    others = [c for c in source.columns if c != key]
    grouped = source.groupBy(key).agg(
        F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*others)).alias("__row")
    )
    unique = F.when(F.col("__n") == 1, F.col("__row")).otherwise(
        F.raise_error(F.concat(F.lit(f"merge source has several rows for {key} "), F.col(key).cast("string")))
    )
    return grouped.select(key, unique.alias("__row")).select(
        *[F.col(key) if c == key else F.col("__row")[c].alias(c) for c in source.columns]
    )


ACCOUNT_UPDATES = ("balance_cents", "status")
ACCOUNT_INSERTS = (
    "account_id", "customer_id", "account_type", "balance_cents", "currency", "opened_date", "status",
)


def merge_accounts(accounts: DataFrame, updates: DataFrame) -> DataFrame:
    """Account upsert; ``opened_date`` may arrive as text and is cast on insert."""
    return merge_upsert(accounts, updates, "account_id", ACCOUNT_UPDATES, ACCOUNT_INSERTS)


def rederive_balance(accounts: DataFrame) -> DataFrame:
    """Bring ``balance_dollars`` in line with ``balance_cents`` after a merge."""
    return accounts.withColumn("balance_dollars", F.col("balance_cents").cast("double") / F.lit(100.0))

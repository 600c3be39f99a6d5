"""Point-in-time joins without range joins.

Facts and state rows are put on one timeline per key and the newest state is carried forward. The
work is linear in facts plus states, where an equi-key join with a range condition compares every
fact of a key with every state of that key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ledgerlake.operators.ranges import range_scan
from ledgerlake.operators.scd2 import _timeline

STATE, FACT = 0, 1


def _latest_state(
    facts: DataFrame, states: DataFrame, key: str, time: str, tie_break: str, groups: Sequence[str]
) -> DataFrame:
    """Facts with, per state group, the newest non-null struct at or before the fact time.

    ``states`` has columns (key, at, *groups); a state at exactly the fact time counts.
    """
    payload = F.struct(*facts.columns)
    fact_rows = facts.select(
        F.col(key).alias("key"), F.col(time).alias("at"), F.lit(FACT).alias("kind"),
        F.col(tie_break).cast("string").alias("tie"), payload.alias("fact"),
        *[F.lit(None).cast(states.schema[g].dataType).alias(g) for g in groups],
    )
    state_rows = states.select(
        F.col(key).alias("key"), "at", F.lit(STATE).alias("kind"), F.lit("").alias("tie"),
        F.lit(None).cast(fact_rows.schema["fact"].dataType).alias("fact"), *groups,
    )
    rows = state_rows.unionByName(fact_rows)
    scanned = range_scan(rows, ["key"], ["at", "kind", "tie"], carry={f"{g}_now": g for g in groups})
    return scanned.filter(F.col("kind") == FACT).select("fact.*", *[f"{g}_now" for g in groups])


def point_in_time_join(facts: DataFrame, history: DataFrame, time: str, tie_break: str) -> DataFrame:
    """Facts with the customer version valid at the fact time; null where none was valid."""
    version = F.struct(
        "customer_key", "address_line", "state_code", "risk_rating", "effective_from", "effective_to"
    )
    states = history.select("customer_id", F.col("effective_from").alias("at"), version.alias("version"))
    joined = _latest_state(facts, states, "customer_id", time, tie_break, ["version"])
    end = F.col("version_now.effective_to")
    valid = F.when(end.isNull() | (F.col(time) < end), F.col("version_now"))
    return joined.withColumn("version", valid).select(*facts.columns, "version.*")


def as_of_attributes(
    facts: DataFrame, snapshot: DataFrame, changes: DataFrame, time: str, tie_break: str
) -> DataFrame:
    """The same answer straight from the snapshot and the change feed, without building history."""
    joined = _latest_state(
        facts, _timeline(snapshot, changes), "customer_id", time, tie_break, ["address", "risk"]
    )
    return joined.select(
        *facts.columns, "address_now.address_line", "address_now.state_code", "risk_now.risk_rating"
    )

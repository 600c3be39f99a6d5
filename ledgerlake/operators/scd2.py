"""Customer history as slowly changing dimension type 2.

A history row is valid in the half-open range [effective_from, effective_to); the open row has no
end and ``is_current`` true. Address and state change together (ADDRESS events), the risk rating by
itself (RISK_RATING events). Events carry a full image, but only the part named by their type is
trusted: the other part was copied from the operational table and may be older than an earlier event.

A merge and a rebuild follow one rule: an event opens a version if it changes what holds just before it. One that
repeats it, one from before the enrollment and one of a customer that the snapshot doesn't know open none.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.functions.moments import micros
from ledgerlake.operators.ranges import range_scan

ADDRESS, RISK = "ADDRESS", "RISK_RATING"

HISTORY = [
    "customer_key", "customer_id", "address_line", "state_code", "risk_rating",
    "effective_from", "effective_to", "is_current",
]


def surrogate_key(customer_id: Column, effective_from: Column) -> Column:
    """Digest of natural key and start: the same on every run, and no global order is needed."""
    return F.sha2(F.concat_ws("|", customer_id, micros(effective_from).cast("string")), 256)


def _history(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "customer_key", surrogate_key(F.col("customer_id"), F.col("effective_from"))
    ).select(*HISTORY)


def initial_history(snapshot: DataFrame) -> DataFrame:
    """One open version per customer, valid from the enrollment date."""
    return _history(
        snapshot.withColumns(
            {
                "effective_from": F.col("enrollment_date").cast("timestamp_ntz"),
                "effective_to": F.lit(None).cast("timestamp_ntz"),
                "is_current": F.lit(True),
            }
        )
    )


def _address() -> Column:
    return F.struct("address_line", "state_code")


def _risk() -> Column:
    return F.struct("risk_rating")


def _timeline(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """Customer states in time: what each instant sets, null where it sets nothing.

    One customer and instant is one row. Events there win over a snapshot row, and of several events
    of one type the largest counts. Events of customers that the snapshot doesn't know, and those from
    before the enrollment, are left out.
    """
    nothing = [F.lit(None).alias(f"{name}_event") for name in ("address", "risk")]
    start = snapshot.select(
        "customer_id", F.col("enrollment_date").cast("timestamp_ntz").alias("at"),
        _address().alias("address"), _risk().alias("risk"), *nothing,
    )
    enrolled = snapshot.select("customer_id", F.col("enrollment_date").cast("timestamp_ntz").alias("__since"))
    known = changes.join(enrolled, "customer_id").filter(F.col("change_timestamp") >= F.col("__since"))
    events = known.filter(F.col("change_type").isin(ADDRESS, RISK)).select(
        "customer_id", F.col("change_timestamp").alias("at"), F.lit(None).alias("address"), F.lit(None).alias("risk"),
        F.when(F.col("change_type") == ADDRESS, _address()).alias("address_event"),
        F.when(F.col("change_type") == RISK, _risk()).alias("risk_event"),
    )
    return start.unionByName(events).groupBy("customer_id", "at").agg(
        *[
            F.coalesce(F.max(f"{name}_event"), F.max(name)).alias(name)
            for name in ("address", "risk")
        ]
    )


def sequenced_history(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """Full rebuild from the snapshot and all changes, any number per customer."""
    scanned = range_scan(
        _timeline(snapshot, changes), ["customer_id"], ["at"],
        carry={"address_now": "address", "risk_now": "risk"}, before={"address_before": "address", "risk_before": "risk"},
    )
    same = [F.col(f"{name}_now").eqNullSafe(F.col(f"{name}_before")) for name in ("address", "risk")]
    versions = scanned.filter(~(same[0] & same[1])).select(
        "customer_id", "address_now.address_line", "address_now.state_code", "risk_now.risk_rating",
        F.col("at").alias("effective_from"),
    )
    ended = range_scan(versions, ["customer_id"], ["effective_from"], lead={"effective_to": "effective_from"})
    return _history(ended.withColumn("is_current", F.col("effective_to").isNull()))


def first_changes(changes: DataFrame) -> DataFrame:
    """The earliest change per customer: what one single-change merge run applies.

    Changes of one instant go by type, then by payload, so the largest payload of a type is applied
    last, as in a rebuild. Equal rows are one change.
    """
    others = [c for c in changes.columns if c != "customer_id"]
    trusted = F.when(F.col("change_type") == RISK, F.col("risk_rating"))
    position = F.struct(
        "change_timestamp", "change_type", trusted.alias("trusted"), "address_line", "state_code", "risk_rating"
    )
    earliest = changes.groupBy("customer_id").agg(F.min_by(F.struct(*others), position).alias("first"))
    return earliest.select("customer_id", "first.*").select(*changes.columns)


def pending_changes(changes: DataFrame) -> DataFrame:
    """Changes a single-change run leaves for later runs."""
    names = changes.columns
    first = first_changes(changes).toDF(*[f"first_{c}" for c in names])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in names])
    return changes.distinct().join(first, same, "left_anti")


def merge_changes(history: DataFrame, changes: DataFrame) -> DataFrame:
    """Close-out-and-insert of at most one change per customer.

    Only open rows, one per customer, are joined; closed rows pass through untouched. A change of the
    very instant at which the open row begins alters that row instead of closing it. Changes that alter
    nothing or are earlier than the open row are skipped (see ``skipped_changes``).
    """
    open_rows = history.filter("is_current")
    matched = open_rows.join(_offered(changes), "customer_id", "left")
    keep = [F.col(c).alias(c) for c in HISTORY]
    closed = {**{c: F.col(c) for c in HISTORY}, "effective_to": F.col("new_at"), "is_current": F.lit(False)}
    opened = {
        **{c: F.col(c) for c in HISTORY},
        "customer_key": surrogate_key(F.col("customer_id"), F.col("new_at")),
        **_after(), "effective_from": F.col("new_at"),
    }
    versions = F.when(
        _applies() & (F.col("new_at") == F.col("effective_from")),
        F.array(F.struct(*[{**opened, "effective_from": F.col("effective_from")}[c].alias(c) for c in HISTORY])),
    ).when(
        _applies(),
        F.array(
            F.struct(*[closed[c].alias(c) for c in HISTORY]), F.struct(*[opened[c].alias(c) for c in HISTORY])
        ),
    ).otherwise(F.array(F.struct(*keep)))
    merged = matched.select(F.inline(versions))
    return history.filter(~F.col("is_current")).select(*HISTORY).unionByName(merged)


def skipped_changes(history: DataFrame, changes: DataFrame) -> DataFrame:
    """First changes that a merge run does not apply, with the reason."""
    joined = _offered(changes).join(history.filter("is_current"), "customer_id", "left")
    reason = (
        F.when(F.col("effective_from").isNull(), "unknown_customer")
        .when(F.col("new_at") < F.col("effective_from"), "stale")
        .when(~_applies(), "no_change")
    )
    return joined.select(
        "customer_id", F.col("new_at").alias("change_timestamp"), F.col("new_type").alias("change_type"),
        reason.alias("reason"),
    ).filter("reason is not null")


def _offered(changes: DataFrame) -> DataFrame:
    return first_changes(changes).select(
        "customer_id", F.col("change_timestamp").alias("new_at"), F.col("change_type").alias("new_type"),
        F.col("address_line").alias("new_address"), F.col("state_code").alias("new_state"),
        F.col("risk_rating").alias("new_risk"),
    )


def _after() -> dict[str, Column]:
    """Tracked attributes after the offered change."""
    moved = F.col("new_type") == ADDRESS
    rated = F.col("new_type") == RISK
    return {
        "address_line": F.when(moved, F.col("new_address")).otherwise(F.col("address_line")),
        "state_code": F.when(moved, F.col("new_state")).otherwise(F.col("state_code")),
        "risk_rating": F.when(rated, F.col("new_risk")).otherwise(F.col("risk_rating")),
    }


def _applies() -> Column:
    same = [value.eqNullSafe(F.col(name)) for name, value in _after().items()]
    return F.coalesce(
        (F.col("new_at") >= F.col("effective_from")) & ~(same[0] & same[1] & same[2]), F.lit(False)
    )


def version_history(history: DataFrame) -> DataFrame:
    """History with ``version_no`` counting from 1 within each customer."""
    rows = history.withColumn("__one", F.lit(1))
    return range_scan(rows, ["customer_id"], ["effective_from"], running={"version_no": "__one"}).drop("__one")


def snapshot_at(history: DataFrame, at: dt.datetime) -> DataFrame:
    """Every customer as of one instant."""
    moment = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
    return history.filter(
        (F.col("effective_from") <= moment)
        & (F.col("effective_to").isNull() | (moment < F.col("effective_to")))
    )


def history_violations(history: DataFrame) -> DataFrame:
    """Broken invariants per customer: current rows, empty ranges, gaps and overlaps."""
    following = range_scan(
        history, ["customer_id"], ["effective_from", "customer_key"], lead={"next_from": "effective_from"}
    )
    end, nxt = F.col("effective_to"), F.col("next_from")
    rules = {
        "empty_range": end <= F.col("effective_from"),
        "gap": end < nxt,
        "overlap": nxt.isNotNull() & (end.isNull() | (end > nxt)),
        "flag": F.col("is_current") != end.isNull(),
    }
    broken = following.select(
        "customer_id",
        F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule"),
    )
    per_customer = history.groupBy("customer_id").agg(F.count_if("is_current").alias("open_rows"))
    not_one = per_customer.filter("open_rows <> 1").select("customer_id", F.lit("current_rows").alias("rule"))
    return broken.unionByName(not_one).groupBy("customer_id", "rule").agg(F.count(F.lit(1)).alias("n"))

import random

import pytest
from pyspark.sql import functions as F

from ledgerlake import schemas
from ledgerlake.operators import scd2
from ledgerlake.streaming.corrected import CorrectedSilver, CorrectedTotals
from ledgerlake.streaming.keyed_history import KeyedHistory, versions
from tests.test_scd2 import EVENTS, SNAPSHOT, day, make_changes, make_snapshot
from tests.test_streaming import TXN, Feed, transactions


def test_late_rows_are_counted_and_corrected(spark, tmp_path, rows):
    feed = Feed(spark, tmp_path / "in", spark.createDataFrame([], TXN).schema)
    parts = [
        transactions(spark, (1, 0, 1, 100, "a"), (2, 9, 0, 50, "a")),
        transactions(spark, (3, 0, 5, 1_000, "a"), (4, 8, 1, 7, "b"), (5, 9, 2, 2, "a")),  # T3 is late, T4 within a day
        transactions(spark, (6, 3, 0, 5, "b"), (7, 30, 0, 1, "a")),
    ]
    totals = CorrectedTotals(spark, str(tmp_path / "totals"))
    for part in parts:
        feed.add(part)
        totals.start(feed.stream(), str(tmp_path / "cp")).awaitTermination()
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    day_of = F.date_trunc("day", "timestamp").cast("timestamp_ntz")
    plain = everything.groupBy(day_of.alias("p"), "category").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("t"))
    assert rows(totals.read(), "period_start", "category", "n", "total_cents") == rows(plain)
    assert rows(totals.late_rows(everything.schema), "transaction_id") == [("T3",), ("T6",)]
    assert rows(totals.counts(), "batch", "n_rows", "late_rows") == [(0, 2, 0), (1, 3, 1), (2, 2, 1)]
    assert totals.read().agg(F.sum("late_n")).first()[0] == 2


def test_a_repeated_batch_changes_nothing(spark, tmp_path, rows):
    totals = CorrectedTotals(spark, str(tmp_path / "totals"))
    for batch_id, part in ((0, transactions(spark, (1, 5, 1, 100, "a"))), (1, transactions(spark, (2, 0, 1, 7, "a"))), (1, transactions(spark, (2, 0, 1, 7, "a")))):
        totals.apply(part, batch_id)
    totals.apply(transactions(spark).limit(0) if False else spark.createDataFrame([], TXN), 2)
    assert rows(totals.read(), "period_start", "n", "total_cents", "late_n") == [(day(0), 1, 7, 1), (day(5), 1, 100, 0)]
    totals.apply(transactions(spark, (3, 0, 2, 1, "a")), 3)  # the watermark outlives an empty batch
    assert totals.counts().filter("batch = 3").first()["late_rows"] == 1


def test_silver_keeps_late_rows_and_drops_late_repeats(spark, tmp_path, rows):
    table = CorrectedSilver(spark, str(tmp_path / "silver"))
    batches = [
        transactions(spark, (1, 0, 1, 100, "a"), (2, 60, 0, 200, "b")),
        transactions(spark, (1, 0, 1, 100, "a"), (3, 1, 0, 300, "a"), (3, 1, 0, 300, "a"), (4, 61, 0, 5, "a")),
    ]
    for batch_id, part in enumerate(batches):
        table.apply(part, batch_id)
    found = table.read(batches[0])
    assert rows(found, "transaction_id", "year", "month", "amount_dollars") == [
        ("T1", 2025, 1, 1.0), ("T2", 2025, 3, 2.0), ("T3", 2025, 1, 3.0), ("T4", 2025, 3, 0.05),
    ]
    assert table.late_rows(batches[0].schema).count() == 3  # stored as they came


# keyed history


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4], [4, 2, 3, 0, 1]])
def test_keyed_history_is_the_same_for_any_arrival_order(spark, tmp_path, rows, order):
    snapshot, feed = make_snapshot(spark), Feed(spark, tmp_path / "in", schemas.CHANGE_EVENT, per_batch=2)
    history = KeyedHistory(spark, str(tmp_path / "h"), snapshot)
    for i in order[:3]:
        feed.add(make_changes(spark, [EVENTS[i]]))
    history.start(feed.stream(), str(tmp_path / "cp")).awaitTermination()
    for i in order[3:]:
        feed.add(make_changes(spark, [EVENTS[i]]))
    feed.add(make_changes(spark, [EVENTS[order[0]]]))  # delivered twice
    history.start(feed.stream(), str(tmp_path / "cp")).awaitTermination()
    assert rows(history.read()) == rows(scd2.sequenced_history(snapshot, make_changes(spark)))
    assert history.read().filter("is_current").count() == len(SNAPSHOT)


def test_keyed_history_of_odd_events(spark, tmp_path, rows):
    """Events before and at the enrollment, at one instant, of unknown customers and types, that change nothing, and nulls."""
    snapshot, feed = make_snapshot(spark), Feed(spark, tmp_path / "in", schemas.CHANGE_EVENT)
    draw = random.Random(3)
    events = []
    for i in range(120):
        kind = draw.choice(["ADDRESS", "RISK_RATING", "RISK_RATING", "OTHER"])
        place = draw.choice([("1 A", "NC"), ("9 Z", "GA"), (None, "TX"), ("x", None)])
        events.append((draw.choice(["C-1", "C-2", "C-9"]), draw.choice([-3000, -1827, *range(12)]), *place, draw.choice(["LOW", "HIGH", None]), kind))
    for begin in range(0, 120, 30):
        feed.add(make_changes(spark, events[begin : begin + 30]))
    history = KeyedHistory(spark, str(tmp_path / "h"), snapshot)
    history.start(feed.stream(), str(tmp_path / "cp")).awaitTermination()
    assert rows(history.read()) == rows(scd2.sequenced_history(snapshot, make_changes(spark, events)))


def test_what_a_batch_reads_does_not_grow(spark, tmp_path):
    """Input rows of a micro-batch are those of its file and the snapshot, after any number of batches."""
    snapshot, feed = make_snapshot(spark), Feed(spark, tmp_path / "in", schemas.CHANGE_EVENT)
    for i in range(6):
        feed.add(make_changes(spark, [("C-1", i, f"{i} A", "TX", "LOW", "ADDRESS")]))
    history = KeyedHistory(spark, str(tmp_path / "h"), snapshot)
    stream = history.start(feed.stream(), str(tmp_path / "cp"))
    stream.awaitTermination()
    read = [p["numInputRows"] for p in stream.recentProgress if p["numInputRows"]]
    assert len(read) == 6 and len(set(read)) == 1
    stored = history.stored().groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in stored] == [len(SNAPSHOT), 2, 2, 2, 2, 2, 2]


def test_versions_of_one_customer():
    start = (10, "a", "NC", "LOW")
    assert versions(start, {}) == [["a", "NC", "LOW", 10, None]]
    events = {5: (True, "z", "Z", False, None), 20: (True, "a", "NC", False, None), 30: (False, None, None, True, "HIGH"), 40: (True, "b", "TX", True, None)}
    assert versions(start, events) == [["a", "NC", "LOW", 10, 30], ["a", "NC", "HIGH", 30, 40], ["b", "TX", None, 40, None]]
    assert versions(start, {10: (True, None, None, False, None)}) == [[None, None, "LOW", 10, None]]

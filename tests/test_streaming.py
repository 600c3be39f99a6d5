import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlake import schemas
from ledgerlake.operators import scd2
from ledgerlake.streaming.history import HistoryStream
from ledgerlake.streaming.tables import read_totals, silver_stream, totals_stream
from tests.test_scd2 import EVENTS, SNAPSHOT, day, make_changes, make_snapshot

TXN = "transaction_id string, account_id string, timestamp timestamp_ntz, amount_cents long, merchant string, category string, status string, created_at timestamp_ntz"


class Feed:
    """A folder that receives one file per call, read ``per_batch`` files at a time."""

    def __init__(self, spark, folder, schema, per_batch=1):
        self.spark, self.folder, self.schema, self.per_batch, self.n = spark, folder, schema, per_batch, 0
        folder.mkdir()

    def add(self, df):
        out = self.folder / f"f{self.n:03d}"
        df.coalesce(1).write.parquet(str(out))
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.per_batch).parquet(f"{self.folder}/*")


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4], [4, 2, 3, 0, 1]])
def test_history_is_the_same_for_any_arrival_order(spark, tmp_path, rows, order):
    snapshot, feed = make_snapshot(spark), Feed(spark, tmp_path / "in", schemas.CHANGE_EVENT, per_batch=2)
    history = HistoryStream(spark, str(tmp_path / "h"), snapshot)
    for i in order[:3]:
        feed.add(make_changes(spark, [EVENTS[i]]))
    history.start(feed.stream(), str(tmp_path / "cp")).awaitTermination()
    for i in order[3:]:
        feed.add(make_changes(spark, [EVENTS[i]]))
    feed.add(make_changes(spark, [EVENTS[order[0]]]))  # delivered twice
    history.start(feed.stream(), str(tmp_path / "cp")).awaitTermination()
    assert rows(history.read()) == rows(scd2.sequenced_history(snapshot, make_changes(spark)))
    assert history.read().filter("is_current").count() == len(SNAPSHOT)


def test_repeated_batch_changes_nothing(spark, tmp_path, rows):
    snapshot = make_snapshot(spark)
    history = HistoryStream(spark, str(tmp_path / "h"), snapshot)
    history.write_initial()
    for batch_id, events in ((0, EVENTS[:3]), (1, EVENTS[2:]), (1, EVENTS[2:])):
        history.apply(make_changes(spark, events), batch_id)
    assert rows(history.read()) == rows(scd2.sequenced_history(snapshot, make_changes(spark)))


def test_early_equal_and_empty_batches(spark, tmp_path, rows):
    """Events before and at the enrollment, at one instant in two batches, and a batch without events."""
    snapshot = make_snapshot(spark)
    enrolled = (dt.datetime(2020, 1, 1) - day(0)).days
    batches = [
        [("C-1", 5, "a", "TX", "LOW", "ADDRESS")],
        [],
        [("C-1", enrolled - 3, "b", "CA", "LOW", "ADDRESS"), ("C-2", enrolled, "c", "NY", "LOW", "ADDRESS")],
        [("C-1", enrolled - 9, "x", "x", "HIGH", "RISK_RATING"), ("C-1", 5, "x", "x", "MEDIUM", "RISK_RATING")],
        [("C-1", 2, "d", "GA", "LOW", "ADDRESS"), ("C-2", 9, "x", "x", "HIGH", "RISK_RATING"), ("C-9", 1, "n", "N", "LOW", "ADDRESS")],
        [("C-9", 0, "m", "M", "LOW", "ADDRESS")],
    ]
    history = HistoryStream(spark, str(tmp_path / "h"), snapshot)
    history.write_initial()  # C-9 is not in the snapshot
    for batch_id, events in enumerate(batches):
        history.apply(make_changes(spark, events), batch_id)
    everything = make_changes(spark, [e for events in batches for e in events])
    assert rows(history.read()) == rows(scd2.sequenced_history(snapshot, everything))


def test_only_the_tail_is_written(spark, tmp_path):
    history = HistoryStream(spark, str(tmp_path / "h"), make_snapshot(spark))
    history.write_initial()
    history.apply(make_changes(spark, [("C-1", d, f"{d} A", "TX", "LOW", "ADDRESS") for d in range(200)]), 0)
    history.apply(make_changes(spark, [("C-1", 300, "9 Z", "GA", "LOW", "ADDRESS")]), 1)
    assert history._versions().filter("batch = 1").count() == 2
    assert history.read().filter("customer_id = 'C-1'").count() == 202


def transactions(spark, *items):
    data = [(f"T{i}", "A", day(d) + dt.timedelta(hours=h), n, "m", k, "posted", day(d)) for i, d, h, n, k in items]
    return spark.createDataFrame(data, TXN)


def test_silver_drops_repeats_and_keeps_partitions(spark, tmp_path, rows):
    feed = Feed(spark, tmp_path / "in", spark.createDataFrame([], TXN).schema)
    feed.add(transactions(spark, (1, 0, 1, 100, "a"), (2, 0, 2, 200, "b")))
    feed.add(transactions(spark, (2, 0, 2, 200, "b"), (3, 40, 0, 300, "a")))
    out = str(tmp_path / "silver")
    silver_stream(feed.stream(), out, str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(out)
    assert rows(found, "transaction_id", "year", "month", "amount_dollars") == [("T1", 2025, 1, 1.0), ("T2", 2025, 1, 2.0), ("T3", 2025, 2, 3.0)]


def test_totals_follow_batches_and_drop_only_late_rows(spark, tmp_path, rows):
    feed = Feed(spark, tmp_path / "in", spark.createDataFrame([], TXN).schema)
    feed.add(transactions(spark, (1, 0, 1, 100, "a"), (2, 0, 23, 50, "a")))
    feed.add(transactions(spark, (3, 1, 0, 10, "a"), (4, 0, 12, 5, "b")))
    out, checkpoint = str(tmp_path / "totals"), str(tmp_path / "cp")
    totals_stream(feed.stream(), out, checkpoint).awaitTermination()
    assert rows(read_totals(spark, out), "period_start", "category", "n", "total_cents") == [
        (day(0), "a", 2, 150), (day(0), "b", 1, 5), (day(1), "a", 1, 10),
    ]
    feed.add(transactions(spark, (5, 9, 0, 1, "a")))
    totals_stream(feed.stream(), out, checkpoint).awaitTermination()
    feed.add(transactions(spark, (6, 0, 5, 1_000, "a"), (7, 9, 1, 2, "a")))
    totals_stream(feed.stream(), out, checkpoint).awaitTermination()
    found = {(r["period_start"], r["category"]): r["total_cents"] for r in read_totals(spark, out).collect()}
    assert found[day(9), "a"] == 3 and found[day(0), "a"] == 150


def test_days_do_not_depend_on_the_session_zone(spark, tmp_path, rows):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        feed = Feed(spark, tmp_path / "in", spark.createDataFrame([], TXN).schema)
        feed.add(transactions(spark, (1, 68, 2, 7, "a"), (2, 68, 23, 8, "a"), (3, 69, 0, 9, "a")))  # a day with a clock change
        totals_stream(feed.stream(), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
        found = rows(read_totals(spark, str(tmp_path / "t")), "period_start", "total_cents")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == [(day(68), 15), (day(69), 9)]

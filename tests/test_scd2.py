import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from ledgerlake import schemas
from ledgerlake.operators import pit, scd2

ENROLLED = dt.date(2020, 1, 1)

# Two changes each; the second event repeats the snapshot value of the other attribute.
SNAPSHOT = {"C-1": ("1 A", "NC", "LOW"), "C-2": ("2 B", "NC", "LOW"), "C-3": ("3 C", "FL", "HIGH"), "C-4": ("4 D", "OH", "LOW")}
EVENTS = [
    ("C-1", 1, "1 A", "NC", "HIGH", "RISK_RATING"),
    ("C-1", 5, "9 Z", "GA", "LOW", "ADDRESS"),
    ("C-2", 2, "9 Y", "IL", "LOW", "ADDRESS"),
    ("C-2", 4, "2 B", "NC", "MEDIUM", "RISK_RATING"),
    ("C-3", 3, "3 C", "FL", "MEDIUM", "RISK_RATING"),
]


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def make_snapshot(spark, people=SNAPSHOT):
    data = [(c, "F", "L", f"{c}@x", ENROLLED, a, s, r) for c, (a, s, r) in people.items()]
    return spark.createDataFrame(data, schemas.CUSTOMER_SNAPSHOT)


def make_changes(spark, events=EVENTS):
    return spark.createDataFrame([(c, day(d), a, s, r, k) for c, d, a, s, r, k in events], schemas.CHANGE_EVENT)


@pytest.fixture
def snapshot(spark):
    return make_snapshot(spark)


@pytest.fixture
def changes(spark):
    return make_changes(spark)


def current(history):
    return {
        r["customer_id"]: (r["address_line"], r["state_code"], r["risk_rating"])
        for r in history.filter("is_current").collect()
    }


def test_sequenced_keeps_what_earlier_events_set(snapshot, changes):
    history = scd2.sequenced_history(snapshot, changes)
    assert history.count() == len(SNAPSHOT) + len(EVENTS)
    assert current(history) == {
        "C-1": ("9 Z", "GA", "HIGH"), "C-2": ("9 Y", "IL", "MEDIUM"), "C-3": ("3 C", "FL", "MEDIUM"), "C-4": ("4 D", "OH", "LOW"),
    }
    assert scd2.history_violations(history).count() == 0


def test_single_change_run(snapshot, changes, rows):
    initial = scd2.initial_history(snapshot)
    merged = scd2.merge_changes(initial, changes)
    assert merged.count() == len(SNAPSHOT) + 3
    assert current(merged)["C-1"] == ("1 A", "NC", "HIGH")
    assert scd2.history_violations(merged).count() == 0
    pending = scd2.pending_changes(changes)
    assert rows(pending, "customer_id", "change_type") == [("C-1", "ADDRESS"), ("C-2", "RISK_RATING")]
    # the rest applied by a second run gives the sequenced history
    again = scd2.merge_changes(merged, pending)
    assert rows(again) == rows(scd2.sequenced_history(snapshot, changes))


def test_stale_repeated_and_unknown_changes_are_reported(spark, snapshot, rows):
    initial = scd2.initial_history(snapshot)
    odd = make_changes(
        spark,
        [("C-1", -9999, "0 X", "TX", "LOW", "ADDRESS"), ("C-2", 1, "2 B", "NC", "LOW", "ADDRESS"),
         ("C-9", 1, "0 X", "TX", "LOW", "ADDRESS"), ("C-3", 1, "0 X", "TX", "HIGH", "ADDRESS")],
    )
    assert rows(scd2.skipped_changes(initial, odd), "customer_id", "reason") == [
        ("C-1", "stale"), ("C-2", "no_change"), ("C-9", "unknown_customer"),
    ]
    merged = scd2.merge_changes(initial, odd)
    assert merged.count() == len(SNAPSHOT) + 1 and current(merged)["C-3"] == ("0 X", "TX", "HIGH")


def test_merging_twice_applies_once(snapshot, changes, rows):
    once = scd2.merge_changes(scd2.initial_history(snapshot), scd2.first_changes(changes))
    assert rows(scd2.merge_changes(once, scd2.first_changes(changes))) == rows(once)


def test_change_to_null_is_kept(spark, snapshot):
    changes = make_changes(spark, [("C-1", 1, None, None, "LOW", "ADDRESS"), ("C-1", 2, "1 A", "NC", "HIGH", "RISK_RATING")])
    assert current(scd2.sequenced_history(snapshot, changes))["C-1"] == (None, None, "HIGH")


def test_changes_at_one_instant_make_one_version(spark, snapshot):
    changes = make_changes(spark, [("C-1", 1, "5 E", "TX", "LOW", "ADDRESS"), ("C-1", 1, "1 A", "NC", "HIGH", "RISK_RATING")])
    history = scd2.sequenced_history(snapshot, changes)
    assert history.filter("customer_id = 'C-1'").count() == 2
    assert current(history)["C-1"] == ("5 E", "TX", "HIGH")


def test_version_numbers_keys_and_snapshots(snapshot, changes, rows):
    history = scd2.sequenced_history(snapshot, changes)
    numbered = scd2.version_history(history).filter("customer_id = 'C-1'")
    assert rows(numbered, "version_no", "risk_rating", "state_code") == [(1, "LOW", "NC"), (2, "HIGH", "NC"), (3, "HIGH", "GA")]
    assert history.select("customer_key").distinct().count() == history.count()
    at_change = {r["customer_id"]: r["risk_rating"] for r in scd2.snapshot_at(history, day(1)).collect()}
    assert at_change == {"C-1": "HIGH", "C-2": "LOW", "C-3": "HIGH", "C-4": "LOW"}
    before = {r["customer_id"]: r["risk_rating"] for r in scd2.snapshot_at(history, day(1) - dt.timedelta(microseconds=1)).collect()}
    assert before["C-1"] == "LOW"


def test_violations_are_found(spark, snapshot, rows):
    base = scd2.initial_history(snapshot).filter("customer_id = 'C-1'")
    gap = base.selectExpr("* except (effective_to, is_current)", "timestamp_ntz'2021-01-01' as effective_to", "false as is_current")
    later = base.selectExpr(
        "* except (effective_from, effective_to, is_current)", "timestamp_ntz'2022-01-01' as effective_from",
        "timestamp_ntz'2022-01-01' as effective_to", "true as is_current",
    )
    assert rows(scd2.history_violations(gap.unionByName(later)), "rule") == [("empty_range",), ("flag",), ("gap",)]
    assert rows(scd2.history_violations(base.unionByName(later)), "rule") == [
        ("current_rows",), ("empty_range",), ("flag",), ("overlap",),
    ]


EVENT = st.tuples(
    st.sampled_from(["C-1", "C-2", "C-4"]), st.integers(0, 900), st.sampled_from(["5 E", "6 F"]),
    st.sampled_from(["TX", "CA"]), st.sampled_from(["LOW", "HIGH"]), st.sampled_from(["ADDRESS", "RISK_RATING"]),
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(events=st.lists(EVENT, max_size=25, unique_by=lambda e: (e[0], e[1])), data=st.data())
def test_histories_replay_events(spark, events, data):
    """Against replaying the events one by one, also for facts joined at a point in time."""
    snapshot, changes = make_snapshot(spark), make_changes(spark, events)
    states, versions = dict(SNAPSHOT), {c: [(dt.datetime(2020, 1, 1), v)] for c, v in SNAPSHOT.items()}
    for c, d, a, s, r, kind in sorted(events, key=lambda e: e[1]):
        old = states[c]
        states[c] = (a, s, old[2]) if kind == "ADDRESS" else (old[0], old[1], r)
        if states[c] != old:  # an event that changes nothing opens no version, as in a merge
            versions[c].append((day(d), states[c]))
    history = scd2.sequenced_history(snapshot, changes)
    found = {}
    for r in history.orderBy("effective_from").collect():
        found.setdefault(r["customer_id"], []).append((r["effective_from"], (r["address_line"], r["state_code"], r["risk_rating"])))
    assert found == versions
    assert scd2.history_violations(history).count() == 0

    moments = data.draw(st.lists(st.tuples(st.sampled_from(["C-1", "C-2", "C-9"]), st.integers(-3000, 1000)), max_size=10))
    facts = spark.createDataFrame([(i, c, day(d)) for i, (c, d) in enumerate(moments)], "id int, customer_id string, t timestamp_ntz")
    expected = {}
    for i, (c, d) in enumerate(moments):
        valid = [state for start, state in versions.get(c, []) if start <= day(d)]
        expected[i] = valid[-1] if valid else (None, None, None)
    for joined in (
        pit.point_in_time_join(facts, history, "t", "id"), pit.as_of_attributes(facts, snapshot, changes, "t", "id"),
    ):
        assert {r["id"]: (r["address_line"], r["state_code"], r["risk_rating"]) for r in joined.collect()} == expected


def test_merge_and_rebuild_follow_one_rule(spark, rows):
    """An event that repeats the present address, one from before the enrollment, and one that changes something."""
    snapshot = make_snapshot(spark)
    before = (dt.datetime(2020, 1, 1) - day(0)).days - 5
    for event in (("C-1", 3, "1 A", "NC", "LOW", "ADDRESS"), ("C-2", before, "9 Z", "GA", "HIGH", "ADDRESS"), ("C-4", 2, "x", "x", "HIGH", "RISK_RATING")):
        changes = make_changes(spark, [event])
        merged = scd2.merge_changes(scd2.initial_history(snapshot), changes)
        assert rows(merged) == rows(scd2.sequenced_history(snapshot, changes))
        assert merged.count() == len(SNAPSHOT) + (event[0] == "C-4")


def test_point_in_time_join_respects_closed_ends(spark, rows):
    history = scd2.initial_history(make_snapshot(spark)).selectExpr(
        "* except (effective_to, is_current)", "timestamp_ntz'2021-01-01' as effective_to", "false as is_current"
    )
    facts = spark.createDataFrame([(1, "C-1", dt.datetime(2020, 6, 1)), (2, "C-1", dt.datetime(2021, 1, 1))], "id int, customer_id string, t timestamp_ntz")
    assert rows(pit.point_in_time_join(facts, history, "t", "id"), "id", "state_code") == [(1, "NC"), (2, None)]


def tied_feed(spark, seed):
    """Events with ties in time and type, null parts, exact repeats and an unknown customer."""
    rng = random.Random(seed)
    rows = []
    for customer in ["A", "B", "C", "X"]:
        for _ in range(8):
            rows.append(
                (customer, dt.datetime(2024, 1, 1 + rng.randrange(4)), rng.choice(["ADDRESS", "RISK_RATING"]),
                 rng.choice(["1 Elm", "2 Elm", None]), rng.choice(["TX", "CA"]), rng.choice(["LOW", "HIGH", None]))
            )
    rows += rows[:3]
    schema = "customer_id string, change_timestamp timestamp_ntz, change_type string, address_line string, state_code string, risk_rating string"
    snapshot = spark.createDataFrame(
        [(c, "0 Elm", "NY", "LOW", dt.date(2024, 1, 1)) for c in "ABC"],
        "customer_id string, address_line string, state_code string, risk_rating string, enrollment_date date",
    )
    return snapshot, spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("seed", [1, 2])
def test_no_change_is_lost(spark, rows, seed):
    _, feed = tied_feed(spark, seed)
    applied, pending = scd2.first_changes(feed), scd2.pending_changes(feed)
    assert rows(applied.unionByName(pending)) == rows(feed.distinct())
    assert applied.count() == 4


def test_single_change_runs_end_in_the_rebuild(spark, rows):
    """States at every instant agree, ties, nulls, repeats and unknown customers included."""
    snapshot, feed = tied_feed(spark, 3)
    history, left = scd2.initial_history(snapshot), feed
    while left.limit(1).count():
        merged, pending = scd2.merge_changes(history, left), scd2.pending_changes(left)
        history, left = (spark.createDataFrame(f.collect(), f.schema) for f in (merged, pending))
    rebuilt = scd2.sequenced_history(snapshot, feed)
    assert rebuilt.filter("customer_id = 'X'").count() == 0
    for day in range(1, 6):
        at = dt.datetime(2024, 1, day, 12)
        state = ["customer_id", "address_line", "state_code", "risk_rating"]
        assert rows(scd2.snapshot_at(history, at), *state) == rows(scd2.snapshot_at(rebuilt, at), *state)

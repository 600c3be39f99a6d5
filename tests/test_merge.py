import datetime as dt

import pytest
from pyspark.errors import PySparkException

from ledgerlake.operators import merge

TARGET = (
    "account_id string, customer_id string, account_type string, balance_cents long, currency string, "
    "opened_date date, status string, created_at timestamp_ntz, ingested_at timestamp_ntz, balance_dollars double"
)
SOURCE = (
    "account_id string, customer_id string, account_type string, balance_cents long, currency string, "
    "opened_date string, status string"
)
DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def accounts(spark):
    return spark.createDataFrame(
        [("ACC-1", "C-7", "savings", 100, "USD", DAY.date(), "frozen", DAY, DAY, 1.0),
         ("ACC-2", "C-8", "checking", 200, "USD", DAY.date(), "active", DAY, DAY, 2.0)],
        TARGET,
    )


@pytest.fixture
def updates(spark):
    return spark.createDataFrame(
        [("ACC-1", "C-1", "checking", 99_999, "USD", "2020-11-06", "active"),
         ("ACC-9", "C-1", "savings", 50_000, "USD", "2026-06-22", "active")],
        SOURCE,
    )


def test_updates_listed_columns_and_inserts(accounts, updates):
    found = {r["account_id"]: r for r in merge.merge_accounts(accounts, updates).collect()}
    assert set(found) == {"ACC-1", "ACC-2", "ACC-9"}
    one = found["ACC-1"]
    assert (one["balance_cents"], one["status"]) == (99_999, "active")
    assert (one["customer_id"], one["account_type"], one["balance_dollars"]) == ("C-7", "savings", 1.0)
    new = found["ACC-9"]
    assert new["opened_date"] == dt.date(2026, 6, 22)
    assert (new["balance_dollars"], new["created_at"], new["ingested_at"]) == (None, None, None)


def test_rederive(accounts, updates):
    found = merge.rederive_balance(merge.merge_accounts(accounts, updates))
    assert {r["account_id"]: r["balance_dollars"] for r in found.collect()} == {"ACC-1": 999.99, "ACC-2": 2.0, "ACC-9": 500.0}


def test_repeating_a_merge_changes_nothing(accounts, updates, rows):
    once = merge.merge_accounts(accounts, updates)
    assert rows(merge.merge_accounts(once, updates)) == rows(once)


def test_update_to_null(spark, accounts):
    source = spark.createDataFrame([("ACC-1", None, None, None, None, None, None)], SOURCE)
    found = {r["account_id"]: r for r in merge.merge_accounts(accounts, source).collect()}
    assert found["ACC-1"]["balance_cents"] is None and found["ACC-2"]["balance_cents"] == 200


def test_ambiguous_source_fails(accounts, updates):
    with pytest.raises(PySparkException, match="several rows for account_id"):
        merge.merge_accounts(accounts, updates.unionAll(updates)).collect()


def test_small_source_leaves_the_target_unshuffled(spark, tmp_path, accounts, updates):
    spark.range(200_000).selectExpr(
        "concat('ACC-', id) as account_id", "'C' as customer_id", "'savings' as account_type", "id as balance_cents",
        "'USD' as currency", "date'2020-01-01' as opened_date", "'active' as status",
        "timestamp_ntz'2020-01-01' as created_at", "timestamp_ntz'2020-01-01' as ingested_at", "1.0D as balance_dollars",
    ).write.parquet(str(tmp_path / "a"))
    target = spark.read.parquet(str(tmp_path / "a"))
    updates.write.parquet(str(tmp_path / "u"))  # its size is then known to Spark, which broadcasts it by itself
    merged = merge.merge_accounts(target, spark.read.parquet(str(tmp_path / "u")))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter, BuildRight" in plan and "LeftSemi, BuildRight" in plan and "Cartesian" not in plan
    # both keys of the source exist in this target
    assert merged.count() == 200_000 and merged.filter("balance_cents = 99999 and account_id = 'ACC-1'").count() == 1


def test_large_source_gives_the_same(spark, accounts, updates, rows, monkeypatch):
    small = rows(merge.merge_accounts(accounts, updates))
    monkeypatch.setattr(merge, "few_keys", lambda source, key: None)
    assert rows(merge.merge_accounts(accounts, updates)) == small

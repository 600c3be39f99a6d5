"""Restriction to asked keys without jobs, and request operators that start none while they are planned."""

import pytest

from ledgerlake.operators import requests
from ledgerlake.operators.merge import merge_accounts, merge_upsert
from ledgerlake.operators.skew import few_keys, keep_asked, restrict_to
from ledgerlake.plans import standins as s

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def jobs(spark):
    """How many jobs a function starts."""
    tracker = spark.sparkContext.statusTracker()

    def count(work):
        before = set(tracker.getJobIdsForGroup(None))
        work()
        return len(set(tracker.getJobIdsForGroup(None)) - before)

    return count


def test_few_keys_are_estimated(spark, rows):
    answers = spark.sql("SELECT * FROM VALUES ('hot', 1), ('k1', 2), ('k2', 3), ('k2', 4) AS t(k, v)")
    table = spark.range(300).selectExpr("id", "case when id % 3 = 0 then 'hot' else 'k' || id % 50 end as k")
    few = few_keys(answers, "k")
    assert few is not None
    assert rows(restrict_to(table, few, "k"), "id", "k") == rows(table.join(answers, "k", "left_semi"), "id", "k")
    large = spark.range(10**9).selectExpr("cast(id as string) as k")
    assert few_keys(large, "k") is None
    assert restrict_to(table, None, "k") is table


@pytest.fixture
def many(spark):
    """No set of keys counts as few."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("kind", ["string", "bigint", "int"])
def test_many_keys_lose_no_asked_row(spark, many, kind):
    table = spark.range(200_000).selectExpr(f"cast(nullif(id, 7) as {kind}) as k", "'a' as bucket", "'b' as bits", "id")
    wanted = spark.range(200_001).where("id % 2 = 1 or id = 200000").selectExpr(f"cast(nullif(id, 9) as {kind}) as k", "1 as bucket")
    wanted = wanted.unionByName(wanted)
    assert few_keys(wanted, "k") is None
    kept = keep_asked(table, wanted, "k")
    assert kept.columns == table.columns
    assert kept.join(wanted.distinct(), "k", "left_semi").count() == 99_998  # all odd ones but 7 and 9, once each
    assert kept.count() < 100_500  # few others pass
    assert keep_asked(table, wanted.limit(0), "k").count() == 0


def test_keys_of_two_types_are_all_kept(spark, many):
    table, wanted = spark.range(20).selectExpr("id as k"), spark.range(9).selectExpr("cast(id as int) as k")
    assert keep_asked(table, wanted, "k").count() == 20
    fractions = table.selectExpr("cast(k as double) as k")
    assert keep_asked(fractions, fractions.limit(2), "k").count() == 20


def test_many_requests_cut_the_transactions_before_their_shuffle(spark, rows, many):
    """Else every transaction of every account is sorted and shuffled, once for each list."""
    accounts, transactions, asked = (f(spark, FOLDER) for f in (s.accounts, s.transactions, s.requests))
    answers = requests.dispatch(asked, accounts, transactions)
    plan = answers._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 5  # accounts three times, transactions twice
    found = rows(answers)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert found == rows(requests.dispatch(asked, accounts, transactions))
    assert sum(r[2] is None for r in found) > 100


def test_operators_start_no_job(spark, jobs):
    accounts, transactions = s.accounts(spark, FOLDER), s.transactions(spark, FOLDER)
    asked = accounts.selectExpr("account_id as request_id", "account_id", "'A' as category", "5 as limit")
    assert jobs(lambda: requests.balance_lookup(asked, accounts)) == 0
    assert jobs(lambda: requests.recent_transactions(asked, accounts, transactions)) == 0
    assert jobs(lambda: requests.category_spend(asked, accounts, transactions)) == 0
    assert jobs(lambda: merge_accounts(accounts, accounts)) == 0
    assert jobs(lambda: accounts.count()) > 0


def test_no_broadcast_is_forced(spark):
    """Few but wide source rows are left to Spark's own size guard."""
    target = spark.range(10).selectExpr("cast(id as string) as k", "'' as v")
    source = spark.range(20).selectExpr("cast(id as string) as k", "repeat('x', 1000000) as v")
    merged = merge_upsert(target, source, "k", ["v"], ["k", "v"])
    assert "Hint" not in merged._jdf.queryExecution().analyzed().toString()

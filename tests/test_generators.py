import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import generators as g

NOW = dt.datetime(2026, 6, 1)


@pytest.fixture(scope="module")
def people(spark):
    return g.customers(spark.range(400).withColumnRenamed("id", "n"), NOW.date()).cache()


def test_same_rows_for_any_partitioning(spark, people, rows):
    other = g.customers(spark.range(400).repartition(7).withColumnRenamed("id", "n"), NOW.date())
    assert rows(other) == rows(people)
    assert rows(g.accounts(other)) == rows(g.accounts(people))
    assert rows(g.customers(spark.range(400).withColumnRenamed("id", "n"), NOW.date(), seed=1)) != rows(people)


def test_customers(people):
    shares = {r["risk_rating"]: r["count"] / 400 for r in people.groupBy("risk_rating").count().collect()}
    assert abs(shares["LOW"] - 0.6) < 0.1 and abs(shares["HIGH"] - 0.1) < 0.06
    assert people.select("state_code").distinct().count() == len(g.STATES)
    assert people.select("email").distinct().count() == 400
    assert people.filter(~F.col("enrollment_date").between(dt.date(2018, 6, 1), dt.date(2026, 5, 2))).count() == 0


def test_accounts(people):
    made = g.accounts(people)
    per_customer = {r["count"] for r in made.groupBy("customer_id").count().collect()}
    assert per_customer == {1, 2, 3}
    assert made.groupBy("customer_id", "account_type").count().filter("count > 1").count() == 0
    assert made.select("account_id").distinct().count() == made.count()
    for kind, (low, high) in g.BALANCES.items():
        balances = made.filter(F.col("account_type") == kind).agg(F.min("balance_cents"), F.max("balance_cents")).first()
        assert low <= balances[0] <= balances[1] <= high
    joined = made.join(people.select("customer_id", "enrollment_date"), "customer_id")
    assert joined.filter("datediff(opened_date, enrollment_date) not between 0 and 60").count() == 0


def test_transactions(people):
    made = g.transactions(g.accounts(people), NOW)
    counts = made.groupBy("account_id").count().agg(F.min("count"), F.max("count")).first()
    assert tuple(counts) == (15, 40)
    assert made.filter("transaction_id not rlike '^TXN-ACC-[0-9]+-00[0-3][0-9]$'").count() == 0
    assert made.select("transaction_id").distinct().count() == made.count()
    for name, low, high, merchants in g.CATEGORIES:
        part = made.filter(F.col("category") == name)
        ends = part.agg(F.min("amount_cents"), F.max("amount_cents")).first()
        assert low <= ends[0] <= ends[1] <= high
        assert {r[0] for r in part.select("merchant").distinct().collect()} == set(merchants)
    span = made.agg(F.min("timestamp"), F.max("timestamp")).first()
    assert NOW - dt.timedelta(days=60, hours=23) <= span[0] and span[1] <= NOW


def test_changes(people):
    feed = g.changes(people, NOW)
    counts = g.change_type_counts(feed).first()
    assert abs(counts["n_address"] / 400 - 0.3) < 0.08 and abs(counts["n_risk"] / 400 - 0.2) < 0.08
    joined = feed.join(people.selectExpr("customer_id", "risk_rating as old", "state_code as home"), "customer_id")
    assert joined.filter("change_type = 'RISK_RATING' and (risk_rating = old or state_code <> home)").count() == 0
    assert joined.filter("change_type = 'ADDRESS' and risk_rating <> old").count() == 0
    times = [r["change_timestamp"] for r in feed.collect()]
    assert times == sorted(times)


def test_one_split_of_numbers_is_generated_by_many_tasks(spark):
    numbers = spark.range(0, 400, 1, 1).withColumnRenamed("id", "n")
    made = g.transactions(g.accounts(g.customers(numbers, NOW.date())), NOW)
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < sum(sizes) / 2

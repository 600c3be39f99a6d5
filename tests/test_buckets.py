import os

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import merge, scd2
from ledgerlake.sources.buckets import BucketedTable
from tests.test_scd2 import make_changes, make_snapshot


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_merge_touches_its_buckets_only(spark, rows, tmp_path):
    target = spark.range(500).select(
        F.col("id").cast("string").alias("account_id"), F.lit("C").alias("customer_id"), F.lit("checking").alias("account_type"),
        F.col("id").alias("balance_cents"), F.lit("USD").alias("currency"), F.current_date().alias("opened_date"), F.lit("active").alias("status"),
    )
    updates = target.filter("account_id in ('3', '7')").withColumn("balance_cents", F.lit(-1).cast("bigint"))
    updates = updates.unionByName(updates.limit(1).withColumn("account_id", F.lit("new")))
    table = BucketedTable(spark, str(tmp_path / "t"), target.schema, "account_id", buckets=32)
    table.overwrite(target)
    before = files(tmp_path / "t")
    touched = table.merge(updates, merge.merge_accounts)
    assert 1 <= len(touched) <= 3
    after = files(tmp_path / "t")
    changed = {os.path.basename(os.path.dirname(f)) for f, _ in set(before.items()) ^ set(after.items())}
    assert changed == {f"__bucket={b}" for b in touched}
    assert rows(table.read()) == rows(merge.merge_accounts(target, updates))
    read = [r[0] for r in table.part(touched).select(F.input_file_name()).distinct().collect()]
    assert {os.path.basename(os.path.dirname(f)) for f in read} == changed
    assert table.merge(updates.limit(0), merge.merge_accounts) == []


def test_history_merge_in_buckets(spark, rows, tmp_path):
    initial, changes = scd2.initial_history(make_snapshot(spark)), make_changes(spark)
    table = BucketedTable(spark, str(tmp_path / "h"), initial.schema, "customer_id", buckets=8)
    table.overwrite(initial)
    table.merge(changes, scd2.merge_changes)
    assert rows(table.read()) == rows(scd2.merge_changes(initial, changes))


def test_a_merge_that_fails_changes_nothing(spark, rows, tmp_path):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    table = BucketedTable(spark, str(tmp_path / "t"), target.schema, "k", buckets=4)
    table.overwrite(target)
    twice = spark.createDataFrame([("a", 5), ("a", 6)], "k string, v int")
    with pytest.raises(Exception, match="several rows"):
        table.merge(twice, lambda t, s: merge.merge_upsert(t, s, "k", ["v"], ["k", "v"]))
    assert rows(table.read()) == [("a", 1), ("b", 2)]

"""Physical plans: partial top-n, pruned and pushed-down scans, shuffles that are not needed."""

import re

import pytest

from ledgerlake import workspace
from ledgerlake.operators.spending import latest_per_key
from ledgerlake.plans import standins as s
from ledgerlake.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_is_cut_before_the_shuffle(spark):
    plan = plan_of(latest_per_key(s.transactions(spark, FOLDER), ["account_id"], "timestamp", "transaction_id", 50))
    assert re.search(r"Final[\s\S]*Exchange hashpartitioning\(account_id[\s\S]*Partial", plan)


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["totals_by_category"](spark, FOLDER))
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string,l_linestatus:string>" in plan
    plan = plan_of(QUERIES["change_type_counts"](spark, FOLDER))
    assert "In(event_type, [click,error])" in plan


def test_index_counts_terms_without_shuffling_postings(spark):
    from pyspark.sql import functions as F

    texts = spark.range(10).selectExpr("cast(id as string) as d", "0 as i", "'a b a' as t").repartition("d")
    counted = texts.select("d", "i", F.explode(F.split("t", " ")).alias("w")).groupBy("d", "i", "w").count()
    assert plan_of(counted).count("Exchange") == 1


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Settings:
        def get(self, key, default):
            return default

    class Cluster:
        conf = Settings()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.new_folder(Cluster(), "x")
    Settings.get = lambda self, key, default: "s3a://bucket/shared/"
    assert workspace.new_folder(Cluster(), "x").startswith("s3a://bucket/shared/x-")

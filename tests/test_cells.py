import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import cells, vectors
from tests.test_retrieval import as_lists, plain_top, vector_tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def share_found(exact, found):
    return np.mean([len(set(exact[q]) & set(found.get(q, []))) / len(exact[q]) for q in exact])


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_with_a_tenth_of_the_items_scored(spark, size):
    """Every twentieth vector a query, at 500 and 2,000 items."""
    given = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    items = given.selectExpr("cast(vec_id as string) as item_id", "embedding")
    asked = given.filter("vec_id % 20 = 0").selectExpr("cast(vec_id as string) as query_id", "embedding")
    index = cells.build(items)
    assert share_found(as_lists(vectors.nearest(asked, items)), as_lists(index.search(asked))) >= 0.9
    work = index.work(asked).agg(F.sum("scored"), F.sum("scanned"), F.count(F.lit(1))).first()
    assert work[0] <= 0.1 * work[2] * index.model.items
    assert work[1] < work[2] * index.model.items  # cells are left out too


@pytest.mark.parametrize("copies", [1, 10])
def test_exact_search_equals_a_scan(spark, copies, monkeypatch):
    monkeypatch.setattr(cells, "SPLIT_ROWS", 8)  # crowded cells are split
    monkeypatch.setattr(cells, "SLICE", 5)
    queries, items, cos = vector_tables(spark, 13, 300, copies=copies)
    index = cells.build(items.repartition(4))
    assert index.model.splits.max() > 1
    assert as_lists(index.nearest(queries, k=7)) == plain_top(cos, 7)
    assert as_lists(index.search(queries, k=7, probes=10**6)).keys() == plain_top(cos, 7).keys()


def test_angles_rule_cells_out(spark):
    """Clustered vectors: exact search scans few of them, and the answer is that of a scan."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16)) * 3
    data = [(f"i{i:04d}", (centres[i % 20] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(800)]
    items = spark.createDataFrame(data, "item_id string, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i:03d}", c.tolist()) for i, c in enumerate(centres)], "query_id string, embedding array<double>")
    index = cells.build(items)
    assert as_lists(index.nearest(queries)) == as_lists(vectors.nearest(queries, items))
    scanned = index._found(queries, 5, None).agg(F.sum("scanned")).first()[0]
    assert scanned < 0.3 * 20 * 800


def test_vectors_are_shuffled_when_built_only(spark):
    queries, items, _ = vector_tables(spark, 13, 300)
    plan = plan_of(cells.build(items).search(queries))
    assert "SelectedBucketsCount" in plan
    (at,) = [i for i, line in enumerate(plan.splitlines()) if "FileScan" in line and "code:binary" in line]
    above = plan.splitlines()[:at]
    join = max(i for i, line in enumerate(above) if "CoGroups" in line)
    # the items are the second side: what stands between their scan and the join is a sort and a filter
    beside = [line.strip(" :+-*()0123456789") for line in above[join + 1 :]]
    assert any(line.startswith("Sort") for line in beside[-3:]) and not any(line.startswith("Exchange") for line in beside[-3:])


def test_small_tables_and_missing_vectors(spark):
    queries, items, cos = vector_tables(spark, 3, 4)
    assert as_lists(cells.build(items).nearest(queries, k=9)) == plain_top(cos, 9)
    odd = items.unionByName(spark.createDataFrame([("none", None)], "item_id string, embedding array<double>"))
    assert as_lists(cells.build(odd).nearest(queries, k=9)) == plain_top(cos, 9)
    empty = cells.build(items.limit(0))
    assert empty.search(queries).count() == 0 and empty.nearest(queries).count() == 0
    assert cells.build(items).search(queries.limit(0)).count() == 0


def test_many_queries_do_not_pass_through_the_driver(spark, monkeypatch):
    """10^5 queries: what planning brings to the driver doesn't grow with them."""
    rows = []
    kind = type(spark.range(1))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: rows.append(found := collect(self)) or found)
    item = F.array(*[F.sin(F.col("id") * (d + 1.5)) for d in range(8)])
    items = spark.range(3000).select(F.col("id").cast("string").alias("item_id"), item.alias("embedding"))
    many = spark.range(100_000).select(F.col("id").cast("string").alias("query_id"), F.transform(item, lambda x: x + 0.1).alias("embedding"))
    found = vectors.nearest(many, items, k=3)
    planned = sum(map(len, rows))
    assert planned == 0
    index = cells.build(items)
    built = sum(map(len, rows))
    assert built <= 3000 + 2 * cells.SAMPLE + 10_000
    indexed = index.nearest(many.limit(1000), k=3)
    assert sum(map(len, rows)) == built
    some = "query_id % 5000 = 0"
    assert as_lists(found.where(some)) == as_lists(vectors.nearest(many.where(some), items, k=3))
    assert indexed.columns == found.columns


def test_a_block_of_items_takes_bounded_memory():
    """Scores of 256 queries against 40,000 items would be 82 MB a copy."""
    rng = np.random.default_rng(3)
    queries, items = rng.standard_normal((256, 8)), rng.standard_normal((40_000, 8))
    ids = np.array([f"i{i:05d}" for i in range(len(items))], dtype=object)
    hits = vectors.Hits(3)
    tracemalloc.start()
    hits.add(queries, ids, items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    units = np.rint(queries @ items.T * 10**6).astype(np.int64)
    best = np.argsort(-units, axis=1, kind="stable")[:, :3]
    assert hits.items.reshape(-1, 3).tolist() == ids[best].tolist()
    q, item = np.arange(200_000) % 256, np.arange(200_000) % 40_000
    assert cells._pair_scores(queries, items, q, item).tolist() == units[q, item].tolist()

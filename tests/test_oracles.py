"""Every registered query on the smallest test data: its plan, and its rows against its SQL."""

import re

import pytest

from ledgerlake.plans.catalog import ORACLES, QUERIES
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
PYTHON = {"bm25_topk", "vector_topk", "vector_topk_lsh", "hybrid_rrf", "retriever_compare", "policy_lookup"}
PYTHON |= {"vector_cells_exact", "vector_cells_recall", "bm25_incremental", "knowledge_base_replace", "request_dispatch_mixed"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    check_plan(name, frame._jdf.queryExecution().executedPlan().toString())
    _, found = differences(frame, duck, ORACLES.get(name))
    assert found == []


def check_plan(name, plan):
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    python = re.search(r"(MapInArrow|MapInPandas|EvalPython|FlatMapCoGroups|FlatMapGroups)", plan)
    assert python is None or name in PYTHON
    for line in plan.splitlines():
        # windows are always partitioned, never one task for the whole table
        if " Window [" in line:
            assert not re.search(r"\], \[\], \[", line), line


def test_only_the_approximate_query_lacks_sql():
    assert set(QUERIES) - set(ORACLES) == {"vector_topk_lsh"}


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

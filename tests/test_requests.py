import datetime as dt

import pytest

from ledgerlake.operators import requests, spending

ACCOUNTS = [
    ("ACC-1", "CUST-1", "checking", 563_575, "USD", "active"),
    ("ACC-2", "CUST-1", "savings", -50, "USD", "frozen"),
]
TRANSACTIONS = [
    ("T-1", "ACC-1", 1, -8_523, "Market", "groceries"),
    ("T-2", "ACC-1", 2, -3_210, None, "groceries"),
    ("T-3", "ACC-1", 2, -999, "Diner", "dining"),
    ("T-4", "ACC-1", 3, 200_000, "Employer", "income"),
    ("T-5", "ACC-1", 4, -4_000, "Pump", "gas"),
    ("T-6", "ACC-3", 4, -1, "Nobody", "gas"),
]


@pytest.fixture
def accounts(spark):
    return spark.createDataFrame(
        ACCOUNTS, "account_id string, customer_id string, account_type string, balance_cents long, currency string, status string"
    )


@pytest.fixture
def transactions(spark):
    data = [(i, a, dt.datetime(2026, 6, day), c, m, k, "posted") for i, a, day, c, m, k in TRANSACTIONS]
    return spark.createDataFrame(
        data, "transaction_id string, account_id string, timestamp timestamp_ntz, amount_cents long, merchant string, category string, status string"
    )


def test_balance(spark, accounts, rows):
    asked = spark.createDataFrame(
        [(1, "ACC-1"), (2, "ACC-99"), (3, None), (4, "")], "request_id int, account_id string"
    )
    found = requests.balance_lookup(asked, accounts)
    assert rows(found, "request_id", "error", "details", "balance_dollars", "account_type") == [
        (1, None, [], 5635.75, "checking"),
        (2, "account_not_found", [], None, None),
        (3, "invalid_arguments", ["account_id"], None, None),
        (4, "invalid_arguments", ["account_id"], None, None),
    ]


def test_recent(spark, accounts, transactions):
    asked = spark.createDataFrame(
        [(1, "ACC-1", 3), (2, "ACC-1", None), (3, "ACC-1", 9999), (4, "ACC-1", 0), (5, "ACC-2", 5), (6, "ACC-3", 5)],
        "request_id int, account_id string, limit int",
    )
    found = {r["request_id"]: r for r in requests.recent_transactions(asked, accounts, transactions).collect()}
    assert [t["transaction_id"] for t in found[1]["transactions"]] == ["T-5", "T-4", "T-2"]  # tie: smaller id first
    assert found[2]["limit"] == 10 and found[2]["count"] == 5
    assert found[3]["error"] == "invalid_arguments" and found[3]["details"] == ["limit"]
    assert found[4]["error"] == "invalid_arguments" and found[4]["transactions"] is None
    assert found[5]["error"] is None and found[5]["count"] == 0
    assert found[6]["error"] == "account_not_found"
    assert found[1]["transactions"][2]["amount_dollars"] == -32.1


def test_category_total_covers_returned_rows_only(spark, accounts, transactions):
    asked = spark.createDataFrame(
        [(1, "ACC-1", "groceries", None), (2, "ACC-1", "groceries", 1), (3, "ACC-1", "not_a_category", 5),
         (4, "ACC-9", "gas", 5), (5, "ACC-1", "", 5), (6, "ACC-1", "gas", 101)],
        "request_id int, account_id string, category string, limit int",
    )
    found = {r["request_id"]: r for r in requests.category_spend(asked, accounts, transactions).collect()}
    assert (found[1]["count"], found[1]["total_dollars"]) == (2, -117.33)
    assert (found[2]["count"], found[2]["total_dollars"]) == (1, -32.1)
    assert (found[3]["error"], found[3]["count"], found[3]["total_dollars"]) == (None, 0, 0.0)
    assert found[4]["error"] == "account_not_found" and found[4]["total_dollars"] is None
    assert found[5]["details"] == ["category"] and found[6]["details"] == ["limit"]


def test_full_spend_ignores_the_limit(transactions, rows):
    found = spending.category_spend_full(transactions).filter("account_id = 'ACC-1' and category = 'groceries'")
    assert rows(found, "n", "total_cents", "total_dollars") == [(2, -11_733, -117.33)]


def test_many_requests_for_one_account(spark, accounts, transactions):
    asked = spark.range(2000).selectExpr("id as request_id", "'ACC-1' as account_id", "cast(1 + id % 50 as int) as limit")
    found = requests.recent_transactions(asked, accounts, transactions)
    assert found.count() == 2000
    assert found.filter("`count` <> least(limit, 5)").count() == 0


def test_policy_lookup_and_dispatch(spark, accounts, transactions, rows):
    ranked = spark.createDataFrame(
        [("q1", 1, "fees", "Wire", "text one", 0.03125), ("q1", 2, "fees", "Card", "text two", 0.02)],
        "query_id string, rank int, document_name string, section_title string, content string, score double",
    )

    def retrieve(queries):
        return queries.join(ranked, "query_id").drop("query")

    asked = spark.createDataFrame(
        [("q1", "wire fee", 1), ("q2", "nothing here", None), ("q3", "ab", 3), ("q4", "wire", 6), ("q5", "x" * 501, 3)],
        "request_id string, query string, max_results int",
    )
    found = {r["request_id"]: r for r in requests.policy_lookup(asked, retrieve).collect()}
    assert [(x["document"], x["relevance_score"]) for x in found["q1"]["results"]] == [("fees", 0.0312)]
    assert found["q2"]["results"] == [] and found["q2"]["message"].startswith("No relevant")
    assert found["q2"]["max_results"] == 3
    assert [found[q]["details"] for q in ("q3", "q4", "q5")] == [["query"], ["max_results"], ["query"]]

    mixed = spark.createDataFrame(
        [("q1", "lookup_policy", None, None, None, "wire fee", 2), ("b", "get_account_balance", "ACC-1", None, None, None, None),
         ("r", "search_transactions", "ACC-1", 2, None, None, None),
         ("c", "search_transactions_by_category", "ACC-1", 5, "gas", None, None),
         ("u", "nonexistent_tool", None, None, None, None, None), ("n", None, None, None, None, None, None)],
        "request_id string, tool_name string, account_id string, limit int, category string, query string, max_results int",
    )
    found = requests.dispatch(mixed, accounts, transactions, retrieve)
    assert rows(found, "request_id", "error", "result_count", "amount_dollars") == [
        ("b", None, None, 5635.75), ("c", None, 1, -40.0), ("n", "unknown_tool", None, None),
        ("q1", None, 2, None), ("r", None, 2, None), ("u", "unknown_tool", None, None),
    ]


def test_accounts_by_customer_is_ordered(spark, accounts):
    customers = spark.createDataFrame([("CUST-1",), ("CUST-2",)], "customer_id string")
    dated = accounts.selectExpr("*", "date'2020-01-01' as opened_date")
    assert [r["account_id"] for r in requests.accounts_by_customer(customers, dated).collect()] == ["ACC-1", "ACC-2"]

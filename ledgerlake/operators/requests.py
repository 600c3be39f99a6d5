"""Bulk request operators: a table of requests in, one answer row per request out.

Bad requests become rows with ``error`` and ``details``; nothing throws. Transactions are first cut
to the largest list a request may ask for, which is exact because limits are validated, and only
those short lists meet the requests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.functions.money import dollars
from ledgerlake.operators.quality import broken_rules
from ledgerlake.operators.skew import keep_asked
from ledgerlake.operators.spending import latest_as_list

# Defaults and allowed ranges of the request arguments.
RECENT_DEFAULT, RECENT_MAX = 10, 50
CATEGORY_DEFAULT, CATEGORY_MAX = 20, 100
POLICY_DEFAULT, POLICY_MAX = 3, 5
QUERY_MIN_CHARS, QUERY_MAX_CHARS = 3, 500

BALANCE_TOOL = "get_account_balance"
RECENT_TOOL = "search_transactions"
CATEGORY_TOOL = "search_transactions_by_category"
POLICY_TOOL = "lookup_policy"


def _empty(name: str) -> Column:
    return F.coalesce(F.length(name), F.lit(0)) < 1


def _outside(value: Column, low: int, high: int) -> Column:
    return ~value.between(low, high)


def validate(requests: DataFrame, tool: str) -> DataFrame:
    """Fill defaults and add ``details``, the names of the broken argument rules."""
    rules = {"account_id": _empty("account_id")} if tool != POLICY_TOOL else {}
    if tool == RECENT_TOOL:
        requests = requests.withColumn("limit", F.coalesce("limit", F.lit(RECENT_DEFAULT)))
        rules["limit"] = _outside(F.col("limit"), 1, RECENT_MAX)
    elif tool == CATEGORY_TOOL:
        requests = requests.withColumn("limit", F.coalesce("limit", F.lit(CATEGORY_DEFAULT)))
        rules["category"] = _empty("category")
        rules["limit"] = _outside(F.col("limit"), 1, CATEGORY_MAX)
    elif tool == POLICY_TOOL:
        requests = requests.withColumn("max_results", F.coalesce("max_results", F.lit(POLICY_DEFAULT)))
        rules["query"] = _outside(F.coalesce(F.length("query"), F.lit(0)), QUERY_MIN_CHARS, QUERY_MAX_CHARS)
        rules["max_results"] = _outside(F.col("max_results"), 1, POLICY_MAX)
    return requests.withColumn("details", broken_rules(rules))


def _error(found: Column) -> Column:
    return F.when(F.size("details") > 0, "invalid_arguments").when(found.isNull(), "account_not_found")


def _good(value: Column) -> Column:
    return F.when(F.col("error").isNull(), value)


def balance_lookup(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """request_id, account_id -> account type, balance, currency and status, or an error."""
    checked = validate(requests, BALANCE_TOOL)
    wanted = accounts.select(
        "account_id", "account_type", dollars(F.col("balance_cents")).alias("balance_dollars"),
        "currency", "status", F.lit(True).alias("found"),
    )
    answer = checked.join(keep_asked(wanted, checked, "account_id"), "account_id", "left").withColumn(
        "error", _error(F.col("found"))
    )
    return answer.select(
        "request_id", "account_id", "error", "details",
        *[_good(F.col(c)).alias(c) for c in ("account_type", "balance_dollars", "currency", "status")],
    )


def recent_transactions(requests: DataFrame, accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """request_id, account_id, limit -> count and the newest transactions, or an error."""
    checked = validate(requests, RECENT_TOOL)
    lists = latest_as_list(
        keep_asked(transactions, checked, "account_id"),
        ["account_id"], "timestamp", "transaction_id", RECENT_MAX,
        ["transaction_id", "timestamp", dollars(F.col("amount_cents")).alias("amount_dollars"),
         "merchant", "category", "status"],
    )
    known = keep_asked(accounts.select("account_id", F.lit(True).alias("found")), checked, "account_id")
    book = known.join(lists, "account_id", "left")
    answer = checked.join(book, "account_id", "left").withColumn(
        "error", _error(F.col("found"))
    )
    answer = answer.withColumn("items", _good(_first_items("limit")))
    return answer.select(
        "request_id", "account_id", "limit", "error", "details",
        _good(F.size("items").cast("bigint")).alias("count"), F.col("items").alias("transactions"),
    )


def category_spend(requests: DataFrame, accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """request_id, account_id, category, limit -> count, total and items, or an error.

    The total covers the returned rows, that is after the limit. An unknown category gives zero.
    """
    checked = validate(requests, CATEGORY_TOOL)
    lists = latest_as_list(
        keep_asked(transactions, checked, "account_id"),
        ["account_id", "category"], "timestamp", "transaction_id", CATEGORY_MAX,
        ["transaction_id", "timestamp", "amount_cents",
         dollars(F.col("amount_cents")).alias("amount_dollars"), "merchant"],
    )
    known = keep_asked(accounts.select("account_id", F.lit(True).alias("found")), checked, "account_id")
    answer = checked.join(known, "account_id", "left").join(lists, ["account_id", "category"], "left")
    answer = answer.withColumn("error", _error(F.col("found"))).withColumn("items", _good(_first_items("limit")))
    total = F.aggregate("items", F.lit(0).cast("bigint"), lambda acc, item: acc + item["amount_cents"])
    return answer.select(
        "request_id", "account_id", "category", "limit", "error", "details",
        _good(F.size("items").cast("bigint")).alias("count"),
        _good(dollars(total)).alias("total_dollars"),
        F.col("items").alias("transactions"),
    )


def _first_items(limit: str) -> Column:
    """The first ``limit`` list items; an account without transactions has an empty list."""
    return F.when(
        F.col(limit) >= 1, F.coalesce(F.slice("items", F.lit(1), F.greatest(F.col(limit), F.lit(1)).cast("int")), F.array())
    )


def list_items(answers: DataFrame, *context: str) -> DataFrame:
    """The nested lists as one row per item."""
    return answers.select(*context, F.explode("transactions").alias("item")).select(*context, "item.*")


def accounts_by_customer(customers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Accounts of every customer, in account order within a customer."""
    owned = customers.select("customer_id").join(
        accounts.select("customer_id", "account_id", "account_type", "balance_cents", "currency",
                        "opened_date", "status"),
        "customer_id",
    )
    return owned.orderBy("customer_id", "account_id")


def policy_lookup(requests: DataFrame, retrieve) -> DataFrame:
    """request_id, query, max_results -> ranked excerpts, or an error.

    ``retrieve`` maps (query_id, query) rows to ranked chunks (``rank`` from 1 to the maximum).
    """
    checked = validate(requests, POLICY_TOOL)
    asked = checked.filter(F.size("details") == 0)
    ranked = retrieve(asked.select(F.col("request_id").alias("query_id"), "query"))
    item = F.struct(
        "rank", F.col("document_name").alias("document"), F.col("section_title").alias("section"),
        "content", F.bround("score", 4).alias("relevance_score"),
    )
    # at most POLICY_MAX excerpts per request
    lists = ranked.filter(F.col("rank") <= POLICY_MAX).groupBy(F.col("query_id").alias("request_id")).agg(
        F.sort_array(F.collect_list(item)).alias("items")
    )
    answer = checked.join(lists, "request_id", "left")
    invalid = F.size("details") > 0
    shown = F.coalesce(F.slice("items", F.lit(1), F.greatest("max_results", F.lit(1)).cast("int")), F.array())
    return answer.select(
        "request_id", "query", "max_results",
        F.when(invalid, "invalid_arguments").alias("error"), "details",
        F.when(~invalid, shown).alias("results"),
        F.when(~invalid & (F.size(shown) == 0), "No relevant policy information found.").alias("message"),
    )


def dispatch(requests: DataFrame, accounts: DataFrame, transactions: DataFrame, retrieve=None) -> DataFrame:
    """Route mixed requests by ``tool_name``; unknown names become ``unknown_tool`` rows."""
    def of(tool: str) -> DataFrame:
        return requests.filter(F.col("tool_name") == tool)

    def shaped(answers: DataFrame, tool: str, count: Column, amount: Column) -> DataFrame:
        body = F.struct(*[c for c in answers.columns if c != "request_id"])
        return answers.select(
            "request_id", F.lit(tool).alias("tool_name"), "error",
            count.cast("bigint").alias("result_count"), amount.cast("double").alias("amount_dollars"),
            F.to_json(body).alias("response"),
        )

    nothing = F.lit(None)
    parts = [
        shaped(balance_lookup(of(BALANCE_TOOL).select("request_id", "account_id"), accounts),
               BALANCE_TOOL, nothing, F.col("balance_dollars")),
        shaped(recent_transactions(of(RECENT_TOOL).select("request_id", "account_id", "limit"),
                                   accounts, transactions),
               RECENT_TOOL, F.col("count"), nothing),
        shaped(category_spend(of(CATEGORY_TOOL).select("request_id", "account_id", "category", "limit"),
                              accounts, transactions),
               CATEGORY_TOOL, F.col("count"), F.col("total_dollars")),
    ]
    known = [BALANCE_TOOL, RECENT_TOOL, CATEGORY_TOOL, POLICY_TOOL]
    if retrieve is None:  # a known tool without its source is no unknown tool
        parts.append(
            of(POLICY_TOOL).select(
                "request_id", "tool_name", F.lit("retrieval_unavailable").alias("error"),
                nothing.cast("bigint").alias("result_count"), nothing.cast("double").alias("amount_dollars"),
                F.to_json(F.struct(F.lit("retrieval_unavailable").alias("error"))).alias("response"),
            )
        )
    else:
        parts.append(
            shaped(policy_lookup(of(POLICY_TOOL).select("request_id", "query", "max_results"), retrieve),
                   POLICY_TOOL, F.size("results"), nothing)
        )
    name = F.coalesce("tool_name", F.lit(""))
    unknown = requests.filter(~name.isin(*known)).select(
        "request_id", "tool_name", F.lit("unknown_tool").alias("error"),
        nothing.cast("bigint").alias("result_count"), nothing.cast("double").alias("amount_dollars"),
        F.to_json(F.struct(F.lit("unknown_tool").alias("error"), F.col("tool_name").alias("tool"))).alias("response"),
    )
    return reduce(DataFrame.unionByName, [*parts, unknown])

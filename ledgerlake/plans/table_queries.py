"""Silver, quality, request, version and merge queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake import schemas
from ledgerlake.operators import merge, quality, requests, silver, spending, usage
from ledgerlake.plans import standins as s
from ledgerlake.plans.registry import query
from ledgerlake.sources.buckets import BucketedTable
from ledgerlake.sources.versions import VersionedTable, version_counts, version_diff
from ledgerlake.workspace import new_folder

CUSTOMERS, ACCOUNTS, TRANSACTIONS = s.CUSTOMERS, s.ACCOUNTS, s.TRANSACTIONS
INGESTED = "TIMESTAMP '2024-06-01 00:00:00' AS ingested_at"

SILVER_CUSTOMERS = f"""silver AS (
  SELECT * REPLACE (lower(email) AS email), {INGESTED} FROM customers)"""


# silver ------------------------------------------------------------------


@query("silver_customers", s.with_(CUSTOMERS, SILVER_CUSTOMERS) + "SELECT * FROM silver")
def silver_customers(spark: SparkSession, folder: str) -> DataFrame:
    return silver.clean_customers(s.customers(spark, folder), s.AS_OF)


@query("silver_accounts", s.with_(ACCOUNTS) + f"SELECT *, {INGESTED}, balance_cents / 100 AS balance_dollars FROM accounts")
def silver_accounts(spark: SparkSession, folder: str) -> DataFrame:
    return silver.clean_accounts(s.accounts(spark, folder), s.AS_OF)


@query(
    "silver_transactions",
    s.with_(TRANSACTIONS)
    + f"""SELECT *, {INGESTED}, amount_cents / 100 AS amount_dollars,
       CAST(year(timestamp) AS INTEGER) AS year, CAST(month(timestamp) AS INTEGER) AS month FROM transactions""",
)
def silver_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return silver.clean_transactions(s.transactions(spark, folder), s.AS_OF)


def _sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "customers": s.customers(spark, folder),
        "accounts": s.accounts(spark, folder),
        "transactions": s.transactions(spark, folder),
    }


def _tables(spark: SparkSession) -> dict[str, VersionedTable]:
    root = new_folder(spark, "silver")
    return {name: VersionedTable(spark, f"{root}/{name}") for name in schemas.CONTRACTS}


_THREE = """(SELECT 'customers' AS table_name, count(*) AS n FROM customer UNION ALL
  SELECT 'accounts', count(*) FROM orders UNION ALL SELECT 'transactions', count(*) FROM lineitem)"""


@query("load_row_counts", f"SELECT table_name, n AS loaded, n AS written FROM {_THREE}")
def load_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = silver.write_all_silver(_sources(spark, folder), _tables(spark), s.AS_OF)
    return spark.createDataFrame(
        [(name, c["loaded"], c["written"]) for name, c in counts.items()],
        "table_name string, loaded bigint, written bigint",
    )


@query("silver_run_counts", f"SELECT table_name, CAST(1 AS BIGINT) AS version, n FROM {_THREE}")
def silver_run_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs in a row: the second publishes version 1 with the same rows."""
    tables = _tables(spark)
    for _ in range(2):
        silver.write_all_silver(_sources(spark, folder), tables, s.AS_OF)
    parts = [
        tables[name].read().agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("table_name"), F.lit(tables[name].current_version()).cast("bigint").alias("version"), "n"
        )
        for name in tables
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "silver_between",
    s.with_(TRANSACTIONS)
    + """SELECT transaction_id, amount_cents, CAST(year(timestamp) AS INTEGER) AS year, CAST(month(timestamp) AS INTEGER) AS month
FROM transactions WHERE timestamp >= TIMESTAMP '1996-11-15' AND timestamp < TIMESTAMP '1997-03-10'""",
)
def silver_between(spark: SparkSession, folder: str) -> DataFrame:
    target = _tables(spark)["transactions"]
    silver.write_silver("transactions", s.transactions(spark, folder), target, s.AS_OF)
    found = silver.transactions_between(target.read(), dt.datetime(1996, 11, 15), dt.datetime(1997, 3, 10))
    return found.select("transaction_id", "amount_cents", "year", "month")


@query(
    "totals_by_category",
    s.with_(TRANSACTIONS)
    + "SELECT category, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS total_cents FROM transactions GROUP BY 1",
)
def totals_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return silver.totals_by_category(s.transactions(spark, folder))


@query(
    "reference_join",
    """SELECT 'CUST-' || c_custkey AS customer_id, n_name, r_name FROM customer
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
)
def reference_join(spark: SparkSession, folder: str) -> DataFrame:
    people = s.table(spark, folder, "customer").select(
        F.concat(F.lit("CUST-"), F.col("c_custkey").cast("string")).alias("customer_id"), F.col("c_nationkey").alias("n_nationkey")
    )
    with_nation = silver.add_reference_data(people, s.table(spark, folder, "nation"), "n_nationkey")
    regions = s.table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return silver.add_reference_data(with_nation, regions, "n_regionkey").select("customer_id", "n_name", "r_name")


@query(
    "json_roundtrip",
    s.with_(ACCOUNTS) + "SELECT account_id, balance_cents, opened_date, status FROM accounts",
)
def json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    kept = s.accounts(spark, folder).select("account_id", "balance_cents", "opened_date", "status")
    encoded = kept.select(F.to_json(F.struct(*kept.columns)).alias("record"))
    return encoded.select(F.from_json("record", kept.schema).alias("r")).select("r.*")


@query(
    "accounts_in_list",
    s.with_(ACCOUNTS)
    + "SELECT account_id, balance_cents, status FROM accounts WHERE account_type IN ('checking', 'savings') AND status IN ('active', 'frozen')",
)
def accounts_in_list(spark: SparkSession, folder: str) -> DataFrame:
    chosen = F.col("account_type").isin("checking", "savings") & F.col("status").isin("active", "frozen")
    return s.accounts(spark, folder).filter(chosen).select("account_id", "balance_cents", "status")


# quality -----------------------------------------------------------------


def _raw_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Uncleaned input: unabridged state names, first names missing for overdrawn customers."""
    source = s.table(spark, folder, "customer").select(
        F.concat(F.lit("CUST-"), F.col("c_custkey").cast("string")).alias("customer_id"),
        F.col("c_mktsegment").alias("raw_state"), F.when(F.col("c_acctbal") >= 0, "Customer").alias("raw_first"),
    )
    return s.customers(spark, folder).join(source, "customer_id").withColumns(
        {"state_code": F.col("raw_state"), "first_name": F.col("raw_first")}
    ).drop("raw_state", "raw_first")


@query(
    "contract_violations",
    """SELECT 'customers' AS table_name, 'CUST-' || c_custkey AS row_key, 'state_code_too_long' AS rule
FROM customer WHERE length(c_mktsegment) > 2
UNION ALL SELECT 'customers', 'CUST-' || c_custkey, 'first_name_null' FROM customer WHERE c_acctbal < 0""",
)
def contract_violations(spark: SparkSession, folder: str) -> DataFrame:
    return quality.contract_violations(_raw_customers(spark, folder), schemas.CUSTOMERS)


@query(
    "check_violations",
    s.with_(ACCOUNTS)
    + "SELECT 'accounts' AS table_name, account_id AS row_key, 'balance_cents_minimum' AS rule FROM accounts WHERE balance_cents < -10000000",
)
def check_violations(spark: SparkSession, folder: str) -> DataFrame:
    return quality.check_violations(s.accounts(spark, folder), schemas.ACCOUNTS)


@query(
    "duplicate_keys",
    """SELECT 'transactions' AS table_name, 'transaction_id' AS key_name,
  'TXN-' || l_orderkey || '-' || l_linenumber AS key_value, count(*) AS n FROM lineitem GROUP BY 3 HAVING count(*) > 1""",
)
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    raw = s.table(spark, folder, "lineitem").select(
        F.concat_ws("-", F.lit("TXN"), "l_orderkey", "l_linenumber").alias("transaction_id")
    )
    return quality.duplicate_keys(raw, schemas.TRANSACTIONS)


@query(
    "fk_orphans",
    s.with_(ACCOUNTS, s.REQUESTS, CUSTOMERS)
    + """SELECT 'requests' AS table_name, 'account_id' AS key_name, account_id AS key_value, count(*) AS n
FROM requests WHERE account_id NOT IN (SELECT account_id FROM accounts) GROUP BY 3
UNION ALL SELECT 'accounts', 'customer_id', customer_id, count(*) FROM accounts
WHERE customer_id NOT IN (SELECT customer_id FROM customers) GROUP BY 3""",
)
def fk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    accounts = s.accounts(spark, folder)
    calls = quality.orphans(s.requests(spark, folder), "requests", "account_id", accounts, "account_id")
    owners = quality.orphans(accounts, "accounts", "customer_id", s.customers(spark, folder), "customer_id")
    return calls.unionByName(owners)


@query(
    "quarantine",
    s.with_(ACCOUNTS)
    + """SELECT account_id, CASE WHEN balance_cents < -10000000 THEN 'quarantined' ELSE 'valid' END AS outcome,
       CASE WHEN balance_cents < -10000000 THEN 'balance_cents_minimum' ELSE '' END AS reasons FROM accounts""",
)
def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    outcomes, _ = quality.write_outcomes(s.accounts(spark, folder), schemas.ACCOUNTS, new_folder(spark, "outcomes"))
    return outcomes.select("account_id", "outcome", F.array_join("reasons", ",").alias("reasons"))


@query(
    "mask_pii",
    s.with_(CUSTOMERS)
    + """SELECT sha256('pepper' || customer_id) AS customer_token, substr(first_name, 1, 1) || '***' AS first_name,
       substr(last_name, 1, 1) || '***' AS last_name, substr(email, 1, 1) || '***@Example.com' AS email,
       '***' AS address_line, state_code FROM customers""",
)
def mask_pii(spark: SparkSession, folder: str) -> DataFrame:
    return quality.mask_customers(s.customers(spark, folder), "pepper").select(
        "customer_token", "first_name", "last_name", "email", "address_line", "state_code"
    )


# requests ----------------------------------------------------------------

_RANGE = "\"limit\" BETWEEN 1 AND 50"
_CATEGORY_RANGE = "\"limit\" BETWEEN 1 AND 100"
_RECENT = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY timestamp DESC, transaction_id) AS rn FROM transactions)"""
_BY_CATEGORY = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY account_id, category ORDER BY timestamp DESC, transaction_id) AS rn
  FROM transactions)"""


@query(
    "balance_lookup",
    s.with_(ACCOUNTS, s.REQUESTS)
    + """SELECT request_id, r.account_id, CASE WHEN a.account_id IS NULL THEN 'account_not_found' END AS error,
       account_type, balance_cents / 100 AS balance_dollars, currency, status
FROM requests r LEFT JOIN accounts a USING (account_id)""",
)
def balance_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return requests.balance_lookup(
        s.requests(spark, folder).select("request_id", "account_id"), s.accounts(spark, folder)
    ).drop("details")


def _recent(spark: SparkSession, folder: str) -> DataFrame:
    return requests.recent_transactions(
        s.requests(spark, folder).select("request_id", "account_id", "limit"),
        s.accounts(spark, folder), s.transactions(spark, folder),
    )


@query(
    "recent_transactions",
    s.with_(ACCOUNTS, s.REQUESTS, TRANSACTIONS, _RECENT)
    + f"""SELECT request_id, rn AS rank, t.transaction_id, strftime(t.timestamp, '%Y-%m-%dT%H:%M:%S') AS "timestamp",
       t.amount_cents / 100 AS amount_dollars, t.merchant, t.category, t.status
FROM requests r JOIN accounts a USING (account_id) JOIN ranked t USING (account_id)
WHERE {_RANGE} AND rn <= "limit" """,
)
def recent_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return requests.list_items(_recent(spark, folder), "request_id").withColumns(
        {"timestamp": F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), "rank": F.col("rn").cast("bigint")}
    ).drop("rn")


@query(
    "recent_counts",
    s.with_(ACCOUNTS, s.REQUESTS, TRANSACTIONS, "sizes AS (SELECT account_id, count(*) AS n FROM transactions GROUP BY 1)")
    + f"""SELECT request_id, CASE WHEN NOT {_RANGE} THEN 'invalid_arguments' WHEN a.account_id IS NULL THEN 'account_not_found' END AS error,
       CASE WHEN {_RANGE} AND a.account_id IS NOT NULL THEN least("limit", coalesce(n, 0)) END AS "count"
FROM requests r LEFT JOIN accounts a USING (account_id) LEFT JOIN sizes USING (account_id)""",
)
def recent_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _recent(spark, folder).select("request_id", "error", "count")


def _spend(spark: SparkSession, folder: str) -> DataFrame:
    return requests.category_spend(
        s.requests(spark, folder).select("request_id", "account_id", "category", "limit"),
        s.accounts(spark, folder), s.transactions(spark, folder),
    )


@query(
    "recent_by_category",
    s.with_(ACCOUNTS, s.REQUESTS, TRANSACTIONS, _BY_CATEGORY)
    + f"""SELECT request_id, rn AS rank, t.timestamp, t.amount_cents / 100 AS amount_dollars, t.merchant
FROM requests r JOIN accounts a USING (account_id) JOIN ranked t ON t.account_id = r.account_id AND t.category = r.category
WHERE {_CATEGORY_RANGE} AND rn <= "limit" """,
)
def recent_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return requests.list_items(_spend(spark, folder), "request_id").select(
        "request_id", F.col("rn").cast("bigint").alias("rank"), "timestamp", "amount_dollars", "merchant"
    )


_SPEND_SQL = f"""spend AS (
  SELECT request_id, count(rn) AS n, coalesce(sum(amount_cents), 0) / 100 AS total
  FROM requests r LEFT JOIN ranked t ON t.account_id = r.account_id AND t.category = r.category AND rn <= "limit"
  GROUP BY 1)"""


@query(
    "category_spend",
    s.with_(ACCOUNTS, s.REQUESTS, TRANSACTIONS, _BY_CATEGORY, _SPEND_SQL)
    + f"""SELECT request_id, r.account_id, category,
       CASE WHEN NOT {_CATEGORY_RANGE} THEN 'invalid_arguments' WHEN a.account_id IS NULL THEN 'account_not_found' END AS error,
       CASE WHEN {_CATEGORY_RANGE} AND a.account_id IS NOT NULL THEN n END AS "count",
       CASE WHEN {_CATEGORY_RANGE} AND a.account_id IS NOT NULL THEN total END AS total_dollars
FROM requests r JOIN spend USING (request_id) LEFT JOIN accounts a ON a.account_id = r.account_id""",
)
def category_spend(spark: SparkSession, folder: str) -> DataFrame:
    return _spend(spark, folder).select("request_id", "account_id", "category", "error", "count", "total_dollars")


@query(
    "category_spend_full",
    s.with_(TRANSACTIONS)
    + """SELECT account_id, category, CAST(year(timestamp) AS INTEGER) AS year, CAST(month(timestamp) AS INTEGER) AS month,
       count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS total_cents, sum(amount_cents) / 100 AS total_dollars
FROM transactions GROUP BY ALL""",
)
def category_spend_full(spark: SparkSession, folder: str) -> DataFrame:
    return spending.category_spend_full(s.transactions(spark, folder), by_month=True)


@query(
    "accounts_by_customer",
    s.with_(CUSTOMERS, ACCOUNTS)
    + """SELECT c.customer_id, account_id, account_type, balance_cents, currency, opened_date, status
FROM customers c JOIN accounts a ON a.customer_id = c.customer_id""",
)
def accounts_by_customer(spark: SparkSession, folder: str) -> DataFrame:
    return requests.accounts_by_customer(s.customers(spark, folder), s.accounts(spark, folder))


@query(
    "request_validation",
    s.with_(s.REQUESTS)
    + f"""SELECT request_id, CASE WHEN {_RANGE} THEN '' ELSE 'limit' END AS recent_details,
       CASE WHEN {_CATEGORY_RANGE} THEN '' ELSE 'limit' END AS category_details FROM requests""",
)
def request_validation(spark: SparkSession, folder: str) -> DataFrame:
    calls = s.requests(spark, folder)
    recent = requests.validate(calls, requests.RECENT_TOOL).withColumn("recent_details", F.array_join("details", ","))
    both = requests.validate(recent, requests.CATEGORY_TOOL)
    return both.select("request_id", "recent_details", F.array_join("details", ",").alias("category_details"))


# what answers a request, and what is shown of it
DISPATCH = (
    ACCOUNTS, s.REQUESTS, TRANSACTIONS, _BY_CATEGORY, _SPEND_SQL,
            "sizes AS (SELECT account_id, count(*) AS n FROM transactions GROUP BY 1)",
            f"""answers AS (
  SELECT request_id, tool_name,
         CASE WHEN tool_name NOT IN ('get_account_balance', 'search_transactions', 'search_transactions_by_category') THEN 'unknown_tool'
              WHEN tool_name = 'search_transactions' AND NOT {_RANGE} THEN 'invalid_arguments'
              WHEN tool_name = 'search_transactions_by_category' AND NOT {_CATEGORY_RANGE} THEN 'invalid_arguments'
              WHEN a.account_id IS NULL THEN 'account_not_found' END AS error,
         "limit", sizes.n AS size, spend.n, total, balance_cents, status
  FROM requests r LEFT JOIN accounts a USING (account_id) LEFT JOIN sizes USING (account_id) JOIN spend USING (request_id))""",
)
DISPATCHED = """SELECT request_id, tool_name, error,
       CASE WHEN error IS NOT NULL THEN NULL WHEN tool_name = 'search_transactions' THEN least("limit", coalesce(size, 0))
            WHEN tool_name = 'search_transactions_by_category' THEN n END AS result_count,
       CASE WHEN error IS NOT NULL THEN NULL WHEN tool_name = 'get_account_balance' THEN balance_cents / 100
            WHEN tool_name = 'search_transactions_by_category' THEN total END AS amount_dollars """


@query("request_dispatch", s.with_(*DISPATCH) + DISPATCHED + "FROM answers")
def request_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    return requests.dispatch(
        s.requests(spark, folder), s.accounts(spark, folder), s.transactions(spark, folder)
    ).drop("response")


# usage -------------------------------------------------------------------


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return s.table(spark, folder, "events").select(
        F.col("event_id").alias("call_id"), F.col("user_id").alias("client_id"), F.col("ts").alias("called_at"),
        s.cents(F.col("value")).alias("tokens"),
    )


_LOG = "log AS (SELECT event_id AS call_id, user_id AS client_id, ts AS called_at, CAST(round(value * 100) AS BIGINT) AS tokens FROM events)"


@query(
    "usage_running_totals",
    s.with_(_LOG)
    + """SELECT *, count(*) OVER w AS calls_so_far, CAST(sum(tokens) OVER w AS BIGINT) AS tokens_so_far FROM log
WINDOW w AS (PARTITION BY client_id ORDER BY called_at, call_id ROWS UNBOUNDED PRECEDING)""",
)
def usage_running_totals(spark: SparkSession, folder: str) -> DataFrame:
    return usage.running_totals(_log(spark, folder))


@query("usage_totals", s.with_(_LOG) + "SELECT client_id, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM log GROUP BY 1")
def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    return usage.totals(_log(spark, folder))


# merge and versions ------------------------------------------------------


def _account_updates(spark: SparkSession, folder: str) -> DataFrame:
    """New balances of all accounts with transactions, and a new account per supplier."""
    moved = s.transactions(spark, folder).groupBy("account_id").agg(F.sum("amount_cents").alias("balance_cents")).select(
        "account_id", F.lit("CUST-0").alias("customer_id"), F.lit("checking").alias("account_type"), "balance_cents",
        F.lit("USD").alias("currency"), F.lit("2020-11-06").alias("opened_date"), F.lit("active").alias("status"),
    )
    opened = s.table(spark, folder, "supplier").select(
        F.concat(F.lit("SUP-"), F.col("s_suppkey").cast("string")).alias("account_id"),
        F.concat(F.lit("CUST-"), F.col("s_suppkey").cast("string")).alias("customer_id"),
        F.lit("savings").alias("account_type"), s.cents(F.col("s_acctbal")).alias("balance_cents"),
        F.lit("USD").alias("currency"), F.lit("2026-06-22").alias("opened_date"), F.lit("active").alias("status"),
    )
    return moved.unionByName(opened)


_MERGED = f"""silver AS (SELECT *, {INGESTED}, balance_cents / 100 AS balance_dollars FROM accounts),
moved AS (SELECT account_id, CAST(sum(amount_cents) AS BIGINT) AS new_cents FROM transactions GROUP BY 1),
merged AS (
  SELECT s.* REPLACE (coalesce(new_cents, balance_cents) AS balance_cents,
                      CASE WHEN new_cents IS NULL THEN status ELSE 'active' END AS status)
  FROM silver s LEFT JOIN moved USING (account_id)
  UNION ALL BY NAME
  SELECT 'SUP-' || s_suppkey AS account_id, 'CUST-' || s_suppkey AS customer_id, 'savings' AS account_type,
         CAST(round(s_acctbal * 100) AS BIGINT) AS balance_cents, 'USD' AS currency, DATE '2026-06-22' AS opened_date,
         'active' AS status FROM supplier)"""


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    return merge.merge_accounts(silver_accounts(spark, folder), _account_updates(spark, folder))


@query("merge_accounts", s.with_(ACCOUNTS, TRANSACTIONS, _MERGED) + "SELECT * FROM merged")
def merge_accounts(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder)


@query("merge_accounts_touched", s.with_(ACCOUNTS, TRANSACTIONS, _MERGED) + "SELECT * FROM merged")
def merge_accounts_touched(spark: SparkSession, folder: str) -> DataFrame:
    """The same upsert of a table in buckets, of which only those of the updates are read and written."""
    accounts = silver_accounts(spark, folder)
    table = BucketedTable(spark, new_folder(spark, "accounts"), accounts.schema, "account_id", buckets=16)
    table.overwrite(accounts)
    table.merge(_account_updates(spark, folder), merge.merge_accounts)
    return table.read()


def _customer_versions(spark: SparkSession, folder: str, until: int = 2) -> VersionedTable:
    """Version 0 all customers, 1 the first ten, 2 the restored version 0."""
    versioned = VersionedTable(spark, new_folder(spark, "customers"))
    versioned.overwrite(silver_customers(spark, folder))
    if until >= 1:
        versioned.overwrite(versioned.read(0).orderBy("customer_id").limit(10))
    if until >= 2:
        versioned.restore(0)
    return versioned


@query(
    "overwrite_subset",
    s.with_(CUSTOMERS, SILVER_CUSTOMERS) + "SELECT * FROM silver ORDER BY customer_id LIMIT 10",
)
def overwrite_subset(spark: SparkSession, folder: str) -> DataFrame:
    return _customer_versions(spark, folder, until=1).read()


@query("version_as_of", s.with_(CUSTOMERS, SILVER_CUSTOMERS) + "SELECT * FROM silver")
def version_as_of(spark: SparkSession, folder: str) -> DataFrame:
    return _customer_versions(spark, folder, until=1).read(0)


@query("version_restore", s.with_(CUSTOMERS, SILVER_CUSTOMERS) + "SELECT * FROM silver")
def version_restore(spark: SparkSession, folder: str) -> DataFrame:
    return _customer_versions(spark, folder).read()


@query(
    "version_history",
    """SELECT CAST(0 AS BIGINT) AS version, 'OVERWRITE' AS operation, count(*) AS num_rows FROM customer
UNION ALL SELECT 1, 'OVERWRITE', 10 UNION ALL SELECT 2, 'RESTORE', count(*) FROM customer""",
)
def version_history(spark: SparkSession, folder: str) -> DataFrame:
    return _customer_versions(spark, folder).history().select("version", "operation", "num_rows")


@query(
    "version_counts",
    """SELECT CAST(0 AS BIGINT) AS version, count(*) AS num_rows FROM customer
UNION ALL SELECT 1, 10 UNION ALL SELECT 2, count(*) FROM customer""",
)
def version_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return version_counts(_customer_versions(spark, folder).history())


@query(
    "version_diff",
    s.with_(ACCOUNTS, TRANSACTIONS, _MERGED)
    + """SELECT account_id, CASE WHEN o.account_id IS NULL THEN 'added' ELSE 'changed' END AS change
FROM merged m LEFT JOIN silver o USING (account_id)
WHERE o.account_id IS NULL OR o.balance_cents <> m.balance_cents OR o.status <> m.status""",
)
def accounts_diff(spark: SparkSession, folder: str) -> DataFrame:
    versioned = VersionedTable(spark, new_folder(spark, "accounts"))
    versioned.overwrite(silver_accounts(spark, folder))
    versioned.overwrite(merge.merge_accounts(versioned.read(), _account_updates(spark, folder)), operation="MERGE")
    return version_diff(versioned.read(0), versioned.read(1), "account_id")

"""Queries in which every rule fires: broken rows, tool blocks and requests derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake import schemas
from ledgerlake.functions.vectors import norm, normalize
from ledgerlake.operators import conversations, quality, requests
from ledgerlake.plans import standins as s
from ledgerlake.plans.registry import query
from ledgerlake.sources import files
from ledgerlake.workspace import new_folder

# quality -----------------------------------------------------------------


@query(
    "fk_orphans_transactions",
    s.with_(s.ACCOUNTS, s.CARD_TRANSACTIONS)
    + """SELECT 'transactions' AS table_name, 'account_id' AS key_name, account_id AS key_value, count(*) AS n
FROM card_transactions WHERE account_id NOT IN (SELECT account_id FROM accounts) GROUP BY 3""",
)
def fk_orphans_transactions(spark: SparkSession, folder: str) -> DataFrame:
    cards = s.card_transactions(s.table(spark, folder, "events"))
    return quality.orphans(cards, "transactions", "account_id", s.accounts(spark, folder), "account_id")


@query(
    "duplicate_keys_all",
    """SELECT 'customers' AS table_name, 'customer_id' AS key_name, 'CUST-' || o_custkey AS key_value, count(*) AS n
FROM orders GROUP BY 3 HAVING count(*) > 1
UNION ALL SELECT 'customers', 'email', 'c' || (o_custkey % 50) || '@example.com', count(*) FROM orders GROUP BY 3 HAVING count(*) > 1
UNION ALL SELECT 'accounts', 'account_id', 'ACC-' || l_orderkey, count(*) FROM lineitem GROUP BY 3 HAVING count(*) > 1
UNION ALL SELECT 'conversations', 'conversation_id', 'CONV-' || conv_id, count(*) FROM conversations GROUP BY 3 HAVING count(*) > 1""",
)
def duplicate_keys_all(spark: SparkSession, folder: str) -> DataFrame:
    """Customers once per order, accounts once per line, conversations once per turn."""
    orders = s.table(spark, folder, "orders")
    people = orders.select(
        F.concat(F.lit("CUST-"), F.col("o_custkey").cast("string")).alias("customer_id"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string"), F.lit("@example.com")).alias("email"),
    )
    lines = s.table(spark, folder, "lineitem").select(
        F.concat(F.lit("ACC-"), F.col("l_orderkey").cast("string")).alias("account_id")
    )
    talks = s.messages(spark, folder).select("conversation_id")
    headers = schemas.Contract(name="conversations", schema=talks.schema, primary_key="conversation_id")
    return (
        quality.duplicate_keys(people, schemas.CUSTOMERS)
        .unionByName(quality.duplicate_keys(lines, schemas.ACCOUNTS))
        .unionByName(quality.duplicate_keys(talks, headers))
    )


@query(
    "domain_violations",
    s.with_(s.ACCOUNTS, s.TRANSACTIONS)
    + """, raw_accounts AS (
  SELECT 'ACC-' || o_orderkey AS row_key, lower(o_orderpriority) LIKE '1%' AS odd_type, o_orderstatus = 'P' AS odd_status,
         o_totalprice > 100000 AS overdrawn FROM orders),
raw_transactions AS (
  SELECT 'TXN-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS row_key
  FROM lineitem WHERE l_returnflag = 'N')
SELECT 'accounts' AS table_name, row_key, 'account_type_domain' AS rule FROM raw_accounts WHERE odd_type
UNION ALL SELECT 'accounts', row_key, 'status_domain' FROM raw_accounts WHERE odd_status
UNION ALL SELECT 'accounts', row_key, 'balance_cents_minimum' FROM raw_accounts WHERE overdrawn
UNION ALL SELECT 'transactions', row_key, 'status_domain' FROM raw_transactions""",
)
def domain_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Urgent orders as accounts of an unknown type, pending ones of an unknown status, dear ones overdrawn."""
    raw = s.table(spark, folder, "orders").select(
        F.concat(F.lit("ACC-"), F.col("o_orderkey").cast("string")).alias("account_id"),
        F.when(F.col("o_orderpriority").startswith("1"), "escrow").otherwise("savings").alias("account_type"),
        F.when(F.col("o_orderstatus") == "P", "paused").otherwise("active").alias("status"),
        F.when(F.col("o_totalprice") > 100000, -20_000_000).otherwise(0).cast("long").alias("balance_cents"),
    )
    lines = s.transactions(spark, folder).withColumn(
        "status", F.when(F.col("category") == "N", "unknown").otherwise(F.col("status"))
    )
    return quality.check_violations(raw, schemas.ACCOUNTS).unionByName(
        quality.check_violations(lines, schemas.TRANSACTIONS)
    )


@query(
    "null_violations",
    """SELECT 'accounts' AS table_name, 'ACC-' || o_orderkey AS row_key, 'customer_id_null' AS rule FROM orders WHERE o_custkey % 7 = 0
UNION ALL SELECT 'accounts', 'ACC-' || o_orderkey, 'currency_too_long' FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'transactions', 'TXN-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d'),
  'category_null' FROM lineitem WHERE l_returnflag = 'A'""",
)
def null_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts without an owner or with a long currency, transactions without a category."""
    source = s.table(spark, folder, "orders").select(
        F.concat(F.lit("ACC-"), F.col("o_orderkey").cast("string")).alias("account_id"),
        (F.col("o_custkey") % 7 == 0).alias("lost"), (F.col("o_orderstatus") == "F").alias("long"),
    )
    accounts = s.accounts(spark, folder).join(source, "account_id").withColumns(
        {"customer_id": F.when(~F.col("lost"), F.col("customer_id")), "currency": F.when(F.col("long"), "DOLLAR").otherwise("USD")}
    )
    lines = s.transactions(spark, folder).withColumn("category", F.when(F.col("category") != "A", F.col("category")))
    return quality.contract_violations(accounts, schemas.ACCOUNTS).unionByName(
        quality.contract_violations(lines, schemas.TRANSACTIONS)
    )


# conversations -----------------------------------------------------------

_BLOCKS = """blocks AS (
  SELECT conversation_id, turn, role, text, role = 'assistant' AND length(text) % 3 = 0 AS asks,
         conversation_id || '-' || turn AS use_id FROM messages)"""


def _tool_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant messages whose length divides by three also ask for a tool, named by their text's length."""
    rows = s.messages(spark, folder).select("conversation_id", "turn", "role", "text")
    asks = (F.col("role") == "assistant") & (F.length("text") % 3 == 0)
    said = F.struct(F.col("text").alias("text"), F.lit(None).alias("toolUse"), F.lit(None).alias("toolResult"))
    name = F.concat(F.lit("tool"), (F.length("text") % 4).cast("string"))
    use = F.struct(
        name.alias("name"), F.lit("{}").alias("input"),
        F.concat_ws("-", "conversation_id", F.col("turn").cast("string")).alias("toolUseId"),
    )
    asked = F.struct(F.lit(None).alias("text"), use.alias("toolUse"), F.lit(None).alias("toolResult"))
    block = f"array<{conversations.BLOCK}>"
    content = F.when(asks, F.concat(F.array(said).cast(block), F.array(asked).cast(block))).otherwise(F.array(said).cast(block))
    return rows.withColumn("content", content).drop("text")


@query(
    "conversation_routing",
    s.with_(s.MESSAGES, _BLOCKS)
    + """SELECT conversation_id, turn AS last_turn, role AS last_role, CASE WHEN asks THEN 'tools' ELSE 'end' END AS next_step
FROM blocks QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) = 1""",
)
def conversation_routing(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.routing(_tool_messages(spark, folder))


_LAST_USES = """last_uses AS (
  SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) = 1)"""


@query(
    "tool_uses",
    s.with_(s.MESSAGES, _BLOCKS, _LAST_USES)
    + """SELECT conversation_id, 'tool' || (length(text) % 4) AS name, '{}' AS input, use_id AS "toolUseId" FROM last_uses WHERE asks""",
)
def tool_uses(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.last_tool_uses(_tool_messages(spark, folder))


@query(
    "tool_results",
    s.with_(s.MESSAGES, _BLOCKS, _LAST_USES)
    + """SELECT conversation_id, use_id AS tool_use_id, 'answer' AS content,
       CASE WHEN length(text) % 4 = 0 THEN 'error' ELSE 'success' END AS status FROM last_uses WHERE asks""",
)
def tool_results(spark: SparkSession, folder: str) -> DataFrame:
    """Answers exist for all uses, and for calls that the last message doesn't hold."""
    messages = _tool_messages(spark, folder)
    answers = s.messages(spark, folder).filter("role = 'assistant'").select(
        "conversation_id", F.concat_ws("-", "conversation_id", F.col("turn").cast("string")).alias("toolUseId"),
        F.lit("answer").alias("content"), F.when(F.length("text") % 4 == 0, "unknown_tool").alias("error"),
    )
    paired = conversations.tool_results(conversations.last_tool_uses(messages), answers)
    return paired.select(
        "conversation_id", F.col("toolResult.toolUseId").alias("tool_use_id"), "toolResult.content", "toolResult.status"
    )


@query(
    "display_text",
    s.with_(s.MESSAGES) + """SELECT conversation_id, turn, role, CAST(0 AS INTEGER) AS block_no, text FROM messages""",
)
def display_text(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.display_text(_tool_messages(spark, folder))


@query(
    "conversation_append",
    s.with_(s.MESSAGES)
    + """, last AS (SELECT conversation_id, max(turn) AS last_turn FROM messages GROUP BY 1)
SELECT conversation_id, turn, role, text FROM messages
UNION ALL SELECT conversation_id, last_turn + 1, 'user', 'again' FROM last
UNION ALL SELECT conversation_id, last_turn + 2, 'assistant', 'yes' FROM last""",
)
def conversation_append(spark: SparkSession, folder: str) -> DataFrame:
    """Two more messages for every conversation."""
    messages = s.messages(spark, folder).select("conversation_id", "turn", "role", "text")
    ids = messages.select("conversation_id").distinct()
    new = ids.select("conversation_id", F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("position"), F.lit("user").alias("role"), F.lit("again").alias("text")),
        F.struct(F.lit(1).cast("long").alias("position"), F.lit("assistant").alias("role"), F.lit("yes").alias("text")),
    )))
    return conversations.append(messages.withColumn("turn", F.col("turn").cast("long")), new).withColumn(
        "turn", F.col("turn").cast(messages.schema["turn"].dataType)
    )


# requests ----------------------------------------------------------------


@query(
    "policy_validation",
    """SELECT item_id AS request_id, CASE WHEN length(q) BETWEEN 3 AND 500 THEN '' ELSE 'query' END
    || CASE WHEN length(q) NOT BETWEEN 3 AND 500 AND m NOT BETWEEN 1 AND 5 THEN ',' ELSE '' END
    || CASE WHEN m BETWEEN 1 AND 5 THEN '' ELSE 'max_results' END AS details, m AS max_results
FROM (SELECT item_id, CASE item_id % 4 WHEN 0 THEN left(text, 2) WHEN 1 THEN repeat(text, 9) ELSE text END AS q,
             CASE WHEN item_id % 7 = 0 THEN 3 ELSE item_id % 7 END AS m FROM benchmark)""",
)
def policy_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Queries too short and too long, numbers of results missing and out of range."""
    items = s.table(spark, folder, "benchmark")
    text = F.when(F.col("item_id") % 4 == 0, F.left("text", F.lit(2))).when(F.col("item_id") % 4 == 1, F.repeat("text", 9))
    asked = items.select(
        F.col("item_id").alias("request_id"), text.otherwise(F.col("text")).alias("query"),
        F.when(F.col("item_id") % 7 != 0, F.col("item_id") % 7).alias("max_results"),
    )
    return requests.validate(asked, requests.POLICY_TOOL).select(
        "request_id", F.array_join("details", ",").alias("details"), F.col("max_results").cast("long").alias("max_results")
    )


@query(
    "account_validation",
    s.with_(s.REQUESTS)
    + """SELECT request_id, CASE WHEN "limit" % 5 = 0 THEN 'account_id' ELSE '' END AS balance_details,
       array_to_string(list_filter([CASE WHEN "limit" % 5 = 0 THEN 'account_id' END, CASE WHEN "limit" % 3 = 0 THEN 'category' END,
         CASE WHEN "limit" NOT BETWEEN 1 AND 100 THEN 'limit' END], lambda x: x IS NOT NULL), ',') AS category_details FROM requests""",
)
def account_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Ids missing or empty, categories empty, limits out of range."""
    calls = s.requests(spark, folder).withColumns(
        {
            "account_id": F.when(F.col("limit") % 10 == 0, F.lit("")).when(F.col("limit") % 5 != 0, F.col("account_id")),
            "category": F.when(F.col("limit") % 3 == 0, F.lit("")).otherwise(F.col("category")),
        }
    )
    checked = requests.validate(calls, requests.BALANCE_TOOL).withColumn("balance_details", F.array_join("details", ","))
    return requests.validate(checked, requests.CATEGORY_TOOL).select(
        "request_id", "balance_details", F.array_join("details", ",").alias("category_details")
    )


# vectors and files -------------------------------------------------------


@query(
    "embedding_unit_norms",
    """SELECT vec_id, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM (
  SELECT vec_id, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings)""",
)
def embedding_unit_norms(spark: SparkSession, folder: str) -> DataFrame:
    unit = normalize(F.col("embedding"))
    return s.table(spark, folder, "embeddings").select("vec_id", F.round(norm(unit), 9).alias("norm"))


@query("change_feed_files", s.with_(s.CUSTOMERS, s.CHANGES) + "SELECT * FROM changes")
def change_feed_files(spark: SparkSession, folder: str) -> DataFrame:
    """The change feed, written as CSV and read again under its schema."""
    path = new_folder(spark, "change-feed")
    files.write_changes(s.changes(spark, folder), path)
    return files.read_changes(spark, path)

"""Banking tables derived from the given tables, in Spark and as SQL common table expressions.

customer -> customers, orders -> accounts, lineitem -> transactions, events -> change feed, requests
and card transactions, documents and pages -> knowledge base, conversations -> messages.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlake.functions.money import cents
from ledgerlake.functions.text import WHITESPACE
from ledgerlake.operators.generators import STATES

AS_OF = dt.datetime(2024, 6, 1)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _id(prefix: str, column: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(column) if isinstance(column, str) else column).cast("string"))


# customers ---------------------------------------------------------------


def customers(spark: SparkSession, folder: str) -> DataFrame:
    enrolled = F.date_add(F.lit("2015-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int"))
    return table(spark, folder, "customer").select(
        _id("CUST-", "c_custkey").alias("customer_id"),
        F.lit("Customer").alias("first_name"), F.col("c_name").alias("last_name"),
        F.concat("c_name", F.lit("@Example.com")).alias("email"),
        enrolled.alias("enrollment_date"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit(" Main Street")).alias("address_line"),
        F.substring("c_mktsegment", 1, 2).alias("state_code"),
        F.when(F.col("c_acctbal") < 0, "HIGH").when(F.col("c_acctbal") < 3000, "MEDIUM").otherwise("LOW").alias("risk_rating"),
        enrolled.cast("timestamp_ntz").alias("created_at"), _ntz("2024-01-01 00:00:00").alias("updated_at"),
    )


CUSTOMERS = """customers AS (
  SELECT 'CUST-' || c_custkey AS customer_id, 'Customer' AS first_name, c_name AS last_name,
         c_name || '@Example.com' AS email,
         (DATE '2015-01-01' + CAST(c_custkey % 3000 AS INTEGER))::DATE AS enrollment_date,
         c_nationkey || ' Main Street' AS address_line, substr(c_mktsegment, 1, 2) AS state_code,
         CASE WHEN c_acctbal < 0 THEN 'HIGH' WHEN c_acctbal < 3000 THEN 'MEDIUM' ELSE 'LOW' END AS risk_rating,
         (DATE '2015-01-01' + CAST(c_custkey % 3000 AS INTEGER))::TIMESTAMP AS created_at,
         TIMESTAMP '2024-01-01 00:00:00' AS updated_at
  FROM customer)"""


# accounts ----------------------------------------------------------------


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    kind = (
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "checking")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "credit_card").otherwise("savings")
    )
    balance = cents(F.col("o_totalprice"))
    return table(spark, folder, "orders").select(
        _id("ACC-", "o_orderkey").alias("account_id"), _id("CUST-", "o_custkey").alias("customer_id"),
        kind.alias("account_type"), F.when(kind == "credit_card", -balance).otherwise(balance).alias("balance_cents"),
        F.lit("USD").alias("currency"), F.col("o_orderdate").cast("date").alias("opened_date"),
        F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "frozen")
        .otherwise("closed").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
    )


_KIND = """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'checking'
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'credit_card' ELSE 'savings' END"""

ACCOUNTS = f"""accounts AS (
  SELECT 'ACC-' || o_orderkey AS account_id, 'CUST-' || o_custkey AS customer_id, {_KIND} AS account_type,
         CASE WHEN {_KIND} = 'credit_card' THEN -1 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS balance_cents,
         'USD' AS currency, CAST(o_orderdate AS DATE) AS opened_date,
         CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'frozen' ELSE 'closed' END AS status,
         o_orderdate AS created_at, o_orderdate AS updated_at
  FROM orders)"""


# transactions ------------------------------------------------------------


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    amount = cents(F.col("l_extendedprice"))
    return table(spark, folder, "lineitem").select(
        F.concat_ws(
            "-", F.lit("TXN"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")
        ).alias("transaction_id"),
        _id("ACC-", "l_orderkey").alias("account_id"), F.col("l_shipdate").alias("timestamp"),
        F.when(F.col("l_linestatus") == "F", -amount).otherwise(amount).alias("amount_cents"),
        _id("Merchant ", "l_suppkey").alias("merchant"), F.col("l_returnflag").alias("category"),
        F.when(F.col("l_returnflag") == "R", "reversed").when(F.col("l_linestatus") == "O", "pending")
        .otherwise("posted").alias("status"),
        F.col("l_shipdate").alias("created_at"),
    )


TRANSACTIONS = """transactions AS (
  SELECT 'TXN-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
           || strftime(l_shipdate, '%Y%m%d') AS transaction_id,
         'ACC-' || l_orderkey AS account_id, l_shipdate AS timestamp,
         CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END * CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents,
         'Merchant ' || l_suppkey AS merchant, l_returnflag AS category,
         CASE WHEN l_returnflag = 'R' THEN 'reversed' WHEN l_linestatus = 'O' THEN 'pending' ELSE 'posted' END AS status,
         l_shipdate AS created_at
  FROM lineitem)"""


def card_transactions(events: DataFrame) -> DataFrame:
    """Works on the events table, read or streamed."""
    return events.select(
        _id("EVT-", "event_id").alias("transaction_id"), _id("ACC-", "user_id").alias("account_id"),
        F.col("ts").alias("timestamp"), cents(F.col("value")).alias("amount_cents"),
        F.col("event_type").alias("merchant"), F.col("event_type").alias("category"),
        F.lit("posted").alias("status"), F.col("ts").alias("created_at"),
    )


CARD_TRANSACTIONS = """card_transactions AS (
  SELECT 'EVT-' || event_id AS transaction_id, 'ACC-' || user_id AS account_id, ts AS timestamp,
         CAST(round(value * 100) AS BIGINT) AS amount_cents, event_type AS merchant, event_type AS category,
         'posted' AS status, ts AS created_at
  FROM events)"""


# requests ----------------------------------------------------------------

_TOOLS = {"click": "get_account_balance", "view": "search_transactions", "purchase": "search_transactions_by_category"}


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a tool call; ``limit`` runs from 0 to 99, so some are out of range."""
    tool = F.col("event_type")
    for event_type, name in _TOOLS.items():
        tool = F.when(F.col("event_type") == event_type, name).otherwise(tool)
    return table(spark, folder, "events").select(
        F.col("event_id").alias("request_id"), tool.alias("tool_name"),
        _id("ACC-", cents(F.col("value"))).alias("account_id"), _k().alias("limit"),
        F.when(_k() < 30, "A").when(_k() < 60, "N").when(_k() < 90, "R").otherwise("none").alias("category"),
    )


_K_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

REQUESTS = f"""requests AS (
  SELECT event_id AS request_id,
         CASE event_type WHEN 'click' THEN 'get_account_balance' WHEN 'view' THEN 'search_transactions'
                         WHEN 'purchase' THEN 'search_transactions_by_category' ELSE event_type END AS tool_name,
         'ACC-' || CAST(round(value * 100) AS BIGINT) AS account_id, {_K_SQL} AS "limit",
         CASE WHEN {_K_SQL} < 30 THEN 'A' WHEN {_K_SQL} < 60 THEN 'N' WHEN {_K_SQL} < 90 THEN 'R' ELSE 'none' END AS category
  FROM events)"""


# change feed -------------------------------------------------------------


def changes_from(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Clicks move a customer, errors re-rate one; the other part is copied from the snapshot."""
    states = F.array(*[F.lit(s) for s in STATES])
    moved = F.col("event_type") == "click"
    rated = F.when(F.col("value") < 10, "LOW").when(F.col("value") < 50, "MEDIUM").otherwise("HIGH")
    kept = snapshot.select("customer_id", "address_line", "state_code", "risk_rating")
    feed = events.filter(F.col("event_type").isin("click", "error")).withColumn("customer_id", _id("CUST-", "user_id"))
    return feed.join(kept, "customer_id").select(
        "customer_id", F.col("ts").alias("change_timestamp"),
        F.when(moved, F.concat(_k().cast("string"), F.lit(" Elm Street"))).otherwise(F.col("address_line")).alias("address_line"),
        F.when(moved, F.element_at(states, (_k() % 10 + 1).cast("int"))).otherwise(F.col("state_code")).alias("state_code"),
        F.when(moved, F.col("risk_rating")).otherwise(rated).alias("risk_rating"),
        F.when(moved, "ADDRESS").otherwise("RISK_RATING").alias("change_type"),
    )


def changes(spark: SparkSession, folder: str) -> DataFrame:
    return changes_from(table(spark, folder, "events"), customers(spark, folder))


CHANGES = f"""changes AS (
  SELECT c.customer_id, e.ts AS change_timestamp,
         CASE WHEN event_type = 'click' THEN {_K_SQL} || ' Elm Street' ELSE c.address_line END AS address_line,
         CASE WHEN event_type = 'click' THEN list_extract({STATES!r}, ({_K_SQL} % 10 + 1)) ELSE c.state_code END AS state_code,
         CASE WHEN event_type = 'click' THEN c.risk_rating WHEN value < 10 THEN 'LOW' WHEN value < 50 THEN 'MEDIUM'
              ELSE 'HIGH' END AS risk_rating,
         CASE WHEN event_type = 'click' THEN 'ADDRESS' ELSE 'RISK_RATING' END AS change_type
  FROM events e JOIN customers c ON c.customer_id = 'CUST-' || e.user_id
  WHERE event_type IN ('click', 'error'))"""


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").filter("event_type = 'purchase'").select(
        "event_id", _id("CUST-", "user_id").alias("customer_id"), F.col("ts").alias("approved_at"),
        cents(F.col("value")).alias("amount_cents"),
    )


PURCHASES = """purchases AS (
  SELECT event_id, 'CUST-' || user_id AS customer_id, ts AS approved_at, CAST(round(value * 100) AS BIGINT) AS amount_cents
  FROM events WHERE event_type = 'purchase')"""


# conversations -----------------------------------------------------------


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        _id("CONV-", "conv_id").alias("conversation_id"),
        _id("CUST-", F.floor(F.col("conv_id") / 20)).alias("customer_id"), "turn", "role", "text",
    )


MESSAGES = """messages AS (
  SELECT 'CONV-' || conv_id AS conversation_id, 'CUST-' || (conv_id // 20) AS customer_id, turn, role, text
  FROM conversations)"""


# texts -------------------------------------------------------------------


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of a document becomes a paragraph."""
    return table(spark, folder, "documents").select(
        _id("doc-", "doc_id").alias("document_name"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")
    )


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as markdown: the first heading opens the text, paragraphs are separated by blank lines."""
    text = F.col("html")
    for pattern, replacement in _PAGE_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return table(spark, folder, "pages").select(_id("page-", "page_id").alias("document_name"), text.alias("text"))


_PAGE_RULES = [(r"(?s)^.*?<h1>", "# "), ("</h1>", "\n"), ("<p>", "\n\n"), ("<[^>]*>", "")]


def conversation_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation as a markdown document with a section per turn."""
    section = F.concat(
        F.lit("## "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n")
    )
    listed = F.sort_array(F.collect_list(F.struct("turn", section.alias("section"))))
    body = F.array_join(F.transform(listed, lambda item: item["section"]), "")
    return table(spark, folder, "conversations").groupBy("conv_id").agg(body.alias("body")).select(
        _id("conv-", "conv_id").alias("document_name"),
        F.concat(F.lit("# conv "), F.col("conv_id").cast("string"), F.lit("\n"), F.col("body")).alias("text"),
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_WS = "'" + WHITESPACE + "'"
_PARTS = rf"list_filter(list_transform(regexp_split_to_array(body, '\n\s*\n'), lambda x: trim(x, {_WS})), lambda x: x <> '')"


def chunk_sql(source: str, name: str = "chunks") -> str:
    """Chunks of ``source`` (document_name, text), whose texts have no second-level headings."""
    return rf"""{name}_sections AS (
  SELECT document_name, 0 AS section_index, starts_with(t, '# ') AS titled, t,
         CASE WHEN contains(t, chr(10)) THEN substr(t, 1, strpos(t, chr(10)) - 1) ELSE t END AS first_line,
         CASE WHEN contains(t, chr(10)) THEN substr(t, strpos(t, chr(10)) + 1) ELSE '' END AS rest
  FROM (SELECT document_name, trim(text, {_WS}) AS t FROM {source}) WHERE t <> ''),
{name}_bodies AS (
  SELECT document_name, section_index,
         CASE WHEN titled THEN trim(ltrim(first_line, '#'), {_WS}) ELSE 'Introduction' END AS section_title,
         CASE WHEN titled THEN trim(rest, {_WS}) ELSE t END AS body
  FROM {name}_sections),
{name}_packed AS (
  SELECT document_name, section_index, section_title, body, length(body) > 1500 AS long,
         list_reduce({_PARTS}, lambda a, x:
           CASE WHEN a.cur = '' THEN {{'done': a.done, 'cur': x}}
                WHEN length(a.cur) + 2 + length(x) <= 1500 THEN {{'done': a.done, 'cur': a.cur || chr(10) || chr(10) || x}}
                ELSE {{'done': list_append(a.done, a.cur), 'cur': x}} END,
           {{'done': []::VARCHAR[], 'cur': ''}}) AS packed
  FROM {name}_bodies WHERE length(body) >= 50),
{name} AS (
  SELECT document_name || '#' || section_index || CASE WHEN long THEN '.' || (i - 1) ELSE '' END AS chunk_id,
         document_name, section_index, CASE WHEN long THEN i - 1 ELSE -1 END AS sub_index, section_title,
         CASE WHEN long THEN list_extract(texts, i) ELSE body END AS content
  FROM (SELECT *, unnest(generate_series(1, CASE WHEN long THEN len(texts) ELSE 1 END)) AS i
        FROM (SELECT *, list_append(packed.done, packed.cur) AS texts FROM {name}_packed)))"""


DOCUMENTS = """docs AS (
  SELECT 'doc-' || doc_id AS document_name, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)"""
DOCUMENT_CHUNKS = DOCUMENTS + ",\n" + chunk_sql("docs")


def _page_sql() -> str:
    text = "html"
    for pattern, replacement in _PAGE_RULES:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return f"page_texts AS (SELECT 'page-' || page_id AS document_name, {text} AS text FROM pages)"


PAGE_CHUNKS = _page_sql() + ",\n" + chunk_sql("page_texts")


def tokens_sql(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 1)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"

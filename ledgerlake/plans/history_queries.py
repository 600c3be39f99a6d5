"""Customer history, point-in-time, conversation, generator and streaming queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.operators import conversations, generators, pit, scd2
from ledgerlake.operators import silver
from ledgerlake.plans import standins as s
from ledgerlake.plans.registry import query
from ledgerlake.sources.buckets import BucketedTable
from ledgerlake.streaming.corrected import CorrectedSilver, CorrectedTotals
from ledgerlake.streaming.history import HistoryStream
from ledgerlake.streaming.keyed_history import KeyedHistory
from ledgerlake.streaming.tables import read_totals, silver_stream, totals_stream
from ledgerlake.workspace import new_folder

# customer history ---------------------------------------------------------

_KEY = "sha256(customer_id || '|' || epoch_us(effective_from)) AS customer_key"

_INITIAL = f"""initial AS (
  SELECT {_KEY}, * FROM (
    SELECT customer_id, address_line, state_code, risk_rating, CAST(enrollment_date AS TIMESTAMP) AS effective_from,
           CAST(NULL AS TIMESTAMP) AS effective_to, true AS is_current FROM customers))"""

_TIMELINE = """timeline AS (
  SELECT customer_id, CAST(enrollment_date AS TIMESTAMP) AS moment, address_line AS a, state_code AS st, risk_rating AS r FROM customers
  UNION ALL
  SELECT customer_id, change_timestamp, CASE WHEN change_type = 'ADDRESS' THEN changes.address_line END,
         CASE WHEN change_type = 'ADDRESS' THEN changes.state_code END, CASE WHEN change_type = 'RISK_RATING' THEN changes.risk_rating END
  FROM changes JOIN customers USING (customer_id) WHERE change_timestamp >= CAST(enrollment_date AS TIMESTAMP))"""

# events that change nothing open no version
_SEQUENCED = f"""states AS (
  SELECT customer_id, last_value(a IGNORE NULLS) OVER w AS address_line, last_value(st IGNORE NULLS) OVER w AS state_code,
         last_value(r IGNORE NULLS) OVER w AS risk_rating, moment AS effective_from
  FROM timeline WINDOW w AS (PARTITION BY customer_id ORDER BY moment ROWS UNBOUNDED PRECEDING)),
opened AS (
  SELECT * FROM states QUALIFY (address_line, state_code, risk_rating)
    IS DISTINCT FROM lag((address_line, state_code, risk_rating)) OVER (PARTITION BY customer_id ORDER BY effective_from)),
sequenced AS (
  SELECT {_KEY}, *, effective_to IS NULL AS is_current FROM (
    SELECT *, lead(effective_from) OVER (PARTITION BY customer_id ORDER BY effective_from) AS effective_to FROM opened))"""

_HISTORY = (s.CUSTOMERS, s.CHANGES, _TIMELINE, _SEQUENCED)

_FIRST = """first_changes AS (
  SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY change_timestamp, change_type) = 1)"""


@query("scd2_initial", s.with_(s.CUSTOMERS, _INITIAL) + "SELECT * FROM initial")
def scd2_initial(spark: SparkSession, folder: str) -> DataFrame:
    return scd2.initial_history(s.customers(spark, folder))


@query(
    "scd2_dedupe_changes",
    s.with_(s.CUSTOMERS, s.CHANGES)
    + """SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY change_timestamp, change_type) = 1 AS applied FROM changes""",
)
def scd2_dedupe_changes(spark: SparkSession, folder: str) -> DataFrame:
    feed = s.changes(spark, folder)
    applied = scd2.first_changes(feed).withColumn("applied", F.lit(True))
    return applied.unionByName(scd2.pending_changes(feed).withColumn("applied", F.lit(False)))


_MERGE_SQL = (
    s.with_(s.CUSTOMERS, s.CHANGES, _INITIAL, _FIRST,
            """applied AS (
  SELECT i.customer_id, f.change_timestamp AS moment, change_type, i.effective_from AS since,
         CASE WHEN change_type = 'ADDRESS' THEN f.address_line ELSE i.address_line END AS address_line,
         CASE WHEN change_type = 'ADDRESS' THEN f.state_code ELSE i.state_code END AS state_code,
         CASE WHEN change_type = 'ADDRESS' THEN i.risk_rating ELSE f.risk_rating END AS risk_rating
  FROM initial i JOIN first_changes f USING (customer_id)
  WHERE f.change_timestamp > i.effective_from AND
        CASE WHEN change_type = 'ADDRESS'
             THEN (f.address_line, f.state_code) IS DISTINCT FROM (i.address_line, i.state_code)
             ELSE f.risk_rating IS DISTINCT FROM i.risk_rating END)""")
    + f"""SELECT i.* REPLACE (a.moment AS effective_to, a.moment IS NULL AS is_current)
FROM initial i LEFT JOIN applied a USING (customer_id)
UNION ALL BY NAME
SELECT {_KEY}, customer_id, address_line, state_code, risk_rating, effective_from, CAST(NULL AS TIMESTAMP) AS effective_to, true AS is_current
FROM (SELECT *, moment AS effective_from FROM applied)"""
)


@query("scd2_merge", _MERGE_SQL)
def scd2_merge(spark: SparkSession, folder: str) -> DataFrame:
    return scd2.merge_changes(scd2.initial_history(s.customers(spark, folder)), s.changes(spark, folder))


@query("scd2_merge_touched", _MERGE_SQL)
def scd2_merge_touched(spark: SparkSession, folder: str) -> DataFrame:
    """The same merge into a history in buckets, of which only those of the changes are read and written."""
    initial = scd2.initial_history(s.customers(spark, folder))
    table = BucketedTable(spark, new_folder(spark, "history"), initial.schema, "customer_id", buckets=16)
    table.overwrite(initial)
    table.merge(s.changes(spark, folder), scd2.merge_changes)
    return table.read()


def _sequenced(spark: SparkSession, folder: str) -> DataFrame:
    return scd2.sequenced_history(s.customers(spark, folder), s.changes(spark, folder))


@query("scd2_sequenced", s.with_(*_HISTORY) + "SELECT * FROM sequenced")
def scd2_sequenced(spark: SparkSession, folder: str) -> DataFrame:
    return _sequenced(spark, folder)


@query(
    "scd2_history",
    s.with_(*_HISTORY)
    + "SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY effective_from) AS version_no FROM sequenced",
)
def scd2_history(spark: SparkSession, folder: str) -> DataFrame:
    return scd2.version_history(_sequenced(spark, folder))


@query(
    "scd2_snapshot_at",
    s.with_(*_HISTORY)
    + """SELECT * FROM sequenced WHERE effective_from <= TIMESTAMP '2024-01-15'
AND (effective_to IS NULL OR effective_to > TIMESTAMP '2024-01-15')""",
)
def scd2_snapshot_at(spark: SparkSession, folder: str) -> DataFrame:
    return scd2.snapshot_at(_sequenced(spark, folder), dt.datetime(2024, 1, 15))


@query(
    "scd2_violations",
    s.with_(*_HISTORY,
            "open_only AS (SELECT * REPLACE (CAST(NULL AS TIMESTAMP) AS effective_to, true AS is_current) FROM sequenced)",
            "following AS (SELECT *, lead(effective_from) OVER (PARTITION BY customer_id ORDER BY effective_from) AS nxt FROM open_only)")
    + """SELECT customer_id, 'overlap' AS rule, count(*) AS n FROM following WHERE nxt IS NOT NULL GROUP BY 1
UNION ALL SELECT customer_id, 'current_rows', CAST(1 AS BIGINT) FROM open_only GROUP BY 1 HAVING count(*) <> 1""",
)
def scd2_violations(spark: SparkSession, folder: str) -> DataFrame:
    """The checks on a history whose versions were never closed."""
    unclosed = _sequenced(spark, folder).withColumns(
        {"effective_to": F.lit(None).cast("timestamp_ntz"), "is_current": F.lit(True)}
    )
    return scd2.history_violations(unclosed)


@query(
    "pit_join",
    s.with_(*_HISTORY, s.PURCHASES)
    + """SELECT p.*, customer_key, address_line, state_code, risk_rating, effective_from, effective_to
FROM purchases p LEFT JOIN sequenced h ON h.customer_id = p.customer_id
 AND h.effective_from <= p.approved_at AND (h.effective_to IS NULL OR p.approved_at < h.effective_to)""",
)
def pit_join(spark: SparkSession, folder: str) -> DataFrame:
    return pit.point_in_time_join(s.purchases(spark, folder), _sequenced(spark, folder), "approved_at", "event_id")


@query(
    "asof_attributes",
    s.with_(s.CUSTOMERS, s.CHANGES, _TIMELINE, s.PURCHASES,
            "addresses AS (SELECT customer_id, moment, a, st FROM timeline WHERE a IS NOT NULL)",
            "ratings AS (SELECT customer_id, moment, r FROM timeline WHERE r IS NOT NULL)")
    + """SELECT p.*, x.a AS address_line, x.st AS state_code, y.r AS risk_rating FROM purchases p
ASOF LEFT JOIN addresses x ON x.customer_id = p.customer_id AND p.approved_at >= x.moment
ASOF LEFT JOIN ratings y ON y.customer_id = p.customer_id AND p.approved_at >= y.moment""",
)
def asof_attributes(spark: SparkSession, folder: str) -> DataFrame:
    return pit.as_of_attributes(
        s.purchases(spark, folder), s.customers(spark, folder), s.changes(spark, folder), "approved_at", "event_id"
    )


@query(
    "change_type_counts",
    s.with_(s.CUSTOMERS, s.CHANGES)
    + """SELECT count(*) AS n, count(*) FILTER (change_type = 'ADDRESS') AS n_address,
       count(*) FILTER (change_type = 'RISK_RATING') AS n_risk FROM changes""",
)
def change_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return generators.change_type_counts(s.changes(spark, folder))


# conversations ------------------------------------------------------------


def _headers(messages: DataFrame) -> DataFrame:
    """Headers with owner and times: an hour of conversation per message."""
    owners = messages.groupBy("conversation_id").agg(F.max("customer_id").alias("customer_id"))
    started = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return conversations.headers(messages, owners, started, started + F.make_dt_interval(hours=F.col("n_messages").cast("int")))


def _blocks(messages: DataFrame) -> DataFrame:
    return conversations.text_messages(messages.select("conversation_id", "turn", "role", "text"))


_DOCUMENTS = """documents_of AS (
  SELECT conversation_id, max(customer_id) AS customer_id, count(*) AS n_messages,
         TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' + to_hours(count(*)) AS updated_at,
         string_agg(role || ':' || text, chr(10) ORDER BY turn) AS transcript
  FROM messages GROUP BY 1)"""


# leaves of 64 turns, nodes of 64 children, a single child stands for itself; enough levels for 64^3 turns
_DIGESTS = """leaves AS (
  SELECT conversation_id, turn // 64 AS place, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest
  FROM messages GROUP BY ALL),
nodes AS (
  SELECT conversation_id, place // 64 AS place,
         CASE WHEN count(*) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest
  FROM leaves GROUP BY conversation_id, leaves.place // 64),
roots AS (
  SELECT conversation_id,
         CASE WHEN count(*) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest
  FROM nodes GROUP BY conversation_id)"""


@query(
    "conversation_docs",
    s.with_(s.MESSAGES, _DOCUMENTS, _DIGESTS)
    + """SELECT conversation_id, customer_id, n_messages, digest AS transcript_hash FROM documents_of JOIN roots USING (conversation_id)""",
)
def conversation_docs(spark: SparkSession, folder: str) -> DataFrame:
    messages = s.messages(spark, folder)
    line = F.concat("role", F.lit(":"), F.col("content")[0]["text"])
    digests = conversations.transcript_digests(_blocks(messages), line)
    return _headers(messages).join(digests, "conversation_id").select(
        "conversation_id", "customer_id", "n_messages", F.col("digest").alias("transcript_hash")
    )


@query(
    "conversation_get",
    s.with_(s.MESSAGES, _DOCUMENTS)
    + "SELECT conversation_id, n_messages FROM documents_of WHERE conversation_id IN (SELECT conversation_id FROM messages WHERE role = 'system')",
)
def conversation_get(spark: SparkSession, folder: str) -> DataFrame:
    messages = s.messages(spark, folder)
    ids = messages.filter("role = 'system'").select("conversation_id")
    return conversations.get(_headers(messages), ids).select("conversation_id", "n_messages")


@query(
    "conversation_recent",
    s.with_(s.MESSAGES, _DOCUMENTS)
    + """SELECT conversation_id, customer_id, n_messages, created_at, updated_at,
       row_number() OVER (PARTITION BY customer_id ORDER BY updated_at DESC, conversation_id) AS rn
FROM documents_of QUALIFY rn <= 10""",
)
def conversation_recent(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.recent(_headers(s.messages(spark, folder))).withColumn("rn", F.col("rn").cast("bigint"))


@query(
    "conversation_upsert",
    s.with_(s.MESSAGES, _DOCUMENTS,
            "stored AS (SELECT DISTINCT conversation_id FROM messages WHERE role <> 'assistant' AND conversation_id IN (SELECT conversation_id FROM messages WHERE role = 'system'))")
    + """SELECT conversation_id, customer_id, n_messages,
       CASE WHEN conversation_id IN (SELECT conversation_id FROM stored) THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-06-01' END AS created_at,
       TIMESTAMP '2024-06-01' AS updated_at FROM documents_of""",
)
def conversation_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Stored are conversations with a system message, still without answers; all are saved again."""
    messages = s.messages(spark, folder)
    guided = messages.filter("role = 'system'").select("conversation_id").distinct()
    stored = _headers(messages.filter("role <> 'assistant'").join(guided, "conversation_id", "left_semi"))
    now = F.lit(s.AS_OF.isoformat(sep=" ")).cast("timestamp_ntz")
    return conversations.upsert(stored, _headers(messages), now)


@query(
    "conversation_last_turn",
    s.with_(s.MESSAGES)
    + """SELECT conversation_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role, 'end' AS next_step
FROM messages GROUP BY 1""",
)
def conversation_last_turn(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.routing(conversations.text_messages(s.messages(spark, folder).drop("customer_id")))


@query(
    "conversation_turn_cap",
    s.with_(s.MESSAGES)
    + """SELECT conversation_id, count(*) FILTER (role = 'assistant') AS assistant_turns,
       count(*) FILTER (role = 'assistant') >= 3 AS capped FROM messages GROUP BY 1""",
)
def conversation_turn_cap(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.turn_cap(s.messages(spark, folder), cap=3)


# generators ---------------------------------------------------------------


def _draw(tag: str, *key: str) -> str:
    text = " || '|' || ".join([f"'42|{tag}'", *[f"CAST({k} AS VARCHAR)" for k in key]])
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


def _int(low, high, draw: str) -> str:
    return f"({low} + CAST(floor({draw} * ({high} - {low} + 1)) AS BIGINT))"


def _pick(options: list, draw: str) -> str:
    return f"list_extract({options!r}, CAST(floor({draw} * {len(options)}) AS INTEGER) + 1)"


def _street(tag: str, key: str) -> str:
    return f"{_int(100, 9999, _draw(tag + '-number', key))} || ' ' || {_pick(generators.STREETS, _draw(tag + '-street', key))}"


_PEOPLE = f"""people AS (
  SELECT n, 'CUST-' || (1000 + n) AS customer_id, first AS first_name, last AS last_name,
         lower(first) || '.' || lower(last) || n || '@example.com' AS email,
         CAST(DATE '2024-06-01' - CAST({_int(30, 2920, _draw('enrolled', 'n'))} AS INTEGER) AS DATE) AS enrollment_date,
         {_street('home', 'n')} AS address_line, {_pick(generators.STATES, _draw('state', 'n'))} AS state_code,
         CASE WHEN {_draw('risk', 'n')} < 0.6 THEN 'LOW' WHEN {_draw('risk', 'n')} < 0.9 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_rating
  FROM (SELECT c_custkey AS n, {_pick(generators.FIRST_NAMES, _draw('first', 'c_custkey'))} AS first,
               {_pick(generators.LAST_NAMES, _draw('last', 'c_custkey'))} AS last FROM customer))"""

_TYPES = " UNION ALL ".join(
    f"SELECT n, {_draw('type-' + kind, 'n')} AS draw, '{kind}' AS kind, {low} AS low, {high} AS high FROM people"
    for kind, (low, high) in generators.BALANCES.items()
)
_OPENED = f"""drawn AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY draw, kind) AS place FROM ({_TYPES})),
opened AS (
  SELECT number, 'ACC-' || number AS account_id, customer_id, kind AS account_type,
         low + CAST(floor({_draw('balance', 'number')} * (high - low + 1)) AS BIGINT) AS balance_cents, 'USD' AS currency,
         CAST(enrollment_date + CAST({_int(0, 60, _draw('opened', 'number'))} AS INTEGER) AS DATE) AS opened_date, 'active' AS status
  FROM (SELECT d.*, p.customer_id, p.enrollment_date, 5000 + p.n * 3 + place AS number FROM drawn d JOIN people p USING (n)
        WHERE place <= {_int(1, 3, _draw('accounts', 'p.n'))}))"""

_KINDS = ", ".join(
    f"{{'category': '{name}', 'low': {low}, 'high': {high}, 'merchants': {merchants!r}}}"
    for name, low, high, merchants in generators.CATEGORIES
)


def _people(spark: SparkSession, folder: str) -> DataFrame:
    numbers = s.table(spark, folder, "customer").select(F.col("c_custkey").alias("n"))
    return generators.customers(numbers, s.AS_OF.date())


@query("gen_customers", s.with_(_PEOPLE) + "SELECT * FROM people")
def gen_customers(spark: SparkSession, folder: str) -> DataFrame:
    return _people(spark, folder)


@query("gen_accounts", s.with_(_PEOPLE, _OPENED) + "SELECT * FROM opened")
def gen_accounts(spark: SparkSession, folder: str) -> DataFrame:
    return generators.accounts(_people(spark, folder))


@query(
    "gen_transactions",
    s.with_(_PEOPLE, _OPENED,
            f"""spread AS (
  SELECT *, list_extract([{_KINDS}], CAST(floor({_draw('category', 'number', 'i')} * 8) AS INTEGER) + 1) AS kind
  FROM (SELECT number, account_id, unnest(generate_series(CAST(0 AS BIGINT), {_int(15, 40, _draw('transactions', 'number'))} - 1)) AS i FROM opened))""")
    + f"""SELECT 'TXN-' || account_id || '-' || lpad(CAST(i AS VARCHAR), 4, '0') AS transaction_id, account_id,
       TIMESTAMP '2024-06-01' - to_days(CAST({_int(0, 60, _draw('days', 'number', 'i'))} AS INTEGER))
         - to_hours({_int(0, 23, _draw('hours', 'number', 'i'))}) AS timestamp,
       kind.low + CAST(floor({_draw('amount', 'number', 'i')} * (kind.high - kind.low + 1)) AS BIGINT) AS amount_cents,
       list_extract(kind.merchants, CAST(floor({_draw('merchant', 'number', 'i')} * len(kind.merchants)) AS INTEGER) + 1) AS merchant,
       kind.category AS category, 'posted' AS status FROM spread""",
)
def gen_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return generators.transactions(generators.accounts(_people(spark, folder)), s.AS_OF)


@query(
    "gen_changes",
    s.with_(_PEOPLE)
    + f"""SELECT customer_id, TIMESTAMP '2024-06-01' - to_days(CAST({_int(30, 540, _draw('moved-at', 'n'))} AS INTEGER)) AS change_timestamp,
       {_street('new', 'n')} AS address_line, {_pick(generators.STATES, _draw('new-state', 'n'))} AS state_code, risk_rating,
       'ADDRESS' AS change_type FROM people WHERE {_draw('moves', 'n')} < 0.3
UNION ALL
SELECT customer_id, TIMESTAMP '2024-06-01' - to_days(CAST({_int(30, 540, _draw('rerated-at', 'n'))} AS INTEGER)), address_line, state_code,
       list_extract(list_filter(['LOW', 'MEDIUM', 'HIGH'], lambda x: x <> risk_rating), CAST(floor({_draw('new-risk', 'n')} * 2) AS INTEGER) + 1),
       'RISK_RATING' FROM people WHERE {_draw('rerated', 'n')} < 0.2""",
)
def gen_changes(spark: SparkSession, folder: str) -> DataFrame:
    return generators.changes(_people(spark, folder), s.AS_OF)


# streams ------------------------------------------------------------------


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = s.table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


@query(
    "stream_silver",
    s.with_(s.CARD_TRANSACTIONS)
    + """SELECT *, TIMESTAMP '2024-06-01' AS ingested_at, amount_cents / 100 AS amount_dollars,
       CAST(year(timestamp) AS INTEGER) AS year, CAST(month(timestamp) AS INTEGER) AS month FROM card_transactions""",
)
def stream_silver(spark: SparkSession, folder: str) -> DataFrame:
    path, checkpoint = new_folder(spark, "stream-silver"), new_folder(spark, "checkpoint")
    stream = s.card_transactions(_stream(spark, folder))
    silver_stream(stream, path, checkpoint, as_of=s.AS_OF).awaitTermination()
    shape = silver.clean_transactions(s.card_transactions(s.table(spark, folder, "events")), s.AS_OF).schema
    return spark.read.schema(shape).parquet(path).select(*shape.names)


@query(
    "stream_totals",
    s.with_(s.CARD_TRANSACTIONS)
    + """SELECT date_trunc('day', timestamp) AS period_start, category, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS total_cents
FROM card_transactions GROUP BY ALL""",
)
def stream_totals(spark: SparkSession, folder: str) -> DataFrame:
    path, checkpoint = new_folder(spark, "stream-totals"), new_folder(spark, "checkpoint")
    totals_stream(s.card_transactions(_stream(spark, folder)), path, checkpoint).awaitTermination()
    return read_totals(spark, path)


def _two_files(spark: SparkSession, folder: str) -> DataFrame:
    """The transactions as a stream of two files: those of odd days, then those of even days, mostly late."""
    rows, path = s.card_transactions(s.table(spark, folder, "events")), new_folder(spark, "feed")
    for name, rest in (("a", 1), ("b", 0)):
        rows.filter(F.pmod(F.dayofmonth("timestamp"), F.lit(2)) == rest).coalesce(1).write.parquet(f"{path}/{name}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


@query(
    "stream_totals_corrected",
    s.with_(s.CARD_TRANSACTIONS)
    + """SELECT date_trunc('day', timestamp) AS period_start, category, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS total_cents,
       CAST(count(*) FILTER (day(timestamp) % 2 = 0 AND timestamp < (
         SELECT max(timestamp) FROM card_transactions WHERE day(timestamp) % 2 = 1) - INTERVAL 1 DAY) AS BIGINT) AS late_n
FROM card_transactions GROUP BY ALL""",
)
def stream_totals_corrected(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of a feed whose second half comes later than the watermark: those of a batch job, late rows counted."""
    totals = CorrectedTotals(spark, new_folder(spark, "stream-totals"))
    totals.start(_two_files(spark, folder), new_folder(spark, "checkpoint")).awaitTermination()
    return totals.read()


@query(
    "stream_silver_corrected",
    s.with_(s.CARD_TRANSACTIONS)
    + """SELECT *, TIMESTAMP '2024-06-01' AS ingested_at, amount_cents / 100 AS amount_dollars,
       CAST(year(timestamp) AS INTEGER) AS year, CAST(month(timestamp) AS INTEGER) AS month FROM card_transactions""",
)
def stream_silver_corrected(spark: SparkSession, folder: str) -> DataFrame:
    table = CorrectedSilver(spark, new_folder(spark, "stream-silver"), as_of=s.AS_OF)
    table.start(_two_files(spark, folder), new_folder(spark, "checkpoint")).awaitTermination()
    return table.read(s.card_transactions(s.table(spark, folder, "events")))


@query("stream_scd2", s.with_(*_HISTORY) + "SELECT * FROM sequenced")
def stream_scd2(spark: SparkSession, folder: str) -> DataFrame:
    """The change feed as a stream with keyed state ends in the same history as the full rebuild."""
    snapshot = s.customers(spark, folder)
    history = KeyedHistory(spark, new_folder(spark, "stream-history"), snapshot)
    feed = s.changes_from(_stream(spark, folder), snapshot)
    history.start(feed, new_folder(spark, "checkpoint")).awaitTermination()
    return history.read()


@query("stream_scd2_files", s.with_(*_HISTORY) + "SELECT * FROM sequenced")
def stream_scd2_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same from stored events and versions instead of state."""
    snapshot = s.customers(spark, folder)
    history = HistoryStream(spark, new_folder(spark, "stream-history"), snapshot)
    feed = s.changes_from(_stream(spark, folder), snapshot)
    history.start(feed, new_folder(spark, "checkpoint")).awaitTermination()
    return history.read()

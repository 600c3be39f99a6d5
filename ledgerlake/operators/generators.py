"""Synthetic banking data derived from a table of numbers.

Every value is a function of (seed, tag, key), so a generated table is identical for any
partitioning and may be regenerated piecewise.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.functions.draws import choice, integer, uniform

# State codes, risk ratings with weights, account types with balance ranges in cents,
# spending categories with amount ranges in cents and merchants.
STATES = ["CA", "NY", "TX", "FL", "PA", "IL", "OH", "GA", "NC", "MI"]
RISK_RATINGS = ["LOW", "MEDIUM", "HIGH"]
RISK_WEIGHTS = [0.6, 0.3, 0.1]
BALANCES = {
    "checking": (50_000, 1_500_000),
    "savings": (100_000, 8_000_000),
    "credit_card": (-500_000, -10_000),
}
CATEGORIES = [
    ("groceries", -10_000, -2_000, ["Whole Foods", "Trader Joes", "Kroger", "Safeway"]),
    ("dining", -5_000, -800, ["Starbucks", "Chipotle", "Local Restaurant", "Uber Eats"]),
    ("gas", -8_000, -1_500, ["Shell", "Exxon", "BP", "Chevron"]),
    ("subscriptions", -3_000, -500, ["Netflix", "Spotify", "NYTimes", "Adobe"]),
    ("travel", -50_000, -5_000, ["Delta Airlines", "Marriott", "United", "Airbnb"]),
    ("utilities", -25_000, -3_000, ["Electric Co", "Water Dept", "Gas Co", "Internet ISP"]),
    ("income", 200_000, 800_000, ["ACH-Payroll", "Direct-Deposit"]),
    ("transfer", 5_000, 200_000, ["Transfer-from-savings", "Transfer-from-checking"]),
]
ACCOUNTS_PER_CUSTOMER = (1, 3)
TRANSACTIONS_PER_ACCOUNT = (15, 40)
HISTORY_DAYS, HISTORY_HOURS = 60, 23
ADDRESS_SHARE, RISK_SHARE = 0.30, 0.20
CHANGE_DAYS = (30, 540)
ENROLLED_DAYS = (30, 2_920)

# Word lists of this package for made-up people and streets.
FIRST_NAMES = ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gia", "Hal", "Ines", "Jon"]
LAST_NAMES = ["Archer", "Baker", "Cooper", "Dyer", "Fletcher", "Mason", "Potter", "Sawyer", "Turner", "Weaver"]
STREETS = ["Oak Street", "Elm Avenue", "Lake Road", "Hill Lane", "Mill Court"]


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _date(as_of: dt.date) -> Column:
    return F.lit(as_of.isoformat()).cast("date")


def _address(seed: int, tag: str, *key: Column) -> Column:
    number = integer(100, 9_999, uniform(seed, f"{tag}-number", *key))
    return F.concat_ws(" ", number.cast("string"), choice(_strings(STREETS), uniform(seed, f"{tag}-street", *key)))


def _dealt(numbers: DataFrame) -> DataFrame:
    """Numbers in as many partitions as a shuffle has.

    A number becomes up to 120 transactions in the task that reads it, and a few megabytes of numbers are one split
    of a file, so without this one task may generate everything. Adaptive execution leaves a given number of
    partitions as it is; it would put so few bytes back into one.
    """
    spark = numbers.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return numbers.repartition(max(tasks, spark.sparkContext.defaultParallelism))


def customers(numbers: DataFrame, as_of: dt.date, seed: int = 42) -> DataFrame:
    """(n) -> one customer per number."""
    numbers = _dealt(numbers.select("n"))
    n = F.col("n")
    risk = uniform(seed, "risk", n)
    first, last = (
        choice(_strings(names), uniform(seed, tag, n)) for names, tag in ((FIRST_NAMES, "first"), (LAST_NAMES, "last"))
    )
    days = integer(*ENROLLED_DAYS, uniform(seed, "enrolled", n))
    return numbers.select(
        "n", F.format_string("CUST-%d", F.lit(1000) + n).alias("customer_id"),
        first.alias("first_name"), last.alias("last_name"),
        F.concat(F.lower(first), F.lit("."), F.lower(last), n.cast("string"), F.lit("@example.com")).alias("email"),
        F.date_sub(_date(as_of), days.cast("int")).alias("enrollment_date"),
        _address(seed, "home", n).alias("address_line"),
        choice(_strings(STATES), uniform(seed, "state", n)).alias("state_code"),
        F.when(risk < RISK_WEIGHTS[0], RISK_RATINGS[0])
        .when(risk < RISK_WEIGHTS[0] + RISK_WEIGHTS[1], RISK_RATINGS[1])
        .otherwise(RISK_RATINGS[2]).alias("risk_rating"),
    )


def accounts(people: DataFrame, seed: int = 42) -> DataFrame:
    """One to three accounts of different types per customer.

    Types are ordered by a draw per type. Account numbers leave room for three per customer, so they
    need no global counter.
    """
    n = F.col("n")
    drawn = F.array_sort(
        F.array(
            *[
                F.struct(
                    uniform(seed, f"type-{kind}", n).alias("draw"), F.lit(kind).alias("kind"),
                    F.lit(low).cast("bigint").alias("low"), F.lit(high).cast("bigint").alias("high"),
                )
                for kind, (low, high) in BALANCES.items()
            ]
        )
    )
    how_many = integer(*ACCOUNTS_PER_CUSTOMER, uniform(seed, "accounts", n)).cast("int")
    opened = people.select(
        "n", "customer_id", "enrollment_date", F.posexplode(F.slice(drawn, F.lit(1), how_many)).alias("i", "type")
    ).withColumn("number", F.lit(5001) + F.col("n") * ACCOUNTS_PER_CUSTOMER[1] + F.col("i"))
    number = F.col("number")
    days = integer(0, 60, uniform(seed, "opened", number)).cast("int")
    return opened.select(
        "number", F.format_string("ACC-%d", number).alias("account_id"), "customer_id",
        F.col("type.kind").alias("account_type"),
        integer(F.col("type.low"), F.col("type.high"), uniform(seed, "balance", number)).alias("balance_cents"),
        F.lit("USD").alias("currency"), F.date_add("enrollment_date", days).alias("opened_date"),
        F.lit("active").alias("status"),
    )


def transactions(opened: DataFrame, now: dt.datetime, seed: int = 42) -> DataFrame:
    """Fifteen to forty transactions per account over the last sixty days."""
    table = F.array(
        *[
            F.struct(
                F.lit(name).alias("category"), F.lit(low).cast("bigint").alias("low"),
                F.lit(high).cast("bigint").alias("high"), _strings(merchants).alias("merchants"),
            )
            for name, low, high, merchants in CATEGORIES
        ]
    )
    number, i = F.col("number"), F.col("i")
    how_many = integer(*TRANSACTIONS_PER_ACCOUNT, uniform(seed, "transactions", number))
    rows = opened.select(
        "number", "account_id", F.explode(F.sequence(F.lit(0).cast("bigint"), how_many - 1)).alias("i")
    ).withColumn("kind", choice(table, uniform(seed, "category", number, i)))
    moment = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    back = F.make_dt_interval(
        integer(0, HISTORY_DAYS, uniform(seed, "days", number, i)).cast("int"),
        integer(0, HISTORY_HOURS, uniform(seed, "hours", number, i)).cast("int"),
    )
    return rows.select(
        F.format_string("TXN-%s-%04d", "account_id", i).alias("transaction_id"), "account_id",
        (moment - back).alias("timestamp"),
        integer(F.col("kind.low"), F.col("kind.high"), uniform(seed, "amount", number, i)).alias("amount_cents"),
        choice(F.col("kind.merchants"), uniform(seed, "merchant", number, i)).alias("merchant"),
        F.col("kind.category").alias("category"), F.lit("posted").alias("status"),
    )


def changes(people: DataFrame, now: dt.datetime, seed: int = 42) -> DataFrame:
    """Address changes for 30 % and, independently, new risk ratings for 20 % of the customers."""
    n = F.col("n")
    moment = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")

    def at(tag: str) -> Column:
        return moment - F.make_dt_interval(integer(*CHANGE_DAYS, uniform(seed, tag, n)).cast("int"))

    other_ratings = F.array_remove(_strings(RISK_RATINGS), F.col("risk_rating"))
    moved = people.filter(uniform(seed, "moves", n) < ADDRESS_SHARE).select(
        "customer_id", at("moved-at").alias("change_timestamp"), _address(seed, "new", n).alias("address_line"),
        choice(_strings(STATES), uniform(seed, "new-state", n)).alias("state_code"), "risk_rating",
        F.lit("ADDRESS").alias("change_type"),
    )
    rated = people.filter(uniform(seed, "rerated", n) < RISK_SHARE).select(
        "customer_id", at("rerated-at").alias("change_timestamp"), "address_line", "state_code",
        choice(other_ratings, uniform(seed, "new-risk", n)).alias("risk_rating"),
        F.lit("RISK_RATING").alias("change_type"),
    )
    return moved.unionByName(rated).orderBy("change_timestamp", "customer_id", "change_type")


def change_type_counts(feed: DataFrame) -> DataFrame:
    return feed.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("change_type") == "ADDRESS").alias("n_address"),
        F.count_if(F.col("change_type") == "RISK_RATING").alias("n_risk"),
    )

import datetime as dt

from pyspark.sql import functions as F

from ledgerlake import schemas
from ledgerlake.operators import quality

DAY = dt.datetime(2024, 1, 1)


def accounts(spark, *changes):
    base = {"account_id": "A", "customer_id": "C", "account_type": "checking", "balance_cents": 0, "currency": "USD",
            "opened_date": DAY.date(), "status": "active", "created_at": DAY, "updated_at": DAY}
    loose = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.ACCOUNTS.schema)
    return spark.createDataFrame([tuple({**base, **c}.values()) for c in changes], loose)


def test_row_rules(spark, rows):
    df = accounts(
        spark, {"account_id": "ok", "balance_cents": -10_000_000}, {"account_id": "low", "balance_cents": -10_000_001},
        {"account_id": "odd", "account_type": "loan", "status": "gone"}, {"account_id": "nul", "currency": None},
        {"account_id": "long", "currency": "USDX"},
    )
    assert rows(quality.check_violations(df, schemas.ACCOUNTS), "row_key", "rule") == [
        ("low", "balance_cents_minimum"), ("odd", "account_type_domain"), ("odd", "status_domain"),
    ]
    assert rows(quality.contract_violations(df, schemas.ACCOUNTS), "row_key", "rule") == [
        ("long", "currency_too_long"), ("nul", "currency_null"),
    ]
    valid, failing = quality.split_quarantine(df, schemas.ACCOUNTS)
    assert rows(valid, "account_id") == [("ok",)]
    assert valid.columns == df.columns and failing.count() == 4


def test_schema_problems(spark):
    df = accounts(spark, {})
    assert quality.schema_problems(df, schemas.ACCOUNTS) == []
    odd = df.drop("status").withColumn("balance_cents", F.lit("1")).withColumn("extra", F.lit(1))
    assert quality.schema_problems(odd, schemas.ACCOUNTS) == [
        "missing column status", "unexpected column extra", "column balance_cents is string, expected bigint",
    ]


def test_keys_and_orphans(spark, rows):
    people = spark.createDataFrame([("C", "a@x"), ("C", "b@x"), ("D", "a@x"), (None, None), (None, None)], "customer_id string, email string")
    assert rows(quality.duplicate_keys(people, schemas.CUSTOMERS)) == [
        ("customers", "customer_id", "C", 2), ("customers", "email", "a@x", 2),
    ]
    children = accounts(spark, {"customer_id": "X"}, {"customer_id": "X"}, {"customer_id": "C"}, {"customer_id": None})
    assert rows(quality.orphans(children, "accounts", "customer_id", people, "customer_id")) == [("accounts", "customer_id", "X", 2)]


def test_masking(spark):
    people = spark.createDataFrame(
        [("C-1", "Ada", "Archer", "ada@x.com", "1 Oak", "NC")],
        "customer_id string, first_name string, last_name string, email string, address_line string, state_code string",
    )
    one = quality.mask_customers(people, "salt").first()
    assert (one["first_name"], one["last_name"], one["email"], one["address_line"]) == ("A***", "A***", "a***@x.com", "***")
    assert "customer_id" not in one.asDict() and one["customer_token"] != quality.mask_customers(people, "other").first()["customer_token"]


def test_outcomes_are_written_in_one_scan(spark, rows, tmp_path):
    df = accounts(spark, {"account_id": "ok"}, {"account_id": "low", "balance_cents": -10_000_001}, {"account_id": "nul", "currency": None})
    source = str(tmp_path / "in")
    df.write.parquet(source)
    read = spark.read.parquet(source)
    outcomes, counts = quality.write_outcomes(read, schemas.ACCOUNTS, str(tmp_path / "out"))
    assert counts == {"valid": 1, "quarantined": 2}
    assert rows(outcomes.filter("outcome = 'valid'"), "account_id") == [("ok",)]
    assert rows(outcomes.filter("outcome = 'quarantined'"), "account_id", "reasons") == [("low", ["balance_cents_minimum"]), ("nul", ["currency_null"])]
    plan = quality.marked_rows(read, schemas.ACCOUNTS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    valid, failing = quality.split_quarantine(read, schemas.ACCOUNTS)
    assert valid.count() == 1 and failing.count() == 2

"""Declared contracts of the operational tables and the change feed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Contract:
    """Schema plus the rules a row has to satisfy."""

    name: str
    schema: T.StructType
    primary_key: str
    unique: tuple[str, ...] = ()
    max_lengths: dict[str, int] = field(default_factory=dict)
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    minimums: dict[str, int] = field(default_factory=dict)
    foreign_keys: dict[str, tuple[str, str]] = field(default_factory=dict)


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DateType(), T.TimestampNTZType()

CUSTOMERS = Contract(
    name="customers",
    schema=_schema(
        ("customer_id", _S, False),
        ("first_name", _S, False),
        ("last_name", _S, False),
        ("email", _S, False),
        ("enrollment_date", _D, False),
        ("address_line", _S, True),
        ("state_code", _S, True),
        ("risk_rating", _S, True),
        ("created_at", _TS, False),
        ("updated_at", _TS, False),
    ),
    primary_key="customer_id",
    unique=("email",),
    max_lengths={
        "customer_id": 20, "first_name": 100, "last_name": 100, "email": 255,
        "address_line": 255, "state_code": 2, "risk_rating": 20,
    },
)

ACCOUNTS = Contract(
    name="accounts",
    schema=_schema(
        ("account_id", _S, False),
        ("customer_id", _S, False),
        ("account_type", _S, False),
        ("balance_cents", _L, False),
        ("currency", _S, False),
        ("opened_date", _D, False),
        ("status", _S, False),
        ("created_at", _TS, False),
        ("updated_at", _TS, False),
    ),
    primary_key="account_id",
    max_lengths={"account_id": 20, "customer_id": 20, "account_type": 20, "currency": 3, "status": 20},
    # The account types, statuses and balance floor of the data model.
    domains={
        "account_type": ("checking", "savings", "credit_card"),
        "status": ("active", "frozen", "closed"),
    },
    minimums={"balance_cents": -10_000_000},
    foreign_keys={"customer_id": ("customers", "customer_id")},
)

TRANSACTIONS = Contract(
    name="transactions",
    schema=_schema(
        ("transaction_id", _S, False),
        ("account_id", _S, False),
        ("timestamp", _TS, False),
        ("amount_cents", _L, False),
        ("merchant", _S, True),
        ("category", _S, False),
        ("status", _S, False),
        ("created_at", _TS, False),
    ),
    primary_key="transaction_id",
    max_lengths={"transaction_id": 40, "account_id": 20},
    # The transaction statuses of the data model.
    domains={"status": ("pending", "posted", "reversed")},
    foreign_keys={"account_id": ("accounts", "account_id")},
)

CONTRACTS = {c.name: c for c in (CUSTOMERS, ACCOUNTS, TRANSACTIONS)}

CHANGE_EVENT = _schema(
    ("customer_id", _S, False),
    ("change_timestamp", _TS, False),
    ("address_line", _S, True),
    ("state_code", _S, True),
    ("risk_rating", _S, True),
    ("change_type", _S, False),
)

CUSTOMER_SNAPSHOT = _schema(
    ("customer_id", _S, False),
    ("first_name", _S, True),
    ("last_name", _S, True),
    ("email", _S, True),
    ("enrollment_date", _D, True),
    ("address_line", _S, True),
    ("state_code", _S, True),
    ("risk_rating", _S, True),
)

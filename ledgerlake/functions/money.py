"""Money is whole cents; dollars are a derived double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dollars(cents: Column) -> Column:
    return cents.cast("double") / F.lit(100.0)


def cents(amount: Column) -> Column:
    return F.round(amount * F.lit(100.0)).cast("bigint")

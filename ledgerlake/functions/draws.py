"""Pseudo-random draws that depend only on (seed, tag, key).

Derived from a digest of the key, so the value of a row is the same on every run, for every
partitioning and after every task retry, which ``rand(seed)`` does not give.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uniform(seed: int, tag: str, *key: Column) -> Column:
    """A double in [0, 1)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[k.cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def integer(low: Column | int, high: Column | int, draw: Column) -> Column:
    """An integer in [low, high], both included."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return (low + F.floor(draw * (high - low + F.lit(1)))).cast("bigint")


def choice(options: Column, draw: Column) -> Column:
    """One element of an array column."""
    position = F.floor(draw * F.size(options)) + F.lit(1)
    return F.element_at(options, position.cast("int"))

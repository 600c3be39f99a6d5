"""Restricting a large table to the keys that were asked for, by plan-time size estimates only.

No job runs while a plan is built, and no broadcast of rows is forced: Spark's own size guard and
adaptive execution decide, and adaptive execution splits the partitions of hot keys. Only a bitmap of
fixed size is broadcast by a hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType, StringType

BROADCAST_SETTING = "spark.sql.autoBroadcastJoinThreshold"

# Fixed value: bits of the bitmap of asked keys, 8 MB in 2,048 rows.
MARKS = 1 << 26


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of ``df``, from its optimised plan; nothing is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_bytes(df: DataFrame) -> int:
    """Up to which estimated size Spark broadcasts a join side."""
    setting = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(setting)


def few_keys(wanted: DataFrame, key: str) -> DataFrame | None:
    """The distinct keys, if Spark expects them to be small enough for a broadcast."""
    keys = wanted.select(key).distinct()
    return keys if estimated_bytes(keys) <= broadcast_bytes(keys) else None


def restrict_to(df: DataFrame, keys: DataFrame | None, key: str) -> DataFrame:
    """Drop rows nobody asked for, without a shuffle of ``df``; many keys are left to the later join."""
    return df if keys is None else df.join(keys, key, "left_semi")


def keep_asked(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Drop rows of ``df`` that nobody asked for, without a shuffle of ``df``, however many keys are asked.

    Few keys are exact. Many are marked in a bitmap of ``MARKS`` bits, which is broadcast: no asked row is
    lost, and some others pass (a tenth of them with 7 million keys), so a join by key has to follow.
    """
    few = few_keys(wanted, key)
    if few is not None or not _same_hash(df, wanted, key):
        return restrict_to(df, few, key)
    marks, mark = _marks(wanted, key), _mark(df[key])
    bit = F.bitmap_bit_position(mark)
    byte = F.conv(F.hex(F.substring(marks["bits"], (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = (F.bitmap_bucket_number(mark) == marks["bucket"]) & (F.getbit(byte, (bit % 8).cast("int")) == 1)
    return df.join(F.broadcast(marks), marked, "left_semi")


def _mark(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(MARKS)) + 1


def _marks(wanted: DataFrame, key: str) -> DataFrame:
    """bucket, bits: a bit for the hash of every asked key."""
    marks = wanted.filter(F.col(key).isNotNull()).select(_mark(F.col(key)).alias("mark"))
    return marks.groupBy(F.bitmap_bucket_number("mark").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("mark")).alias("bits")
    )


def _same_hash(df: DataFrame, wanted: DataFrame, key: str) -> bool:
    """Whether equal keys have equal hashes: not so for two types, nor for fractions and collations."""
    kind = df.schema[key].dataType
    return kind == wanted.schema[key].dataType and (isinstance(kind, IntegralType) or kind == StringType())

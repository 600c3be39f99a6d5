"""Tables in folders by a hash of their key, of which a merge reads and writes only those its source mentions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerlake.workspace import written

BUCKET = "__bucket"


class BucketedTable:
    """Rows of ``schema`` below ``path``, a folder for each of ``buckets`` hashes of ``key``; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 256):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def _write(self, rows: DataFrame) -> None:
        """Replace the buckets that ``rows`` holds; a large bucket is split over tasks and files."""
        dealt = rows.select(*self.schema.names).withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET)
        writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BUCKET).parquet(self.path)

    def overwrite(self, rows: DataFrame) -> None:
        """Write ``rows`` as the table's first content, or in place of the buckets they fall into."""
        self._write(rows)

    def read(self) -> DataFrame:
        return self._rows().drop(BUCKET)

    def touched(self, source: DataFrame) -> list[int]:
        """The buckets of the keys of ``source``, at most ``buckets`` numbers."""
        return sorted(r[0] for r in source.select(self._bucket().alias("b")).distinct().collect())

    def part(self, buckets: list[int]) -> DataFrame:
        """The rows of some buckets; no other folder is read."""
        return self._rows().where(F.col(BUCKET).isin(buckets)).drop(BUCKET)

    def merge(self, source: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Put ``merged(target, source)`` in place of the touched buckets of the target; returns their numbers.

        ``merged`` must keep each key's rows apart from those of others, as upserts by key do. The result is
        written aside before it replaces what it was made from.
        """
        buckets = self.touched(source)
        if buckets:
            self._write(written(merged(self.part(buckets), source), "merged-buckets"))
        return buckets

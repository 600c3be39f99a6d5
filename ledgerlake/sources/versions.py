"""Parquet datasets with a folder per version: ``version=N/operation=NAME/``, whole rows in each.

A version is there once Spark has marked its folder as complete, so an unfinished write is not seen.
There is no log beside the data: versions are found by their folders, and their numbers of rows are
counted from them. One writer at a time; use a table format where several writers meet.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T


class SchemaMismatch(ValueError):
    """The rows offered do not fit the table; nothing was written."""


@dataclass(frozen=True)
class Commit:
    version: int
    num_rows: int


def check_schema(table: T.StructType, offered: T.StructType, exact: bool = False) -> None:
    """Reject unknown columns and changed types; ``exact`` also rejects missing columns."""
    known = {f.name: f for f in table}
    problems = [f"unknown column {f.name}" for f in offered if f.name not in known]
    problems += [
        f"column {f.name} is {f.dataType.simpleString()}, table has {known[f.name].dataType.simpleString()}"
        for f in offered
        if f.name in known and f.dataType.simpleString() != known[f.name].dataType.simpleString()
    ]
    given = {f.name for f in offered}
    problems += [f"missing column {f.name}" for f in table if exact and f.name not in given]
    if problems:
        raise SchemaMismatch("; ".join(problems))


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # reading

    def versions(self) -> dict[int, str]:
        """Operation of each complete version, by number."""
        return {version: operation for version, operation, _ in self._complete()}

    def times(self) -> dict[int, dt.datetime]:
        """When each version was complete, in UTC, by number: the time of the mark that Spark leaves."""
        zone = dt.timezone.utc
        return {v: dt.datetime.fromtimestamp(ms / 1000, zone).replace(tzinfo=None) for v, _, ms in self._complete()}

    def version_at(self, moment: dt.datetime) -> int | None:
        """The newest version that was complete at ``moment`` (UTC); None if none was."""
        return max((v for v, at in self.times().items() if at <= moment), default=None)

    def _complete(self) -> list[tuple[int, str, int]]:
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/operation=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        names = [(re.search(r"version=(\d+)/operation=(\w+)/", f.getPath().toString()), f.getModificationTime()) for f in found]
        return [(int(n[1]), n[2], ms) for n, ms in names]

    def current_version(self) -> int | None:
        return max(self.versions(), default=None)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest or the given version, with the schema that version was written with."""
        found = self.versions()
        chosen = max(found, default=None) if version is None else version
        if chosen not in found:
            raise LookupError(f"{self.path} has no version {'' if version is None else version}")
        return self.spark.read.parquet(self._folder(chosen, found[chosen]))

    def timed_history(self) -> DataFrame:
        """version, operation, num_rows and committed_at (UTC) of every version."""
        times = self.spark.createDataFrame(sorted(self.times().items()), "version bigint, committed_at timestamp_ntz")
        return self.history().join(times, "version")

    def history(self) -> DataFrame:
        """version, operation and number of rows of every version."""
        parts = [
            self.read(v).agg(F.count(F.lit(1)).alias("num_rows")).select(
                F.lit(v).cast("bigint").alias("version"), F.lit(operation).alias("operation"), "num_rows"
            )
            for v, operation in sorted(self.versions().items())
        ]
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    # writing

    def overwrite(
        self,
        rows: DataFrame,
        partition_by: Sequence[str] = (),
        allow_schema_change: bool = False,
        operation: str = "OVERWRITE",
    ) -> Commit:
        """Write ``rows`` as the whole table, as a new version."""
        newest = self.current_version()
        if newest is not None and not allow_schema_change:
            check_schema(self.read(newest).schema, rows.schema, exact=True)
        version = 0 if newest is None else newest + 1
        seen = Observation()
        writer = rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self._folder(version, operation))
        return Commit(version, seen.get["rows"])

    def append(self, rows: DataFrame, partition_by: Sequence[str] = ()) -> Commit:
        """Write the current rows and ``rows`` as a new version; missing columns are null."""
        newest = self.current_version()
        if newest is None:
            return self.overwrite(rows, partition_by, operation="APPEND")
        current = self.read(newest)
        check_schema(current.schema, rows.schema)
        joined = current.unionByName(rows, allowMissingColumns=True)
        return self.overwrite(joined, partition_by, operation="APPEND")

    def restore(self, version: int, partition_by: Sequence[str] = ()) -> Commit:
        """Write the rows of an old version as the newest one."""
        return self.overwrite(self.read(version), partition_by, allow_schema_change=True, operation="RESTORE")

    def _folder(self, version: int, operation: str) -> str:
        return f"{self.path}/version={version}/operation={operation}"


def version_counts(history: DataFrame) -> DataFrame:
    return history.select("version", "num_rows")


def version_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Key and kind (added, removed, changed) of every row that differs.

    A column that one version lacks counts as null there. Only the key and a 64-bit hash of each row
    are shuffled, not the rows; nulls are part of the hash.
    """
    types = {f.name: f.dataType for f in [*before.schema, *after.schema] if f.name != key}
    names = sorted(types)

    def hashed(rows: DataFrame, name: str) -> DataFrame:
        given = [F.col(f"`{n}`") if n in rows.columns else F.lit(None).cast(types[n]) for n in names]
        given = [v.cast(types[n]) for v, n in zip(given, names)]
        return rows.select(key, F.xxhash64(*given, *[v.isNull() for v in given]).alias(name))

    joined = hashed(before, "old_hash").join(hashed(after, "new_hash"), key, "full_outer")
    return joined.select(
        key,
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
        .alias("change"),
    ).filter(F.col("change").isNotNull())

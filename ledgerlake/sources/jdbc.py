"""JDBC source and sink. Credentials come from the caller; none are kept here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Connection:
    url: str
    user: str
    password: str
    driver: str = "org.postgresql.Driver"
    fetch_size: int = 10_000

    def options(self) -> dict[str, str]:
        if "@" in self.url.split("?")[0] or "password=" in self.url:
            raise ValueError("pass credentials as properties, not inside the URL")
        return {
            "url": self.url, "user": self.user, "password": self.password,
            "driver": self.driver, "fetchsize": str(self.fetch_size),
        }


@dataclass(frozen=True)
class Split:
    """Parallel read on a numeric, date or timestamp column; bounds only shape the ranges."""

    column: str
    lower: str
    upper: str
    partitions: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column, "lowerBound": self.lower,
            "upperBound": self.upper, "numPartitions": str(self.partitions),
        }


def bounds(spark: SparkSession, connection: Connection, table: str, column: str, partitions: int) -> Split:
    """Ask the database for the range of a column: one row comes back."""
    query = f"SELECT min({column}) AS lo, max({column}) AS hi FROM {table}"
    lo, hi = spark.read.format("jdbc").options(**connection.options(), query=query).load().first()
    return Split(column, str(lo), str(hi), partitions)


def read_table(
    spark: SparkSession, connection: Connection, table: str, split: Split | None = None
) -> DataFrame:
    """A table scan; filters and column selection reach the database, ``split`` makes it parallel."""
    extra = split.options() if split else {}
    return spark.read.format("jdbc").options(**connection.options(), **extra, dbtable=table).load()


def write_tables(connection: Connection, tables: Mapping[str, DataFrame], order: Sequence[str]) -> None:
    """Replace table contents; ``order`` lists parents before children.

    Children are emptied first (in reverse order), then parents, so no reference is ever broken.
    """
    for name in reversed(order):
        _write(tables[name].limit(0), connection, name, "overwrite")
    for name in order:
        _write(tables[name], connection, name, "append")


def _write(rows: DataFrame, connection: Connection, table: str, mode: str) -> None:
    (
        rows.write.format("jdbc")
        .options(**connection.options(), dbtable=table, truncate="true", cascadeTruncate="true", batchsize="10000")
        .mode(mode).save()
    )

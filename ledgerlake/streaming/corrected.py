"""Streams whose results include rows later than the watermark.

A micro-batch compares its rows with the watermark that earlier batches left: the latest event time they have
seen, less the lateness. Rows before it are late. They are stored in a table of their own and counted, and what
they change is merged with the rest, so a stream ends in the results of a batch job over all rows. Each batch
writes to folders of its own and replaces them when it is repeated; it reads one row of the batch before it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.operators.silver import clean_transactions

_SEEN = "latest timestamp_ntz, n_rows long, late_rows long"


class _Corrected:
    """``transactions`` by micro-batch; ``lateness`` is an interval as SQL writes it."""

    def __init__(self, spark: SparkSession, path: str, lateness: str = "1 day"):
        self.spark, self.path, self.lateness = spark, path, lateness

    def start(self, transactions: DataFrame, checkpoint: str) -> StreamingQuery:
        return (
            transactions.writeStream.foreachBatch(self.apply)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        late = self._late(batch_id)
        marked = batch.withColumn("late", late)
        self._store(marked, batch_id)
        marked.filter("late").drop("late").write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")
        counted = marked.agg(F.max("timestamp").alias("latest"), F.count(F.lit(1)).alias("n_rows"), F.count_if("late").alias("late_rows"))
        earlier = self._seen(batch_id - 1)
        latest = F.greatest("latest", F.lit(earlier["latest"] if earlier else None).cast("timestamp_ntz"))
        counted.withColumn("latest", latest).write.mode("overwrite").parquet(f"{self.path}/seen/batch={batch_id}")

    def late_rows(self, schema) -> DataFrame:
        """The late rows of all batches."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/late")

    def counts(self) -> DataFrame:
        """batch, latest, n_rows, late_rows"""
        return self.spark.read.schema(f"{_SEEN}, batch int").parquet(f"{self.path}/seen")

    def _seen(self, batch_id: int):
        """The one row that a batch left; None before the first."""
        return self.counts().filter(F.col("batch") == batch_id).first() if batch_id >= 0 else None

    def _late(self, batch_id: int) -> Column:
        earlier = self._seen(batch_id - 1)
        if earlier is None or earlier["latest"] is None:
            return F.lit(False)
        watermark = F.lit(earlier["latest"]).cast("timestamp_ntz") - F.expr(f"INTERVAL {self.lateness}")
        return F.coalesce(F.col("timestamp") < watermark, F.lit(False))

    def _store(self, marked: DataFrame, batch_id: int) -> None:
        raise NotImplementedError


class CorrectedTotals(_Corrected):
    """Count and sum per day and category: sums of every batch, its late rows apart."""

    def _store(self, marked: DataFrame, batch_id: int) -> None:
        day = F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("period_start")
        sums = marked.groupBy(day, "category", "late").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("total_cents"))
        sums.write.mode("overwrite").parquet(f"{self.path}/sums/batch={batch_id}")

    def read(self) -> DataFrame:
        """period_start, category, n, total_cents of all rows, and late_n, how many of them came late."""
        fields = "period_start timestamp_ntz, category string, late boolean, n long, total_cents long"
        sums = self.spark.read.schema(fields).parquet(f"{self.path}/sums")
        return sums.groupBy("period_start", "category").agg(
            F.sum("n").alias("n"), F.sum("total_cents").alias("total_cents"),
            F.sum(F.when(F.col("late"), F.col("n")).otherwise(F.lit(0))).alias("late_n"),
        )


class CorrectedSilver(_Corrected):
    """Cleaned transactions by month, each transaction once, however late it or its repeats come.

    New rows are compared with the stored ids of the months they fall into; no other month is read.
    """

    def __init__(self, spark: SparkSession, path: str, lateness: str = "1 day", as_of: dt.datetime | None = None):
        super().__init__(spark, path, lateness)
        self.as_of = as_of

    def _store(self, marked: DataFrame, batch_id: int) -> None:
        cleaned = clean_transactions(marked.drop("late").dropDuplicates(["transaction_id"]), self.as_of)
        if batch_id > 0:
            months = [tuple(r) for r in cleaned.select("year", "month").distinct().collect()]
            kept = self._stored("transaction_id string, year int, month int").filter(F.col("batch") < batch_id)
            mentioned = F.lit(False)
            for year, month in months:
                mentioned = mentioned | ((F.col("year") == year) & (F.col("month") == month))
            cleaned = cleaned.join(kept.filter(mentioned).select("transaction_id"), "transaction_id", "left_anti").select(*cleaned.columns)
        cleaned.write.mode("overwrite").partitionBy("year", "month").parquet(f"{self.path}/silver/batch={batch_id}")

    def _stored(self, fields: str) -> DataFrame:
        return self.spark.read.schema(f"{fields}, batch int").parquet(f"{self.path}/silver")

    def read(self, transactions: DataFrame) -> DataFrame:
        """The table; ``transactions`` names the columns of the source."""
        shape = clean_transactions(transactions, self.as_of).schema
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape)
        return self._stored(fields).select(*shape.names)

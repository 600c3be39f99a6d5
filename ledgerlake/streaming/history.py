"""Customer history kept up to date from a stream of change events.

Every micro-batch stores its events and rebuilds, for the customers it mentions, the history from
the earliest time it mentions. Late and repeated events therefore end in the same state as a rebuild
from scratch. A batch writes to folders of its own and replaces them when it is repeated.

The rows a batch writes for a customer replace all older rows from the first of them on. Only that
tail is written, so a customer with a long history costs what changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlake import schemas
from ledgerlake.operators.scd2 import HISTORY, initial_history, sequenced_history

_INITIAL = -1


class HistoryStream:
    """For a feed that arrives roughly in order a batch reads stored events of recent months only."""

    def __init__(self, spark: SparkSession, path: str, snapshot: DataFrame):
        self.spark, self.path, self.snapshot = spark, path, snapshot

    def start(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        self.write_initial()
        return (
            changes.writeStream.foreachBatch(self.apply)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )

    def write_initial(self) -> None:
        self._write(initial_history(self.snapshot), _INITIAL)

    def read(self) -> DataFrame:
        return valid_versions(self._versions())

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        months = batch.withColumn("month", _month(F.col("change_timestamp")))
        months.write.mode("overwrite").partitionBy("month").parquet(f"{self.path}/changes/batch={batch_id}")
        new = self._changes().filter(F.col("batch") == batch_id)
        first_month = new.agg(F.min("month")).first()[0]
        if first_month is None:
            return
        since = new.groupBy("customer_id").agg(F.min("change_timestamp").alias("since"))

        events = (
            self._changes().filter((F.col("batch") <= batch_id) & (F.col("month") >= first_month))
            .join(since, "customer_id").filter("change_timestamp >= since").drop("since", "batch", "month")
        )
        # What holds just before the rebuilt time, and the snapshot row if it lies later.
        states = ["address_line", "state_code", "risk_rating"]
        earlier = self._versions().filter(F.col("batch") < batch_id).join(since.select("customer_id"), "customer_id", "left_semi")
        base = (
            valid_versions(earlier).join(since, "customer_id").filter("effective_from < since").groupBy("customer_id")
            .agg(F.max_by(F.struct("effective_from", *states), "effective_from").alias("base"))
            .select("customer_id", F.col("base.effective_from").alias("enrollment_date"), *[f"base.{c}" for c in states])
        )
        ahead = (
            self.snapshot.join(since, "customer_id")
            .withColumn("enrollment_date", F.col("enrollment_date").cast("timestamp_ntz"))
            .filter("enrollment_date >= since").select(*base.columns)
        )
        self._write(sequenced_history(base.unionByName(ahead), events), batch_id)

    def _changes(self) -> DataFrame:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.CHANGE_EVENT)
        return self.spark.read.schema(f"{fields}, batch int, month int").parquet(f"{self.path}/changes")

    def _versions(self) -> DataFrame:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in initial_history(self.snapshot).schema)
        return self.spark.read.schema(f"{fields}, batch int").parquet(f"{self.path}/versions")

    def _write(self, versions: DataFrame, batch_id: int) -> None:
        versions.select(*HISTORY).write.mode("overwrite").parquet(f"{self.path}/versions/batch={batch_id}")


def valid_versions(versions: DataFrame) -> DataFrame:
    """Version rows that no later batch replaced."""
    newer = Window.partitionBy("customer_id").orderBy(F.desc("batch")).rowsBetween(Window.unboundedPreceding, -1)
    replaced = (
        versions.groupBy("customer_id", "batch").agg(F.min("effective_from").alias("first"))
        .select("customer_id", "batch", F.min("first").over(newer).alias("replaced_from"))
    )
    marked = versions.join(replaced, ["customer_id", "batch"], "left")
    return marked.filter("replaced_from is null or effective_from < replaced_from").select(*HISTORY)


def _month(moment: Column) -> Column:
    return (F.year(moment) * 100 + F.month(moment)).cast("int")

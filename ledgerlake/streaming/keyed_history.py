"""Customer history from a change stream, kept as keyed state.

The state of a customer holds the snapshot's row and what each instant sets, so a micro-batch touches the
customers it mentions and nothing that earlier batches wrote. It emits a customer's versions from the one before
the earliest mentioned instant on; they replace all older rows from the first of them on. Late and repeated
events therefore end in the state of a rebuild.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerlake.functions.moments import micros, moment_of
from ledgerlake.operators.scd2 import ADDRESS, HISTORY, RISK, initial_history, surrogate_key
from ledgerlake.streaming.history import valid_versions

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_INITIAL = -1

_TRACKED = ["address_line", "state_code", "risk_rating"]
_EMITTED = "customer_id string, address_line string, state_code string, risk_rating string, since long, until long"


def _largest(a: tuple, b: tuple) -> tuple:
    """The later of two events of one instant and type: the larger payload, nulls first."""
    return max(a, b, key=lambda values: [(v is not None, v or "") for v in values])


def versions(start: tuple, events: dict[int, tuple]) -> list[list]:
    """[address_line, state_code, risk_rating, since, until] of a customer, in order.

    ``start`` is (enrolled, address_line, state_code, risk_rating), ``events`` what an instant sets:
    (has_address, address_line, state_code, has_risk, risk_rating). What changes nothing opens no version.
    """
    enrolled, *now = start
    made: list[list] = []
    for at in sorted({enrolled, *events}):
        if at < enrolled:
            continue
        has_address, line, state, has_risk, risk = events.get(at, (False, None, None, False, None))
        then = [*([line, state] if has_address else now[:2]), risk if has_risk else now[2]]
        if not made or then != now:
            if made:
                made[-1][4] = at
            made.append([*then, at, None])
        now = then
    return made


class CustomerHistory(StatefulProcessor):
    """Keeps a customer's start and events; emits the versions that a batch changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.start = handle.getValueState("start", "enrolled long, address_line string, state_code string, risk_rating string")
        self.events = handle.getMapState(
            "events", "at long", "has_address boolean, address_line string, state_code string, has_risk boolean, risk_rating string"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        touched: dict[int, tuple] = {}
        start = self.start.get() if self.start.exists() else None
        for frame in rows:
            frame = frame.astype(object).where(frame.notna(), None)
            if start is None:
                one = frame.iloc[0]
                start = (int(one["enrolled"]), one["start_address"], one["start_state"], one["start_risk"])
                self.start.update(start)
            columns = ["at", "change_type", "address_line", "state_code", "risk_rating"]
            for at, kind, line, state, risk in frame[columns].itertuples(index=False, name=None):
                at = int(at)
                if at < start[0]:
                    continue
                if at not in touched:
                    touched[at] = (self.events.getValue((at,)) if self.events.containsKey((at,)) else None) or (False, None, None, False, None)
                has_address, l0, s0, has_risk, r0 = touched[at]
                if kind == ADDRESS:
                    l0, s0 = _largest((l0, s0), (line, state)) if has_address else (line, state)
                    has_address = True
                else:
                    (r0,) = _largest((r0,), (risk,)) if has_risk else (risk,)
                    has_risk = True
                touched[at] = (has_address, l0, s0, has_risk, r0)
        for at, sets in touched.items():
            self.events.updateValue((at,), sets)
        if touched:
            whole = versions(tuple(start), {int(k[0]): tuple(v) for k, v in self.events.iterator()})
            earliest = min(touched)
            first = max((i for i, v in enumerate(whole) if v[3] < earliest), default=0)
            frame = pd.DataFrame(whole[first:], columns=[*_TRACKED, "since", "until"])
            frame.insert(0, "customer_id", key[0])
            frame["until"] = frame["until"].astype("Int64")
            yield frame

    def close(self) -> None:
        pass


class KeyedHistory:
    """Versions below ``path``, a folder for each micro-batch; a repeated batch replaces its folder."""

    def __init__(self, spark: SparkSession, path: str, snapshot: DataFrame):
        self.spark, self.path, self.snapshot = spark, path, snapshot

    def start(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Process what is there. Keyed state needs the RocksDB store, which is set for the session."""
        self.spark.conf.set(_STORE, _ROCKSDB)
        self._write(initial_history(self.snapshot), _INITIAL)
        people = self.snapshot.select(
            "customer_id", micros(F.col("enrollment_date").cast("timestamp_ntz")).alias("enrolled"),
            F.col("address_line").alias("start_address"), F.col("state_code").alias("start_state"),
            F.col("risk_rating").alias("start_risk"),
        )
        known = changes.filter(F.col("change_type").isin(ADDRESS, RISK)).withColumn("at", micros(F.col("change_timestamp")))
        events = known.select("customer_id", "at", "change_type", *_TRACKED).join(people, "customer_id")
        tails = events.groupBy("customer_id").transformWithStateInPandas(CustomerHistory(), _EMITTED, "Update", "None")
        return (
            tails.writeStream.outputMode("update").foreachBatch(self._save)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )

    def read(self) -> DataFrame:
        """The versions that no later batch replaced."""
        return valid_versions(self.stored())

    def stored(self) -> DataFrame:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in initial_history(self.snapshot).schema)
        return self.spark.read.schema(f"{fields}, batch int").parquet(f"{self.path}/versions")

    def _save(self, tails: DataFrame, batch_id: int) -> None:
        since = moment_of(F.col("since"))
        rows = tails.select(
            surrogate_key(F.col("customer_id"), since).alias("customer_key"), "customer_id", *_TRACKED,
            since.alias("effective_from"), moment_of(F.col("until")).alias("effective_to"),
            F.col("until").isNull().alias("is_current"),
        )
        self._write(rows, batch_id)

    def _write(self, rows: DataFrame, batch_id: int) -> None:
        rows.select(*HISTORY).write.mode("overwrite").parquet(f"{self.path}/versions/batch={batch_id}")

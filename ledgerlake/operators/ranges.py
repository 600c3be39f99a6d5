"""Ordered per-key scans over range partitions, with a state carried across their borders.

A window partitioned by a key puts the whole key into one task, and one by key and day a day's burst. Here rows
are range-partitioned by key *and* order, with splitters that Spark samples, so every task gets about the same
number of rows, whichever keys they belong to. A task scans its sorted rows once. What crosses a border is one
row per partition: the state of its last key, which later partitions continue, and its first row.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, IntegralType, LongType, StructField, StructType

from ledgerlake.workspace import written

MOST_PARTS_BITS = 20
_PART, _HEAD, _TOP, _TAIL = "__part", "__head", "__top", "__tail"


def range_scan(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carry: Mapping[str, str] | None = None,
    before: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    running: Mapping[str, str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add columns computed along ``order`` (ascending, total within a key) for each key.

    ``carry``   output -> column: its last non-null value up to and including the row.
    ``before``  output -> column: its last non-null value before the row.
    ``lead``    output -> column: its value in the following row, null on the last row.
    ``running`` output -> column of numbers: its sum up to and including the row, null counting as 0.

    Null keys are keys. ``parts`` partitions (by default those of any shuffle) change task sizes, never results.
    The sorted rows are written once, as the borders must come from the same partitions.
    """
    carry, before = dict(carry or {}), dict(before or {})
    lead, running = dict(lead or {}), dict(running or {})
    total = {o: DoubleType() if isinstance(rows.schema[c].dataType, (FloatType, DoubleType)) else LongType() for o, c in running.items()}
    for o, c in running.items():
        if not isinstance(rows.schema[c].dataType, (IntegralType, FloatType, DoubleType)):
            raise TypeError(f"{c} is {rows.schema[c].dataType.simpleString()}, no whole number or double")
    made = {**{o: rows.schema[c].dataType for part in (carry, before, lead) for o, c in part.items()}, **total}
    schema = StructType([
        *rows.schema.fields,
        *[StructField(o, t) for o, t in made.items()],
        StructField(_PART, IntegerType()),
        *[StructField(c, BooleanType()) for c in (_HEAD, _TOP, _TAIL)],
    ])
    sorting = [*keys, *order]
    dealt = rows.repartitionByRange(parts, *sorting) if parts else rows.repartitionByRange(*sorting)
    scan = _scanner(rows.columns, list(keys), carry, before, lead, running)
    scanned = written(dealt.sortWithinPartitions(*sorting).mapInArrow(scan, schema), "ranges")
    borders = _borders(scanned, keys, carry, before, lead, running)
    both = scanned.join(borders, _PART, "left")
    head, tail = F.col(_HEAD), F.col(_TAIL)
    return both.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        *[F.when(head & F.col(o).isNull(), F.col(f"__in_{o}")).otherwise(F.col(o)).alias(o) for o in (*carry, *before)],
        *[F.when(tail, F.col(f"__next_{o}")).otherwise(F.col(o)).alias(o) for o in lead],
        *[(F.col(o) + F.when(head, F.coalesce(f"__in_{o}", F.lit(0))).otherwise(F.lit(0))).alias(o) for o in running],
    )


def _borders(scanned: DataFrame, keys, carry, before, lead, running) -> DataFrame:
    """One row per partition: what its first key brings along, and the row after its last.

    A state holds for the next partition if that begins with the key the last one ended with.
    """
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)])
    # the state after a partition: inclusive values, also of the columns that are asked for before each row
    states = {**{o: F.col(o) for o in carry}, **{o: F.coalesce(c, o) for o, c in before.items()}}
    tails = scanned.where(_TAIL).select(
        _PART, key.alias("last"), *[c.alias(f"s_{o}") for o, c in states.items()], *[F.col(o).alias(f"s_{o}") for o in running]
    )
    following = F.struct(F.lit(True).alias("there"), *[F.col(c).alias(o) for o, c in lead.items()])
    tops = scanned.where(_TOP).select(F.col(_PART).alias("__p"), key.alias("first"), following.alias("row"))
    ends = tails.join(tops, F.col(_PART) == F.col("__p"))
    so_far = Window.partitionBy("last").orderBy(_PART).rowsBetween(Window.unboundedPreceding, 0)
    after = ends.select(
        _PART, "first", "last", "row",
        *[F.last(f"s_{o}", ignorenulls=True).over(so_far).alias(f"s_{o}") for o in (*carry, *before)],
        *[F.sum(f"s_{o}").over(so_far).alias(f"s_{o}") for o in running],
    )
    # one row per partition, and Spark has fewer partitions than this window holds
    along = Window.partitionBy(F.shiftright(_PART, MOST_PARTS_BITS)).orderBy(_PART)
    beside = after.select(
        _PART,
        F.lag(F.struct("last", *[f"s_{o}" for o in (*carry, *before, *running)])).over(along).alias("p"),
        F.lead(F.struct("first", "row")).over(along).alias("n"),
        "first", "last",
    )
    same = {"p": _same(keys, "p.last", "first"), "n": _same(keys, "n.first", "last")}
    return beside.select(
        _PART,
        *[F.when(same["p"], F.col(f"p.s_{o}")).alias(f"__in_{o}") for o in (*carry, *before, *running)],
        *[F.when(same["n"], F.col(f"n.row.{o}")).alias(f"__next_{o}") for o in lead],
    )


def _same(keys: Sequence[str], a: str, b: str) -> Column:
    result = F.col(a).isNotNull()
    for i in range(len(keys)):
        result = result & F.col(f"{a}.k{i}").eqNullSafe(F.col(f"{b}.k{i}"))
    return result


def _changes(batch: pa.RecordBatch, keys: list[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row has another key than the row before it; of the first row, than ``last``."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = last is None or any(last.column(k)[0].as_py() != batch.column(k)[0].as_py() for k in keys)
    for k in keys:
        column = batch.column(k)
        a, b = column.slice(0, len(column) - 1), column.slice(1)
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= differs | (nulls[1:] != nulls[:-1])
    return new


def _filled(column: pa.Array, begins: np.ndarray, state: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Last non-null value up to each row, and before each row; ``state`` (one value) is what the first key brings.

    ``begins`` holds the place where each row's key begins, -1 where it began earlier.
    """
    rows = np.arange(len(column))
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    until = np.maximum.accumulate(np.where(valid, rows, -1))
    earlier = np.concatenate([[-1], until[:-1]])
    values = pa.concat_arrays([state, column])

    def taken(places: np.ndarray) -> pa.Array:
        own = places >= np.maximum(begins, 0)
        brought = ~own & (begins < 0)
        return values.take(pa.array(np.where(own, places + 1, 0), mask=~(own | brought)))

    return taken(until), taken(earlier)


def _scanner(columns: list[str], keys: list[str], carry, before, lead, running):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        states: dict[str, pa.Array] = {}
        sums: dict[str, float] = {}
        last: pa.RecordBatch | None = None  # the row before the batch
        held: list | None = None  # its results, until the next row is known
        first_key = True
        names = [*columns, *carry, *before, *lead, *running, _PART, _HEAD, _TOP, _TAIL]

        def row(held: list, following: dict[str, pa.Array] | None, tail: bool) -> pa.RecordBatch:
            arrays = [
                following[n] if n in lead and following is not None else pa.nulls(1, a.type) if n in lead else a
                for n, a in zip(names, held)
            ]
            arrays[-1] = pa.array([tail])
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = _changes(batch, keys, last)
            begins = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            if held is not None:
                yield row(held, None if new[0] else {o: batch.column(c).slice(0, 1) for o, c in lead.items()}, False)
            head = np.full(n, first_key) & ((begins < 0) | (last is None) & (begins == 0))
            arrays = [batch.column(c) for c in columns]
            for some, which in ((carry, 0), (before, 1)):
                for o, c in some.items():
                    column = batch.column(c)
                    state = pa.nulls(1, column.type) if new[0] or o not in states else states[o]
                    found = _filled(column, begins, state)
                    states[o] = found[0].slice(n - 1)
                    arrays.append(found[which])
            for c in lead.values():
                column = batch.column(c)
                following = np.arange(1, n + 1)
                ends = np.append(new[1:], True)
                arrays.append(column.take(pa.array(np.where(ends, 0, following), mask=ends)))
            for o, c in running.items():
                values = pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False)
                values = values.astype(np.float64 if values.dtype.kind == "f" else np.int64)
                summed = np.cumsum(values)
                base = np.where(begins > 0, summed[np.maximum(begins - 1, 0)], 0)
                found = summed - base + np.where(begins < 0, sums.get(o, 0), 0)
                sums[o] = found[-1]
                arrays.append(pa.array(found))
            top = np.zeros(n, dtype=bool)
            top[0] = last is None
            arrays += [pa.array(np.full(n, part, dtype=np.int32)), pa.array(head), pa.array(top), pa.array(np.zeros(n, dtype=bool))]
            first_key = bool(head[-1])
            if n > 1:
                yield pa.RecordBatch.from_arrays([a.slice(0, n - 1) for a in arrays], names=names)
            held = [a.slice(n - 1) for a in arrays]
            last = batch.slice(n - 1)
        if held is not None:
            yield row(held, None, True)

    return run

"""Removal of repeated byte strings by a suffix array that is dealt over tasks.

A suffix is a place of a text and what follows; two places repeat if their suffixes share the first ``WINDOW``
bytes. Of each such string the run of ``LEAD`` bytes with the least hash is its lead, so equal strings have equal
leads at equal places. Neighbouring places with one lead are kept together as a stretch. Only leads that occur
in two places, in stretches of different content, have anything to compare; equal stretches repeat as a whole.

The suffixes to compare are range-partitioned by their leads, with splitters that Spark samples. A bucket holds
whole leads, so no lead lies across a boundary; it sorts its suffixes by multikey quicksort, eight bytes a step,
and equal neighbours repeat. A lead with more than ``CROWDED`` different stretches would fill a bucket: its
suffixes are dealt once more by two digests of their whole strings, which lets a group of any size be split and
summed up before the shuffle.

Copies of a whole text are counted, not compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerlake.llm.common import utf8
from ledgerlake.llm.phrases import rolled
from ledgerlake.workspace import written

WINDOW = 400
LEAD = 64
#: Places that are hashed at once; a place within such a segment fits the lower bits of a key.
SEGMENT = 1 << 17
PLACE_BITS = 18
#: Different stretches of one lead that are compared in one bucket, and bytes of stretches sorted at once.
CROWDED = 4_000
SORTED_BYTES = 4 << 20

_TABLES = np.random.default_rng(13).integers(0, 1 << 64, (2, 256), dtype=np.uint64)


def least_of_each(keys: np.ndarray, n: int) -> np.ndarray:
    """Least of every ``n`` keys in a row: running minima from both borders of blocks of ``n``."""
    size = -(-len(keys) // n) * n
    padded = np.full(size, np.iinfo(keys.dtype).max, dtype=keys.dtype)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, n)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: len(keys) - n + 1], forward[n - 1 : len(keys)])


def stretches(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, window: int, lead: int) -> np.ndarray:
    """Rows (hash of the lead, text, first place, last place, place of the lead) of texts that lie in a row.

    ``data`` holds the bytes of all texts, which begin and end at the given places. A string belongs to one text.
    """
    found = []
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for at in range(0, len(data) - window + 1, SEGMENT):
        part = data[at : at + SEGMENT + window - 1]
        hashes = rolled(_TABLES[0][part], lead)
        keys = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        leads = (least_of_each(keys, window - lead + 1) & mask).astype(np.int64)
        change = np.zeros(len(leads) + 1, dtype=np.int64)
        text = np.arange(np.searchsorted(ends, at, side="right"), np.searchsorted(begins, at + len(leads)))
        first, last = np.maximum(begins[text] - at, 0), np.minimum(ends[text] - window + 1 - at, len(leads))
        some = last > first
        np.add.at(change, first[some], 1)
        np.add.at(change, last[some], -1)
        own = np.where(np.cumsum(change[:-1]) > 0, leads, -1)
        cuts = np.flatnonzero(np.diff(own)) + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(own)]])
        kept = own[starts] >= 0
        starts, stops = starts[kept], stops[kept]
        whose = np.searchsorted(ends, starts + at, side="right")
        place = own[starts]
        found.append(
            np.column_stack([hashes[place].view(np.int64), whose, starts + at, stops - 1 + at, place + at])
        )
    return np.concatenate(found) if found else np.zeros((0, 5), dtype=np.int64)


_STRETCH = pa.struct(
    [("lead", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("at", pa.int32())]
)


def _measure(docs: DataFrame, window: int, lead: int) -> DataFrame:
    """Per row: the text's digest and size, and the stretches of texts that a task has not met yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            whole = [hashlib.sha256(t).digest() for t in texts]
            fresh = []
            for i, (text, digest) in enumerate(zip(texts, whole)):
                if len(text) >= window and digest not in seen:
                    seen.add(digest)
                    fresh.append(i)
            joined = b"".join([texts[i] for i in fresh])
            ends = np.cumsum([len(texts[i]) for i in fresh], dtype=np.int64)
            begins = ends - np.array([len(texts[i]) for i in fresh], dtype=np.int64)
            rows = stretches(np.frombuffer(joined, dtype=np.uint8), begins, ends, window, lead)
            digests = [xxhash.xxh3_128_digest(joined[i : j + window]) for i, j in zip(rows[:, 2].tolist(), rows[:, 3].tolist())]
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            base = begins[rows[:, 1]] if len(rows) else rows[:, 1]
            order = np.argsort(rows[:, 1], kind="stable")
            count = np.zeros(len(texts), dtype=np.int64)
            count[fresh] = np.bincount(rows[:, 1], minlength=len(fresh))[: len(fresh)]
            parts = [rows[order, 0], halves[order, 0], halves[order, 1]]
            parts += [(rows[order, k] - base[order]).astype(np.int32) for k in (2, 3, 4)]
            inner = pa.StructArray.from_arrays([pa.array(p) for p in parts], fields=list(_STRETCH))
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            columns = [batch.column(0), pa.array([w[:16] for w in whole], pa.binary()), pa.array([len(t) for t in texts], pa.int64())]
            columns += [pa.array([w.hex() for w in whole], pa.string()), pa.ListArray.from_arrays(offsets, inner)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tid", "n_bytes", "whole_sha256", "stretches"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, tid binary, n_bytes long, whole_sha256 string, "
        "stretches array<struct<lead:long,hi:long,lo:long,first:int,last:int,at:int>>"
    )
    return docs.select("doc_id", utf8()).mapInArrow(run, schema)


def _marked(measures: DataFrame) -> DataFrame:
    """Stretches whose lead occurs in two places: (tid, first, last, at, lead, whole, n).

    ``whole``: the same stretch lies in another place, so all of it repeats. ``n``: different stretches of the
    lead if this one is to be compared, else null; of equal stretches the one at the least place is compared.
    Every join is one of written tables, so Spark can split a hot lead.
    """
    each = measures.select("tid", F.inline("stretches")).withColumn("place", F.xxhash64("tid", "first"))
    counted = each.groupBy("lead").agg(F.min("place").alias("a"), F.max("place").alias("z"))
    again = written(counted.where("a <> z").select("lead"), "suffix-leads")
    some = written(each.join(again, "lead"), "suffix-stretches")
    kinds = some.groupBy("lead", "hi", "lo").agg(F.min("place").alias("a"), F.max("place").alias("z"))
    kinds = written(kinds, "suffix-kinds")
    sizes = written(kinds.groupBy("lead").agg(F.count(F.lit(1)).alias("n")), "suffix-sizes")
    sized = kinds.join(sizes, "lead")
    marked = some.join(sized, ["lead", "hi", "lo"])
    compared = (F.col("place") == F.col("a")) & (F.col("n") > 1)
    return marked.select(
        "tid", "first", "last", "at", "lead", (F.col("a") != F.col("z")).alias("whole"), F.when(compared, F.col("n")).alias("n")
    )


def _bodies(texts: DataFrame, window: int, lead: int) -> DataFrame:
    """The stretches to compare, with their bytes; a text that a task meets again gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        names = ["lead", "tid", "first", "at", "whole", "n", "body"]
        types = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for tid, text, wanted in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if tid in seen:
                    continue
                seen.add(tid)
                for w in wanted:
                    first, at = w["first"], w["at"]
                    values = (text[at : at + lead], tid, first, at - first, w["whole"], w["n"], text[first : w["last"] + window])
                    for column, value in zip(rows, values):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    schema = "lead binary, tid binary, first long, at int, whole boolean, n long, body binary"
    return texts.select("tid", utf8(), "wanted").mapInArrow(run, schema)


def equal_strings(data: bytes, places: np.ndarray, groups: np.ndarray, window: int) -> np.ndarray:
    """Which of the places have a string of ``window`` bytes that another place of their group has too.

    Multikey quicksort with eight bytes as one symbol: groups are parted by the symbol at a depth, places that are
    alone in their part are done, and the others go on to the next depth. A group that agrees isn't sorted.
    """
    symbols = np.ndarray(shape=(max(len(data) - 7, 0),), dtype=">u8", buffer=data, strides=(1,))
    alive = np.lexsort((places, groups))
    label = groups[alive]
    for depth in range(0, window, 8):
        starts = np.flatnonzero(np.diff(label, prepend=label[:1] - 1))
        sizes = np.diff(starts, append=len(label))
        alive, label = alive[np.repeat(sizes > 1, sizes)], label[np.repeat(sizes > 1, sizes)]
        if not len(alive):
            break
        symbol = symbols[places[alive] + min(depth, window - 8)].astype(np.uint64)
        differs = np.zeros(len(label), dtype=bool)
        differs[1:] = (symbol[1:] != symbol[:-1]) & (label[1:] == label[:-1])
        number = np.cumsum(np.diff(label, prepend=label[:1] - 1) != 0) - 1
        mixed = np.bincount(number, weights=differs)[number] > 0
        part = np.flatnonzero(mixed)
        order = part[np.lexsort((symbol[part], number[part]))]
        alive[part], symbol[part] = alive[order], symbol[order]
        label = np.cumsum(np.concatenate([[False], (number[1:] != number[:-1]) | (symbol[1:] != symbol[:-1])]))
    starts = np.flatnonzero(np.diff(label, prepend=label[:1] - 1))
    sizes = np.diff(starts, append=len(label))
    found = np.zeros(len(places), dtype=bool)
    found[alive[np.repeat(sizes > 1, sizes)]] = True
    return found


def _dense(bodies: list[bytes], at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the bodies, which lie in a row: whose, places, and how far before the lead they begin."""
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    count = sizes - window + 1
    whose = np.repeat(np.arange(len(bodies)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return whose, np.repeat(np.cumsum(sizes) - sizes, count) + step, np.repeat(at, count) - step


def _spans(whose: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts, as (whose, first, last)."""
    cuts = np.flatnonzero((np.diff(starts) != 1) | (np.diff(whose) != 0)) + 1
    begins, ends = np.concatenate([[0], cuts]).astype(int), np.concatenate([cuts, [len(starts)]]).astype(int) - 1
    if not len(starts):
        return whose, starts, starts
    return whose[begins], starts[begins], starts[ends]


def _bucket_repeats(bodies: DataFrame, window: int) -> DataFrame:
    """(tid, first, last) of repeated suffixes; rows come sorted by lead, and a lead is in one partition."""

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        # a text that was split off with its copies may come more than once
        rows = list({(r[1], r[2]): r for r in rows}.values())
        leads = {r[0]: 0 for r in rows}
        number = {lead: i for i, lead in enumerate(leads)}
        whose, places, before = _dense([r[5] for r in rows], np.array([r[3] for r in rows]), window)
        lead = np.array([number[r[0]] for r in rows])
        found = equal_strings(b"".join([r[5] for r in rows]), places, (lead[whose] << 32) + before, window)
        found &= ~np.array([r[4] for r in rows])[whose]
        first = np.array([r[2] + r[3] for r in rows])
        who, begins, ends = _spans(whose[found], (first[whose] - before)[found])
        arrays = [pa.array([rows[i][1] for i in who], pa.binary()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["tid", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, group = 0, 0  # bytes in all, and where the last lead begins
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if rows and row[0] != rows[-1][0]:
                    if size > SORTED_BYTES:
                        yield compare(rows)
                        rows, size = [], 0
                    group = len(rows)
                rows.append(row)
                size += len(row[5])
        if rows:
            yield compare(rows)

    ordered = bodies.select("lead", "tid", "first", "at", "whole", "body").repartitionByRange("lead").sortWithinPartitions("lead")
    return ordered.mapInArrow(run, "tid binary, first long, last long")


def _crowded_repeats(bodies: DataFrame, window: int) -> DataFrame:
    """(tid, first, last) of repeated suffixes, by two independent digests of each whole string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, first, whole, body in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                data = np.frombuffer(body, dtype=np.uint8)
                hi, lo = (rolled(table[data], window).view(np.int64) for table in _TABLES)
                n = len(hi)
                arrays = [pa.array(hi), pa.array(lo), pa.array([tid] * n, pa.binary()), pa.array(first + np.arange(n))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([whole] * n)], names=["hi", "lo", "tid", "first", "whole"])

    each = bodies.select("tid", "first", "whole", "body").mapInArrow(
        run, "hi long, lo long, tid binary, first long, whole boolean"
    )
    each = written(each, "suffix-crowded")
    place = F.xxhash64("tid", "first")
    counted = each.groupBy("hi", "lo").agg(F.min(place).alias("a"), F.max(place).alias("z"))
    again = written(counted.where("a <> z").select("hi", "lo"), "suffix-crowded-again")
    found = each.where("not whole").join(again, ["hi", "lo"])
    return found.select("tid", "first", F.col("first").alias("last"))


def merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs in order; those that touch are one."""
    order = np.argsort(begins, kind="stable")
    begins, reached = begins[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(begins), dtype=bool)
    new[1:] = begins[1:] > reached[:-1]
    return begins[new], reached[np.append(np.flatnonzero(new)[1:] - 1, len(begins) - 1)]


def _cleaned(texts: DataFrame, window: int) -> DataFrame:
    """tid, n_removed, n_spans, kept (digest) of texts with repeated strings; once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        names = ["tid", "removed", "spans", "sha256"]
        types = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for tid, text, runs in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if tid in seen:
                    continue
                seen.add(tid)
                first, last = (np.array([r[k] for r in runs], dtype=np.int64) for k in ("first", "last"))
                begins, ends = merged(first, last + window)
                kept = hashlib.sha256()
                for i, j in zip([0, *ends.tolist()], [*begins.tolist(), len(text)]):
                    kept.update(text[i:j])
                for column, value in zip(rows, (tid, int((ends - begins).sum()), len(begins), kept.hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    return texts.select("tid", utf8(), "runs").mapInArrow(run, "tid binary, removed long, spans long, sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, lead: int = LEAD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null and empty ones none. A byte is removed if a string of ``window`` bytes that covers
    it starts in another place too, in any row, the same row included; strings are those of the input.
    ``n_spans`` counts maximal removed runs; ``kept_sha256`` is of the remaining bytes. Repeated rows repeat each
    other's strings. An empty table gives no rows. Other columns are not returned.
    """
    if not 0 < lead < window or window < 8 or window >= 1 << (PLACE_BITS - 1):
        raise ValueError("a window must hold 8 bytes or more and be longer than its lead")
    keyed = docs.select("doc_id", "text", F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)).alias("tid"))
    measures = written(_measure(docs.select("doc_id", "text"), window, lead), "suffix-measures")
    marked = written(_marked(measures), "suffix-marked")
    place = F.struct("first", "last", "at", "whole", "n")
    wanted = marked.where("n is not null").groupBy("tid").agg(F.collect_set(place).alias("wanted"))
    # the lists of places are the hashed side, not the texts
    texts = keyed.select("tid", "text").join(wanted.hint("shuffle_hash"), "tid")
    bodies = written(_bodies(texts, window, lead), "suffix-bodies")
    repeats = _bucket_repeats(bodies.where(F.col("n") <= CROWDED), window)
    repeats = repeats.unionByName(_crowded_repeats(bodies.where(F.col("n") > CROWDED), window))
    whole = marked.where("whole").select("tid", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
    runs = repeats.unionByName(whole).groupBy("tid").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    cleaned = _cleaned(keyed.select("tid", "text").join(runs.hint("shuffle_hash"), "tid"), window)
    copies = measures.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"))
    results = written(copies.join(cleaned.dropDuplicates(["tid"]), "tid", "left"), "suffix-results")
    rows = measures.drop("stretches").join(results, "tid")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= window)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha256", "whole_sha256")).alias("kept_sha256"),
    )

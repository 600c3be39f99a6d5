"""Benchmark decontamination by suffix arrays over the training texts.

The training texts are met in shards of bounded size. Each shard gets a suffix array over its words;
every benchmark suffix is binary-searched in it, which gives all places where a window of the suffix
occurs verbatim. Matches that go on from window to window are joined to longest matches with their
places. The benchmark is met in blocks of bounded size, each sent to the tasks once.

A shard's array leaves out the suffixes that cannot match any window: those that meet a word unknown
to the benchmark block within the shortest window. That is exact, and keeps the sort small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlake.llm.common import aside, utf8

WINDOW = 10
#: Words of a shard, and characters of the benchmark that one pass sends to every task.
SHARD_WORDS = 1_000_000
BLOCK_CHARS = 8_000_000

# A-Z become a-z, other ASCII characters than letters and digits become spaces, the rest stays
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)

RESULT = (
    "n_words long, spans array<struct<start:long,end:long>>, "
    "matches array<struct<item_id:long,item_start:long,start:long,length:long>>"
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of letters, digits and non-ASCII characters."""
    return text.translate(_TABLE).split() if text else []


class Queries:
    """One block of the benchmark: its words as numbers, and one entry per suffix that holds a window."""

    def __init__(self, items: list[tuple[int, bytes | None]], window: int):
        self.numbers: dict[bytes, int] = {}
        words, ids, places, sizes = [], [], [], []
        for item_id, text in items:
            coded = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            if not coded:
                continue
            size = min(window, len(coded))
            for i in range(len(coded) - size + 1):
                words.append(coded[i : i + size] + [0] * (window - size))
                ids.append(item_id)
                places.append(i)
                sizes.append(size)
        self.words = np.array(words, dtype=np.int32).reshape(-1, window)
        self.ids = np.array(ids, dtype=np.int64)
        self.places = np.array(places, dtype=np.int64)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.least = int(self.sizes.min()) if len(sizes) else 0


def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the ``depth`` words that follow them; ``words`` ends with ``depth`` zeros.

    Prefix doubling on ranks of all places: after a round, ranks order by twice as many words.
    """
    rank, length = words.astype(np.int64), 1
    top = int(rank.max(initial=0)) + 1
    while length < depth:
        step = min(length, depth - length)
        pair = rank * top
        pair[: len(rank) - step] += rank[step:]
        _, rank = np.unique(pair, return_inverse=True)
        top, length = int(rank.max(initial=0)) + 1, length + step
    return starts[np.argsort(rank[starts], kind="stable")]


def _bounds(words: np.ndarray, array: np.ndarray, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """First and last place in the suffix array of the suffixes that begin with each window."""
    window = queries.words.shape[1]
    columns = np.arange(window)
    used = columns[None, :] < queries.sizes[:, None]
    found = []
    for upper in (False, True):
        low = np.zeros(len(queries.ids), dtype=np.int64)
        high = np.full(len(queries.ids), len(array), dtype=np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            sign = np.where(used[open_], words[array[mid][:, None] + columns].astype(np.int64) - queries.words[open_], 0)
            first = (sign != 0).argmax(axis=1)
            order = sign[np.arange(len(open_)), first]
            below = order <= 0 if upper else order < 0
            low[open_[below]] = mid[below] + 1
            high[open_[~below]] = mid[~below]
        found.append(low)
    return found[0], found[1]


def _shard(texts: list[list[bytes]], queries: Queries) -> tuple[list[list], list[list]]:
    """Hit spans and longest matches of each text of a shard."""
    window = queries.words.shape[1]
    get = queries.numbers.get
    coded, begins = [], []
    for words in texts:
        begins.append(len(coded))
        coded.extend([get(w, 0) for w in words])
        coded.append(0)  # no match crosses two texts
    begin = np.array(begins, dtype=np.int64)
    words = np.array(coded + [0] * window, dtype=np.int32)
    spans: list[list] = [[] for _ in texts]
    matches: list[list] = [[] for _ in texts]
    zeros = np.concatenate(([0], np.cumsum(words == 0)))
    starts = np.flatnonzero(zeros[queries.least : len(coded) + queries.least] == zeros[: len(coded)])
    if not len(starts):
        return spans, matches
    # only runs of known words take part in the sort
    keep = np.zeros(len(words), dtype=bool)
    for i in range(window):
        keep[np.minimum(starts + i, len(words) - 1)] = True
    place = np.flatnonzero(keep)
    gap = np.flatnonzero(np.diff(place, prepend=-2) > 1)
    packed_at = np.insert(place, gap, -1)
    packed = np.concatenate((np.where(packed_at < 0, 0, words[packed_at]), np.zeros(window, dtype=np.int32)))
    where = np.full(len(words), -1, dtype=np.int64)
    where[packed_at[packed_at >= 0]] = np.flatnonzero(packed_at >= 0)
    array = suffix_array(packed, where[starts], window)
    low, high = _bounds(packed, array, queries)
    count = high - low
    if not count.any():
        return spans, matches
    which = np.repeat(np.arange(len(count)), count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    at = packed_at[array[rows]]
    size, item, item_at = queries.sizes[which], queries.ids[which], queries.places[which]
    # longest matches: windows of one item that go on from place to place
    order = np.lexsort((at, at - item_at, item))
    a, i, p, s = at[order], item[order], item_at[order], size[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (i[1:] != i[:-1]) | (a[1:] - p[1:] != a[:-1] - p[:-1]) | (a[1:] != a[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    of = np.searchsorted(begin, a[first], side="right") - 1
    ends = a[last] + s[last]
    for d, item_id, item_start, start, end in zip(of, i[first], p[first], a[first], ends):
        base = int(begins[d])
        matches[d].append(
            {"item_id": int(item_id), "item_start": int(item_start), "start": int(start) - base, "length": int(end - start)}
        )
    for d, found in enumerate(matches):
        for start, end in sorted((m["start"], m["start"] + m["length"]) for m in found):
            if spans[d] and start <= spans[d][-1]["end"]:
                spans[d][-1]["end"] = max(spans[d][-1]["end"], end)
            else:
                spans[d].append({"start": start, "end": end})
    return spans, matches


def _pass(docs: DataFrame, items: list[tuple[int, bytes | None]], window: int) -> DataFrame:
    carried = [c for c in docs.columns if c != "__bytes"]
    shape = docs.select(*carried)
    block = docs.sparkSession.sparkContext.broadcast(items)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema.fields) + ", " + RESULT
    result = pa.schema(
        [
            ("n_words", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("matches", pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "item_start", "start", "length")]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(block.value, window)
        for batch in batches:
            texts = [words_of(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) <= SHARD_WORDS):
                    size += len(texts[end])
                    end += 1
                some = texts[begin:end]
                spans, matches = _shard(some, queries) if queries.least else ([[]] * len(some), [[]] * len(some))
                kept = [batch.column(i).slice(begin, end - begin) for i in range(batch.num_columns - 1)]
                made = [pa.array([len(t) for t in some], result.field(0).type)]
                made += [pa.array(v, f.type) for v, f in zip((spans, matches), list(result)[1:])]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*carried, *result.names])
                begin = end

    return shape.withColumn("__bytes", utf8()).mapInArrow(run, schema)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes | None]]]:
    """The benchmark's items in blocks of at most ``BLOCK_CHARS`` characters (or one item)."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", utf8().alias("b")).distinct()
    block, size = [], 0
    for item_id, text in items.orderBy("item_id", "b").toLocalIterator():
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((item_id, bytes(text)))
        size += len(text)
    yield block


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, ``spans`` (hit words, half open) and ``matches`` (longest verbatim matches).

    A match names item_id, the item's word it begins with, the document's word, and its length. Items
    with fewer words than ``window`` match as a whole; items without words, text or id match nothing.
    Null and empty texts have no words. Repeated rows each get the same result. Columns of ``docs`` are
    kept; one named n_words, spans or matches is replaced. Later blocks of a large benchmark read the
    result of the earlier ones, so each adds one pass.
    """
    clean = docs.select(*[c for c in docs.columns if c not in ("n_words", "spans", "matches", "__bytes")])
    result = None
    for items in _blocks(benchmark):
        if result is None:
            result = _pass(clean, items, window)
            continue
        earlier = result.select(*clean.columns, F.col("spans").alias("__spans"), F.col("matches").alias("__matches"))
        result = _pass(earlier, items, window).select(
            *clean.columns,
            "n_words",
            _merged(F.concat("__spans", "spans")).alias("spans"),
            F.concat("__matches", "matches").alias("matches"),
        )
    return result


def _merged(spans):
    """Overlapping or touching spans become one."""
    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        touches = (F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["end"])
        head = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(touches, F.concat(head, F.array(joined))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:bigint,end:bigint>>"), add)


def report(found: DataFrame) -> DataFrame:
    """Per row of ``matches``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    return aside(docs, lambda d: matches(d, benchmark, window).where(F.size("spans") == 0))

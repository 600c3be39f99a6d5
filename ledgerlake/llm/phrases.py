"""Removal of repeated passages by sharded phrase automata.

A window of ``WINDOW`` words that starts in two places holds the same phrases in both. Of every window
the phrase with the least hash is sampled, so equal windows sample the same phrase at the same place.
Phrases sampled in two places or more are candidates; the others prove their windows to be unique.

Candidates are dealt into shards by the text that holds them first. A shard's phrases are compiled into
an Aho-Corasick automaton, and the candidate passages of all documents that share them stream through
it, which confirms the phrases verbatim and locates every occurrence. The windows around located
phrases are counted by a hash of their words, and the words they cover are removed.

Copies of a whole text are counted, not compared: a text that occurs twice repeats all its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerlake.llm.common import utf8
from ledgerlake.workspace import written

WINDOW = 35
PHRASE = 10
#: Candidate phrases that a shard's automaton is meant to hold, and passages that one task streams through it.
SHARD_PHRASES = 4_000
SHARD_PASSAGES = 4_000
KEPT_WORDS = 300_000

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class WordHashes:
    """64-bit hashes of words; a task keeps those of the words it has met, up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` hashes, mixed in all bits."""
    total, length, part, size = None, 0, hashes, 1
    while True:
        if n & size:
            if total is None:
                total, length = part, size
            else:
                m = len(part) - length
                total = total[:m] + np.uint64(pow(_BASE, length, 1 << 64)) * part[length:]
                length += size
        if length == n:
            break
        part = part[: len(part) - size] + np.uint64(pow(_BASE, size, 1 << 64)) * part[size:]
        size *= 2
    total = total ^ (total >> np.uint64(33))
    total = total * np.uint64(0xFF51AFD7ED558CCD)
    return total ^ (total >> np.uint64(29))


def sampled(hashes: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all phrases, and for each window the place of its phrase with the least hash."""
    grams = rolled(hashes, phrase)
    among = np.lib.stride_tricks.sliding_window_view(grams, window - phrase + 1)
    return grams, among.argmin(axis=1) + np.arange(len(among))


def _identity():
    """Two digests that name a text; equal texts have equal ones."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text).alias("tid"), F.crc32(text.cast("binary")).alias("tid2")


def _measure(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """Per row: identity, n_words, whole_sha256, and the sampled phrases of texts a task has not met yet."""
    phrases = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            sizes, digests, found = [], [], []
            for tid, text in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                words = text.split() if text else []
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) < window or tid in seen:
                    found.append([])
                    continue
                seen.add(tid)
                grams, chosen = sampled(hashes(words), window, phrase)
                places = np.unique(chosen)
                found.append([{"hash": h, "pos": p} for h, p in zip(grams[places].view(np.int64).tolist(), places.tolist())])
            columns = [batch.column(i) for i in range(3)]
            made = [pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(found, phrases)]
            names = ["doc_id", "tid", "tid2", "n_words", "whole_sha256", "phrases"]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, tid long, tid2 long, n_words long, whole_sha256 string, "
        "phrases array<struct<hash:long,pos:int>>"
    )
    return docs.select("doc_id", *_identity(), utf8()).mapInArrow(run, schema)


def _passages(texts: DataFrame, shards: int, window: int, phrase: int) -> DataFrame:
    """The candidate passages of ``texts`` by shard, and in the text that holds them first, the phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for tid, tid2, text, candidates in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                words = text.split()
                _, chosen = sampled(hashes(words), window, phrase)
                shard_at = np.full(len(words), -1, dtype=np.int64)
                own: dict[int, set[bytes]] = {}
                for candidate in candidates:
                    pos, first = candidate["pos"], candidate["first"]
                    shard_at[pos] = first % shards
                    if first == tid:
                        own.setdefault(first % shards, set()).add(b" ".join(words[pos : pos + phrase]))
                for shard, held in own.items():
                    for column, value in zip(rows, (shard, 0, tid, tid2, 0, b"\n".join(sorted(held)))):
                        column.append(value)
                shard_of = shard_at[chosen]
                cuts = np.flatnonzero(np.diff(shard_of)) + 1
                for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard_of)]):
                    if shard_of[begin] >= 0:
                        passage = b" ".join(words[begin : end + window - 1])
                        for column, value in zip(rows, (int(shard_of[begin]), 1, tid, tid2, begin, passage)):
                            column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["shard", "kind", "tid", "tid2", "start", "passage"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    schema = "shard long, kind int, tid long, tid2 long, start long, passage binary"
    return texts.select("tid", "tid2", utf8(), "candidates").mapInArrow(run, schema)


def automaton(phrases: Iterable[bytes]) -> ahocorasick.Automaton:
    """An automaton that finds the phrases at word borders; bytes stand as characters."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for phrase in phrases:
        found.add_word(f" {phrase.decode('latin-1')} ", len(phrase))
    found.make_automaton()
    return found


def located(machine: ahocorasick.Automaton, passage: bytes, words: list[bytes]) -> np.ndarray:
    """Whether a phrase begins at each word of the passage, whose words are joined by single spaces."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begins = np.cumsum(sizes + 1) - sizes - 1
    at = np.zeros(len(words), dtype=bool)
    if len(machine):
        found = [end - size - 1 for end, size in machine.iter(f" {passage.decode('latin-1')} ")]
        at[np.searchsorted(begins, found)] = True
    return at


def _windows(dealt: DataFrame, window: int, phrase: int) -> DataFrame:
    """Hash and place of every window whose sampled phrase the shard's automaton finds in its passage.

    Partitions come sorted by (shard, part, kind): the phrases of a shard before its passages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, now, phrases, machine = WordHashes(), None, set(), None
        for batch in batches:
            made: list[list[np.ndarray]] = [[], [], [], []]
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for shard, part, kind, tid, tid2, start, passage in zip(*columns):
                if (shard, part) != now:
                    now, phrases, machine = (shard, part), set(), None
                if kind == 0:
                    phrases.update(passage.split(b"\n"))
                    continue
                if machine is None:
                    machine = automaton(phrases)
                words = passage.split(b" ")
                coded = hashes(words)
                _, chosen = sampled(coded, window, phrase)
                sure = np.flatnonzero(located(machine, passage, words)[chosen])
                made[0].append(rolled(coded, window)[sure].view(np.int64))
                made[1].append(np.full(len(sure), tid, dtype=np.int64))
                made[2].append(np.full(len(sure), tid2, dtype=np.int64))
                made[3].append(sure + start)
            if made[0]:
                arrays = [pa.array(np.concatenate(c)) for c in made]
                yield pa.RecordBatch.from_arrays(arrays, names=["hash", "tid", "tid2", "start"])

    return dealt.mapInArrow(run, "hash long, tid long, tid2 long, start long")


def repeated_windows(docs: DataFrame, measures: DataFrame, window: int, phrase: int) -> tuple[DataFrame, DataFrame]:
    """Texts that hold candidates (tid, tid2, text, ...), and rows (tid, tid2, starts) of repeated windows."""
    by_row = measures.groupBy("tid", "tid2", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("tid", "tid2")
    alike = F.coalesce(F.min_by("n", "doc_id"), F.max("n"))  # rows that have the least id, or none have one
    texts = by_row.agg(F.min("doc_id").alias("least"), alike.alias("alike"))
    places = measures.select("tid", F.explode("phrases").alias("p")).select("tid", F.col("p.hash").alias("hash"), F.col("p.pos").alias("pos"))
    place = F.xxhash64("tid", "pos")
    counted = places.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("z"), F.min("tid").alias("first"))
    again = counted.where("a <> z").select("hash", "first")
    flagged = places.join(again, "hash").groupBy("tid").agg(F.collect_set(F.struct("pos", "first")).alias("candidates"))
    # the row with the least id stands for its text; the hashed side holds the candidates, not the texts
    wanted = flagged.join(texts, "tid").withColumnsRenamed({"tid": "w_tid", "tid2": "w_tid2"}).hint("shuffle_hash")
    keyed = docs.select("doc_id", "text", *_identity())
    same = (F.col("tid") == F.col("w_tid")) & (F.col("tid2") == F.col("w_tid2")) & F.col("doc_id").eqNullSafe(F.col("least"))
    found = written(keyed.join(wanted, same).select("tid", "tid2", "text", "candidates", "alike"), "phrase-texts")
    # fully repeated rows share the least id: one of them stays, and no other text is shuffled for it
    once = found.where("alike > 1").dropDuplicates(["tid", "tid2"])
    held = found.where("alike = 1").unionByName(once).drop("alike")
    n_phrases = held.agg(F.coalesce(F.sum(F.size("candidates")), F.lit(0))).first()[0]
    shards = max(1, n_phrases // (2 * SHARD_PHRASES))
    rows = written(_passages(held, shards, window, phrase), "phrase-passages")
    counts = rows.where("kind = 1").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / SHARD_PASSAGES).cast("int")
    sized = rows.join(counts.select("shard", parts.alias("parts")), "shard")
    own = F.array(F.pmod(F.xxhash64("tid", "start"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = sized.select(
        "shard", F.explode(F.when(F.col("kind") == 0, every).otherwise(own)).alias("part"), "kind", "tid", "tid2", "start", "passage"
    )
    dealt = dealt.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    windows = written(_windows(dealt, window, phrase), "phrase-windows")
    place = F.xxhash64("tid", "tid2", "start")
    counted = windows.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("z"))
    repeated = windows.join(counted.where("a <> z").select("hash"), "hash")
    return held, repeated.groupBy("tid", "tid2").agg(F.collect_set("start").alias("starts"))


def _cleaned(texts: DataFrame, window: int) -> DataFrame:
    """tid, tid2, n_removed, kept (the words that stay, joined by spaces) of texts with repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.split()
                change = np.zeros(len(words) + 1, dtype=np.int64)
                begins = np.array(starts, dtype=np.int64)
                np.add.at(change, begins, 1)
                np.add.at(change, begins + window, -1)
                stays = np.cumsum(change[:-1]) == 0
                removed.append(int(len(words) - stays.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stays)]))
            arrays = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["tid", "tid2", "n_removed", "kept"])

    chosen = texts.select("tid", "tid2", utf8(), "starts")
    return chosen.mapInArrow(run, "tid long, tid2 long, n_removed long, kept binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    Words are runs of anything but ASCII white space. A word is removed if a window of ``window`` words
    that covers it starts in another place too, in any row, the same row included; windows are those of
    the input. ``kept_sha256`` is of the kept words joined by one space. Null and empty texts have no
    words. Repeated rows repeat each other's windows. Other columns are not returned.
    """
    if not 0 < phrase < window:
        raise ValueError("a phrase must be shorter than a window")
    measures = written(_measure(docs.select("doc_id", "text"), window, phrase), "phrase-measures")
    held, starts = repeated_windows(docs, measures, window, phrase)
    copies = measures.groupBy("tid", "tid2").agg(F.count(F.lit(1)).alias("copies"))
    cleaned = _cleaned(held.join(starts, ["tid", "tid2"]), window)
    results = cleaned.select("tid", "tid2", F.col("n_removed").alias("removed"), F.sha2("kept", 256).alias("sha256"))
    texts = written(copies.join(results, ["tid", "tid2"], "left"), "phrase-results")
    rows = measures.drop("phrases").join(texts, ["tid", "tid2"])
    copied = (F.col("copies") > 1) & (F.col("n_words") >= window)
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha256", "whole_sha256")).alias("kept_sha256"),
    )

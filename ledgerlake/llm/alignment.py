"""Alignment of the tokens of two tokenizers by coalesced byte intervals.

Tokens of both are byte intervals of one string. Sorted by start, with the running maximum of the ends, a group
begins where a start reaches that maximum; inside a group every pair that overlaps is a link.

Neither tokenizer has a token that goes on from anything but white space into a space or a line end, so a text is
cut there into atoms, whose tokens are those of the text. A worker keeps the aligned atoms it has met, and
aligns new ones many at a time.

One scan of the texts writes each document's figures and its linked pairs of ids. The pairs are counted over all
documents, and the counts are summed over each document's pairs.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlake.llm.tokens import byte_table, load, of_worker
from ledgerlake.workspace import written

#: Atoms that a worker keeps, and characters of an atom that is kept.
KEPT_ATOMS = 400_000
KEPT_CHARS = 64
#: Atoms that are aligned at once, and texts that are described at once.
ATOMS = 4_096
TEXTS = 200
#: Counted pairs that go to every task as one table (17 bytes each); with more of them they are joined instead.
SHIPPED_PAIRS = 4_000_000

_CUT = re.compile(r"(?<=\S)(?=[ \n])")


class ByteLevel:
    """Tokenizer A, and the bytes of each of its ids."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.tokenizer.encode_special_tokens = True
        table = byte_table()
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(table[c] for c in n) if all(c in table for c in n) else n.encode() for n in names]

    def __call__(self, text: str) -> list[int]:
        """Ids of the text itself."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """Tokenizer B, which puts a space before a text, and the bytes of each of its ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.tokenizer.id_to_piece(i) for i in range(self.tokenizer.get_piece_size())]
        self.space = self.tokenizer.piece_to_id("▁")
        self.bytes = [
            bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode()
            for n in names
        ]

    def __call__(self, text: str) -> list[int]:
        """Ids of a text as if no space were put before it; one that begins with a space has that one."""
        if text[0] != " ":
            ids = self.tokenizer.encode(text)
            return ids[1:] if ids[:1] == [self.space] else []
        return self.tokenizer.encode(text[1:]) if len(text) > 1 else [self.space]


def coalesce(sizes_a: np.ndarray, sizes_b: np.ndarray, begins_a: np.ndarray, begins_b: np.ndarray):
    """Group of each token and linked pairs of tokens, from the sizes and starts of both sides.

    All intervals are sorted by start. A group breaks where a start reaches the running maximum of the ends;
    links are the overlapping intervals of different sides.
    """
    n_a = len(sizes_a)
    starts = np.concatenate([begins_a, begins_b])
    ends = starts + np.concatenate([sizes_a, sizes_b])
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), dtype=np.int64)
    breaks[1:] = starts[order][1:] >= reached[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(breaks) - 1
    first = np.searchsorted(ends[n_a:], starts[:n_a], side="right")
    last = np.searchsorted(starts[n_a:], ends[:n_a], side="left")
    count = np.maximum(last - first, 0)
    a = np.repeat(np.arange(n_a), count)
    b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return group[:n_a], group[n_a:], a, b


class Atoms:
    """Aligned atoms by slot: counts, shown groups, and linked pairs of ids, one after the other."""

    def __init__(self):
        self.counts = np.zeros((4, 0), dtype=np.int64)  # n_a, n_b, n_groups, n_links
        self.shown: list[str] = []
        self.pairs = np.zeros(0, dtype=np.int64)
        self.ends = np.zeros(0, dtype=np.int64)  # of each atom's pairs

    def add(self, counts: np.ndarray, shown: list[str], pairs: np.ndarray) -> None:
        self.counts = np.concatenate([self.counts, counts], axis=1)
        self.shown += shown
        self.pairs = np.concatenate([self.pairs, pairs])
        self.ends = np.concatenate([self.ends, len(self.pairs) - len(pairs) + np.cumsum(counts[3])])


#: Slots of words that are no atoms on their own, and of atoms whose tokens have other bytes.
ODD, OTHER = -1, -2


class Aligner:
    """Texts as slots of aligned atoms; a pair of ids is a number of 64 bits, A's id in the upper half."""

    def __init__(self, paths: tuple[str, str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = ByteLevel(paths[0]), Pieces(paths[1])
        self.sizes = [np.array([len(x) for x in side.bytes]) for side in (self.a, self.b)]
        self.names = [np.array([str(i) for i in range(len(x))], dtype=object) for x in self.sizes]
        self.known: dict[str, int] = {}
        self.atoms = Atoms()

    def hold(self, words: set[str]) -> dict[str, int]:
        """Slots of all ``words``; those of earlier calls are dropped when there are too many."""
        if len(self.known) > KEPT_ATOMS:
            self.known, self.atoms = {}, Atoms()
        new = [w for w in words if w not in self.known]
        # words that begin or end in other white space than line ends before them have other tokens on their own
        odd = [not w or w[-1].isspace() and w.strip("\n") != "" or w.lstrip("\n")[:1].isspace() for w in new]
        self.known.update((w, ODD) for w, o in zip(new, odd) if o)
        plain = [w for w, o in zip(new, odd) if not o]
        for begin in range(0, len(plain), ATOMS):
            some = plain[begin : begin + ATOMS]
            self.known.update(zip(some, self.align([w if w[0] == "\n" else " " + w for w in some], self.atoms)))
        return self.known

    def align(self, atoms: list[str], into: Atoms) -> list[int]:
        """Slots of new atoms in ``into``. Each begins with a space or a line end.

        Atoms that end in something else are tokenized in a row, as they are cut where a text may be cut.
        """
        joined = [x for x in atoms if not x[-1].isspace()]
        text = "".join(joined)
        ids = [np.array(side(text) if text else [], dtype=np.int64) for side in (self.a, self.b)]
        if any(self._bytes(side, i) != text.encode() for side, i in zip((self.a, self.b), ids)):
            return [self._one(x, into) for x in atoms]
        slots = iter(self._place(joined, ids, into))
        return [self._one(x, into) if x[-1].isspace() else next(slots) for x in atoms]

    @staticmethod
    def _bytes(side: ByteLevel | Pieces, ids) -> bytes:
        return b"".join([side.bytes[i] for i in ids])

    def _one(self, atom: str, into: Atoms) -> int:
        ids = [np.array(side(atom), dtype=np.int64) for side in (self.a, self.b)]
        if any(self._bytes(side, i) != atom.encode() for side, i in zip((self.a, self.b), ids)):
            return OTHER
        return self._place([atom], ids, into)[0]

    def _place(self, atoms: list[str], ids: list[np.ndarray], into: Atoms) -> range:
        if not atoms:
            return range(0)
        border = np.cumsum([len(x.encode()) for x in atoms])
        size_a, size_b = (sizes[i] for sizes, i in zip(self.sizes, ids))
        begin_a, begin_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        group_a, group_b, a, b = coalesce(size_a, size_b, begin_a, begin_b)
        ends = [np.searchsorted(begins, border) for begins in (begin_a, begin_b)]
        end_group = np.append(group_a, group_a[-1] + 1)[ends[0] - 1] + 1
        end_link = np.searchsorted(a, ends[0])
        counts = np.array([np.diff(e, prepend=0) for e in (*ends, end_group, end_link)])
        # all groups in a row: ids of A, ids of B, with the marks between them
        side = np.repeat([0, 1], [len(group_a), len(group_b)])
        group = np.concatenate([group_a, group_b])
        order = np.lexsort((side, group))
        shown = np.concatenate([names[i] for names, i in zip(self.names, ids)])[order]
        within = group[order][1:] == group[order][:-1]
        marks = np.full(len(order), ";", dtype=object)
        marks[:-1][within] = np.where(side[order][1:] == side[order][:-1], ",", "|")[within]
        places = np.cumsum([len(x) + 1 for x in shown])
        last = np.searchsorted(group[order], end_group) - 1
        text = "".join(itertools.chain.from_iterable(zip(shown, marks)))
        cuts = places[last].tolist()
        first = len(into.shown)
        into.add(counts, [text[i : j - 1] for i, j in zip([0, *cuts], cuts)], (ids[0][a] << 32) | ids[1][b])
        return range(first, first + len(atoms))

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[Atoms, np.ndarray]]:
        """For each text the slots of its atoms in order; none if it has no tokens."""
        rows = [split(t) if t else [] for t in texts]
        words = set(itertools.chain.from_iterable(rows))
        long = {w for w in words if len(w) > KEPT_CHARS}
        known = self.hold(words - long)
        for text, row in zip(texts, rows):
            slots = [known.get(w, ODD) for w in row] if long else [known[w] for w in row]
            atoms = self.atoms
            if ODD in slots:
                atoms = Atoms()
                slots = self.align(_CUT.split(" " + text), atoms)
            yield atoms, np.array([] if OTHER in slots else slots, dtype=np.int64)


def split(text: str) -> list[str]:
    """Words between spaces; the first of a line keeps the line ends before it. Empty words are odd."""
    if text[0] == "\n":
        return [""]
    words: list[str] = []
    before = ""
    for line in text.split("\n"):
        if not line:
            before += "\n"
            continue
        some = line.split(" ")
        some[0] = before + some[0]
        before = "\n"
        words += some
    if len(before) > 1:
        words.append(before[1:])
    return words


def _linked(described: list[tuple[Atoms, np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text: its different pairs, and how often each is linked."""
    pairs, times = [], []
    for atoms, slots in described:
        ends = atoms.ends[slots]
        count = atoms.counts[3][slots]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends - count, count)
        found, n = np.unique(atoms.pairs[at], return_counts=True)
        pairs.append(found)
        times.append(n)
    return pairs, times


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


_NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_FIGURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned(docs: DataFrame, tokenizers: tuple[str, str]) -> DataFrame:
    """Figures of every row, and its different linked pairs with how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = of_worker(Aligner, tokenizers)
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                part = batch.slice(begin, TEXTS)
                described = list(align(part.column(1).to_pylist()))
                totals = np.array([atoms.counts[:, slots].sum(axis=1) for atoms, slots in described])
                shown = [";".join([atoms.shown[i] for i in slots]) for atoms, slots in described]
                digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in shown]
                pairs, times = _linked(described)
                columns = [*[pa.array(c) for c in totals.T], pa.array(digests, pa.string())]
                columns += [_lists(pairs, pa.int64()), _lists(times, pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *_NAMES, "pairs", "times"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {_FIGURES}, pairs array<long>, times array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows a pair of ids is linked, and whether no pair of its A id is in more.

    Tasks count first, so a pair that is in every row is one row of each task in the shuffle.
    """
    counted = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counted.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    most = written(counts.groupBy("a").agg(F.max("n").alias("most")), "pair-most")
    return written(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def _shipped(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Every row with its sums; the counted pairs, a checked number of them, go to the tasks as one table."""
    table = counts.orderBy("pair").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(tuple(table.column(i).to_numpy() for i in range(3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = shared.value
        for batch in batches:
            pairs, times = batch.column(6), batch.column(7)
            row = np.repeat(np.arange(len(pairs)), np.diff(pairs.offsets.to_numpy()))
            at = np.searchsorted(known, pairs.flatten().to_numpy())
            often = times.flatten().to_numpy().astype(np.int64)
            n_best, total = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
            np.add.at(n_best, row, often * best[at])
            np.add.at(total, row, often * counts[at])
            columns = [*[batch.column(i) for i in range(6)], pa.array(n_best), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_NAMES, "n_best", "count_sum"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    given = rows.select("doc_id", *_NAMES, "pairs", "times")
    return given.mapInArrow(run, f"doc_id {id_type}, {_FIGURES}, n_best long, count_sum long")


def _joined(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Every row with its sums; the pairs of each row meet the counted pairs in a join."""
    keyed = written(rows.withColumn("__row", F.monotonically_increasing_id()), "aligned-rows")
    each = keyed.select("__row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    sums = each.join(counts, "pair").groupBy("__row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return keyed.join(sums, "__row", "left").select("doc_id", *_NAMES, *zero)


def align_tokens(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row of ``docs``.

    ``a`` is a byte-level tokenizer file, ``b`` a model of pieces; A encodes a space and the text, B the text.
    Texts that are null or empty, or whose tokens' bytes aren't a space and the text in both, have zeros and
    an empty ``groups_sha256``. Repeated rows and rows without an id count as documents of their own. An empty
    table gives no rows. Other columns are not returned.
    """
    rows = written(aligned(docs, (a, b)), "aligned")
    counts = pair_counts(rows)
    return _joined(rows, counts) if counts.count() > SHIPPED_PAIRS else _shipped(rows, counts)

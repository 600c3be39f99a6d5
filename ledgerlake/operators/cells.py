"""An index of vectors in coarse cells, with residual product codes.

Cells are the clusters of a distributed k-means over unit vectors. A vector is stored with its cell and a code:
its difference from the cell's centre, cut into short parts, each named by the nearest entry of that part's
codebook. The table of vectors is bucketed by cell, so vectors are shuffled once, when the index is built; a
search shuffles queries only. Queries never pass through the driver.

Approximate search scans the codes of the cells nearest to a query and scores those items exactly whose coded
score reaches the query's floor. Exact search scans every cell that the angle between query and centre and the
cell's radius can't rule out.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ledgerlake.operators.ranking import SCORE_DIGITS, by_score, top_k
from ledgerlake.operators.vectors import RECALL, given, ids_of, nearest, unit_rows
from ledgerlake.workspace import new_folder, written

#: Most cells, and vectors that cells and codebooks are trained on (twice as many at most). The centres and the
#: sample of a model go to every task: 64 MB at 1,024 dimensions.
MOST_CELLS = 4_096
TRAINED = 20_000
ROUNDS = 8
#: Numbers of a vector that one byte of its code stands for, and entries of a codebook.
PART = 4
ENTRIES = 256
#: Vectors of a cell that one task holds, and queries that meet the index at once.
SPLIT_ROWS = 16_384
QUERY_ROWS = 65_536
#: Vectors that floors are taken from, and the share of them that lies above a query's floor.
SAMPLE = 4_096
SCORED = 0.05
#: Queries and hits that the number of probed cells is measured on.
MEASURED = 256
#: Queries that are scored at once, rows of probed cells that are made at once, pairs that are scored exactly at once.
SLICE = 256
PROBED_ROWS = 65_536
PAIRS = 65_536

_UNIT = 10**SCORE_DIGITS
_FOUND = "query_id string, item_id string, score double, scanned long, scored long"


@dataclass(frozen=True)
class Model:
    """What tasks need to place and score: all of it of bounded size."""

    centres: np.ndarray  # cells x dimensions
    radii: np.ndarray  # largest angle between a cell's centre and its vectors
    splits: np.ndarray  # tasks a cell is dealt over
    codebooks: np.ndarray  # parts x entries x PART
    sample: np.ndarray  # unit vectors of items
    items: int

    def padded(self, rows: np.ndarray) -> np.ndarray:
        """Rows cut into parts; the last one is filled with zeros."""
        parts = self.codebooks.shape[0]
        wide = np.zeros((len(rows), parts * PART))
        wide[:, : rows.shape[1]] = rows
        return wide.reshape(len(rows), parts, PART)

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centre of each row, and the angle to it."""
        cells = (unit @ self.centres.T - (self.centres**2).sum(axis=1) / 2).argmax(axis=1)
        return cells, _angles((unit * _units(self.centres)[cells]).sum(axis=1))

    def encode(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = self.padded(unit - self.centres[cells])
        codes = np.empty(rest.shape[:2], dtype=np.uint8)
        for p, book in enumerate(self.codebooks):
            codes[:, p] = (rest[:, p] @ book.T - (book**2).sum(axis=1) / 2).argmax(axis=1)
        return codes

    def coded_scores(self, unit: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines (queries x items of one cell) by table look-up."""
        tables = np.einsum("qpd,ped->pqe", self.padded(unit), self.codebooks)
        scores = np.repeat((unit @ self.centres[cell])[:, None], len(codes), axis=1)
        for p, table in enumerate(tables):
            scores += table[:, codes[:, p]]
        return scores


def _units(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


# training


def _train_centres(train: DataFrame, n: int) -> np.ndarray:
    """About one cell per root of the number of items, by distributed k-means."""
    cells = int(min(MOST_CELLS, max(1, round(math.sqrt(n)))))
    points = train.select(array_to_vector("unit").alias("features"))
    if cells == 1:
        return np.array(train.select("unit").first()[0])[None, :]
    fitted = KMeans(k=cells, maxIter=ROUNDS, seed=7, initMode="random").fit(points)
    return np.array(fitted.clusterCenters())


def _train_codebooks(train: DataFrame, centres: np.ndarray) -> np.ndarray:
    """One codebook per part; each part's book is trained in a task of its own, on the bounded sample."""
    width = centres.shape[1]
    parts = -(-width // PART)
    half = (centres**2).sum(axis=1) / 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = unit_rows(batch.column(0))
                rest = np.zeros((len(unit), parts * PART), dtype=np.float32)
                rest[:, :width] = unit - centres[(unit @ centres.T - half).argmax(axis=1)]
                flat = rest.reshape(len(unit), parts, PART).transpose(1, 0, 2)
                rows = [pa.array(range(parts), pa.int32()), pa.array([p.tobytes() for p in flat], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, names=["part", "points"])

    def train_part(table: pa.Table) -> pa.Table:
        points = np.frombuffer(b"".join(table["points"].to_pylist()), dtype=np.float32).reshape(-1, PART).astype(float)
        book = trained_book(points)
        return pa.table({"part": table["part"].slice(0, 1), "book": pa.array([book.tobytes()], pa.binary())})

    cut_rows = train.select("unit").mapInArrow(cut, "part int, points binary")
    books = cut_rows.groupBy("part").applyInArrow(train_part, "part int, book binary").orderBy("part").collect()
    return np.stack([np.frombuffer(b["book"], dtype=float).reshape(ENTRIES, PART) for b in books])


def trained_book(points: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """``ENTRIES`` centres of the points by k-means from evenly spread starts; spare entries repeat one."""
    order = np.lexsort(points.T)
    book = points[order[np.linspace(0, len(points) - 1, ENTRIES).astype(int)]]
    for _ in range(rounds):
        mine = (points @ book.T - (book**2).sum(axis=1) / 2).argmax(axis=1)
        n = np.bincount(mine, minlength=ENTRIES)
        for d in range(points.shape[1]):
            total = np.bincount(mine, weights=points[:, d], minlength=ENTRIES)
            book[:, d] = np.where(n > 0, total / np.maximum(n, 1), book[:, d])
    return book


# building


class CellIndex:
    """A bucketed table (item_id, embedding, cell, split, code) and its model."""

    def __init__(self, items: DataFrame | None, model: Model | None, probes: int = 0):
        self.items, self.model, self.probes = items, model, probes

    # searching

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
        """Approximate top ``k`` per (query_id, embedding): query_id, item_id, score, rank.

        The ``probes`` nearest cells of a query are scanned (by default as many as held ``RECALL`` of the exact
        neighbours of sampled items); scores are exact. Ties go to the smaller item_id.
        """
        return _best(self._found(queries, k, probes or self.probes), queries, k)

    def nearest(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """Exact top ``k`` per (query_id, embedding), as ``vectors.nearest`` gives it."""
        return _best(self._found(queries, k, None), queries, k)

    def work(self, queries: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
        """query_id, scanned (codes), scored (items scored exactly) of an approximate search."""
        counts = self._found(queries, k, probes or self.probes).groupBy("query_id")
        return counts.agg(F.sum("scanned").alias("scanned"), F.sum("scored").alias("scored"))

    def _found(self, queries: DataFrame, k: int, probes: int | None) -> DataFrame:
        """Hits of each (query, cell), and a row with what was done for them."""
        spark = queries.sparkSession
        if self.model is None:
            return spark.createDataFrame([], _FOUND)
        placed = written(_probed(given(queries), self.model, k, probes), "cell-queries")
        blocks = max(1, math.ceil(placed.select("query_id").distinct().count() / QUERY_ROWS))
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        parts = [
            _in_cells(placed.where(block == b), self.items, self.model, k, exact=probes is None) for b in range(blocks)
        ]
        return reduce(DataFrame.unionByName, parts)


def build(items: DataFrame, path: str | None = None, probes: int | None = None, k: int = 5) -> CellIndex:
    """Index (item_id, embedding); items without a vector are left out, zero vectors score zero.

    Cells and codebooks are fitted on a hash-drawn sample of ``TRAINED`` items; every item is indexed. ``items``
    should be a written table: it is read a few times, and its vectors are shuffled once, into buckets by cell.
    """
    spark = items.sparkSession
    path = path or new_folder(spark, "cells")
    items = given(items).select("item_id", "embedding")
    n = items.count()
    if not n:
        return CellIndex(None, None)
    drawn = F.pmod(F.xxhash64("item_id", F.lit("train")), F.lit(max(1, n // TRAINED))) == 0
    train = written(_unit_table(items.where(drawn).limit(2 * TRAINED)), "cells-train")
    centres = _train_centres(train, n)
    codebooks = _train_codebooks(train, centres)
    share = max(1, train.count() // SAMPLE)
    some = train.where(F.pmod(F.xxhash64("item_id", F.lit("floor")), F.lit(share)) == 0).limit(2 * SAMPLE)
    sample = np.array([r[0] for r in some.select("unit").collect()]).reshape(-1, centres.shape[1])
    empty = np.zeros(len(centres))
    model = Model(centres, empty, np.ones(len(centres), dtype=np.int64), codebooks, sample, n)
    model = _sized(items, model)
    coded = _coded(items, model).withColumn(
        "split", F.pmod(F.xxhash64("item_id"), F.element_at(F.lit(model.splits.tolist()), F.col("cell") + 1)).cast("int")
    )
    buckets = int(max(8, min(4_096, model.splits.sum())))
    name = f"cells_{uuid.uuid4().hex}"
    (
        coded.repartition(buckets, "cell", "split").write.bucketBy(buckets, "cell", "split").sortBy("cell", "split")
        .option("path", f"{path}/items").saveAsTable(name)
    )
    index = CellIndex(spark.table(name), model, probes or len(centres))
    return index if probes else CellIndex(index.items, model, measured_probes(items, train, model, k))


def _unit_table(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = unit_rows(batch.column(1))
                flat = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), rows.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["item_id", "unit"])

    return items.select("item_id", "embedding").mapInArrow(run, "item_id string, unit array<double>")


def _sized(items: DataFrame, model: Model) -> Model:
    """The model with each cell's radius and number of splits; one row per cell reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, widest = np.zeros(len(model.centres), dtype=np.int64), np.zeros(len(model.centres))
        for batch in batches:
            if batch.num_rows:
                cells, angles = model.place(unit_rows(batch.column(0)))
                n += np.bincount(cells, minlength=len(n))
                np.maximum.at(widest, cells, angles)
        held = np.flatnonzero(n)
        columns = [pa.array(held.astype(np.int32)), pa.array(n[held]), pa.array(widest[held])]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "n", "radius"])

    sized = items.select("embedding").mapInArrow(run, "cell int, n long, radius double")
    radii, splits = np.zeros(len(model.centres)), np.ones(len(model.centres), dtype=np.int64)
    for cell, n, radius in sized.groupBy("cell").agg(F.sum("n"), F.max("radius")).collect():
        radii[cell], splits[cell] = radius, -(-n // SPLIT_ROWS)
    return Model(model.centres, radii, splits, model.codebooks, model.sample, model.items)


def _coded(items: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = unit_rows(batch.column(1))
                cells, _ = model.place(unit)
                codes = pa.array([c.tobytes() for c in model.encode(unit, cells)], pa.binary())
                arrays = [batch.column(0), batch.column(1), pa.array(cells.astype(np.int32)), codes]
                yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "embedding", "cell", "code"])

    vector = items.schema["embedding"].dataType.simpleString()
    return items.mapInArrow(run, f"item_id string, embedding {vector}, cell int, code binary")


def measured_probes(items: DataFrame, train: DataFrame, model: Model, k: int) -> int:
    """Cells to probe so that they hold ``RECALL`` of the exact neighbours of sampled items, themselves left out."""
    share = max(1, train.count() // MEASURED)
    drawn = train.where(F.pmod(F.xxhash64("item_id", F.lit("probe")), F.lit(share)) == 0).limit(2 * MEASURED)
    asked = written(drawn.select(F.col("item_id").alias("query_id"), F.col("unit").alias("embedding")), "cell-probes")
    hits = nearest(asked, items, k + 1).where("query_id <> item_id").select("query_id", "item_id")
    found = _coded(hits.join(items, "item_id").select("item_id", "embedding").distinct(), model).select("item_id", "cell")
    pairs = hits.join(found, "item_id").join(asked, "query_id").select("cell", "embedding").collect()
    if not pairs:
        return 1
    order = _nearest_cells(unit_rows(pa.array([r["embedding"] for r in pairs])), model)
    ranks = np.sort((order == np.array([r["cell"] for r in pairs])[:, None]).argmax(axis=1))
    return int(ranks[math.ceil(RECALL * len(ranks)) - 1]) + 1


# searching


def _nearest_cells(unit: np.ndarray, model: Model) -> np.ndarray:
    return np.argsort(-(unit @ _units(model.centres).T), axis=1, kind="stable")


def _probed(queries: DataFrame, model: Model, k: int, probes: int | None) -> DataFrame:
    """A row for each query, probed cell and split: query_id, embedding, floor, cell, split.

    Without ``probes`` all cells are probed that may hold an item as near as the k-th best of the sample, which
    is a lower bound of the k-th best of all: a cell's items are at least the angle between query and centre,
    less the radius, away. With ``probes`` the floor is what ``SCORED`` of the sample reach.
    """
    shared = queries.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        directions = _units(model.centres)
        above = k if probes is None else max(k, math.ceil(SCORED * len(model.sample)))
        step = int(max(1, min(SLICE, PROBED_ROWS // model.splits.sum())))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                unit = unit_rows(part.column(1))
                scores = np.sort(unit @ model.sample.T, axis=1)
                floors = scores[:, -above] if above <= scores.shape[1] else np.full(len(unit), -2.0)
                if probes is None:
                    floors = floors - 2.0 / _UNIT  # scores are rounded before they rank
                    nearest_angle = np.maximum(_angles(unit @ directions.T) - model.radii - 1e-9, 0.0)
                    # a zero vector scores zero and counts as a right angle to everything, so this holds for it too
                    q, cell = np.nonzero(np.cos(nearest_angle) >= floors[:, None])
                else:
                    chosen = np.argsort(-(unit @ directions.T), axis=1, kind="stable")[:, :probes]
                    q, cell = np.repeat(np.arange(len(unit)), chosen.shape[1]), chosen.ravel()
                times = model.splits[cell]
                split = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                q, cell = np.repeat(q, times), np.repeat(cell, times)
                whose = pa.array(q)
                arrays = [part.column(0).take(whose), part.column(1).take(whose), pa.array(floors[q])]
                arrays += [pa.array(cell.astype(np.int32)), pa.array(split.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "embedding", "floor", "cell", "split"])

    vector = queries.schema["embedding"].dataType.simpleString()
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding")
    return asked.mapInArrow(run, f"query_id string, embedding {vector}, floor double, cell int, split int")


def _in_cells(queries: DataFrame, items: DataFrame, model: Model, k: int, exact: bool) -> DataFrame:
    """The best ``k`` of each query in each of its cells; the items come from their buckets, unshuffled."""
    shared = queries.sparkSession.sparkContext.broadcast(model)

    def score(queries: pa.Table, items: pa.Table) -> pa.Table:
        model = shared.value
        if not queries.num_rows or not items.num_rows:
            return _hits([], [], [], [], [])
        names, item_ids = ids_of(queries["query_id"]), ids_of(items["item_id"])
        by_id = np.argsort(item_ids, kind="stable")
        asked, vectors = unit_rows(queries["embedding"]), unit_rows(items["embedding"])[by_id]
        floors, cell = queries["floor"].to_numpy(), items["cell"][0].as_py()
        codes = np.frombuffer(b"".join(items["code"].to_pylist()), dtype=np.uint8).reshape(len(item_ids), -1)[by_id]
        tables = []
        for begin in range(0, len(asked), SLICE):
            part = slice(begin, begin + SLICE)
            if exact:
                scores = np.rint(asked[part] @ vectors.T * _UNIT).astype(np.int64)
                q, item = np.nonzero(scores >= floors[part][:, None] * _UNIT)
                points = scores[q, item]
                scored = np.full(len(scores), len(vectors))
            else:
                coded = model.coded_scores(asked[part], cell, codes)
                q, item = np.nonzero(coded >= floors[part][:, None])
                points = _pair_scores(asked[part], vectors, q, item)
                scored = np.bincount(q, minlength=len(coded))
            order = np.lexsort((item, -points, q))
            kept = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]
            some = names[part]
            none = [0] * len(kept)
            tables.append(_hits(some[q[kept]], item_ids[by_id][item[kept]], points[kept] / _UNIT, none, none))
            tables.append(_hits(some, [None] * len(some), [None] * len(some), [len(vectors)] * len(some), scored))
        return pa.concat_tables(tables).combine_chunks()

    cell = ["cell", "split"]
    return queries.groupBy(*cell).cogroup(items.groupBy(*cell)).applyInArrow(score, _FOUND)


def _pair_scores(asked: np.ndarray, vectors: np.ndarray, q: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Whole-unit scores of (query, item) pairs, whose vectors are gathered a bounded number at a time."""
    points = np.empty(len(q), dtype=np.int64)
    for begin in range(0, len(q), PAIRS):
        part = slice(begin, begin + PAIRS)
        points[part] = np.rint(np.einsum("id,id->i", asked[q[part]], vectors[item[part]]) * _UNIT).astype(np.int64)
    return points


def _hits(*columns) -> pa.Table:
    types = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
    names = ["query_id", "item_id", "score", "scanned", "scored"]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _best(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    hits = found.where("item_id is not null").drop("scanned", "scored")
    return top_k(hits, k, by_score(["item_id"]))

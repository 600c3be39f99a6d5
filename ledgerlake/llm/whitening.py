"""Whitening of embeddings by the polarisation identity.

A covariance is half of what the variance of a sum of two dimensions has beyond the variances of the two.
So only squares are added up: of every centred dimension, and of the sum of every pair of them. Vectors are
whole numbers here and are centred by whole numbers (the rounded mean), so tasks add whole numbers and lose
nothing; the rest of the mean is taken off exactly on the totals. Only these totals, one for each pair of
dimensions, reach the driver, which takes the eigenvectors and sends a few columns back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.workspace import written

SCALE = 256
COMPONENTS = 4
#: Squares of sums below this are added up in 64 bits, so many rows at a time; others as whole numbers of Python.
NARROW = 1 << 20
ROWS = 1 << 16

_EXACT = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """What the fit leaves: the number of fitted vectors, their sums, and unit components by falling variance."""

    n: int
    sums: list[int]
    components: np.ndarray  # dimensions x components
    variances: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        """The mean rounded to whole numbers."""
        return np.array([_rounded(s, self.n) for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> list[int]:
        """Sums of the vectors after the centre is taken off."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.centre)]


def _rounded(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


def units(vector: Column, scale: int = SCALE) -> Column:
    """Whole numbers: each entry times ``scale``, rounded down; beyond 64 bits the largest such number."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def given(rows: DataFrame) -> DataFrame:
    """Rows that have a vector of at least one entry, all of them finite numbers."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension: one row for each dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                low = (x & 0xFFFFFFFF).sum(axis=0)  # two halves, so no sum leaves 64 bits
                n, total = n + len(x), total + low.astype(object) + ((x >> 32).sum(axis=0).astype(object) << 32)
        if n:
            width = len(total)
            columns = [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64())]
            exact = pa.array([Decimal(int(t)) for t in total], _EXACT)
            yield pa.RecordBatch.from_arrays([*columns, exact], names=["i", "n", "total"])

    parts = fit.mapInArrow(run, "i int, n long, total decimal(38,0)")
    rows = parts.groupBy("i").agg(F.sum("n"), F.sum("total").cast("decimal(38,0)")).orderBy("i").collect()
    return (rows[0][1], [int(r[2]) for r in rows]) if rows else (0, [])


def pair_squares(z: np.ndarray, i: int) -> list[int]:
    """Exact sums of the squares of dimension ``i`` and of its sum with each later dimension."""
    sums = z[:, i:] + z[:, i : i + 1]
    sums[:, 0] = z[:, i]
    if not len(z) or np.abs(sums).max() < NARROW:
        return [int(s) for s in (sums * sums).sum(axis=0)]
    exact = z.astype(object)
    sums = exact[:, i:] + exact[:, i : i + 1]
    sums[:, 0] = exact[:, i]
    return list((sums * sums).sum(axis=0))


def _squares(fit: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Exact totals (dimensions x dimensions): squares of dimensions on the diagonal, of pair sums above it."""
    width = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list[list[int]] | None = None
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(0).slice(begin, ROWS))
                wide = np.abs(x.astype(float)).max() > 1 << 60
                z = x.astype(object) - centre.astype(object) if wide else x - centre
                made = [pair_squares(z, i) for i in range(width)]
                totals = made if totals is None else [[a + b for a, b in zip(s, t)] for s, t in zip(totals, made)]
        for i, row in enumerate(totals or ()):
            places = [pa.array([i] * len(row), pa.int32()), pa.array(range(i, width), pa.int32())]
            exact = pa.array([Decimal(t) for t in row], _EXACT)
            yield pa.RecordBatch.from_arrays([*places, exact], names=["i", "j", "total"])

    parts = fit.mapInArrow(run, "i int, j int, total decimal(38,0)")
    found = np.zeros((width, width), dtype=object)
    for i, j, total in parts.groupBy("i", "j").agg(F.sum("total").cast("decimal(38,0)")).collect():
        found[i, j] = int(total)
    return found


def covariance(n: int, rest: list[int], squares: np.ndarray) -> np.ndarray:
    """Covariances from exact totals; each entry is rounded once, in its last division.

    n times a sum of squares less the square of the rest is n * n times a variance. Of dimension i, j and their
    sum that gives three variances, and the covariance is half of what the last has beyond the two others.
    """
    width = len(rest)
    own = [n * int(squares[i, i]) - rest[i] * rest[i] for i in range(width)]
    found = np.zeros((width, width))
    for i in range(width):
        found[i, i] = own[i] / (n * n)
        for j in range(i + 1, width):
            both = n * int(squares[i, j]) - (rest[i] + rest[j]) ** 2
            found[i, j] = found[j, i] = (both - own[i] - own[j]) / (2 * n * n)
    return found


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct vector of whole numbers once; a hot one is folded before the shuffle."""
    return written(rows.select(units(F.col("embedding")).alias("x")).distinct(), "whitening-fit")


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a written table of distinct vectors ``x``; None without a vector."""
    n, sums = _sums(vectors)
    if not n:
        return None
    base = Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    found = covariance(n, base.rest, _squares(vectors, base.centre))
    values, directions = np.linalg.eigh(found)
    first = np.argsort(-values, kind="stable")[:components]
    # a variance that is nothing but rounding counts as none
    least = np.finfo(float).eps * len(sums) * max(float(np.abs(values).max()), 0.0)
    kept = np.where(values[first] > least, values[first], 0.0)
    return Whitening(n, sums, directions[:, first], kept, float(np.trace(found)))


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened components of vectors; those of a component without variance are 0."""
    centred = (x - model.centre).astype(float) - np.array([r / model.n for r in model.rest])
    scale = np.sqrt(np.where(model.variances > 0, model.variances, 1.0))
    return centred @ model.components / scale * (model.variances > 0)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the measured covariance of the whitened fit list less the identity.

    Components without variance don't count. Each task sums its part; one row for each pair reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                w = np.column_stack([np.ones(batch.num_rows), _projected(_matrix(batch.column(0)), model)])
                total = total + w.T @ w
        if np.ndim(total):
            i, j = np.indices(total.shape)
            arrays = [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel(), pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "total"])

    live = np.flatnonzero(model.variances > 0) + 1
    if not len(live):
        return 0.0
    moments = np.zeros((len(model.variances) + 1,) * 2)
    for i, j, total in vectors.mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total")).collect():
        moments[i, j] = total / model.n
    found = moments[np.ix_(live, live)] - np.outer(moments[0, live], moments[0, live])
    return float(np.abs(found - np.eye(len(live))).max())


def deviations(x: np.ndarray, model: Whitening) -> list[int]:
    """Exact sums over the dimensions of the squares of n * x - S."""
    z, rest = x - model.centre, np.array(model.rest, dtype=object)
    most = int(np.abs(z).max(initial=0)) * model.n + max(abs(int(r)) for r in model.rest)
    if most * most * len(rest) < 1 << 62:
        y = model.n * z - rest.astype(np.int64)
        return (y * y).sum(axis=1).tolist()
    y = model.n * z.astype(object) - rest
    return [int(v) for v in (y * y).sum(axis=1)]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row that has a vector.

    Vectors that are null or empty or hold null or non-finite entries have no rows. A vector takes part in the
    fit once, however many rows hold it; every row gets its own results, also rows that repeat an id or have
    none. Vectors must all be of one width (else ValueError). ``deviation`` is decimal(38,0). Components beyond
    the width don't exist; those without variance (as all are of a single distinct vector) give 0 for
    ``whitened`` and ``explained`` and don't count in ``identity_error``. No rows without a vector. Other columns
    are not returned.
    """
    rows = given(embeddings.select("vec_id", "embedding"))
    id_type = embeddings.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, "
        "explained double, identity_error double"
    )
    vectors = fit_list(rows)
    widths = [r[0] for r in vectors.select(F.size("x")).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths, for example {widths}")
    model = fit(vectors, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model)
    explained = model.variances / model.trace if model.trace > 0 else np.zeros(len(model.variances))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            each = np.repeat(np.arange(len(x)), k)
            far = pa.array([Decimal(d) for d in deviations(x, model)], _EXACT).take(pa.array(each))
            arrays = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), model.n)),
                far,
                pa.array(_projected(x, model).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(each), error)),
            ]
            names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.select("vec_id", units(F.col("embedding")).alias("x")).mapInArrow(run, schema)

"""Quality scores by a sparse ensemble of rules over text statistics.

Small trees are grown on a bounded sample of labelled rows; the path to each node is a conjunctive
rule over statistics of the text. A logistic regression with an absolute penalty keeps few rules, which
are compiled into one Spark column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlake.llm.common import utf8
from ledgerlake.workspace import written

#: Labelled rows that a model is fitted on.
SAMPLE = 20_000
TREES = 24
DEPTH = 3
LEAST_ROWS = 20
PENALTY = 0.002
CUTS = 24

STATISTICS = (
    "bytes", "words", "word_length", "long_words", "upper", "digits", "spaces", "lines", "line_words",
    "sentence_marks", "exclamations", "bars", "symbols", "other_marks", "non_ascii", "distinct_words",
    "distinct_pairs", "top_word", "distinct_lines", "short_lines", "capital_words", "marked_words", "letter_entropy",
)

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_HIGH = np.arange(256) >= 128
_SYMBOL = np.array([chr(b) in "#$%&*@^~<>{}[]=+\\_" for b in range(256)])
_SENTENCE = np.array([chr(b) in ".,;:?" for b in range(256)])
_OTHER = np.array([chr(b) in "\"'()-/`" for b in range(256)])
_LETTERS = np.arange(97, 123)
_MARKED = re.compile(rb"[#$%&*!]{2,}(?=\s|$)")


def statistics(text: bytes | None) -> list[float]:
    """The ``STATISTICS`` of a whole text; shares are between 0 and 1, and 0 for an empty or null text."""
    if not text:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    size = len(text)
    words, lines = text.split(), text.split(b"\n")
    n, distinct = len(words), {}
    for word in words:
        distinct[word] = distinct.get(word, 0) + 1
    shown = max(1, size - int(counts[_SPACE].sum()))
    letters = counts[_LETTERS] + counts[_LETTERS - 32]
    share = letters[letters > 0] / max(1, letters.sum())
    per_word = 1 / max(1, n)
    return [
        float(size),
        float(n),
        shown * per_word,
        sum([len(w) > 20 for w in distinct]) / max(1, len(distinct)),
        counts[_UPPER].sum() / shown,
        counts[_DIGIT].sum() / shown,
        counts[_SPACE].sum() / size,
        float(len(lines)),
        n / len(lines),
        counts[_SENTENCE].sum() / shown,
        counts[33] / shown,
        counts[124] / shown,
        counts[_SYMBOL].sum() / shown,
        counts[_OTHER].sum() / shown,
        counts[_HIGH].sum() / shown,
        len(distinct) * per_word,
        len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 1.0,
        max(distinct.values()) * per_word if distinct else 0.0,
        len(set(lines)) / len(lines),
        sum([len(x) < 20 for x in lines]) / len(lines),
        sum([w[:1].isupper() for w in words]) * per_word,
        len(_MARKED.findall(text)) * per_word,
        float(-(share * np.log(share)).sum()) if len(share) else 0.0,
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row of ``docs``, as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([statistics(t) for t in batch.column(1).to_pylist()], dtype=np.float64)
            columns = [pa.array(c) for c in table.reshape(-1, len(STATISTICS)).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *STATISTICS])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select("doc_id", utf8()).mapInArrow(run, schema)


# -- fitting, on the sample

Condition = tuple[int, bool, float]  # statistic, whether it must be above, limit


@dataclass
class RuleModel:
    """Rules (conjunctions of conditions), their weights, and the constant of the logit."""

    rules: list[tuple[Condition, ...]]
    weights: list[float]
    constant: float

    def expression(self) -> Column:
        """The score as a Spark column over columns named like ``STATISTICS``."""
        logit = F.lit(float(self.constant))
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for statistic, above, limit in rule:
                value = F.col(STATISTICS[statistic])
                holds = holds & ((value > float(limit)) if above else (value <= float(limit)))
            logit = logit + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-logit))


def _grow(x: np.ndarray, cuts: list[np.ndarray], error: np.ndarray, columns: np.ndarray, rows: np.ndarray, path=()) -> list:
    """Paths to all nodes below ``rows`` of a tree that explains ``error``, with the leaves' means."""
    best = (1e-6, None, None)
    if len(path) < DEPTH and len(rows) >= 2 * LEAST_ROWS:
        e = error[rows]
        total = e.sum()
        for j in columns:
            place = np.searchsorted(cuts[j], x[rows, j], side="left")
            n = np.cumsum(np.bincount(place, minlength=len(cuts[j]) + 1))[:-1]
            s = np.cumsum(np.bincount(place, e, minlength=len(cuts[j]) + 1))[:-1]
            fits = (n >= LEAST_ROWS) & (len(rows) - n >= LEAST_ROWS)
            if fits.any():
                gain = np.where(fits, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1), 0)
                k = int(gain.argmax())
                if gain[k] - total**2 / len(rows) > best[0]:
                    best = (gain[k] - total**2 / len(rows), j, cuts[j][k])
    if best[1] is None:
        return [(path, rows, True)]
    below = x[rows, best[1]] <= best[2]
    left = _grow(x, cuts, error, columns, rows[below], (*path, (int(best[1]), False, float(best[2]))))
    right = _grow(x, cuts, error, columns, rows[~below], (*path, (int(best[1]), True, float(best[2]))))
    return [(path, rows, False)] * bool(path) + left + right


def _holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), dtype=bool)
    for statistic, above, limit in rule:
        held &= (x[:, statistic] > limit) if above else (x[:, statistic] <= limit)
    return held


def train(x: np.ndarray, y: np.ndarray, seed: int = 11) -> RuleModel:
    """Rules of boosted small trees, weighted by lasso logistic regression.

    Without rows every text scores one half; with labels of one kind only, every text has that share
    (kept off 0 and 1 by one row of each kind).
    """
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    constant = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return RuleModel([], [], constant)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, CUTS))) for j in range(x.shape[1])]
    logit = np.full(n, constant)
    rules: dict[tuple[Condition, ...], None] = {}
    for _ in range(TREES):
        error = y - 1 / (1 + np.exp(-logit))
        columns = rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]
        rows = np.flatnonzero(rng.random(n) < 0.7)
        if not len(rows):
            rows = np.arange(n)
        for path, _, leaf in _grow(x, cuts, error, columns, rows):
            if not path:
                continue
            path = tuple(sorted(path))
            rules.setdefault(path)
            if leaf:
                held = _holds(path, x)
                logit[held] += 0.3 * error[held].mean() / 0.15 if held.any() else 0.0
    kept = list(rules)
    if not kept:  # too few rows for a tree
        return RuleModel([], [], constant)
    z = np.array([_holds(r, x) for r in kept], dtype=np.float64).T
    weights, constant = _lasso(z, y.astype(np.float64), constant)
    chosen = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleModel([kept[i] for i in chosen], [float(weights[i]) for i in chosen], constant)


def _lasso(z: np.ndarray, y: np.ndarray, constant: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient of the logistic loss with an absolute penalty on the weights."""
    n, k = z.shape
    weights = look = np.zeros(k)
    base = look_base = constant
    step = 4.0 / max(1.0, float(np.linalg.norm(z, 2) ** 2) / n + 1)
    momentum = 1.0
    for _ in range(400):
        error = 1 / (1 + np.exp(-(z @ look + look_base))) - y
        new = look - step * (z.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        new_base = look_base - step * error.mean()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = new + (momentum - 1) / after * (new - weights)
        look_base = new_base + (momentum - 1) / after * (new_base - base)
        weights, base, momentum = new, new_base, after
    return weights, float(base)


#: Parts that a sample is cut in, each in its own order, so that no task sends more than its share.
SAMPLE_PARTS = 16


def fit(measures: DataFrame, labels: DataFrame, held_out: Column | None = None, rows: int = SAMPLE) -> RuleModel:
    """A model of the labelled rows of ``measures``, at most ``rows`` of them, by a hash of id and statistics.

    ``labels`` has doc_id and quality; rows without either teach nothing, repeated labels of an id count
    as their largest. Rows that ``held_out`` marks teach nothing. No more than ``rows`` rows reach the driver,
    however many tasks there are.
    """
    known = labels.where("doc_id is not null and quality is not null")
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").cast("int").alias("__quality"))
    usable = measures if held_out is None else measures.where(~F.coalesce(held_out, F.lit(True)))
    drawn = usable.join(known, F.col("doc_id") == F.col("__id"))
    drawn = drawn.select(F.xxhash64("doc_id", *STATISTICS).alias("__h"), *STATISTICS, "__quality")
    n = drawn.count()
    if n > rows:
        share = F.lit(1.2 * rows / n)
        first = F.row_number().over(Window.partitionBy(F.pmod("__h", F.lit(SAMPLE_PARTS))).orderBy("__h", *STATISTICS))
        near = drawn.where(F.col("__h") / F.lit(2.0**64) + 0.5 <= share)
        drawn = near.withColumn("__n", first).where(F.col("__n") <= rows // SAMPLE_PARTS).drop("__n")
    table = np.array(sorted(tuple(r) for r in drawn.collect()), dtype=np.float64).reshape(-1, len(STATISTICS) + 2)
    return train(table[:, 1:-1], table[:, -1])


def score(measures: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 where the score reaches ``threshold``) of every row of ``measures``."""
    scored = measures.select("doc_id", model.expression().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, threshold: float = 0.3) -> DataFrame:
    """Score every whole text of ``docs`` by a model of its labelled rows that ``held_out`` doesn't mark.

    One row per row, repeated rows too: doc_id, score, predicted. Null and empty texts have statistics of
    0 and are scored by the same rules. Other columns are not returned and never inputs. An empty table
    of labels gives the score one half.
    """
    measures = written(measured(docs), "quality-statistics")
    return score(measures, fit(measures, labels, held_out), threshold)

"""Language identification: averaged embeddings of hashed subwords and a linear softmax.

A word is a run of letters; its subwords are the n-grams of the lower-cased word in brackets, and the
word itself. A text's vector is the mean of the embeddings of all its subwords. Embeddings and softmax
are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows; a held-back
part of the sample calibrates the temperature of the softmax and the score below which a text is
rejected. As embedding and softmax are both linear, a trained model is one row of logits per bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlake.llm.common import aside
from ledgerlake.llm.tokens import forget

BUCKETS = 1 << 16
DIMENSION = 16
EPOCHS = 3
RATE = 0.5
#: Labelled rows per language that a model is fitted on, the most characters of such a row's text (longer
#: ones are not drawn), and the share of the rows that calibrates the model.
SAMPLE = 1_000
SAMPLE_CHARS = 20_000
CALIBRATION = 0.2
#: Share of rightly predicted calibration texts that the rejection may cost.
LOST = 0.001
UNKNOWN = "und"

KEPT_WORDS = 100_000
_WORD = re.compile(r"[^\W\d_]+")
_STEP = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 2- to 4-grams of each ``<word>`` and of the whole, and to which word they belong."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    lengths = np.array([len(m) for m in marked], dtype=np.int64)
    ends = np.cumsum(lengths)
    of = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(ends, lengths) - np.arange(len(codes))
    hashes, owners, gram = [], [], codes
    for n in (2, 3, 4):
        gram = gram[:-1] * _STEP + codes[n - 1 :]
        inside = np.flatnonzero(room[: len(gram)] >= n)
        hashes.append(gram[inside] * np.uint64(2 * n + 1))
        owners.append(of[inside])
    place = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
    powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, _STEP, dtype=np.uint64))
    hashes.append(np.add.reduceat(codes * powers[place], ends - lengths) if len(words) else codes[:0])
    owners.append(np.arange(len(words)))
    mixed = np.concatenate(hashes)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
    return ((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32), np.concatenate(owners)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Model:
    """Logits of each bucket, and what calibration found."""

    languages: list[str]
    logits: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: list[str | None], known: Known | None = None) -> tuple[list[str], list[float]]:
        """Language and calibrated score of each whole text; ``known`` keeps the words met before."""
        known = Known(self.logits) if known is None else known
        rows = [words_of(t) for t in texts]
        known.hold(set().union(*rows))
        names, scores = [], []
        for words in rows:
            if not words or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            total, n = known.summed(words)
            probability = _softmax((total / n + self.bias)[None, :] / self.temperature)[0]
            best = int(probability.argmax())
            names.append(self.languages[best])
            scores.append(float(probability[best]))
        return names, scores


class Known:
    """Summed logits and numbers of subwords of the words a task has met, up to a bound."""

    def __init__(self, logits: np.ndarray):
        self.logits = logits
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.sums = np.zeros((0, self.logits.shape[1]))
        self.sizes = np.zeros(0, dtype=np.int64)

    def hold(self, words: set[str]) -> None:
        if len(self.places) > KEPT_WORDS:
            self.clear()
        new = [w for w in words if w not in self.places]
        sums, sizes = [self.sums], [self.sizes]
        for begin in range(0, len(new), 20_000):
            some = new[begin : begin + 20_000]
            buckets, owners = subwords(some)
            values = self.logits[buckets]
            sums.append(np.stack([np.bincount(owners, v, len(some)) for v in values.T], axis=1).reshape(len(some), -1)
                        if values.shape[1] else np.zeros((len(some), 0)))
            sizes.append(np.bincount(owners, minlength=len(some)))
        first = len(self.places)
        self.places.update((w, first + i) for i, w in enumerate(new))
        if new:
            self.sums, self.sizes = np.concatenate(sums), np.concatenate(sizes)

    def summed(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Sum of the logits of all subwords of ``words``, and their number."""
        at = np.fromiter(map(self.places.__getitem__, words), dtype=np.int64, count=len(words))
        return self.sums[at].sum(axis=0), int(self.sizes[at].sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit a model on (text, language) rows by stochastic gradient descent, one text a step.

    Texts without a letter teach nothing. Without any row the model knows no language. Training takes
    each text as a whole and as a few short pieces, so that short texts are judged as well as long ones.
    """
    rng = np.random.default_rng(seed)
    numbers: dict[str, int] = {}
    coded = []
    for text, lang in rows:
        words = [numbers.setdefault(w, len(numbers)) for w in words_of(text)]
        if words:
            coded.append((np.array(words, dtype=np.int32), lang))
    vocabulary = _Vocabulary(numbers)
    languages = sorted({lang for _, lang in coded})
    k = len(languages)
    if not k:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    code = {lang: i for i, lang in enumerate(languages)}
    order = rng.permutation(len(coded))
    cut = int(len(coded) * CALIBRATION)
    held, fit = order[:cut], order[cut:]
    embedding = rng.normal(0, 0.05, (BUCKETS, DIMENSION))
    softmax, bias = np.zeros((DIMENSION, k)), np.zeros(k)
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            words, lang = coded[i]
            rate = RATE * (1 - done / steps)
            done += 1
            short = int(rng.integers(len(words)))
            for part in (words, words[short : short + int(rng.integers(1, 12))]):
                grams, count = np.unique(vocabulary.grams(part), return_counts=True)
                share = (count / count.sum())[:, None]
                vector = (embedding[grams] * share).sum(axis=0)
                error = _softmax((vector @ softmax + bias)[None, :])[0]
                error[code[lang]] -= 1
                back = softmax @ error
                softmax -= rate * np.outer(vector, error)
                bias -= 0.01 * rate * error
                embedding[grams] -= rate * len(grams) ** 0.5 * share * back
    model = Model(languages, (embedding @ softmax).astype(np.float32), bias, 1.0, 0.0)
    if len(held):
        _calibrate(model, vocabulary, [coded[i] for i in held], code)
    return model


class _Vocabulary:
    """The subwords of numbered words, in one array."""

    def __init__(self, numbers: dict[str, int]):
        words, flat, sizes = list(numbers), [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for begin in range(0, len(words), 20_000):
            some = words[begin : begin + 20_000]
            buckets, owners = subwords(some)
            flat.append(buckets[np.argsort(owners, kind="stable")])
            sizes.append(np.bincount(owners, minlength=len(some)))
        self.flat, self.sizes = np.concatenate(flat), np.concatenate(sizes)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def grams(self, words: np.ndarray) -> np.ndarray:
        """The subwords of some words, one after the other."""
        sizes = self.sizes[words]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1]) - np.repeat(ends - sizes - self.begins[words], sizes)]


def _calibrate(model: Model, vocabulary: _Vocabulary, held: list[tuple[np.ndarray, str]], code: dict[str, int]) -> None:
    """Temperature of least log loss, and the score that all but ``LOST`` of the right texts reach."""
    z = np.array([model.logits[vocabulary.grams(w)].mean(axis=0, dtype=np.float64) + model.bias for w, _ in held])
    y = np.array([code[lang] for _, lang in held])
    grid = np.geomspace(0.5, 20, 60)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    # among k languages a score near 1/k says nothing; nothing above one half of certainty is rejected
    limit = 0.5 * (1 + 1 / len(model.languages))
    model.threshold = float(min(limit, right[int(len(right) * LOST)])) if len(right) else 0.0


def sample(labelled: DataFrame, per_language: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``per_language`` (text, lang) rows of each language, those with the least hash of id and text.

    Every labelled row of at most ``SAMPLE_CHARS`` characters may be drawn; the hash decides, not the
    place. The rows of one language are cut in each task before they meet.
    """
    usable = labelled.where(f"text is not null and lang is not null and length(text) <= {SAMPLE_CHARS}")
    keyed = usable.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    counts = keyed.groupBy("lang").count()
    share = F.least(F.lit(1.0), (F.lit(1.5 * per_language) + 100) / F.col("count"))
    # a hash within the share of its language: somewhat more rows than wanted, whatever the size of the table
    near = (F.col("h") / F.lit(2.0**64) + 0.5) <= share
    drawn = keyed.join(F.broadcast(counts), "lang").where(near)  # a row per language, of which the model holds more
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = drawn.withColumn("n", first).where(F.col("n") <= per_language).select("text", "lang")
    return sorted((r["text"], r["lang"]) for r in rows.collect())


def fit(docs: DataFrame, held_out=None, per_language: int = SAMPLE) -> Model:
    """A model of the rows of ``docs`` with a lang, without those that ``held_out`` (a condition) marks."""
    rows = docs if held_out is None else docs.where(~F.coalesce(held_out, F.lit(True)))
    return train(sample(rows.select("doc_id", "text", "lang"), per_language))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ``accepted``.

    Texts that are null or have no letter are ``und`` with score 0 and not accepted; others carry a
    learned language, and are accepted where the score reaches the calibrated threshold. Columns are
    kept; those named lang_pred, score or accepted are replaced. Repeated rows each get their result.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted", "__text")]
    shape = docs.select(*kept)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        model = shared.value
        known = Known(model.logits)
        for batch in batches:
            names, scores = [], []
            for begin in range(0, batch.num_rows, 250):
                some = model.predict(batch.column(batch.num_columns - 1).slice(begin, 250).to_pylist(), known)
                names += some[0]
                scores += some[1]
            accepted = [n != UNKNOWN and s >= model.threshold for n, s in zip(names, scores)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            made = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*kept, "lang_pred", "score", "accepted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema.fields)
    schema = f"{schema}, lang_pred string, score double, accepted boolean"
    return shape.withColumn("__text", F.col("text")).mapInArrow(run, schema)


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the texts that the model rejects; all columns are kept."""
    return aside(docs, lambda d: identify(d, model).where("accepted"))

"""Whitening, tokenizer alignment and removal of repeated byte strings, against plain versions."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from ledgerlake.llm import alignment, suffixes, whitening
from ledgerlake.llm.queries import QUERIES
from tests.llm import plain
from tests.llm.conftest import FOLDER, made_texts
from tests.llm.test_documents import both, same

BYTE, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


# whitening


def vectors_and_rows():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + d) for d in range(5)], "x", 7) for i in range(80)]
    rows += [rows[4]] * 30 + [(200, rows[4][1], "x", 7), (None, rows[5][1], "x", 7)]  # a hot vector, rows repeated
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [nan] * 5, [0.0, inf, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0, -inf]]
    return rows, [(300 + i, v, "x", 7) for i, v in enumerate(bad)]


SCHEMA = "vec_id long, embedding array<double>, n string, component int"


def expected_whitening(rows, k=4):
    fixed = {i: tuple(int(np.floor(256 * c)) for c in v) for i, (_, v, *_) in enumerate(rows)}
    fit = sorted(set(fixed.values()))
    n, width = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(width)]
    centred = [[Fraction(x[d]) - Fraction(sums[d], n) for d in range(width)] for x in fit]
    cov = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(width)] for i in range(width)])
    values, axes = np.linalg.eigh(cov)
    first = np.argsort(-values)[:k]
    return fixed, n, sums, cov, values[first], axes[:, first]


def test_whitening(spark):
    rows, bad = vectors_and_rows()
    found = whitening.whiten(spark.createDataFrame(rows + bad, SCHEMA).repartition(4)).collect()
    fixed, n, sums, cov, values, axes = expected_whitening(rows)
    assert len(found) == 4 * len(rows) and {r["n"] for r in found} == {n}
    exact = Counter((rows[i][0], k, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in fixed.items() for k in range(1, 5))
    assert Counter((r["vec_id"], r["component"], int(r["deviation"])) for r in found) == exact
    assert all(r["identity_error"] < 1e-10 for r in found)
    by_id = {}
    for r in found:
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(cov)) < 1e-12
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    ids = [i for i in range(80)]
    mine = np.array([[by_id[i][k] for k in range(1, 5)] for i in ids])
    wanted = (np.array([fixed[i] for i in ids]) - np.array(sums) / n) @ axes / np.sqrt(values)
    signs = np.sign((mine * wanted).sum(axis=0))
    assert np.allclose(mine * signs, wanted, atol=1e-9)
    assert by_id[4] == by_id[200]


def test_covariance_by_polarisation_is_exact():
    rng = np.random.default_rng(0)
    for scale in (10, 1 << 24, 1 << 40):  # the last ones leave 64 bits when they are squared
        x = rng.integers(-scale, scale, (40, 4)) + 3 * scale
        model = whitening.Whitening(40, [int(s) for s in x.sum(axis=0)], np.zeros((4, 0)), np.zeros(0), 0.0)
        z = x - model.centre
        squares = np.zeros((4, 4), dtype=object)
        for i in range(4):
            squares[i, i:] = whitening.pair_squares(z, i)
        found = whitening.covariance(40, model.rest, squares)
        for i in range(4):
            for j in range(4):
                a, b = (Fraction(int(x[:, k].sum()), 40) for k in (i, j))
                exact = sum((int(r[i]) - a) * (int(r[j]) - b) for r in x) / 40
                assert found[i, j] == float(exact)
        far = [sum((40 * int(c) - s) ** 2 for c, s in zip(r, model.sums)) for r in x]
        assert whitening.deviations(x, model) == far


def test_whitening_without_variance_or_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitening.whiten(frame([(1, None, "", 1), (2, [], "", 1)])).count() == 0
    assert whitening.whiten(frame([])).count() == 0
    one = whitening.whiten(frame([(1, [1.0, 2.0], "", 1), (2, [1.0, 2.0], "", 1)])).collect()
    assert sorted((r[0], r[1]) for r in one) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(0, 0.0, 0.0, 0.0)}
    line = whitening.whiten(frame([(i, [float(i), 2.0 * i, 5.0], "", 1) for i in range(9)])).collect()
    assert {r["component"] for r in line} == {1, 2, 3}
    assert all((r["explained"] > 0.99) == (r["component"] == 1) and r["identity_error"] < 1e-9 for r in line)
    with pytest.raises(ValueError, match="widths"):
        whitening.whiten(frame([(1, [1.0], "", 1), (2, [1.0, 2.0], "", 1)]))


def test_whitening_query(spark):
    found = QUERIES["op11_embedding_whitening"](spark, FOLDER)
    assert dict(found.dtypes)["deviation"] == "bigint"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    fixed, n, sums, cov, values, axes = expected_whitening(rows)
    for r in found.where("vec_id < 20").collect():
        x = fixed[[i for i, _ in rows].index(r["vec_id"])]
        assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x, sums))
        k = r["component"] - 1
        projected = (np.array(x) - np.array(sums) / n) @ axes[:, k] / np.sqrt(values[k])
        assert abs(abs(r["whitened"]) - abs(projected)) < 1e-8


# alignment


@pytest.fixture(scope="module")
def sides():
    return alignment.ByteLevel(BYTE), alignment.Pieces(PIECE)


def expected_alignments(texts, sides):
    byte = Tokenizer.from_file(BYTE)
    byte.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    ids_a = [byte.encode(f" {t}", add_special_tokens=False).ids for t in texts]
    ids_b = [piece.encode(t or "") for t in texts]
    return plain.alignments(texts, ids_a, ids_b, sides[0].bytes, sides[1].bytes)


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    parts = [*"abAB .,\n\n  \t", " ", " ", "é", "▁", "<s>", "<|endoftext|>", "\x1c", "\r", "中", "🙂", "'s", "don't", "12", "́", "\x00", " the", " and"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(n)]


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


@pytest.mark.parametrize("shipped, kept", [(4_000_000, 400_000), (0, 5)])
def test_alignment(spark, sides, monkeypatch, shipped, kept):
    monkeypatch.setattr(alignment, "SHIPPED_PAIRS", shipped)
    monkeypatch.setattr(alignment, "KEPT_ATOMS", kept)
    monkeypatch.setattr(alignment, "TEXTS", 50)
    texts = [*odd_texts(1500), *[t for t in made_texts() if t is None or len(t) < 3000], "x" * 300 + " y", None, "same", "same"]
    rows = [(i % 1400 or None, t, 5, "p", [1]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair int, pairs string, times array<int>").repartition(3)
    found = alignment.align_tokens(docs, BYTE, PIECE).select("doc_id", *ALIGNED)
    expected = [(d, *e) for (d, *_), e in zip(rows, expected_alignments(texts, sides))]
    same(map(tuple, found.collect()), expected)
    assert alignment.align_tokens(docs.where("false"), BYTE, PIECE).count() == 0


def test_long_texts_align(spark, sides):
    text = max(made_texts(), key=lambda t: len(t or ""))
    (row,) = alignment.align_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), BYTE, PIECE).collect()
    ids = sides[0](f" {text}"), sides[1](f" {text}")
    sizes = [np.array([len(side.bytes[i]) for i in found]) for side, found in zip(sides, ids)]
    ends = [np.cumsum(s) for s in sizes]
    groups = np.intersect1d(*ends)
    assert (row["n_a"], row["n_b"], row["n_groups"]) == (len(ids[0]), len(ids[1]), len(groups))
    # of gapless tokenizations, each token end but the last of a group begins one more link
    assert row["n_links"] == len(np.union1d(*ends))


def test_intervals_coalesce():
    a, b = np.array([3, 2, 4]), np.array([1, 2, 3, 3])
    group_a, group_b, i, j = alignment.coalesce(a, b, np.cumsum(a) - a, np.cumsum(b) - b)
    assert group_a.tolist() == [0, 1, 1] and group_b.tolist() == [0, 0, 1, 1]
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (1, 2), (2, 2), (2, 3)]


# repeated byte strings


def byte_rows(odd_docs):
    return [(d, t if t is None or len(t) < 4000 else t[:4000]) for d, t in both(odd_docs)]


@pytest.mark.parametrize("window, lead, crowded, at_once", [(40, 12, 4000, 4 << 20), (40, 12, 0, 1), (40, 12, 3, 200), (9, 4, 5, 2000), (100, 99, 50, 1)])
def test_byte_repeats(spark, odd_docs, monkeypatch, window, lead, crowded, at_once):
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    monkeypatch.setattr(suffixes, "SORTED_BYTES", at_once)
    rows = byte_rows(odd_docs)
    rows += [(70, "a" * 300), (71, "ab" * 200), (72, "a" * 39), (73, "é" * 90 + "x" * 30), (74, "x" * 29 + "é" * 77), (75, "b" * window)]
    rows += [(500, "q" + rows[20][1]), (501, rows[20][1] + "q" * 5)]
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id long, text string, lead int, tid string").repartition(4)
    expected = [(d, *r) for (d, _), r in zip(rows, plain.byte_repeats([t for _, t in rows], window))]
    same(map(tuple, suffixes.remove_repeats(docs, window, lead).collect()), expected)


def test_byte_repeats_over_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 64)
    rng = random.Random(8)
    base = "".join(rng.choice("abcd ") for _ in range(500))
    rows = [(1, base), (2, "zz" + base[37:400] + "yy" + base[:90]), (3, base[300:] + "é" + base[:300]), (4, "only here " * 3), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = [(d, *r) for (d, _), r in zip(rows, plain.byte_repeats([t for _, t in rows], 40))]
    same(map(tuple, suffixes.remove_repeats(docs, 40, 12).collect()), expected)


def test_hot_passage_and_copies(spark):
    """A third of the rows share a passage, another third are copies; neighbours of the passage differ."""
    rng = random.Random(2)
    word = lambda n: " ".join(f"{rng.randrange(10**6):x}" for _ in range(n))
    passage, copy = word(80), word(120)
    rows = [(i, f"{word(rng.randrange(30))} {passage} {word(rng.randrange(30))}") for i in range(60)]
    rows += [(60 + i, copy) for i in range(60)] + [(120 + i, word(60)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = {r["doc_id"]: tuple(r)[1:] for r in suffixes.remove_repeats(docs).collect()}
    expected = plain.byte_repeats([t for _, t in rows], 400)
    assert found == {d: e for (d, _), e in zip(rows, expected)}
    assert sum(e[1] > 0 for e in expected) == 120


def test_strings_sort_by_multikey_quicksort():
    rng = np.random.default_rng(5)
    for window in (8, 11, 16, 40):
        data = bytes(rng.integers(97, 99, 600, dtype=np.uint8))
        places = np.arange(len(data) - window + 1)
        groups = places % 3
        times = Counter((g, data[p : p + window]) for g, p in zip(groups, places))
        found = suffixes.equal_strings(data, places, groups, window)
        assert found.tolist() == [times[g, data[p : p + window]] > 1 for g, p in zip(groups, places)]
    assert suffixes.equal_strings(b"", np.zeros(0, int), np.zeros(0, int), 8).tolist() == []


def test_least_keys_and_merged_runs():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 30):
        keys = rng.integers(0, 50, 60).astype(np.uint64)
        assert suffixes.least_of_each(keys, n).tolist() == [min(keys[i : i + n]) for i in range(61 - n)]
    begins, ends = suffixes.merged(np.array([5, 0, 9, 20]), np.array([9, 3, 12, 21]))
    assert (begins.tolist(), ends.tolist()) == ([0, 5, 20], [3, 12, 21])


def test_empty_table_has_no_repeats(spark, odd_docs):
    assert suffixes.remove_repeats(odd_docs.where("false")).count() == 0
    assert hashlib.sha256(b"").hexdigest() in {r["kept_sha256"] for r in suffixes.remove_repeats(odd_docs).collect()}
    assert suffixes.remove_repeats(odd_docs.select("doc_id", F.lit(None).cast("string").alias("text"))).agg(F.sum("n_bytes")).first()[0] == 0

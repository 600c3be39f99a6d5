import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.text import content_hash
from ledgerlake.functions.vectors import normalize
from ledgerlake.operators import bm25, chunking, embeddings, ranking, retrieval, vectors

WORDS = "wire fee limit card fraud report deposit mobile check account savings daily".split()


def corpus(spark, texts):
    data = [(f"d#{i}", "d", i, -1, "T", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        data, "chunk_id string, document_name string, section_index int, sub_index int, section_title string, content string"
    )


def plain_scores(texts, query):
    """The published formula, evaluated directly."""
    docs = [t.split() for t in texts]
    avg = sum(map(len, docs)) / len(docs)
    df = {w: sum(w in d for d in docs) for d in docs for w in d}
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    result = []
    for d in docs:
        score = 0.0
        for w in query.split():
            f = d.count(w)
            score += idf.get(w, 0) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(d) / avg))
        result.append(round(score, 6))
    return result


@pytest.fixture(scope="module")
def random_texts():
    draw = random.Random(3)
    # "common" is in most texts, so its weight is negative before the floor
    return [" ".join(["common"] * (i % 4 > 0) + draw.choices(WORDS, k=draw.randrange(1, 12))) for i in range(40)]


def test_bm25_against_the_formula(spark, random_texts):
    queries = {"one": "wire fee", "repeat": "fee fee fee limit", "common": "common card", "none": "zebra", "all": " ".join(WORDS)}
    index = bm25.build_index(corpus(spark, random_texts))
    asked = spark.createDataFrame(list(queries.items()), "query_id string, query string")
    found = {}
    for r in bm25.search(asked, index, k=12).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    for name, text in queries.items():
        scores = plain_scores(random_texts, text)
        expected = sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:12]
        assert [c for c, _ in found[name]] == [f"d#{i}" for i in expected]
        assert [s for _, s in found[name]] == pytest.approx([scores[i] for i in expected], abs=2e-6)
    assert index.stats.chunks == 40 and index.stats.avg_length == pytest.approx(np.mean([len(t.split()) for t in random_texts]))


def test_scores_below_zero_rank_after_unmatched_chunks(spark):
    texts = ["aa bb", "aa bb", "aa bb", "aa cc", "dd ee ff gg hh ii", "aa bb cc"]
    texts = [t if i != 4 else "" for i, t in enumerate(texts)] + ["aa bb cc", ""]
    index = bm25.build_index(corpus(spark, texts))
    assert index.stats.mean_idf < 0 and index.stats.chunks == 8
    asked = spark.createDataFrame([("q", "aa"), ("r", "aa bb cc")], "query_id string, query string")
    found = bm25.search(asked, index, k=4).orderBy("query_id", "rank").collect()
    docs = [t for t in texts]
    for name, text in (("q", "aa"), ("r", "aa bb cc")):
        scores = plain_scores(docs, text)
        expected = sorted(range(len(docs)), key=lambda i: (-scores[i], i))[:4]
        assert [r["chunk_id"] for r in found if r["query_id"] == name] == [f"d#{i}" for i in expected]


def test_query_blocks_give_the_same(spark, random_texts, monkeypatch, rows):
    index = bm25.build_index(corpus(spark, random_texts))
    asked = spark.createDataFrame([(f"q{i}", " ".join(WORDS[i : i + 3])) for i in range(9)], "query_id string, query string")
    whole = rows(bm25.search(asked, index))
    monkeypatch.setattr(vectors, "QUERY_ROWS", 2)
    monkeypatch.setattr(bm25, "SCAN_CHUNKS", 7)
    assert rows(bm25.search(asked, index)) == whole
    scored = {(r["query_id"], r["chunk_id"]): r["score"] for r in bm25.scores(asked, index).collect()}
    assert all(scored.get((r["query_id"], r["chunk_id"]), 0.0) == r["score"] for r in bm25.search(asked, index).collect())


# vectors


def vector_tables(spark, n_queries, n_items, dim=8, copies=1, seed=0):
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((n_queries, dim))
    x = np.repeat(rng.standard_normal((n_items // copies, dim)), copies, axis=0)
    x[0] = 0  # a zero vector scores zero
    queries = spark.createDataFrame([(f"q{i:03d}", v.tolist()) for i, v in enumerate(q)], "query_id string, embedding array<double>")
    items = spark.createDataFrame([(f"i{i:04d}", v.tolist()) for i, v in enumerate(x)], "item_id string, embedding array<double>")
    lengths = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, lengths, out=np.zeros_like(x), where=lengths > 0)
    cos = np.round(q / np.linalg.norm(q, axis=1, keepdims=True) @ unit.T, 6)
    return queries, items, cos


def plain_top(cos, k):
    return {f"q{i:03d}": [f"i{j:04d}" for j in sorted(range(len(r)), key=lambda j: (-r[j], j))[:k]] for i, r in enumerate(cos)}


def as_lists(hits):
    found = {}
    for r in hits.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["item_id"])
    return found


@pytest.mark.parametrize("copies", [1, 10])
def test_nearest_is_exact_also_with_copies(spark, copies):
    queries, items, cos = vector_tables(spark, 13, 300, copies=copies)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        assert as_lists(vectors.nearest(queries, items.repartition(5), k=7)) == plain_top(cos, 7)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_give_the_same_as_the_scan(spark, monkeypatch):
    queries, items, cos = vector_tables(spark, 25, 200, copies=4)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 4)
    assert as_lists(vectors.nearest(queries, items, k=6)) == plain_top(cos, 6)


def test_search_shuffles_no_vectors(spark, base):
    asked = spark.createDataFrame([(1, "report fraud")], "query_id int, query string")
    plan = retrieval.search_vectors(asked, base)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :].split("MapInArrow", 2)[1]
    assert "Exchange" not in below.split("Scan parquet")[0]


def test_hashed_search_finds_neighbours_of_one_table(spark):
    """Recall on the given vectors, every twentieth as a query; both sides come from one DataFrame."""
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    items = given.selectExpr("cast(vec_id as string) as item_id", "embedding")
    asked = given.filter("vec_id % 20 = 0").selectExpr("cast(vec_id as string) as query_id", "embedding")
    exact, hashed = as_lists(vectors.nearest(asked, items)), as_lists(vectors.nearest_hashed(asked, items))
    recall = np.mean([len(set(exact[q]) & set(hashed.get(q, []))) / 5 for q in exact])
    assert recall >= 0.9
    self_join = items.select("item_id", F.col("item_id").alias("query_id"), "embedding").limit(60)
    assert vectors.nearest_hashed(self_join, self_join).filter("query_id = item_id and rank = 1").count() >= 59


@pytest.mark.parametrize("bits", [7, 10, 13])
def test_hashed_search_keeps_recall_where_few_cells_are_probed(spark, monkeypatch, bits):
    """Every twentieth of 2,000 vectors as a query, in up to 8,192 cells, of which few are probed."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    items = given.selectExpr("cast(vec_id as string) as item_id", "embedding")
    asked = given.filter("vec_id % 20 = 0").selectExpr("cast(vec_id as string) as query_id", "embedding")
    probes, measure = [], vectors.measured_probes
    monkeypatch.setattr(vectors, "measured_probes", lambda *given: probes.append(measure(*given)) or probes[0])
    exact, hashed = as_lists(vectors.nearest(asked, items)), as_lists(vectors.nearest_hashed(asked, items, bits=bits))
    recall = np.mean([len(set(exact[q]) & set(hashed.get(q, []))) / 5 for q in exact])
    print(f"bits {bits} probes {probes[0]} recall {recall:.3f}")
    assert recall >= 0.9 and probes[0] <= 0.1 * 2**bits


def test_fewer_items_than_k_and_no_queries(spark):
    queries, items, cos = vector_tables(spark, 3, 4)
    assert as_lists(vectors.nearest(queries, items, k=9)) == plain_top(cos, 9)
    assert vectors.nearest(queries.limit(0), items).count() == 0


def test_hashed_cells_recall_and_splitting(spark, rows):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((20, 16))
    data = [(f"i{i:04d}", (centers[i % 20] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(400)]
    items = spark.createDataFrame(data, "item_id string, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i:03d}", c.tolist()) for i, c in enumerate(centers)], "query_id string, embedding array<double>")
    exact, hashed = as_lists(vectors.nearest(queries, items)), as_lists(vectors.nearest_hashed(queries, items))
    recall = np.mean([len(set(exact[q]) & set(hashed.get(q, []))) / 5 for q in exact])
    assert recall >= 0.9
    split = vectors.nearest_hashed(queries, items, cell_rows=3)
    assert rows(split) == rows(vectors.nearest_hashed(queries, items))


# fusion and the whole path


def test_fusion_scores_ties_and_missing_ranks(spark):
    v = spark.createDataFrame([("q", c, r) for r, c in enumerate("abc", 1)], "query_id string, chunk_id string, rank int")
    b = spark.createDataFrame([("q", c, r) for r, c in enumerate("cda", 1)], "query_id string, chunk_id string, rank int")
    found = ranking.fuse(v, b, 4).orderBy("rank").collect()
    # a and c tie with the ranks swapped: the better vector rank goes first
    assert [(r["chunk_id"], r["vector_rank"], r["bm25_rank"]) for r in found] == [("a", 1, 3), ("c", 3, 1), ("b", 2, None), ("d", None, 2)]
    assert found[0]["score"] == pytest.approx(1 / 61 + 1 / 63)
    swapped = {r["chunk_id"]: r["score"] for r in ranking.fuse(b, v, 4).collect()}
    assert swapped == {r["chunk_id"]: r["score"] for r in found}


DOCUMENTS = {
    "fees": "# Fees\n## Wire fee\nA domestic wire costs thirty dollars, an international wire costs forty five.\n## Card fee\nA replacement card costs ten dollars when it is sent by express mail.",
    "fraud": "# Fraud\n## Reporting\nReport a lost card or fraud at once by phone, at any hour of the day or night.",
    "copy": "## Wire fee\nA domestic wire costs thirty dollars, an international wire costs forty five.",
}


@pytest.fixture(scope="module")
def base(spark):
    documents = spark.createDataFrame(list(DOCUMENTS.items()), "document_name string, text string")
    return retrieval.ingest(documents, embeddings.hashing_provider(32), "test-model")


def test_hybrid_end_to_end(spark, base):
    asked = spark.createDataFrame([(1, "report fraud"), (2, "wire costs"), (3, "wire costs")], "query_id int, query string")
    found = retrieval.hybrid(asked, base, k=2).orderBy("query_id", "rank").collect()
    by_query = {q: [r["chunk_id"] for r in found if r["query_id"] == q] for q in (1, 2, 3)}
    assert by_query[1][0] == "fraud#1" and by_query[2] == by_query[3] == ["copy#1", "fees#1"]  # equal texts: corpus order
    assert found[0]["section_title"] == "Reporting" and found[0]["vector_rank"] == found[0]["bm25_rank"] == 1
    assert base.vectors.count() == 3 and base.chunks.count() == 4  # equal texts are embedded once
    compared = retrieval.compare(asked, base, k=2)
    assert compared.groupBy("query_id", "retriever").count().filter("count = 2").count() == 9


def test_ingest_again_replaces(spark, tmp_path):
    documents = spark.createDataFrame(list(DOCUMENTS.items()), "document_name string, text string")
    for source in (documents, documents.filter("document_name = 'fees'")):
        base = retrieval.ingest(source, embeddings.hashing_provider(8), "m", str(tmp_path / "kb"))
    assert (base.chunks.count(), base.vectors.count(), base.index.chunks.count()) == (2, 2, 2)


def test_ingest_rejects_duplicate_chunks(spark):
    twice = spark.createDataFrame(list(DOCUMENTS.items()) + [("fees", DOCUMENTS["fees"])], "document_name string, text string")
    with pytest.raises(ValueError, match="not unique"):
        retrieval.ingest(twice, embeddings.hashing_provider(8), "m")


# embedding store


def test_store_embeds_each_missing_text_once(spark, rows):
    texts = spark.createDataFrame([("aa bb",), ("aa bb",), ("cc",), ("dd",)], "text string")
    stored = texts.filter("text = 'dd'").select(content_hash(F.col("text")).alias("content_hash"))
    fresh = embeddings.embed_texts(texts, stored, embeddings.hashing_provider(16), "m1")
    assert rows(fresh, "content_hash") == rows(texts.filter("text <> 'dd'").distinct().select(content_hash(F.col("text"))))
    assert embeddings.store_violations(fresh, "m1", 16).count() == 0
    assert rows(embeddings.store_violations(fresh, "m2", 8), "rule") == [("dim",)] * 2 + [("model_id",)] * 2
    looked_up = embeddings.embed_texts(texts, stored, embeddings.table_provider(fresh), "m1")
    assert rows(looked_up, "content_hash", "embedding") == rows(fresh, "content_hash", "embedding")


def test_hashed_vectors(spark):
    """Slots by the digest of a term, which is taken once per term and batch and not per occurrence."""
    words = {"h0": "aa bb aa ÉÉ", "h1": "", "h2": "x", "h3": "bb " * 50}
    texts = spark.createDataFrame(list(words.items()), "content_hash string, text string")
    made = embeddings.hashing_provider(8)(texts)
    assert "md5" not in made._jdf.queryExecution().executedPlan().toString()
    for key, vector in made.collect():
        plain = np.zeros(8)
        for term in [t.lower() for t in words[key].split() if len(t) > 1]:
            plain[int(hashlib.md5(term.encode()).hexdigest()[:7], 16) % 8] += 1
        assert vector == pytest.approx((plain / max(np.linalg.norm(plain), 1)).tolist())


def test_chunk_names_with_nulls(spark):
    rows = [("d", 0, -1), ("d", 3, 12), (None, 0, -1), ("e", None, 2), ("f", 1, None)]
    places = spark.createDataFrame(rows, "document_name string, section_index int, sub_index int")
    assert [r[0] for r in places.select(chunking.chunk_name()).collect()] == ["d#0", "d#3.12", "null#0", "e#null.2", "f#1.null"]


def test_the_length_of_a_vector_is_taken_once(spark):
    """Not for each of its numbers, which is quadratic in the dimension."""
    rows = [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [])]
    units = spark.createDataFrame(rows, "i int, v array<double>").select("i", normalize(F.col("v")).alias("u"))
    assert units._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    assert [tuple(r) for r in units.orderBy("i").collect()] == [(0, [0.6, 0.8]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [])]

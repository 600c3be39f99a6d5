"""Chunking, BM25, vector and hybrid retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.functions.text import WHITESPACE, content_hash, tokenize
from ledgerlake.functions.vectors import norm
from ledgerlake.operators import bm25, cells, chunking, embeddings, requests, retrieval, vectors
from ledgerlake.plans import standins as s
from ledgerlake.plans.registry import query
from ledgerlake.plans.table_queries import DISPATCH, DISPATCHED
from ledgerlake.workspace import new_folder, written

_DIM = 64

# chunking -----------------------------------------------------------------


@query(
    "chunk_sections",
    f"""SELECT 'conv-' || conv_id AS document_name, CAST(turn + 1 AS BIGINT) AS section_index,
       role || ' ' || turn AS section_title, trim(text, '{WHITESPACE}') AS body FROM conversations
UNION ALL SELECT DISTINCT 'conv-' || conv_id, CAST(0 AS BIGINT), 'conv ' || conv_id, '' FROM conversations""",
)
def chunk_sections(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.sections(s.conversation_texts(spark, folder)).withColumn(
        "section_index", F.col("section_index").cast("bigint")
    )


_CHUNK = """SELECT chunk_id, document_name, CAST(section_index AS BIGINT) AS section_index,
       CAST(sub_index AS BIGINT) AS sub_index, section_title, content FROM chunks"""


def _wide(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns({c: F.col(c).cast("bigint") for c in ("section_index", "sub_index")})


@query("chunk_documents", s.with_(s.DOCUMENT_CHUNKS) + _CHUNK)
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _wide(chunking.chunk(s.documents(spark, folder)))


@query("chunk_pages", s.with_(s.PAGE_CHUNKS.replace("chunks", "page_chunks")) + _CHUNK.replace("FROM chunks", "FROM page_chunks"))
def chunk_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _wide(chunking.chunk(s.page_texts(spark, folder)))


@query(
    "chunk_pack_paragraphs",
    s.with_(s.DOCUMENT_CHUNKS)
    + """SELECT document_name, count(*) AS pieces, max(length(content)) AS longest, CAST(sum(length(content)) AS BIGINT) AS n_chars
FROM chunks WHERE sub_index >= 0 GROUP BY 1""",
)
def chunk_pack_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    long = chunking.sections(s.documents(spark, folder)).filter(F.length("body") > chunking.MAX_CHUNK_CHARS)
    pieces = long.select("document_name", F.explode(chunking.pack(chunking.paragraphs(F.col("body")))).alias("piece"))
    return pieces.groupBy("document_name").agg(
        F.count(F.lit(1)).alias("pieces"), F.max(F.length("piece")).cast("bigint").alias("longest"),
        F.sum(F.length("piece")).alias("n_chars"),
    )


@query(
    "chunk_counts",
    s.with_(s.DOCUMENT_CHUNKS)
    + """SELECT document_name, count(*) AS chunks FROM chunks GROUP BY 1
UNION ALL SELECT 'files', count(DISTINCT document_name) FROM chunks UNION ALL SELECT 'total', count(*) FROM chunks""",
)
def chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    chunks = chunking.chunk(s.documents(spark, folder))
    totals = chunking.corpus_totals(chunks).select(
        F.inline(
            F.array(
                F.struct(F.lit("files").alias("document_name"), F.col("files").alias("chunks")),
                F.struct(F.lit("total").alias("document_name"), F.col("total_chunks").alias("chunks")),
            )
        )
    )
    return chunking.chunk_counts(chunks).unionByName(totals)


@query(
    "chunk_preview",
    s.with_(s.DOCUMENT_CHUNKS)
    + """SELECT document_name, chunk_id, section_title, substr(content, 1, 150) AS preview, length(content) AS n_chars
FROM chunks QUALIFY row_number() OVER (PARTITION BY document_name ORDER BY section_index, sub_index) = 1""",
)
def chunk_preview(spark: SparkSession, folder: str) -> DataFrame:
    first = chunking.first_chunks(chunking.chunk(s.documents(spark, folder)))
    return first.withColumn("n_chars", F.col("n_chars").cast("bigint"))


# tokens and BM25 ----------------------------------------------------------


@query(
    "tokenize",
    f"""SELECT doc_id, len(tokens) AS n_tokens, sha256(array_to_string(tokens, ' ')) AS token_hash
FROM (SELECT doc_id, {s.tokens_sql('text')} AS tokens FROM documents)""",
)
def tokenize_documents(spark: SparkSession, folder: str) -> DataFrame:
    tokens = s.table(spark, folder, "documents").select("doc_id", tokenize(F.col("text")).alias("tokens"))
    return tokens.select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("tokens", " "), 256).alias("token_hash"),
    )


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return s.table(spark, folder, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))


_BM25 = rf"""corpus AS (SELECT *, {s.tokens_sql('content')} AS tokens FROM chunks),
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avg_length FROM corpus),
postings AS (
  SELECT chunk_id, term, count(*) AS tf, any_value(length) AS length
  FROM (SELECT chunk_id, len(tokens) AS length, unnest(tokens) AS term FROM corpus) GROUP BY ALL),
idf_raw AS (
  SELECT term, round_even(1000000000 * (ln(n - count(*) + CAST(0.5 AS DOUBLE)) - ln(count(*) + CAST(0.5 AS DOUBLE))), 0)
               / CAST(1000000000 AS DOUBLE) AS idf
  FROM postings, stats GROUP BY term, n),
mean_idf AS (
  SELECT CAST(sum(CAST(round_even(1000000000 * idf, 0) AS BIGINT)) AS DOUBLE) / count(*) / CAST(1000000000 AS DOUBLE) AS m FROM idf_raw),
weights AS (SELECT term, CASE WHEN idf < 0 THEN CAST(0.25 AS DOUBLE) * m ELSE idf END AS w FROM idf_raw, mean_idf),
questions AS (
  SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({s.tokens_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT query_id, chunk_id,
         floor((CAST(sum(CAST(round_even(1000000000 * (
           qtf * w * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * length / avg_length))
         ), 0) AS BIGINT)) AS DOUBLE) + 500) / 1000) / CAST(1000000 AS DOUBLE) AS score
  FROM questions JOIN weights USING (term) JOIN postings USING (term), stats GROUP BY ALL)"""


def _bm25_ranked(k: int) -> str:
    return f"""bm25_ranked AS (
  SELECT query_id, chunk_id, coalesce(score, 0) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, document_name, section_index, sub_index) AS rank
  FROM (SELECT item_id AS query_id, chunks.* FROM benchmark, chunks) LEFT JOIN scores USING (query_id, chunk_id)
  QUALIFY rank <= {k})"""


def _index(spark: SparkSession, folder: str) -> bm25.Bm25Index:
    return bm25.build_index(written(chunking.chunk(s.documents(spark, folder)), "chunks"))


@query(
    "bm25_stats",
    s.with_(s.DOCUMENT_CHUNKS, _BM25)
    + """SELECT n AS chunks, round(avg_length, 6) AS avg_length, (SELECT count(*) FROM idf_raw) AS terms,
       (SELECT round(m, 6) FROM mean_idf) AS mean_idf FROM stats""",
)
def bm25_stats(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(spark, folder)
    return index.stats_table.select(
        "chunks", F.round("avg_length", 6).alias("avg_length"), "terms", F.round("mean_idf", 6).alias("mean_idf")
    )


@query("bm25_scores", s.with_(s.DOCUMENT_CHUNKS, _BM25) + "SELECT query_id, chunk_id, score FROM scores")
def bm25_scores(spark: SparkSession, folder: str) -> DataFrame:
    return bm25.scores(s.questions(spark, folder), _index(spark, folder)).select("query_id", "chunk_id", "score")


@query(
    "bm25_topk",
    s.with_(s.DOCUMENT_CHUNKS, _BM25, _bm25_ranked(5)) + "SELECT query_id, chunk_id, score, rank FROM bm25_ranked",
)
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(bm25.search(s.questions(spark, folder), _index(spark, folder)))


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


# embeddings and vectors ---------------------------------------------------

_CENTROIDS = """centroids AS (
  SELECT label, list(x ORDER BY i) AS v FROM (
    SELECT label, i, avg(CAST(x AS DOUBLE)) AS x
    FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL)
  GROUP BY 1)"""


def _centroids(spark: SparkSession, folder: str) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    mean = F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(_DIM)])
    return s.table(spark, folder, "embeddings").groupBy("label").agg(mean.alias("embedding")).select(
        F.col("label").cast("string").alias("query_id"), "embedding"
    )


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return s.table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"), "embedding")


@query(
    "vector_topk",
    s.with_(_CENTROIDS)
    + """SELECT CAST(c.label AS VARCHAR) AS query_id, CAST(vec_id AS VARCHAR) AS item_id,
       round(list_cosine_similarity(v, CAST(embedding AS DOUBLE[])), 6) AS score,
       row_number() OVER (PARTITION BY c.label ORDER BY round(list_cosine_similarity(v, CAST(embedding AS DOUBLE[])), 6) DESC,
                          CAST(vec_id AS VARCHAR)) AS rank
FROM centroids c, embeddings e QUALIFY rank <= 5""",
)
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = vectors.nearest(_centroids(spark, folder), _items(spark, folder))
    return hits.withColumn("rank", F.col("rank").cast("bigint"))


@query("vector_topk_lsh")
def vector_topk_lsh(spark: SparkSession, folder: str) -> DataFrame:
    hits = vectors.nearest_hashed(_centroids(spark, folder), _items(spark, folder))
    return hits.withColumn("rank", F.col("rank").cast("bigint"))


def _every_twentieth(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whose id is divisible by 20, as a query against all rows."""
    asked = s.table(spark, folder, "embeddings").filter("vec_id % 20 = 0")
    return written(asked.select(F.col("vec_id").cast("string").alias("query_id"), "embedding"), "vector-queries")


@query(
    "vector_cells_exact",
    """SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(e.vec_id AS VARCHAR) AS item_id,
       round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY
         round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) DESC,
         CAST(e.vec_id AS VARCHAR)) AS rank
FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5""",
)
def vector_cells_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Exact neighbours by the cells that angles can't rule out."""
    hits = cells.build(_items(spark, folder)).nearest(_every_twentieth(spark, folder))
    return hits.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "vector_cells_recall",
    """SELECT count(*) AS queries, 5 * count(*) AS neighbours, true AS nine_of_ten_found, true AS one_of_ten_scored
FROM embeddings WHERE vec_id % 20 = 0""",
)
def vector_cells_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether approximate search finds nine tenths of the exact neighbours, and scores a tenth of the items at most."""
    asked, items = _every_twentieth(spark, folder), _items(spark, folder)
    index = cells.build(items)
    exact = vectors.nearest(asked, items).select("query_id", "item_id", F.lit(1).alias("near"))
    found = index.search(asked).select("query_id", "item_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "item_id"], "left").agg(F.count("near").alias("neighbours"), F.count("hit").alias("hits"))
    scored, n = index.work(asked).agg(F.sum("scored"), F.count(F.lit(1))).first()
    return both.select(
        F.lit(n).alias("queries"), "neighbours", (10 * F.col("hits") >= 9 * F.col("neighbours")).alias("nine_of_ten_found"),
        F.lit(10 * scored <= n * index.model.items).alias("one_of_ten_scored"),
    )


@query(
    "embedding_norms",
    "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS norm FROM embeddings",
)
def embedding_norms(spark: SparkSession, folder: str) -> DataFrame:
    return s.table(spark, folder, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 5).alias("norm"))


@query(
    "embedding_contract",
    f"""SELECT sha256(CAST(vec_id AS VARCHAR)) AS content_hash, 'dim' AS rule FROM embeddings WHERE len(embedding) <> {embeddings.EMBEDDING_DIM}
UNION ALL SELECT sha256(CAST(vec_id AS VARCHAR)), 'model_id' FROM embeddings WHERE label > 4""",
)
def embedding_contract(spark: SparkSession, folder: str) -> DataFrame:
    """A store of another width, half of it written by another model."""
    store = s.table(spark, folder, "embeddings").select(
        F.sha2(F.col("vec_id").cast("string"), 256).alias("content_hash"),
        F.when(F.col("label") <= 4, "model-a").otherwise("model-b").alias("model_id"), "embedding",
    )
    return embeddings.store_violations(store, "model-a")


@query(
    "embed_pending",
    """SELECT DISTINCT sha256(text) AS content_hash, length(text) AS n_chars FROM documents
WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))""",
)
def embed_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of labelled documents are stored already, copies of them included."""
    documents = s.table(spark, folder, "documents")
    stored = documents.join(s.table(spark, folder, "labels"), "doc_id", "left_semi")
    store = stored.select(content_hash(F.col("text")).alias("content_hash"))
    return embeddings.pending_texts(documents.select("text"), store).select(
        "content_hash", F.length("text").cast("bigint").alias("n_chars")
    )


# hybrid -------------------------------------------------------------------


def _slots(source: str, key: str, text: str) -> str:
    return f"""(SELECT {key}, slot, CAST(count(*) AS DOUBLE) AS c FROM (
    SELECT {key}, CAST('0x' || substr(md5(t), 1, 7) AS BIGINT) % {_DIM} AS slot
    FROM (SELECT {key}, unnest({s.tokens_sql(text)}) AS t FROM {source})) GROUP BY ALL)"""


_VECTORS = f"""chunk_slots AS {_slots('chunks', 'chunk_id', 'content')},
question_slots AS {_slots('benchmark', 'item_id', 'text')},
chunk_norms AS (SELECT chunk_id, sqrt(sum(c * c)) AS norm FROM chunk_slots GROUP BY 1),
question_norms AS (SELECT item_id, sqrt(sum(c * c)) AS norm FROM question_slots GROUP BY 1),
cosines AS (
  SELECT item_id AS query_id, chunk_id, round(sum(q.c * d.c) / any_value(qn.norm) / any_value(dn.norm), 6) AS score
  FROM question_slots q JOIN chunk_slots d USING (slot) JOIN question_norms qn USING (item_id) JOIN chunk_norms dn USING (chunk_id)
  GROUP BY ALL)"""


def _vector_ranked(k: int) -> str:
    return f"""vector_ranked AS (
  SELECT query_id, chunk_id, coalesce(score, 0) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, document_name, section_index, sub_index) AS rank
  FROM (SELECT item_id AS query_id, chunks.* FROM benchmark, chunks) LEFT JOIN cosines USING (query_id, chunk_id)
  QUALIFY rank <= {k})"""


def _fused(k: int) -> str:
    return f"""fused AS (
  SELECT query_id, chunk_id, vector_rank, bm25_rank, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank ASC NULLS LAST, bm25_rank ASC NULLS LAST) AS rank
  FROM (SELECT query_id, chunk_id, v.rank AS vector_rank, b.rank AS bm25_rank,
               coalesce(CAST(1 AS DOUBLE) / (60 + v.rank), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + b.rank), 0) AS score
        FROM vector_ranked v FULL JOIN bm25_ranked b USING (query_id, chunk_id))
  QUALIFY rank <= {k})"""


_HYBRID = (s.DOCUMENT_CHUNKS, _BM25, _VECTORS, _bm25_ranked(10), _vector_ranked(10))


def _base(spark: SparkSession, folder: str) -> retrieval.KnowledgeBase:
    return retrieval.ingest(s.documents(spark, folder), embeddings.hashing_provider(_DIM), "hashed-terms")


@query(
    "hybrid_rrf",
    s.with_(*_HYBRID, _fused(5))
    + "SELECT query_id, rank, chunk_id, document_name, section_title, content, score, vector_rank, bm25_rank FROM fused JOIN chunks USING (chunk_id)",
)
def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieval.hybrid(s.questions(spark, folder), _base(spark, folder))
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("rank", "vector_rank", "bm25_rank")})


@query(
    "retriever_compare",
    s.with_(*_HYBRID, _fused(3))
    + """SELECT query_id, 'vector' AS retriever, rank, chunk_id, score FROM vector_ranked WHERE rank <= 3
UNION ALL SELECT query_id, 'bm25', rank, chunk_id, score FROM bm25_ranked WHERE rank <= 3
UNION ALL SELECT query_id, 'hybrid', rank, chunk_id, score FROM fused""",
)
def retriever_compare(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieval.compare(s.questions(spark, folder), _base(spark, folder))
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "policy_lookup",
    s.with_(*_HYBRID, _fused(5))
    + """SELECT item_id AS request_id, CASE WHEN item_id % 6 = 0 THEN 'invalid_arguments' END AS error,
       rank, document_name AS document, section_title AS section, round_even(score, 4) AS relevance_score
FROM benchmark LEFT JOIN (SELECT * FROM fused JOIN chunks USING (chunk_id)) f
  ON f.query_id = item_id AND f.rank <= item_id % 6""",
)
def policy_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Questions asking for 0 to 5 excerpts; zero is out of range."""
    asked = s.questions(spark, folder).select(
        F.col("query_id").alias("request_id"), "query", (F.col("query_id") % 6).alias("max_results")
    )
    answers = requests.policy_lookup(asked, retrieval.retriever(_base(spark, folder)))
    return answers.select("request_id", "error", F.explode_outer("results").alias("r")).select(
        "request_id", "error", F.col("r.rank").cast("bigint").alias("rank"), "r.document", "r.section", "r.relevance_score"
    )


@query(
    "request_dispatch_mixed",
    s.with_(*DISPATCH, *_HYBRID, _fused(5))
    + DISPATCHED
    + """, CASE WHEN error IS NULL AND tool_name = 'get_account_balance' THEN status END AS status, NULL AS first_document FROM answers
UNION ALL
SELECT -1 - item_id, 'lookup_policy', CASE WHEN item_id % 6 = 0 THEN 'invalid_arguments' END,
       CASE WHEN item_id % 6 > 0 THEN least(item_id % 6, n) END, NULL, NULL, CASE WHEN item_id % 6 > 0 THEN document_name END
FROM benchmark LEFT JOIN (SELECT query_id AS item_id, count(*) AS n FROM fused GROUP BY 1) USING (item_id)
LEFT JOIN (SELECT query_id AS item_id, document_name FROM fused JOIN chunks USING (chunk_id) WHERE rank = 1) USING (item_id)""",
)
def request_dispatch_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of all tools and unknown ones in one table, policy questions among them, with parts of the payload."""
    policy = s.questions(spark, folder).select(
        (F.lit(-1) - F.col("query_id")).alias("request_id"), F.lit("lookup_policy").alias("tool_name"), "query",
        (F.col("query_id") % 6).cast("int").alias("max_results"),
    )
    asked = s.requests(spark, folder).unionByName(policy, allowMissingColumns=True)
    answers = requests.dispatch(
        asked, s.accounts(spark, folder), s.transactions(spark, folder), retrieval.retriever(_base(spark, folder))
    )
    return answers.select(
        "request_id", "tool_name", "error", "result_count", "amount_dollars",
        F.get_json_object("response", "$.status").alias("status"),
        F.get_json_object("response", "$.results[0].document").alias("first_document"),
    )


# changing a search index --------------------------------------------------


@query(
    "bm25_incremental",
    s.with_(s.DOCUMENT_CHUNKS, _BM25, _bm25_ranked(5)) + "SELECT query_id, chunk_id, score, rank FROM bm25_ranked",
)
def bm25_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """An index of two thirds of the documents, some of them outdated, to which the others and the new ones are added.

    Its answers are those of an index that is built from all documents at once.
    """
    chunks = written(chunking.chunk(s.documents(spark, folder)), "chunks")
    part = F.pmod(F.xxhash64("document_name"), F.lit(3))
    outdated = F.when(part == 0, F.reverse("content")).otherwise(F.col("content"))
    index = bm25.build_index(chunks.where(part < 2).withColumn("content", outdated))
    index = bm25.add_chunks(index, chunks.where(part == 2))
    index = bm25.add_chunks(index, chunks.where(part == 0))  # replaces the outdated ones
    return _ranked(bm25.search(s.questions(spark, folder), index))


@query(
    "knowledge_base_replace",
    s.with_(*_HYBRID, _fused(5)) + "SELECT query_id, rank, chunk_id, score FROM fused",
)
def knowledge_base_replace(spark: SparkSession, folder: str) -> DataFrame:
    """A knowledge base of half the documents that is replaced by one of all: readers see the new one only."""
    path = new_folder(spark, "knowledge-base")
    documents = s.documents(spark, folder)
    provider = embeddings.hashing_provider(_DIM)
    retrieval.ingest(documents.where(F.pmod(F.xxhash64("document_name"), F.lit(2)) == 0), provider, "hashed-terms", path)
    base = retrieval.ingest(documents, provider, "hashed-terms", path)
    found = retrieval.hybrid(s.questions(spark, folder), base)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "score")

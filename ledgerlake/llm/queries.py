"""The document operators as registered queries, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.llm import (
    alignment, decontamination, language, merkle, packing, phrases, quality, secret_scan, sharding, simhash, suffixes, token_counts,
    whitening,
)
from ledgerlake.llm.common import documents, held_out
from ledgerlake.workspace import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of ``docs`` with a digest of their ids and their place; the ids themselves don't travel."""
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query("op2_best_fit_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packed(documents(spark, folder))


_OP3 = r"""
WITH items AS (
  SELECT item_id, w, len(w) AS n FROM (
    SELECT item_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az
          FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)
  ) WHERE len(w) > 0
),
windows AS (
  SELECT DISTINCT item_id, least(n, 10) AS size, array_to_string(w[i : i + least(n, 10) - 1], ' ') AS key
  FROM (SELECT item_id, w, n, unnest(range(1, n - least(n, 10) + 2)) AS i FROM items)
),
docs AS (
  SELECT doc_id, w, len(w) AS n FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS key
  FROM (SELECT doc_id, w, size, unnest(range(1, n - size + 2)) AS i
        FROM docs, (SELECT DISTINCT size FROM windows) WHERE n >= size)
),
found AS (SELECT doc_id, item_id, i, places.size FROM places JOIN windows USING (key) WHERE places.size = windows.size),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op3_benchmark_decontamination", _OP3)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark words in every document."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = decontamination.matches(documents(spark, folder).select("doc_id", "text"), benchmark)
    return decontamination.report(found)


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(documents(spark, folder), shingle=3, max_bits=2)


@query("op10_sharding")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Eight shards of near equal bytes."""
    return sharding.shard_documents(documents(spark, folder), shards=8)


@query("op9_secret_scans")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secret_scan.report(secret_scan.scan(documents(spark, folder).select("doc_id", "text")))


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, by a model of the rows that aren't held out."""
    docs = documents(spark, folder)
    held = held_out(4, 2)
    model = language.fit(docs.select("doc_id", "text", "lang"), held)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


@query("op1_quality_classifier")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, by a model of the labelled rows that aren't held out."""
    held = held_out(5, 0)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.classify(documents(spark, folder), labels, held, threshold=0.3)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, with a cache that starts empty."""
    cache = new_folder(spark, "token-cache")
    return token_counts.count_tokens(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), cache, limit=1024)


def _tree_sql(text: str, prefix: str) -> str:
    """Columns {prefix}nodes, which hold the fingerprint's parts, from the column ``text`` of a table."""
    return f"""
      list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
        lambda p: list_transform(regexp_extract_all(p, '[^\\n]{{1,{merkle.SPAN}}}'), lambda x: md5(x)))) AS {prefix}nodes"""


_SHOWN = """
  sha256(array_to_string(list_transform({0}nodes, lambda s: md5(array_to_string(list_transform(s,
      lambda p: md5(array_to_string(p, ''))), ''))), '')) || '/' ||
  array_to_string(list_transform({0}nodes, lambda s:
    left(md5(array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ''))), '')), 8) || '[' ||
    array_to_string(list_transform(s, lambda p: left(md5(array_to_string(p, '')), 8) || '(' ||
      array_to_string(list_transform(p, lambda x: left(x, 8)), '') || ')'), '') || ']'), '') AS {0}fingerprint,
  list_distinct(list_transform(flatten(flatten({0}nodes)), lambda x: left(x, 8))) AS {0}spans"""

_OP8 = f"""
WITH ordered AS (
  SELECT doc_id, coalesce(text, '') AS text,
    coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS next_text
  FROM documents WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
),
edited AS (
  SELECT *, left(text, length(text) - length(text) // 3) || left(next_text, length(text) // 3) AS edited FROM ordered
),
nodes AS (SELECT *, {_tree_sql('text', '')}, {_tree_sql('edited', 'edited_')}, {_tree_sql('next_text', 'next_')} FROM edited),
trees AS (SELECT *, {_SHOWN.format('')}, {_SHOWN.format('edited_')}, {_SHOWN.format('next_')} FROM nodes)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN fingerprint = edited_fingerprint THEN 1.0::DOUBLE ELSE coalesce(len(list_intersect(spans, edited_spans))::DOUBLE
    / nullif(len(list_distinct(list_concat(spans, edited_spans))), 0), 0) END AS near_edited,
  CASE WHEN fingerprint = next_fingerprint THEN 1.0::DOUBLE ELSE coalesce(len(list_intersect(spans, next_spans))::DOUBLE
    / nullif(len(list_distinct(list_concat(spans, next_spans))), 0), 0) END AS near_next
FROM trees
"""


@query("op8_document_fingerprints", _OP8)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Merkle fingerprints of every document and of its edited text."""
    return merkle.edited_fingerprints(documents(spark, folder)).drop("changed")


_OP6 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
windows AS (
  SELECT r, i, sha256(array_to_string(w[i : i + 34], ' ')) AS key
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)
),
again AS (SELECT r, i FROM windows WHERE key IN (SELECT key FROM windows GROUP BY key HAVING count(*) > 1)),
removed AS (SELECT r, list(DISTINCT p) AS places FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM again) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN w
    ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(places, k))), lambda k: w[k]) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN removed USING (r)
"""


@query("op6_substring_dedup", _OP6)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without its repeated passages."""
    return phrases.remove_repeats(documents(spark, folder), window=35)


@query("op11_embedding_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """The first four whitened components of every embedding; a deviation beyond 64 bits has no long and is null."""
    found = whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens of two vocabularies, aligned."""
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align_tokens(documents(spark, folder), a, b)


_OP13 = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS key
  FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM docs WHERE length(h) >= 800)
),
again AS (SELECT r, i FROM strings WHERE key IN (SELECT key FROM strings GROUP BY key HAVING count(*) > 1)),
runs AS (
  SELECT r, min(i) AS b, max(i) + 400 AS e FROM (
    SELECT r, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run
    FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM again))
  GROUP BY r, run
),
gaps AS (
  SELECT r, coalesce(lag(e) OVER w, 0) AS b, b AS e FROM runs WINDOW w AS (PARTITION BY r ORDER BY b)
  UNION ALL SELECT r, max(e), any_value(length(h) // 2) FROM runs JOIN docs USING (r) GROUP BY r
),
kept AS (SELECT r, string_agg(substr(h, 2 * b + 1, 2 * (e - b)), '' ORDER BY b) AS k FROM gaps JOIN docs USING (r) GROUP BY r),
removed AS (SELECT r, sum(e - b) AS n, count(*) AS spans FROM runs GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE k END)) AS kept_sha256
FROM docs LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""


@query("op13_suffix_array_dedup", _OP13)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without its repeated byte strings."""
    return suffixes.remove_repeats(documents(spark, folder), window=400)

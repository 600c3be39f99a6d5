"""The registered document queries against SQL, and the pipeline against a plain version."""

import random
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from ledgerlake.llm import language, secret_scan
from ledgerlake.llm.common import held_out
from ledgerlake.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences
from tests.llm import plain
from tests.llm.conftest import FOLDER
from tests.llm.test_documents import check_sequences


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    n, found = differences(QUERIES[name](spark, FOLDER), duck, ORACLES.get(name))
    assert found == [] and n >= duck.execute("SELECT count(*) FROM documents").fetchone()[0]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_native_fingerprints_have_no_python(spark):
    plan = QUERIES["op8_document_fingerprints"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = language.fit(docs.select("doc_id", "text", "lang"), held_out(4, 2))
    accepted = {i: t for i, t in rows.items() if model.predict([t])[1][0] >= model.threshold}
    ids = sorted(accepted)
    top = plain.groups([plain.fingerprint(accepted[i]) for i in ids], 2)
    kept = [i for place, i in enumerate(ids) if top[place] == place]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = [i for i, (_, hit, _) in zip(kept, plain.contamination([accepted[i] for i in kept], items)) if not hit]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for i in clean:
        spans = [(s, e) for s, e, _ in secret_scan.base_spans(accepted[i])]
        spans += [(s, e) for s, e, _ in secret_scan.guessed_spans(accepted[i])]
        text, at = "", 0
        for start, end in sorted(spans):
            if start >= at:
                text += accepted[i][at:start] + "[SECRET]"
            at = max(at, end)
        text += accepted[i][at:]
        expected.update((i, piece, *p) for piece, p in enumerate(plain.pieces(text, tokenizer)))
    found = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    n = check_sequences(found)
    assert n <= -(-sum(r["length"] for r in found) // 4096) + 1


def test_stages_keep_rows_of_odd_tables(spark, odd_docs):
    plain_columns = odd_docs.columns
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (docs, docs.where("false")):
            result = stage(spark, some, FOLDER)
            assert result.columns == plain_columns, name
            assert result.count() <= some.count(), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    check_sequences(packed.collect())


def test_planted_passages_and_copies(spark, tmp_path):
    """A table of its own: a third of the rows are copies, others near copies, one holds a benchmark item."""
    rng = random.Random(9)
    words = [f"{rng.randrange(10**5):x}" for _ in range(3000)]
    base = [rng.choice(words) for _ in range(300)]
    rows = [(i, " ".join(base)) for i in range(40)]
    rows += [(i, " ".join([*base[:i], "changed", *base[i + 1 :]])) for i in range(40, 60)]
    rows += [(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(60, 120)]
    items = [(5, " ".join(rows[70][1].split()[100:130]))]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = str(tmp_path)
    removed = {r["doc_id"]: r["n_removed"] for r in QUERIES["op6_substring_dedup"](spark, folder).collect()}
    expected = plain.repeats([t for _, t in rows], 35)
    assert removed == {i: e[1] for (i, _), e in zip(rows, expected)}
    assert {r["doc_id"] for r in QUERIES["op3_benchmark_decontamination"](spark, folder).where("contaminated").collect()} == {70}
    top = plain.groups([plain.fingerprint(t) for _, t in rows], 2)
    found = {r["doc_id"]: r["component_id"] for r in QUERIES["op7_simhash_near_dedup"](spark, folder).collect()}
    assert found == {i: rows[t][0] for (i, _), t in zip(rows, top)}

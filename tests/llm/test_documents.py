"""The ten document operators on odd rows, against plain versions, and on empty tables."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from ledgerlake.llm import (
    decontamination, language, merkle, packing, phrases, quality, secret_scan, sharding, simhash, token_counts,
)
from ledgerlake.llm.common import components, held_out, numbered
from ledgerlake.workspace import new_folder, written
from tests.llm import plain

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def both(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def same(found, expected):
    assert Counter(found) == Counter(expected)


def test_decontamination(odd_docs, odd_benchmark):
    rows = both(odd_docs)
    items = [(r[0], r[1]) for r in odd_benchmark.collect() if r[0] is not None]
    expected = []
    for (doc_id, _), (n, hit, named) in zip(rows, plain.contamination([t for _, t in rows], items)):
        joined = ",".join(sorted(map(str, named)))
        expected.append((doc_id, n, hit, len(named), hashlib.sha256(joined.encode()).hexdigest(), hit > 0))
    found = decontamination.report(decontamination.matches(odd_docs, odd_benchmark))
    same(map(tuple, found.collect()), expected)
    kept = decontamination.decontaminate(odd_docs, odd_benchmark)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(not e[-1] for e in expected)


def test_decontamination_in_blocks(odd_docs, odd_benchmark, monkeypatch):
    docs = odd_docs.select("doc_id", "text")
    whole = decontamination.report(decontamination.matches(docs, odd_benchmark)).collect()
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 300)
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 500)
    same(map(tuple, decontamination.report(decontamination.matches(docs, odd_benchmark)).collect()), map(tuple, whole))


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "p q " + " ".join(f"b{i}" for i in range(5, 25)) + " z")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(f"b{i}" for i in range(30)))], "item_id long, text string")
    (row,) = decontamination.matches(docs, bench).collect()
    assert [tuple(m) for m in row["matches"]] == [(7, 5, 2, 20)]
    assert [tuple(s) for s in row["spans"]] == [(2, 22)]


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(0)
    words = np.concatenate((rng.integers(1, 4, 400), np.zeros(10, int)))
    array = decontamination.suffix_array(words, np.arange(400), 10)
    keys = [tuple(words[i : i + 10]) for i in array]
    assert keys == sorted(keys)


def test_simhash(odd_docs):
    rows = both(odd_docs)
    prints = [plain.fingerprint(t) for _, t in rows]
    top = plain.groups(prints, 2)
    least = defaultdict(lambda: None)
    for (doc_id, _), t in zip(rows, top):
        if doc_id is not None and (least[t] is None or doc_id < least[t]):
            least[t] = doc_id
    expected = [(doc_id, f"{p:016x}", least[t]) for (doc_id, _), p, t in zip(rows, prints, top)]
    same(map(tuple, simhash.near_duplicates(odd_docs).collect()), expected)
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(set(top))
    assert {d for d, _ in got} == set(least[t] for t in set(top))


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
@pytest.mark.parametrize("crowded", [1, 3, 32])
def test_links_are_complete(spark, bits, crowded):
    if bits == 4 and crowded < 32:
        pytest.skip("large balls; the path is that of two bits")
    rng = random.Random(bits * 10 + crowded)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            values.add(base)
            for _ in range(rng.randrange(1, 3)):
                base ^= 1 << rng.randrange(64)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    made = simhash.links(fps, bits, crowded)
    at = {v: i for i, v in enumerate(signed)}
    pairs = [(at[r["a"]], at[r["b"]]) for r in made.collect()]
    assert all((values[a] ^ values[b]).bit_count() <= bits for a, b in pairs)
    found = {r["node"]: r["root"] for r in components(made, "a", "b", "test").collect()}
    expected = plain.groups(values, bits)
    classes = defaultdict(set)
    for i, t in enumerate(expected):
        classes[t].add(signed[i])
    for members in classes.values():
        assert {found.get(m, m) for m in members} == {min(members)}


@pytest.mark.parametrize("bits", [2, 3])
def test_links_broadcast_no_exploded_table(spark, monkeypatch, bits):
    """Spark sizes a ball as one value, so it takes the tables here for small ones, as it does balls of many more."""
    plans = []

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(simhash, "written", noted)
    made = simhash.links(spark.range(200).select(F.xxhash64("id").alias("fp")), bits, crowded=3)
    plans.append(made._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 3 and "SortMergeJoin" in plans[1] and "SortMergeJoin" in plans[2]
    assert not any("Broadcast" in plan for plan in plans)


def test_near_duplicates_of_the_pipeline_broadcast_no_fingerprints(spark, odd_docs, monkeypatch):
    """Fingerprints and their balls are rows by the document, which a broadcast would bring to the driver."""
    plans = {}

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, label)

    monkeypatch.setattr(simhash, "written", noted)
    made = corpus_pipeline.near_duplicates(spark, odd_docs, "")
    assert "SortMergeJoin" in plans["simhash-met"] and "Broadcast" not in plans["simhash-met"]
    joins = [line for line in made._jdf.queryExecution().executedPlan().toString().split("\n") if "Join " in line]
    named = [line for line in joins if "component_id" in line]
    assert named and all("SortMergeJoin" in line for line in named)


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 200).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(500, 501)], "a long, b long"))
    found = {r["node"]: r["root"] for r in components(links, "a", "b", "chain").collect()}
    assert found == {**{i: 1 for i in range(1, 201)}, 500: 500, 501: 500}
    assert components(links.limit(0), "a", "b", "chain").count() == 0


def test_packing(odd_docs):
    cut = packing.pieces(odd_docs, WORD).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = packing.pack(cut).collect()
    tokenizer = Tokenizer.from_file(WORD)
    expected = []
    for doc_id, text in both(odd_docs):
        expected += [(doc_id, i, *p) for i, p in enumerate(plain.pieces(text, tokenizer))]
    same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed], expected)
    check_sequences(packed)


def check_sequences(packed, capacity=4096):
    sequences = defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("n, capacity", [(1, 64), (40, 64), (3000, 64), (20_000, 512)])
def test_plans_hold_every_piece(n, capacity):
    rng = np.random.default_rng(n)
    lengths = np.minimum(capacity, rng.lognormal(np.log(capacity / 6), 1, n).astype(int) + 1)
    histogram = np.bincount(lengths, minlength=capacity + 1)
    planned = packing.plan(histogram, capacity)
    held = np.zeros_like(histogram)
    for chosen, times in planned:
        assert sum(chosen) <= capacity and times > 0
        for size in chosen:
            held[size] += times
    assert (held == histogram).all()
    best = -(-int(lengths.sum()) // capacity)
    assert sum(t for _, t in planned) <= best + max(1, best // 100)


def test_plan_of_awkward_lengths():
    histogram = np.zeros(101, dtype=int)
    histogram[51] = 10  # no two of them fit
    histogram[49] = 4
    planned = packing.plan(histogram, 100)
    assert sum(t for _, t in planned) == 10
    assert packing.plan(np.zeros(101, dtype=int), 100) == []


@pytest.mark.parametrize("pieces, fewest", [
    ({1500: 100, 600: 400, 1000: 1}, 101),
    ({1500: 1000, 600: 4000, 1000: 10}, 1003),
    ({1700: 900, 1100: 1800, 640: 900}, 1025),
    ({3000: 500, 2500: 500, 1500: 500, 1000: 1500, 96: 10}, 1250),
    ({2049: 30, 2047: 30, 1366: 5}, 33),
])
def test_plans_of_few_lengths_are_near_the_optimum(pieces, fewest):
    """``fewest`` is the dual bound, rounded up, or the number of a plan by hand."""
    histogram = np.zeros(4097, dtype=np.int64)
    for size, n in pieces.items():
        histogram[size] = n
    planned = packing.plan(histogram)
    held = Counter()
    for chosen, times in planned:
        assert sum(chosen) <= 4096
        held.update({size: chosen.count(size) * times for size in set(chosen)})
    assert held == pieces
    total = sum(times for _, times in planned)
    assert total <= sum(packing.best_fit(histogram).values())
    assert total <= fewest * 1.01
    use, bound = packing.cover(histogram)
    assert sum(use.values()) <= (1 + 2 * packing.GAP) * bound and bound <= total


def test_sharding(odd_docs):
    rows = sharding.shard_documents(odd_docs, 8).collect()
    texts = defaultdict(list)
    for doc_id, text in both(odd_docs):
        texts[doc_id].append(text)
    sizes, slots, of = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of[r["text_crc32"], r["size"]].add(r["shard"])
    assert len(rows) == odd_docs.count() and {r["law"] for r in rows} == {"bytes"}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())
    same([(r["doc_id"], r["size"]) for r in rows], [(d, len((t or "").encode()) + 1) for d, t in both(odd_docs)])


def test_differencing_is_tight(spark, monkeypatch):
    rng = random.Random(3)
    sizes = [int(rng.lognormvariate(6, 1.2)) + 1 for _ in range(3000)]
    dealt = sharding.difference([[s] + [0] * 7 for s in sizes])
    sums = [0] * 8
    for s, places in zip(sizes, dealt):
        assert sorted(places) == list(range(8))
        sums[places[0]] += s
    assert max(sums) - min(sums) <= 8
    groups = spark.createDataFrame([(str(i), s) for i, s in enumerate(sizes)], "k string, s long")
    monkeypatch.setattr(sharding, "HEAVY", 200)  # so that buckets take part
    placed = sharding.balanced(groups, "k", "s", 8).join(groups, "k").groupBy("shard").agg(F.sum("s")).collect()
    totals = [r[1] for r in placed]
    assert sum(totals) == sum(sizes) and max(totals) - min(totals) <= sum(sizes) // 8 // 100


def test_token_counts_and_cache(spark, odd_docs):
    cache = new_folder(spark, "test-cache")
    tokenizer = Tokenizer.from_file(BYTE)
    expected = []
    for doc_id, text in both(odd_docs):
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        expected.append((doc_id, len((text or "").encode()), n, n > 50))
    same(map(tuple, token_counts.count_tokens(odd_docs, BYTE, cache, limit=50).collect()), expected)
    stored = token_counts.stored(spark, cache)
    assert stored.count() == len({t or "" for _, t in both(odd_docs)})
    same(map(tuple, token_counts.count_tokens(odd_docs, BYTE, cache, limit=50).collect()), expected)
    assert token_counts.stored(spark, cache).count() == stored.count()  # nothing was missing
    # a stored count is used, whatever it says
    other = new_folder(spark, "test-cache")
    stored.withColumn("n_tokens", F.lit(77).cast("long")).write.parquet(other)
    assert {r["n_tokens"] for r in token_counts.count_tokens(odd_docs, BYTE, other).collect()} == {77}


def test_words_kept_between_texts_change_nothing():
    from ledgerlake.llm import tokens

    rng = random.Random(1)
    parts = ["a", "b", "Straße", " ", "\n", "\t", "'s", "1", "é", "<|", "!", "<|endoftext|>", "ñ", "  ", "é", "H̱", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(2000)]
    counts, ids = tokens.TokenCounts(BYTE), tokens.WordIds(WORD)
    counts.later.bound = ids.words.bound = ids.parts.bound = 50
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    for begin in range(0, 2000, 100):
        some = texts[begin : begin + 100]
        assert counts(some) == [len(e.ids) for e in byte.encode_batch(some, add_special_tokens=False)]
        coded = [np.array(e.ids, dtype="<u4").tobytes() for e in word.encode_batch(some, add_special_tokens=False)]
        assert ids([t.encode() for t in some]) == coded


def test_ranked_word_ids_are_the_library_ids():
    from ledgerlake.llm import tokens

    ids = tokens.WordIds(WORD)
    assert ids.ranked is not None
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzàéîõüß"
    parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 24))) for _ in range(3000)]
    parts += ["".join(rng.choice("!#$%&()*+,-./:;<=>?@[]^_{|}~") for _ in range(rng.randrange(1, 7))) for _ in range(500)]
    coded = Tokenizer.from_file(WORD).encode_batch(parts, add_special_tokens=False)
    assert ids._rank(parts) == [np.array(c.ids, dtype="<u4").tobytes() for c in coded]


@pytest.mark.parametrize("window, phrase", [(35, 10), (5, 2), (3, 1)])
def test_repeats(odd_docs, window, phrase):
    rows = both(odd_docs)
    expected = [(d, *r) for (d, _), r in zip(rows, plain.repeats([t for _, t in rows], window))]
    same(map(tuple, phrases.remove_repeats(odd_docs, window, phrase).collect()), expected)


def test_fully_repeated_rows_that_share_a_passage_stay_single(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    nulls = " ".join(f"n{i}" for i in range(50))
    rows = [(7, shared)] * 2 + [(8, shared + " tail")] + [(None, nulls)] * 5 + [(9, "head " + nulls)]
    rows += [(3, shared + " end"), (None, shared + " end"), (None, shared + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = [(d, *r) for (d, _), r in zip(rows, plain.repeats([t for _, t in rows], 35))]
    same(map(tuple, phrases.remove_repeats(docs).collect()), expected)


def test_repeats_in_small_shards(odd_docs, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_PHRASES", 2)
    monkeypatch.setattr(phrases, "SHARD_PASSAGES", 3)
    test_repeats(odd_docs, 8, 3)


def test_merkle(spark, odd_docs):
    rows = both(odd_docs)
    found = merkle.edited_fingerprints(odd_docs).collect()
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = []
    for (doc_id, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        expected.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    same([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found], expected)
    prints = {r["fingerprint"] for r in found}
    assert len(prints) == len({t for _, t in ordered})
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert all((r["near_edited"] == 1) == (r["fingerprint"] == r["edited_fingerprint"]) for r in found)
    text = "\n".join(f"paragraph {i} says this and that" for i in range(9))
    pair = spark.createDataFrame([(2, text), (1, text[:-2] + "zz"), (0, "")], "doc_id long, text string")
    trees = {r["doc_id"]: r for r in merkle.fingerprints(pair).collect()}
    compared = spark.createDataFrame([(trees[2]["paragraphs"], trees[1]["paragraphs"])], "a array<string>, b array<string>")
    assert compared.select(merkle.changed(F.col("a"), F.col("b")).alias("c")).first()["c"] == [8]


def test_merkle_over_many_buckets(odd_docs, monkeypatch):
    one = merkle.edited_fingerprints(odd_docs).collect()
    monkeypatch.setattr(merkle, "BUCKET_BYTES", 3_000)
    many = merkle.edited_fingerprints(odd_docs)
    assert "Python" not in many._jdf.queryExecution().executedPlan().toString()
    same(map(str, many.collect()), map(str, one))


def test_secrets(odd_docs):
    found = secret_scan.report(secret_scan.scan(odd_docs)).collect()
    expected = []
    for doc_id, text in both(odd_docs):
        base = plain.base_spans(text or "")
        kinds = Counter(s.split(":")[0] for s in base)
        expected.append((doc_id, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(",".join(base).encode()).hexdigest()))
    same([(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found], expected)
    assert sum(r["n_guess"] for r in found) == 1  # hunter2!x9Qz, whose "!" the fixed pattern stops at
    masked = {r["text"] for r in secret_scan.redact(odd_docs).collect()}
    assert {'[SECRET]" end', "key [SECRET] password: [SECRET]"} <= masked or {'[SECRET]" end', "key [SECRET] [SECRET]"} <= masked
    assert not any(t and ("AKIAABC" in t or "x9Qz" in t or "1eb9c654" in t) for t in masked)
    assert secret_scan.redact(odd_docs).columns == odd_docs.columns


def test_fixed_patterns_drop_what_they_consumed():
    for text in ("token=token:abcdefgh1", "SECRET = 'a.b' token=12345678", "api_key:apikey=ZZZZZZZZ9", "passwd=pa=sswd=12345678"):
        spans = [f"{k}:{s}:{e}" for s, e, k in secret_scan.base_spans(text)]
        assert spans == plain.base_spans(text)


def test_guess_costs_are_in_order():
    cost = secret_scan.guess_cost
    assert cost("") == 0
    assert cost("password") < cost("password1") < cost("x9$kQ2!vLp0z")
    assert cost("aaaaaaaaaaaa") < cost("qwertyuiop") < cost("vmxkqjzwpt")
    assert cost("abcabcabcabc") < cost("abcxqzabcwvk")
    assert cost("20240105") < cost("83917465")
    # no segmentation costs more than guessing each character
    rng = random.Random(2)
    for _ in range(200):
        value = "".join(rng.choice("ab1!Zé") for _ in range(rng.randrange(1, 12)))
        brute = sum(np.log10(secret_scan._alphabet(c)) for c in value)
        assert cost(value) <= brute + 1e-9


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = held_out(4, 2)
    model = language.fit(docs, held, per_language=150)
    found = language.identify(docs, model).where(held)
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("accepted").cast("int"))).first()
    assert right[0] > 0.98 and right[1] > 0.99


def test_language_of_odd_rows(odd_docs):
    model = language.fit(odd_docs.select("doc_id", "text", "lang"))
    rows = language.identify(odd_docs, model).collect()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in model.languages) if letters else (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
    assert language.keep_accepted(odd_docs, model).columns == odd_docs.columns
    nothing = language.fit(odd_docs.select("doc_id", "text", "lang").limit(0))
    assert {r["lang_pred"] for r in language.identify(odd_docs, nothing).collect()} == {"und"}


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    held = held_out(5, 0)
    scored = quality.classify(docs, labels, held).join(labels, "doc_id").where(held).select("score", "predicted", "quality").collect()
    good = [r["score"] for r in scored if r["quality"] == 1]
    bad = [r["score"] for r in scored if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.95


def test_quality_of_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(10, 1), (10, 0), (None, 1), (12, None), (14, 0), (999, 1)], "doc_id long, quality int")
    rows = quality.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    nothing = quality.classify(odd_docs, labels.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5}


def test_quality_sample_is_bounded(spark, monkeypatch):
    """Also where a third of the rows repeat one row; fewer rows than the bound are all taken."""
    taken = []
    monkeypatch.setattr(quality, "train", lambda x, y: taken.append((len(x), set(y))))
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.random(len(quality.STATISTICS)))) for i in range(1200)]
    rows += [rows[7]] * 600
    measures = spark.createDataFrame(rows, ["doc_id", *quality.STATISTICS]).repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1200)], "doc_id long, quality int")
    for bound in (320, 5000):
        quality.fit(measures, labels, rows=bound)
    assert 160 <= taken[0][0] <= 320 and taken[0][1] == {0.0, 1.0}
    assert taken[1][0] == 1800
    quality.fit(measures, labels, F.col("doc_id") < 1100, rows=5000)
    assert taken[2][0] == 100


def test_rules_score_as_their_column(spark):
    rng = np.random.default_rng(4)
    x = rng.random((400, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.4) & (x[:, 8] < 0.7)).astype(float)
    model = quality.train(x, y)
    assert 0 < len(model.rules) < 200
    logit = model.constant + sum(w * quality._holds(r, x) for r, w in zip(model.rules, model.weights))
    frame = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["doc_id", *quality.STATISTICS])
    scored = sorted(quality.score(frame, model).collect())
    assert np.allclose([r["score"] for r in scored], 1 / (1 + np.exp(-logit)))
    assert np.mean([r["predicted"] == v for r, v in zip(scored, y)]) > 0.9


def test_numbers_are_gapless(spark):
    rows = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else 'x' || id % 5 end as k")
    found = defaultdict(list)
    for r in numbered(rows.repartition(6), ["k"], "n", "numbers").collect():
        found[r["k"]].append(r["n"])
    assert sum(map(len, found.values())) == 1000
    assert all(sorted(v) == list(range(len(v))) for v in found.values())


def test_empty_tables(spark, odd_docs, odd_benchmark):
    none = odd_docs.where("false")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.classify(none, labels).count() == 0
    assert packing.pack(packing.pieces(none, WORD).drop("ids")).count() == 0
    assert decontamination.matches(none, odd_benchmark).count() == 0
    assert decontamination.report(decontamination.matches(odd_docs, odd_benchmark.limit(0))).where("contaminated").count() == 0
    assert language.identify(none, language.fit(odd_docs, per_language=20)).count() == 0
    assert token_counts.count_tokens(none, BYTE, new_folder(spark, "none")).count() == 0
    assert phrases.remove_repeats(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert merkle.edited_fingerprints(none).count() == 0
    assert secret_scan.report(secret_scan.scan(none)).count() == 0
    assert sharding.shard_documents(none).count() == 0

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import word_vectors as W


def corpus(seed=3, n=160):
    r = random.Random(seed)
    topics = [["river", "water", "boat", "fish", "bank", "swim"], ["stock", "market", "bank", "trade", "price", "fund"], ["piano", "song", "music", "choir", "violin", "band"]]
    return [(i, " ".join(r.choice(topics[i % 3] + ["the", "and"]) for _ in range(r.randrange(5, 40)))) for i in range(n)] + [(900, None), (901, ""), (902, "unknownword")]


def counts_of(rows, window, least):
    n, pairs = Counter(), Counter()
    texts = [re.findall(r"\w+", (t or "").lower()) for _, t in rows]
    for t in texts:
        n.update(t)
    for t in texts:
        for i, w in enumerate(t):
            for c in t[i + 1:i + 1 + window]:
                if n[w] >= least and n[c] >= least:
                    pairs[w, c] += 1
                    pairs[c, w] += 1
    return pairs


def pmi_of(pairs):
    total = sum(pairs.values())
    by = Counter()
    for (w, _), x in pairs.items():
        by[w] += x
    return {k: v for k, x in pairs.items() if (v := math.log(x * total / (by[k[0]] * by[k[1]]))) > 0}


def test_counts_pmi_and_factors(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = W.cooccurrences(docs, 3, 5)
    pairs = counts_of(rows, 3, 5)
    assert {(r.word, r.context): r.n for r in counts.collect()} == dict(pairs)
    matrix = W.positive_pmi(counts).checkpoint()
    want = pmi_of(pairs)
    got = {(r.word, r.context): r.value for r in matrix.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    words = sorted({w for w, _ in want})
    m = np.array([[want.get((a, b), 0.0) for b in words] for a in words])
    vectors, values = W.factor(matrix, 4)
    exact, direction = np.linalg.eigh(m)
    order = np.argsort(-np.abs(exact))[:4]
    assert np.allclose(np.abs(values), np.abs(exact[order]), rtol=1e-3)
    v = {r.word: np.array(r.vec) for r in vectors.collect()}
    x = np.array([v[w] for w in words])
    for k, at in enumerate(order):
        side = direction[:, at] * np.sqrt(abs(exact[at]))
        assert min(np.abs(x[:, k] - side).max(), np.abs(x[:, k] + side).max()) < 1e-2 and (x[:, k] ** 3).sum() >= -1e-9
    again, _ = W.factor(matrix, 4)
    assert all(np.allclose(np.array(r.vec), v[r.word], atol=1e-6) for r in again.collect())


def test_copies_are_nearer_than_strangers(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    embed = W.embedder(W.word_vectors(docs, dim=6, min_count=5).checkpoint())
    asked = spark.createDataFrame([(1, "river boat water"), (2, "the river and a boat"), (3, "market price trade"), (4, None), (5, "nothing known"), (6, "river boat water")], "id int, text string")
    v = {r.id: r.embedding for r in embed(asked).collect()}
    assert len(v) == 6 and v[4] is None and v[5] is None and v[1] == v[6]
    cos = lambda a, b: float(np.dot(v[a], v[b]))
    assert abs(cos(1, 1) - 1) < 1e-5 and cos(1, 2) > cos(1, 3) + 0.3
    assert embed(docs.limit(0)).count() == 0
    assert F.col  # the hook takes any table with a text column


def test_pairs_are_counted_in_tasks_and_added_up_in_parts(spark, monkeypatch):
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = dict(counts_of(rows, 4, 5))
    monkeypatch.setattr(W, "PART_PAIRS", 64)  # many parts, each with pairs from every task
    # two words share a number under the first seed: another seed is taken
    ids = []
    honest = W._id
    monkeypatch.setattr(W, "_id", lambda word, seed: ids.append(seed) or (F.length(word).cast("long") if seed == 0 else honest(word, seed)))
    monkeypatch.setattr(W, "BROADCAST_WORDS", 0)  # the larger vocabularies' way
    counts = W.cooccurrences(docs, 4, 5)
    assert {(r.word, r.context): r.n for r in counts.collect()} == want and 1 in ids
    plan = counts._jdf.queryExecution().toString()
    # a pair of words is no row of its own before it is counted
    assert "FlatMapGroupsInArrow" in plan and "Generate explode(next" not in plan and "posexplode" not in plan


@pytest.mark.parametrize("travels", [0, 1 << 20])
def test_blocks_and_cells_give_the_same_factors(spark, monkeypatch, travels):
    rows = corpus(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    matrix = W.positive_pmi(W.cooccurrences(docs, 3, 5)).checkpoint()
    whole, values = W.factor(matrix, 4)
    want = {r.word: np.array(r.vec) for r in whole.collect()}
    monkeypatch.setattr(W, "BLOCK_WORDS", 5)
    monkeypatch.setattr(W, "CELL_ENTRIES", 6)
    monkeypatch.setattr(W, "BROADCAST_BYTES", travels)
    # numbers for words, as the whole job has them
    ids = whole.select(F.xxhash64("word").alias("id"), "word")
    numbered = matrix.select(F.xxhash64("word").alias("word"), F.xxhash64("context").alias("context"), "value")
    parts, again = W.factor(numbered, 4, ids)
    assert np.allclose(values, again, rtol=1e-6)
    got = {r.word: np.array(r.vec) for r in parts.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-5) for k in want)


def test_a_text_travels_once_and_not_with_its_words(spark):
    docs = spark.createDataFrame([(1, "river boat " + "x" * 5000), (2, None)], "id int, text string")
    vectors = spark.createDataFrame([("river", [1.0, 0.0], 1.0), ("boat", [0.0, 1.0], 1.0)], "word string, vec array<double>, weight double")
    plan = W.embedder(vectors)(docs)._jdf.queryExecution().optimizedPlan().toString()
    made = re.findall(r"Aggregate \[_text#\d+, word#\d+\]", plan)
    assert made and "sha2" in plan
    assert W.embedder(vectors)(docs).where("id = 1").first().embedding == pytest.approx([2 ** -0.5] * 2)


def test_spans_lose_no_pair(monkeypatch):
    r = np.random.default_rng(2)
    ids = np.sort(r.integers(-2**62, 2**62, 50))[r.integers(0, 50, 3000)]
    text = np.sort(r.integers(0, 40, 3000))
    want = Counter()
    for i in range(3000):
        for j in range(i + 1, min(i + 6, 3000)):
            if text[i] == text[j]:
                want[tuple(sorted((int(ids[i]), int(ids[j]))))] += 1
    for size in (1 << 21, 700, 5, 1):
        monkeypatch.setattr(W, "PAIRS", size)
        monkeypatch.setattr(W, "BATCH_ROWS", 100)
        got, where = Counter(), {}
        for b in W._pairs_of(ids, text, 5, 7):
            for row in b.to_pylist():
                for x, y, n in zip(row["word"], row["context"], row["n"], strict=True):
                    got[x, y] += n
                    assert x <= y and where.setdefault((x, y), row["part"]) == row["part"]
        assert got == want


def test_tiles_hold_the_pairs_of_known_words_in_few_bytes():
    r = np.random.default_rng(4)
    number = np.where(r.random(40000) < 0.1, -1, r.integers(0, 3000, 40000))
    text = np.sort(r.integers(0, 300, 40000))
    want = Counter()
    for i in range(len(number)):
        for j in range(i + 1, min(i + 5, len(number))):
            if text[i] == text[j] and number[i] >= 0 and number[j] >= 0:
                want[tuple(sorted((int(number[i]), int(number[j]))))] += 1
    for span in (1 << 23, 999):
        got, size = Counter(), 0
        W.SPAN_PAIRS, before = span, W.SPAN_PAIRS
        for b in W._tile_parts(number, text, 4, 6, 512, 3):
            for row in b.to_pylist():
                size += len(row["data"])
                codes, n = W._unpacked_counts(row["data"], row["size"])
                tile = row["part"] // 3
                assert (codes // 512 * 3 // 512 == row["part"] % 3).all()
                for c, k in zip(codes.tolist(), n.tolist(), strict=True):
                    got[tile // 6 * 512 + c // 512, tile % 6 * 512 + c % 512] += k
        W.SPAN_PAIRS = before
        assert got == want
        assert span == 999 or size < 5 * len(want)  # rows of two numbers and a count have 24


def test_a_vocabulary_in_tiles_and_a_larger_one_agree(spark, monkeypatch):
    rows = corpus(13)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(W, "TILE_WORDS", 5)
    monkeypatch.setattr(W, "PART_PAIRS", 64)
    found = []
    for most in (1 << 20, 0):
        monkeypatch.setattr(W, "CARRIED_BYTES", most)
        monkeypatch.setattr(W, "HELD_BYTES", 8 * 18 * 5)  # five dimensions at a time
        counts, words = W.numbered_cooccurrences(docs, 3, 5)
        assert {(r.word, r.context): r.n for r in W.named(counts, words).collect()} == dict(counts_of(rows, 3, 5))
        matrix = W.named(W.positive_pmi(counts, stored=True), words)
        want = pmi_of(counts_of(rows, 3, 5))
        assert {(r.word, r.context): pytest.approx(r.value) for r in matrix.collect()} == want
        found.append({r.word: (np.array(r.vec), r.weight) for r in W.word_vectors(docs, 4, 3, 5).collect()})
    assert found[0].keys() == found[1].keys() and found[0]
    assert all(np.allclose(found[0][k][0], v[0], atol=1e-5) and found[0][k][1] == v[1] for k, v in found[1].items())


def test_a_large_table_of_vectors_meets_the_texts_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "river boat river"), (2, None), (3, "boat song"), (4, "other")], "id int, text string")
    vectors = spark.createDataFrame([("river", [1.0, 0.0], 1.0), ("boat", [0.0, 1.0], 2.0), ("song", [1.0, 1.0], 0.5)], "word string, vec array<double>, weight double")
    whole = {r.id: r.embedding for r in W.embedder(vectors)(docs).collect()}
    monkeypatch.setattr(W, "BROADCAST_BYTES", 16)
    assert {r.id: r.embedding for r in W.embedder(vectors)(docs).collect()} == whole and whole[1] == pytest.approx([2 ** -0.5] * 2)


def test_stored_tables_leave_no_shuffle_files(spark):
    from weft.session import CLEANUP, kept

    shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = spark.conf.get(CLEANUP, None)
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    n = shuffles.shuffleStatuses().size()
    assert kept(df).count() == 10  # the count has a shuffle of its own
    assert shuffles.shuffleStatuses().size() <= n + 1 and spark.conf.get(CLEANUP, None) == before

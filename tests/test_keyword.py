import random
import re

import pytest
from pyspark.sql import functions as F

from weft.operators import history as H
from weft.operators import keyword


def brute(queries, history, limit, by_user):
    out = []
    for qid, user, text in queries:
        words = [w for w in re.split(r"\s+", (text or "").lower()) if w]
        hits = sorted(seq for seq, u, t in history if t is not None and (not by_user or (u is not None and u == user)) and any(w in t.lower() for w in words))
        out += [(qid, seq, i) for i, seq in enumerate(hits[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("by_user", [True, False])
@pytest.mark.parametrize("part", [1 << 16, 3])
def test_search_is_brute_force(spark, monkeypatch, by_user, part):
    monkeypatch.setattr(keyword, "PART_PLACES", part)
    monkeypatch.setattr(keyword, "CARRIED_WORDS", 0 if part == 3 else 1 << 16)
    r = random.Random(6)
    letters = "abcé😀 "
    text = lambda n: "".join(r.choice(letters) for _ in range(r.randrange(n)))
    history = [(i, r.choice(["u", "u", "v", None]), r.choice([text(25), text(25).upper(), None, "", "aaaaaaa", "abcabcabc", "a" * 400])) for i in range(160)]
    queries = [(i, r.choice(["u", "v", "w", None]), r.choice([text(12), text(5), "aaaa", "abcab zz", "aaa\tAAAB", "", None, "a", "é", "bc", "caac"])) for i in range(60)]
    h = spark.createDataFrame(history, "seq long, user_id string, query string")
    q = spark.createDataFrame(queries, "query_id long, user_id string, text string")
    got = H.keyword_search(q, h, 4, "user_id" if by_user else None)
    assert sorted((x.query_id, x.seq, x.rank) for x in got.collect()) == brute(queries, history, 4, by_user)


def test_only_texts_with_the_rare_grams_are_compared(spark):
    rows = [(i, "u", f"common words in every text {i:04}") for i in range(300)] + [(900, "u", "the xylophone")]
    texts = keyword.stored_texts(spark.createDataFrame(rows, "seq long, user_id string, query string"), 5, keyword.F.col("user_id"))
    words = spark.createDataFrame([("u", "xylophone"), ("u", "textxyl"), ("u", "0123")], "_u string, _w string")
    found = keyword._long_candidates(words, keyword.postings(texts))
    assert sorted((x._w, x._id) for x in found.collect()) == [("0123", 123), ("xylophone", 900)]


def test_nothing_to_search(spark):
    h = spark.createDataFrame([], "seq long, user_id string, query string")
    q = spark.createDataFrame([(1, "u", "some words")], "query_id long, user_id string, text string")
    assert H.keyword_search(q, h, 5).count() == 0
    assert H.keyword_search(q.limit(0), h, 5, None).count() == 0


def test_the_driver_holds_few_grams(spark):
    def words(n, size):
        return spark.range(n).select(F.lit("u").alias("_u"), F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), size)).alias("_w"))

    assert keyword._few(words(1000, 4)) and keyword._few(words(0, 4))
    assert not keyword._few(words(20000, 4)) and not keyword._few(words(10, 100000))
    h = spark.createDataFrame([(i, "u", f"{i}xxxx and more") for i in range(50)], "seq long, user_id string, query string")
    q = words(6000, 4).select(F.monotonically_increasing_id().alias("query_id"), F.col("_u").alias("user_id"), F.col("_w").alias("text"))
    got = H.keyword_search(q, h, 2)
    assert "broadcast" not in got._jdf.queryExecution().analyzed().toString().lower()
    assert got.count() > 50


def test_no_side_that_grows_travels_through_the_driver(spark):
    h = spark.createDataFrame([(i, f"u{i % 3}", f"{i % 40}xxxx and more") for i in range(400)], "seq long, user_id string, query string")
    q = spark.range(5000).select(F.col("id").alias("query_id"), F.concat(F.lit("u"), F.col("id") % 3).alias("user_id"), F.concat(F.col("id").cast("string"), F.lit("xxxx")).alias("text"))
    got = H.keyword_search(q, h, 2)  # small for Spark, which would broadcast the sides
    assert got.count() == sum(min(2, sum(f"{i}xxxx" in f"{j % 40}xxxx" and i % 3 == j % 3 for j in range(400))) for i in range(5000) if i < 40)
    got.collect()
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()

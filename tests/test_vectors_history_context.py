"""kNN kernel, history and context rendering on micro fixtures (incl. the reference's own cases)."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from weft.operators import context as C
from weft.operators import history as H
from weft.operators import vectors as VX


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, animal string, embedding array<float>")


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(size=(300, 16)).astype("float32")
    q = rng.normal(size=(25, 16)).astype("float32")
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(d)], "doc_id long, embedding array<float>")
    qs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    got = {(r.query_id, r.rank): r.doc_id for r in VX.knn(qs, docs.repartition(4), k=5).collect()}
    dn = d / np.linalg.norm(d, axis=1, keepdims=True)
    qn = q / np.linalg.norm(q, axis=1, keepdims=True)
    s = qn.astype("float64") @ dn.astype("float64").T
    for i in range(len(q)):
        top = np.argsort(-s[i], kind="stable")[:5]
        assert [got[(i, r + 1)] for r in range(5)] == list(top)


def test_knn_ties_k_larger_than_collection_and_zero_vectors(spark):
    docs = spark.createDataFrame([(5, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0])], "doc_id long, embedding array<float>")
    qs = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r.query_id, r.doc_id, r.rank) for r in VX.knn(qs, docs, k=10).orderBy("query_id", "rank").collect()]
    # equal scores break by doc id; zero vectors never match; k above the size returns what exists
    assert got == [(1, 3, 1), (1, 5, 2)]


def test_filtered_knn_reference_case(spark):
    # fox / cat / dog with metadata; k=2 gives 2 hits; filter animal=cat gives only the cat
    e = {"fox": [1.0, 0.1, 0.0], "cat": [0.2, 1.0, 0.0], "dog": [0.1, 0.2, 1.0]}
    docs = _docs(spark, [(i, f"The {a}", f"test{i}", a, e[a]) for i, a in enumerate(["fox", "cat", "dog"], 1)])
    q = spark.createDataFrame([(1, [1.0, 0.2, 0.1], "cat")], "query_id long, embedding array<float>, want string")
    assert VX.knn(q, docs, k=2).count() == 2
    hits = VX.knn(q, docs, k=2, filters={"want": "animal"}).collect()
    assert [h.doc_id for h in hits] == [2]


def test_sqeuclidean_ascending(spark):
    docs = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1.0, 1.0])], "doc_id long, embedding array<float>")
    qs = spark.createDataFrame([(7, [0.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r.doc_id, round(r.score, 6)) for r in VX.knn(qs, docs, k=3, metric="sqeuclidean").orderBy("rank").collect()]
    assert got == [(1, 0.0), (3, 2.0), (2, 25.0)]


def test_render_documents_and_empty(spark):
    hits = spark.createDataFrame([(1, 1, "alpha", "s1"), (1, 2, "beta", None)],
                                 "query_id long, rank int, text string, source string")
    r = C.render_documents(hits).first()
    assert r.documents_text == "Document 1 (Source: s1):\nalpha\n\nDocument 2:\nbeta\n"
    p = spark.range(1).select(C.render_prompt(F.lit(0), F.lit(C.NO_DOCUMENTS), F.lit(""), F.lit("q?")).alias("p")).first().p
    assert p.startswith(C.GENERAL_SYSTEM) and "USER QUESTION: q?" in p


def test_render_history_date_lines(spark):
    items = spark.createDataFrame([
        (1, 1, dt.datetime(2024, 1, 2, 3, 4, 5), "q1", "r1"), (1, 2, None, "q2", "r2")],
        "query_id long, position int, ts timestamp, query string, response string")
    r = C.render_history(items).first()
    assert r.history_text == ("PREVIOUS QUESTIONS AND ANSWERS:\nDate: 2024-01-02 03:04\nUser: q1\nAssistant: r1\n"
                              "\nUser: q2\nAssistant: r2\n")


def test_special_terms(spark):
    df = spark.createDataFrame([('find "exact phrase" or \'other\' and ai_xyz123 now',)], "t string")
    assert df.select(C.special_terms(F.col("t"))).first()[0] == ["exact phrase", "other", "ai_xyz123"]


def test_retention_reference_case(spark):
    now = dt.datetime(2024, 3, 1, 12, 0, 0)
    h = spark.createDataFrame([("1", 1, now, "Current response"), ("2", 2, now - dt.timedelta(days=31), "Old response")],
                              "id string, seq long, ts timestamp, response string")
    kept, removed = H.expire_history(h, 30, F.lit(now))
    assert [r.response for r in kept.collect()] == ["Current response"] and removed.first().removed == 1


def test_user_history_limit_then_sort(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(str(i), i, "u", t0 + dt.timedelta(hours=(5 - i)) if i != 2 else None) for i in range(5)]
    h = spark.createDataFrame(rows, "id string, seq long, user_id string, ts timestamp")
    got = [r.id for r in H.user_history(h, 3).orderBy("position").collect()]
    # first 3 in storage order (0, 1, 2), then by time ascending with a missing time as 0
    assert got == ["2", "1", "0"]


def test_keyword_search(spark):
    h = spark.createDataFrame([(1, "u", "Click the Button"), (2, "u", "nothing"), (3, "v", "button again")],
                              "seq long, user_id string, query string")
    q = spark.createDataFrame([(10, "u", "BUTTON press")], "query_id long, user_id string, text string")
    got = [(r.query_id, r.seq) for r in H.keyword_search(q, h, 5, "user_id").collect()]
    assert got == [(10, 1)]


def test_transcript_prompt(spark):
    t = spark.createDataFrame([(1, 0, "system", "S"), (1, 1, "user", "U"), (1, 2, "tool", "T"), (1, 3, "assistant", "A")],
                              "conv_id long, turn long, role string, text string")
    assert C.transcript_prompt(t).first().prompt == "System: S\nUser: U\nAssistant: A\nAssistant: "


def test_overlap_filter_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    d = rng.normal(size=(60, 8))
    tags = [["a"], ["b"], ["a", "c"], []]
    docs = spark.createDataFrame([(i, [float(x) for x in v], tags[i % 4]) for i, v in enumerate(d)],
                                 "doc_id long, embedding array<float>, tags array<string>")
    q = rng.normal(size=(5, 8))
    qtags = [["a"], ["c"], [], ["z"], ["b", "c"]]
    qs = spark.createDataFrame([(i, [float(x) for x in v], qtags[i]) for i, v in enumerate(q)],
                               "query_id long, embedding array<float>, tags array<string>")
    got = {}
    for r in VX.training_query(qs, docs, k=3, min_score=-1.0, tags_col="tags").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id))
    dn = d / np.linalg.norm(d, axis=1, keepdims=True)
    for i in range(5):
        ok = [j for j in range(60) if not qtags[i] or set(qtags[i]) & set(tags[j % 4])]
        s = {j: float(np.dot(q[i] / np.linalg.norm(q[i]), dn[j])) for j in ok}
        exp = sorted(ok, key=lambda j: (-round(s[j], 9), j))[:3]
        assert [x[1] for x in sorted(got.get(i, []))] == exp


def test_term_fallback_and_forced_documents(spark):
    emb = VX.hashed_embedder(16)
    docs = emb(spark.createDataFrame([(1, "alpha beta", "s1", 0), (2, "gamma delta", "s2", 0), (3, "other", "s3", 1)],
                                     "doc_id long, text string, source string, label int"), "text", "embedding")
    queries = spark.createDataFrame([(10, 'find "gamma delta"', 1, 0, "u1", [0.0] * 16),
                                     (11, "plain question", 1, 5, "u1", [0.0] * 16)],
                                    "query_id long, text string, k int, filter_label int, user_id string, "
                                    "embedding array<float>")
    hist = spark.createDataFrame([], "id string, seq long, user_id string, query string, response string, "
                                     "ts timestamp, model string, embedding array<float>")
    out = {r.query_id: r for r in C.assemble_context(queries, docs, hist, embedder=emb,
                                                    filters={"filter_label": "label"}).collect()}
    # the zero query vector finds nothing; the quoted term finds document 2 under the same filter
    assert out[10].document_count == 1 and "Document 1 (Source: s2):\ngamma delta" in out[10].prompt
    # no document carries label 5: every search under that filter stays empty
    assert out[11].document_count == 0 and out[11].prompt.startswith(C.GENERAL_SYSTEM)
    forced = spark.createDataFrame([(11, 3, 1)], "query_id long, doc_id long, rank int")
    out2 = {r.query_id: r for r in C.assemble_context(queries, docs, hist, embedder=emb,
                                                     filters={"filter_label": "label"}, forced=forced).collect()}
    assert out2[11].document_count == 1 and "Document 1 (Source: s3):\nother" in out2[11].prompt


def test_global_row_number_across_partitions(spark):
    from weft.operators.ordering import global_row_number

    df = spark.range(0, 5000).selectExpr("id", "(id * 7919) % 5000 AS k").repartition(9)
    got = global_row_number(df, "k", "n", partitions=6).select("k", "n").collect()
    assert sorted((r.k, r.n) for r in got) == [(k, k + 1) for k in range(5000)]


def test_keyword_search_brute_force(spark):
    hist = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "event_id AS seq", "CAST(user_id AS STRING) AS user_id", "concat(event_type, ' ', props) AS query")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    q = docs.selectExpr("doc_id AS query_id", "CAST(doc_id % 15 AS STRING) AS user_id",
                        "split_part(text, '\\n', 1) AS text")
    got = {(r.query_id, r.seq) for r in H.keyword_search(q, hist, 5, "user_id").collect()}
    hrows = sorted((r.seq, r.user_id, r.query.lower()) for r in hist.collect())
    want = set()
    for r in q.collect():
        ws = r.text.lower().split()
        hits = [s for s, u, t in hrows if u == r.user_id and any(w in t for w in ws)][:5]
        want |= {(r.query_id, s) for s in hits}
    assert got == want


def test_term_search_beyond_a_thousand_terms(spark):
    # two queries with neighbouring ids; the first has more than 1,000 terms and only its last one hits
    text = " ".join(f'"t{i}"' for i in range(1005)) + ' "hit"'
    misses = spark.createDataFrame([(4, text, 3), (5, "'other'", 3)], "query_id long, text string, k int")
    docs = spark.createDataFrame([(9, [1.0, 0.0])], "doc_id long, embedding array<float>")

    def embedder(df, column, out):
        return df.withColumn(out, F.when(F.col(column) == "hit", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0))))

    got = [(r.query_id, r.doc_id, r.rank) for r in C.term_fallback(misses, docs, embedder, {}).collect()]
    assert got == [(4, 9, 1)]


def test_upsert_takes_one_row_per_key(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    delta = spark.createDataFrame([(2, "new", 2), (2, "newest", 3), (3, "c", 1)], "doc_id long, text string, version int")
    got = sorted((r.doc_id, r.text) for r in VX.upsert_docs(base, delta, version="version").collect())
    assert got == [(1, "a"), (2, "newest"), (3, "c")]


def test_clear_history_of_some_users(spark):
    hist = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "seq long, user_id string")
    users = spark.createDataFrame([("a",), ("a",)], "user_id string")
    assert sorted(r.seq for r in H.clear_history(hist, users).collect()) == [2, 3]
    assert H.clear_history(hist).count() == 0

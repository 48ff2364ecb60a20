import random

import numpy as np
import pyarrow as pa
import pytest

from weft.operators import topk
from weft.operators import vectors as VX


def tables(spark, seed=4, n_docs=400, n_queries=40):
    r, rng = random.Random(seed), np.random.default_rng(seed)
    d = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)], r.choice(["a", "a", "a", "b", "c", None]), r.choice([1, 2]), r.sample("uvwxyz", r.randrange(3))) for i in range(n_docs)]
    d += [(1000, None, "a", 1, ["u"]), (1001, [0.0] * 6, "a", 1, ["u"]), (1002, d[5][1], "a", 1, None)]
    q = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)], r.choice(["a", "b", "nowhere", None]), r.choice([1, 2]), r.sample("uvw", r.randrange(3)), r.choice([0, 1, 3, 7, None])) for i in range(n_queries)]
    q += [(900, [0.0] * 6, "a", 1, [], 3), (901, None, "a", 1, [], 3), (902, [1.0] * 6, "b", 2, None, 3)]
    return (d, spark.createDataFrame(d, "doc_id long, embedding array<float>, kind string, grade int, tags array<string>").repartition(5),
            q, spark.createDataFrame(q, "query_id long, embedding array<float>, want string, level int, tags array<string>, k int"))


def brute(d, q, metric, filters, tags, k, per_query, least):
    out, products = [], 0
    for i, v, want, level, qt, own in q:
        if v is None:
            continue
        hits = []
        for j, w, kind, grade, dt in d:
            if w is None or (filters and (want is None or want != kind or level != grade)) or (tags and qt and not set(qt) & set(dt or [])):
                continue
            products += 1
            a, b = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
            if metric == "cosine":
                if not a.any() or not b.any():
                    continue
                s = float(a / np.linalg.norm(a) @ (b / np.linalg.norm(b)))
            else:
                s = float(((a - b) ** 2).sum())
            if least is not None and s < least:
                continue
            hits.append((round(-s if metric == "cosine" else s, 9), j))
        for rank, (_, j) in enumerate(sorted(hits)[:min(k, (own or 0)) if per_query else k], 1):
            out.append((i, rank, j))
    return sorted(out), products


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize(("metric", "filters", "tags", "per_query", "least"), [
    ("cosine", False, False, False, None), ("sqeuclidean", False, False, True, None), ("cosine", True, False, True, None), ("cosine", True, True, False, 0.2), ("cosine", False, True, False, None)])
def test_search_is_brute_force_and_scores_only_what_filters_allow(spark, monkeypatch, small, metric, filters, tags, per_query, least):
    if not small:
        monkeypatch.setattr(VX, "QUERY_SIDE_ROWS", 3)
        monkeypatch.setattr(VX, "QUERY_BLOCK_ROWS", 7)
        monkeypatch.setattr(VX, "DOC_BLOCK_ROWS", 60)
    d, docs, q, queries = tables(spark)
    counter = spark.sparkContext.accumulator(0)
    got = VX.knn(queries, docs, k=5, metric=metric, filters={"want": "kind", "level": "grade"} if filters else None, overlap={"tags": "tags"} if tags else None,
                 k_col="k" if per_query else None, min_score=least, counter=counter)
    assert ("FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()) == (not small)
    rows = sorted((r.query_id, r.rank, r.doc_id) for r in got.collect())
    want, products = brute(d, q, metric, filters, tags, 5, per_query, least)
    assert rows == want and rows
    # the product of rows is what the filters leave of it (a k of zero everywhere in a block asks for nothing)
    assert counter.value == products or (per_query and counter.value <= products)


def test_empty_sides(spark):
    _, docs, _, queries = tables(spark)
    assert VX.knn(queries.limit(0), docs, k=3).count() == 0
    assert VX.knn(queries, docs.limit(0), k=3, filters={"want": "kind"}).count() == 0
    assert VX.knn(queries.filter("want = 'nowhere'"), docs, k=3, filters={"want": "kind"}).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "sqeuclidean"])
@pytest.mark.parametrize("least", [None, 0.2])
def test_tiles_hold_few_scores_and_lose_none(monkeypatch, metric, least):
    rng = np.random.default_rng(3)
    # many copies and near copies: ties at the last place, and scores that single precision does not tell apart
    d = np.round(rng.normal(size=(3000, 8)), 1).astype(np.float32)
    d[1500:2000] = d[:500]
    d[2000:2500] = d[7] + rng.normal(size=(500, 8)).astype(np.float32) * 1e-7
    q = np.concatenate([d[:60], d[2000:2020], np.zeros((1, 8), np.float32)])
    held = pa.table({"query_id": np.arange(len(q)), "embedding": pa.array(list(q), pa.list_(pa.float32()))})
    side = topk.Queries(held, ["query_id"], 5, [], [], metric)
    sizes = []
    monkeypatch.setattr(topk, "TILE", 1 << 12)
    monkeypatch.setattr(topk, "TILE_QUERIES", 16)
    inner = side._tile
    monkeypatch.setattr(side, "_tile", lambda who, part, *a: (sizes.append(len(who) * len(part)), inner(who, part, *a)))
    order = rng.permutation(len(d))
    for rows in np.split(order, [1000, 1001, 2600]):
        side.meet(pa.table({"doc_id": rows, "embedding": pa.array(list(d[rows]), pa.list_(pa.float32()))}), [], [], least, None)
    a, b = q.astype(float), d.astype(float)
    if metric == "cosine":
        s = (a / np.maximum(np.linalg.norm(a, axis=1), 1e-300)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
        s[-1] = -np.inf
        out = -np.inf if least is None else least
        want = [[(j, round(s[i, j], 9)) for j in np.lexsort((np.arange(len(d)), -np.round(s[i], 9)))[:5] if s[i, j] > -np.inf and s[i, j] >= out] for i in range(len(q))]
    else:
        s = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        want = [[(j, round(s[i, j], 9)) for j in np.lexsort((np.arange(len(d)), np.round(s[i], 9))) if least is None or s[i, j] >= least][:5] for i in range(len(q))]
    hits = side.hits().to_pylist()
    got = [[(h["doc_id"], h["score"]) for h in hits if h["query_id"] == i] for i in range(len(q))]
    for x, y in zip(got, want, strict=True):
        assert [v for v, _ in x] == [v for v, _ in y] and [v for _, v in x] == pytest.approx([v for _, v in y], abs=1e-8)
    assert max(sizes) <= 1 << 12 and len(sizes) > 3


def test_a_document_travels_few_times_at_once(spark, monkeypatch):
    monkeypatch.setattr(VX, "QUERY_SIDE_ROWS", 3)
    monkeypatch.setattr(VX, "QUERY_BLOCK_ROWS", 7)
    monkeypatch.setattr(VX, "DOC_BLOCK_ROWS", 20)
    monkeypatch.setattr(VX, "ROUND_CELLS", 8)
    d, docs, q, queries = tables(spark)
    left, right = queries.where("embedding is not null"), docs.where("embedding is not null")
    rounds = list(VX._dealt(left, right, []))
    assert len(rounds) > 2 and all(b.groupBy("doc_id").count().agg({"count": "max"}).first()[0] == 1 for _, b, _ in rounds)
    assert sorted(r.query_id for a, _, _ in rounds for r in a.select("query_id").distinct().collect()) == sorted(x[0] for x in q if x[1] is not None)
    got = VX.knn(queries, docs, k=5, filters={"want": "kind", "level": "grade"}, k_col="k")
    want, _ = brute(d, q, "cosine", True, False, 5, True, None)
    assert sorted((r.query_id, r.rank, r.doc_id) for r in got.collect()) == want

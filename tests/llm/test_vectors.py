from collections import Counter

import numpy as np

from tests.llm.data import vectors
from weft.llm import ann, embed_dedup

EMPTY = "vec_id long, embedding array<float>, label int"


def usable(v, width=16):
    return v is not None and len(v) == width and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(v)


def unit(v):
    x = np.array(v, np.float32).astype(np.float64)
    return x / np.sqrt((x * x).sum())


def test_near_duplicates_equal_brute_force(spark):
    rows, df = vectors(spark)
    n = len(rows)
    u = [unit(v) if usable(v) and lab is not None else None for _, v, lab in rows]
    links, cls = [0] * n, list(range(n))

    def root(x):
        while cls[x] != x:
            x = cls[x]
        return x

    for i in range(n):
        for j in range(i):
            if u[i] is not None and u[j] is not None and rows[i][2] == rows[j][2] and u[i] @ u[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                cls[root(i)] = root(j)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    want = Counter((k, links[i], least.get(root(i)), k is not None and k == least.get(root(i))) for i, (k, _, _) in enumerate(rows))
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect())
    assert got == want and max(links) > 25


def _at_angle(r, v, cosine):
    """A unit vector with this cosine to the unit vector ``v``."""
    w = r.normal(size=len(v))
    w -= (w @ v) * v
    return cosine * v + np.sqrt(1 - cosine**2) * w / np.sqrt(w @ w)


def _brute(x, threshold=0.93):
    """``(links, smallest member of the component)`` of every row of unit vectors."""
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    cls = np.arange(len(x))
    while True:
        low = np.array([min(c, cls[n].min(initial=c)) for c, n in zip(cls, near, strict=True)])
        if (low == cls).all():
            return near.sum(axis=1), cls
        cls = low


def test_groups_of_near_copies_link_across(spark):
    # edited versions, each copied with noise: closer inside a group than across, all above 0.93
    r, x = np.random.default_rng(8), []
    for _ in range(40):
        a = unit(r.normal(size=64))
        b = _at_angle(r, a, 0.955)
        x += [unit(v + r.normal(size=64) * 0.006) for v in [a] * 40 + [b] * 40]
    x = np.stack([unit(v) for v in x])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], EMPTY)
    links, cls = _brute(x)
    got = {g.vec_id: (g.n_links, g.component_id) for g in embed_dedup.near_duplicates(df).collect()}
    assert len(set(cls.tolist())) == 40
    assert got == {i: (links[i], cls[i]) for i in range(len(x))}


def test_pairs_that_the_search_misses_are_found(spark, monkeypatch):
    # one random order and one round are too little: the audit must notice, and the label is compared
    monkeypatch.setattr(embed_dedup, "ORDERS", 1)
    monkeypatch.setattr(embed_dedup, "ROUNDS", 1)
    r = np.random.default_rng(9)
    x = [unit(v) for v in r.normal(size=(3000, 64))]
    x = np.stack([unit(v) for v in x + [_at_angle(r, v, 0.94) for v in x[:150]]])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], EMPTY)
    links, cls = _brute(x)
    got = {g.vec_id: (g.n_links, g.component_id) for g in embed_dedup.near_duplicates(df).collect()}
    assert links.sum() == 300 and got == {i: (links[i], cls[i]) for i in range(len(x))}


def test_search_is_exact_in_one_part_and_near_in_many(spark):
    rows, df = vectors(spark)
    mine = df.select("vec_id", "embedding")
    ok = [(k, unit(v)) for k, v, _ in rows if k is not None and usable(v)]
    queries = [100, 201, 401]
    got = ann.search(df, df.filter(df.vec_id.isin([*queries, 500, 501, 505])), k=5).collect()
    assert {r.query_id for r in got} == set(queries)
    for q in queries:
        y = next(v for k, v in ok if k == q)
        # scores of equal vectors are equal in the operator; round so that they are here too
        best = sorted(((-round(float(v @ y), 12), k) for k, v in ok if k != q))[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert np.allclose([m[2] for m in mine], [-b[0] for b in best], atol=1e-9)
        assert {m[1] for m in mine if m[2] > -best[-1][0] + 1e-9} <= {b[1] for b in best}


def test_learned_parts(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 16)).astype(np.float32)
    monkeypatch.setattr(ann, "SAMPLE_PER_PART", 64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(df, df.filter("vec_id % 50 = 0"), k=5).collect()
    u = np.stack([unit(v) for v in x])
    hit = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -2
        hit += len(set(np.argsort(-s)[:5].tolist()) & {g.vec_id for g in got if g.query_id == q})
    assert len(got) == 300 and hit >= 0.9 * 300
    part = ann.balanced_parts(ann.sample_graph(u[:640]), u[:640], 10)
    assert np.bincount(part, minlength=10).max() <= np.ceil(64 * 1.05) and part.min() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], EMPTY)
    assert embed_dedup.near_duplicates(none).count() == 0
    assert ann.search(none, none).count() == 0
    zero = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, None, 1)], EMPTY)
    assert [(r.n_links, r.kept) for r in embed_dedup.near_duplicates(zero).collect()] == [(0, True)] * 2
    assert ann.search(zero, zero).count() == 0
    few = spark.createDataFrame([(50, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 0.0], 1)], EMPTY)
    got = ann.search(few, few.filter("vec_id = 50")).orderBy("rank").collect()
    assert [(g.query_id, g["rank"], g.vec_id, g.score) for g in got] == [(50, 1, 3, 1.0), (50, 2, 2, 0.0)]

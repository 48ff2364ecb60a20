import math
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.data import prose
from weft.llm import doc_classifier, mixing, quality

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    """Labelled prose: toxic texts hold one of a few words, poor ones shout."""
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        t = prose(1000 + i, r.randrange(20, 120))
        toxic, good = i % 10 == 0, i % 4 != 1
        if toxic:
            t += " " + r.choice(["vilea", "vileb", "vilec"])
        if not good:
            t = t.upper().replace(" ", "!! ")
        rows.append((i, t, f"s{i % 7}", "en"))
        if i % 2 == 0 or toxic or not good:
            labels.append((i, int(good), int(toxic)))
    rows += [(700, None, None, None), (701, "", "s1", None), (None, "some words here", "s1", "en"), (5, rows[5][1], "s5", "en")]
    labels += [(None, 1, 0), (3, None, 0), (900, 1, 0), (4, 1, 0)]
    return (spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, source string, lang string, quality double"),
            spark.createDataFrame(labels, LABELS), rows)


def test_classifier_and_quality(spark, corpus):
    docs, labels, rows = corpus
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    right = sum(by[i].kept == (i % 10 != 0 and i % 4 != 1) for i in range(600))
    assert right >= 580
    assert all(0 <= r.quality <= 1 and 0 <= r.toxic <= 1 for r in out) and by[700].site_quality is not None


def test_shrinkage_is_the_formula(spark):
    r = np.random.default_rng(3)
    rows = [(f"h{i % 9}", f"p{i % 4}", float(r.random() < 0.2 + 0.08 * (i % 9)), float(r.uniform(0.05, 0.95))) for i in range(900)] + [("rare", "x", 1.0, 0.5)]
    df = spark.createDataFrame(rows, "_site string, _path string, e_quality double, p_quality double")
    got = quality.shrink(df, "quality").collect()
    e = np.array([x[2] for x in rows])
    n, mean = len(rows), e.mean()
    sites = {h: e[[x[0] == h for x in rows]] for h in {x[0] for x in rows}}
    between = (sum(len(v) * (v.mean() - mean) ** 2 for v in sites.values()) - (len(sites) - 1) * mean * (1 - mean)) / (n - sum(len(v) ** 2 for v in sites.values()) / n)
    prior = mean * (1 - mean) / between - 1
    for g in got:
        v = sites[g._site]
        site = (mean * prior + v.sum()) / (prior + len(v))
        own = np.array([x[2] for x in rows if x[0] == g._site and x[1] == g._path])
        path = (prior * site + own.sum() - g.e_quality) / (prior + len(own) - 1)
        odds = math.log(g.p_quality / (1 - g.p_quality)) + math.log(path / (1 - path)) - math.log(mean / (1 - mean))
        assert abs(g.site_quality - site) < 1e-6 and abs(g.path_quality - path) < 1e-6 and abs(g.quality - 1 / (1 + math.exp(-odds))) < 1e-5
    rare = next(g for g in got if g._site == "rare")
    assert abs(rare.site_quality - mean) < abs(1.0 - mean)  # one document moves its site little


def test_rates_are_the_projected_gradient_solution(spark):
    r = np.random.default_rng(2)
    p = r.dirichlet([0.3, 0.2, 0.2], 400)
    n = r.integers(0, 200, 400)
    df = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(400)], "doc_id long, n_tokens long, p_good double, p_poor double, p_toxic double")
    targets = {"good": 0.7, "poor": 0.25, "toxic": 0.05}
    got = {x.doc_id: x.rate for x in mixing.fit_rates(df, targets).collect()}
    w, goal, rate = n / n.sum(), np.array([0.7, 0.25, 0.05]), np.ones(400)
    share = (w[:, None] * p).sum(axis=0)
    for _ in range(4000):
        pull = (((w * rate)[:, None] * p).sum(axis=0) - goal) / share
        rate = np.maximum(0, rate - p @ pull - mixing.RIDGE * (rate - 1))
    rate[n == 0] = 1
    mine = np.array([got[i] for i in range(400)])
    assert (mine >= 0).all() and np.abs(((w * mine)[:, None] * p).sum(axis=0) - goal).max() < 0.01
    assert np.abs(((w * (mine - rate))[:, None] * p).sum(axis=0)).max() < 0.005


def test_mix_handles_awkward_rows(spark, corpus):
    docs, labels, rows = corpus
    out = mixing.mix(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[700].rate == 1.0 and by[700].copies == 1 and by[700].n_tokens == 0
    assert all(abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-6 for r in out)
    tokens = sum(r.n_tokens for r in out)
    got = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in out) / tokens for d in mixing.DOMAINS}
    assert abs(got["good"] - mixing.TARGETS["good"]) < 0.03 and got["toxic"] < 0.02
    taken = Counter(r.doc_id for r in mixing.mixed(docs, labels).collect())
    assert all(taken[i] in (2 * by[i].copies if i == 5 else by[i].copies,) for i in taken)
    none = docs.limit(0)
    assert mixing.mix(none, labels).count() == 0 and mixing.mix(docs, labels.limit(0)).count() == len(rows)
    assert quality.classify(none, labels).count() == 0 and quality.classify(docs, labels.limit(0)).count() == len(rows)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialise(stage(spark, docs, sf), f"test-{i}")
        counts.append(out.count())
        if i < 4:
            assert out.columns == columns
        docs = out
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and counts[4] == counts[5] > 0
    assert corpus_pipeline.run(spark, sf).count() == counts[5]
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = corpus_pipeline.materialise(stage(spark, none, sf), "none")
        assert none.count() == 0

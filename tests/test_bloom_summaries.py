import random

from pyspark.sql import functions as F

from weft.operators import bloom, summaries


def test_filter_has_no_false_negatives_and_few_false_positives(spark, tmp_path):
    keys = spark.range(0, 20000).selectExpr("concat('key ', id) k").unionByName(spark.createDataFrame([(None,), ("",)], "k string"))
    bloom.store(bloom.build(keys, "k"), str(tmp_path / "f"))
    stored = bloom.load(spark, str(tmp_path / "f"))
    assert bloom.maybe_known(keys.where("k is not null"), F.col("k"), stored).where("not _maybe").count() == 0
    others = spark.range(50000, 70000).selectExpr("concat('key ', id) k")
    assert bloom.maybe_known(others, F.col("k"), stored).where("_maybe").count() < 20000 * 0.02
    assert bloom.maybe_known(spark.createDataFrame([(None,)], "k string"), F.col("k"), stored).where("_maybe").count() == 0


def test_new_rows_and_merged_filters(spark):
    r = random.Random(2)
    old = [f"v{r.randrange(900)}" for _ in range(700)]
    rows = [(i, r.choice([f"v{r.randrange(1800)}", None, "V1"])) for i in range(800)]
    a = spark.createDataFrame([(x,) for x in old[:300]], "e string")
    b = spark.createDataFrame([(x,) for x in old[300:]] + [(None,)], "e string")
    both = a.unionByName(b)
    merged = bloom.merge(bloom.build(a, "e", expected=700), bloom.build(b, "e", expected=700))
    whole = bloom.build(both, "e", expected=700)
    key = lambda x: x.block
    assert sorted(merged.select(*whole.columns).collect(), key=key) == sorted(whole.collect(), key=key)
    df = spark.createDataFrame(rows, "id int, v string")
    got = bloom.new_rows(df, F.lower("v"), both, "e", merged)
    assert got.columns == df.columns and sorted(x.id for x in got.collect()) == [i for i, v in rows if v is None or v.lower() not in set(old)]
    empty = bloom.build(a.limit(0), "e")
    assert bloom.new_rows(df, F.col("v"), a.limit(0), "e", empty).count() == 800


def test_merged_summaries_are_a_full_pass(spark, tmp_path):
    path, r, every = str(tmp_path / "t"), random.Random(3), []
    for part in range(4):
        rows = [(part * 500 + i, r.choice(["x", "y", None]), r.choice(["en", "de"]), r.choice([None, "a" * r.randrange(2000)])) for i in range(500)] + [(7, "x", "en", "same")]
        every += rows
        summaries.append(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").repartition(3), path, ["source", "lang"])
    # an append that died before its summary
    spark.createDataFrame([(1, "x", "en", "lost")], "doc_id long, source string, lang string, text string").write.parquet(f"{path}/rows/append=lost")
    assert summaries.read_rows(spark, path).count() == len(every)
    for by in ([], ["source"], ["source", "lang"]):
        out = summaries.statistics(spark, path, by)
        assert "rows/append" not in out._jdf.queryExecution().toString()
        want = {}
        for d, s, la, t in every:
            want.setdefault(tuple({"source": s, "lang": la}[c] for c in by), []).append((d, len(t or "")))
        got = {tuple(x[c] for c in by): x for x in out.collect()}
        assert got.keys() == want.keys()
        for k, rows in want.items():
            x, sizes, ids = got[k], sorted(n for _, n in rows), {d for d, _ in rows}
            assert (x.documents, x.chars, x.min_chars, x.max_chars) == (len(rows), sum(sizes), sizes[0], sizes[-1])
            assert abs(x.distinct_estimate - len(ids)) <= max(1, 3 * 1.04 / 64 * len(ids))
            for q in summaries.QUANTILES:
                at = x[f"chars_p{int(q * 100)}"]
                low, high = sum(n < at for n in sizes) / len(sizes), sum(n <= at for n in sizes) / len(sizes)
                assert low - 0.0165 <= q <= high + 0.0165
    assert summaries.compact(spark, path, ["source"]).count() == 3

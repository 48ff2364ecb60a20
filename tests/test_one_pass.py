from pyspark.sql import functions as F

from weft.operators import prepare
from weft.operators import render as R
from weft.operators import word_vectors as WV


def items(spark, n=400):
    return spark.range(n).select(F.col("id").alias("item_id"), F.concat(F.lit("About "), F.col("id").cast("string")).alias("instruction"), F.lit("").alias("context"),
                                 F.repeat(F.lit("some words "), (F.col("id") % 9 + 3).cast("int")).alias("output"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("category"),
                                 F.array(F.lit("t")).alias("tags"), F.lit("expert").alias("difficulty"), F.lit("").alias("source_section"))


def test_rows_of_a_stratum_are_not_dealt_to_one_task(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = prepare.stratified_split(items(spark), "category", 0.7, 7)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        few = sorted((r.item_id, r.split) for r in got.collect())
        monkeypatch.setattr(prepare, "CARRIED_STRATA", 1)
        many = prepare.stratified_split(items(spark), "category", 0.7, 7)
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        assert few == sorted((r.item_id, r.split) for r in many.collect()) and len(few) == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_are_rendered_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rendered = R.render_corpus(items(spark), "chatml", 2048)
    schema = rendered.schema

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    s = R.rendered_stats(rendered.mapInArrow(count, schema)).first()
    rows = rendered.collect()
    lengths = sorted(len(r.text) for r in rows)
    assert seen.value == len(rows) == s.total_items == 400
    assert (s.text_length_min, s.text_length_max, s.text_length_median) == (lengths[0], lengths[-1], lengths[len(lengths) // 2])
    assert abs(s.text_length_avg - sum(lengths) / 400) < 1e-9 and s.format == "chatml"
    ratios = [r.metadata.processed_length / r.metadata.original_length for r in rows]
    assert abs(s.avg_compression_ratio - sum(ratios) / 400) < 1e-9
    assert s.category_distribution == "a=134;b=133;unknown=133" and s.difficulty_distribution == "expert=400"
    none = R.rendered_stats(rendered.limit(0)).first()
    assert none.total_items == 0 and none.text_length_avg is None and none.avg_compression_ratio == 1.0


def test_counts_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)
    counts = spark.createDataFrame([("a", "b", 3), ("b", "a", 3), ("a", "a", 2), ("c", "a", 1), ("a", "c", 1)], "word string, context string, n long")

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    assert WV.positive_pmi(counts.mapInArrow(count, counts.schema)).count() > 0
    assert seen.value == 5

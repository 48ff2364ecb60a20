"""Rules of validation, scoring and splitting on hand-made rows (hit and near-miss per rule)."""

from pyspark.sql import functions as F

from tests.conftest import make_items
from weft.functions.text import strip
from weft.operators import prepare, quality

LONG = "x" * 30


def _issues(spark, schema, row):
    df = make_items(spark, [row], schema)
    return {r.issue_type for r in quality.item_issues(df).collect()}


def test_strip_is_unicode_aware(spark):
    df = spark.createDataFrame([(" \t x \n",), (" y ",)], "s string")
    assert [r[0] for r in df.select(strip(F.col("s"))).collect()] == ["x", "y"]


def test_missing_and_length_rules(spark, items_schema):
    base = (1, "a" * 10, "", "b" * 20, "process", ["abc"], "advanced", "")
    assert _issues(spark, items_schema, base) == set()
    assert "instruction_too_short" in _issues(spark, items_schema, (1, "a" * 9, "", "b" * 20, "process", [], "advanced", ""))
    assert "instruction_too_long" in _issues(spark, items_schema, (1, "a" * 2001, "", "b" * 20, "process", [], "advanced", ""))
    assert "instruction_too_long" not in _issues(spark, items_schema, (1, "a" * 2000, "", "b" * 20, "process", [], "advanced", ""))
    assert "output_too_short" in _issues(spark, items_schema, (1, "a" * 10, "", "b" * 19, "process", [], "advanced", ""))
    assert "output_too_long" in _issues(spark, items_schema, (1, "a" * 10, "", "b" * 8001, "process", [], "advanced", ""))
    assert "output_too_long" not in _issues(spark, items_schema, (1, "a" * 10, "", "b" * 8000, "process", [], "advanced", ""))
    ws = _issues(spark, items_schema, (1, "   ", "", LONG, "process", [], "advanced", ""))
    assert {"missing_instruction", "instruction_too_short"} <= ws
    none = _issues(spark, items_schema, (1, None, "", None, None, None, None, None))
    assert {"missing_instruction", "missing_output", "missing_category"} <= none


def test_quality_patterns_and_info_rules(spark, items_schema):
    iss = _issues(spark, items_schema, (1, "What?", "", "Yes.", "misc", ["ab"] + ["tag"] * 10, "expert", ""))
    assert {"poor_instruction_quality", "poor_output_quality", "invalid_category", "invalid_difficulty",
            "too_many_tags", "short_tags"} <= iss
    ok = _issues(spark, items_schema, (1, "What is a monad exactly", "", "A monad is a monoid in ...", "general",
                                       ["abc"] * 10, "foundational", ""))
    assert ok == set()
    # a blank category is missing, but '  ' is also invalid
    blank = _issues(spark, items_schema, (1, "a" * 10, "", "b" * 20, "  ", [], "advanced", ""))
    assert {"missing_category", "invalid_category"} <= blank


def test_item_quality_score(spark, items_schema):
    df = make_items(spark, [
        (1, "a" * 10, "ctx", "b" * 20, "process", ["abc"], "advanced", "s"),
        (2, "", "", "", "", [], "", ""),
        (3, "What?", "", "ok", "", [], "", ""),
    ], items_schema)
    got = {r.item_id: round(r.q, 6) for r in df.select("item_id", quality.item_quality().alias("q")).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: round(1 - 0.2 - 0.3 - 0.2 - 0.3, 6)}


def test_upper_median_even_and_odd(spark, items_schema):
    rows = [(i, "a" * n, "", "b" * 20, "c", [], "d", "") for i, n in enumerate([11, 12, 13, 14])]
    s = quality.item_stats(make_items(spark, rows, items_schema)).first()
    assert s.instruction_median == 13
    rows = [(i, "a" * n, "", "b" * 20, "c", [], "d", "") for i, n in enumerate([11, 12, 13, 14, 15])]
    assert quality.item_stats(make_items(spark, rows, items_schema)).first().instruction_median == 13


def test_empty_dataset_report(spark, items_schema):
    r = quality.validate(make_items(spark, [], items_schema)).first()
    assert (r.total_items, r.error_count, r.quality_score, r.dataset_issue_types) == (0, 1, 0.0, "empty_dataset")


def test_duplicates_first_index(spark, items_schema):
    rows = [(1, "Same  ", "", "x" * 20, "c", [], "d", ""), (2, " same", "", "x" * 20, "c", [], "d", ""),
            (3, "other", "", "x" * 20, "c", [], "d", ""), (4, "SAME", "", "x" * 20, "c", [], "d", "")]
    got = sorted(tuple(r) for r in quality.duplicate_instructions(make_items(spark, rows, items_schema))
                 .select("first_item_id", "item_id").collect())
    assert got == [(1, 2), (1, 4)]


def test_stratified_split_sizes_and_disjoint(spark, items_schema):
    sizes = {"a": 1, "b": 2, "c": 5, "d": 10, "e": 37}
    rows, i = [], 0
    for cat, n in sizes.items():
        for _ in range(n):
            rows.append((i, f"ins {i}", "", "o" * 20, cat, [], "d", ""))
            i += 1
    out = prepare.stratified_split(make_items(spark, rows, items_schema), "category", 0.8, 42)
    got = {(r.category, r.split): r["count"] for r in out.groupBy("category", "split").count().collect()}
    for cat, n in sizes.items():
        assert got.get((cat, "train"), 0) == int(n * 0.8)
        assert got.get((cat, "validation"), 0) == n - int(n * 0.8)
    assert out.count() == i and out.select("item_id").distinct().count() == i


def test_split_guard_small_dataset(spark, items_schema):
    rows10 = [(i, f"i{i}", "", "o" * 20, "a" if i < 9 else "b", [], "d", "") for i in range(10)]
    out = prepare.train_validation_split(make_items(spark, rows10, items_schema), 0.8, "category")
    # 10 rows: not stratified, so the global rule gives int(10 * 0.8) = 8 train rows
    assert out.where("split = 'train'").count() == 8


def test_conversation_pairs_edge_cases(spark):
    turns = spark.createDataFrame([
        (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "x"),
        (2, 0, "assistant", "y"), (2, 1, "user", "c"), (2, 2, "system", "s"), (2, 3, "assistant", "z"),
        (3, 0, "user", ""), (3, 1, "assistant", "w"),
        (4, 0, "user", "d"), (4, 1, "assistant", "e"), (4, 2, "assistant", "f"),
    ], "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.instruction, r.output) for r in prepare.conversation_pairs(turns).collect())
    assert got == [(1, "b", "x"), (2, "c", "z"), (4, "d", "e")]


def test_tag_frequency_ties_first_seen(spark, items_schema):
    rows = [(1, "i", "", "o", "c", ["z", "y"], "d", ""), (2, "i", "", "o", "c", ["y", "x"], "d", "")]
    tf = prepare.tag_frequency(make_items(spark, rows, items_schema)).orderBy(
        F.desc("frequency"), "first_item_id", "first_pos").collect()
    assert [r.tag for r in tf] == ["y", "z", "x"]


def test_split_property_many_strata_and_hot_stratum(spark, items_schema):
    import random

    rnd = random.Random(3)
    sizes = {f"s{i}": rnd.choice([1, 2, 3, 7, 11, 40]) for i in range(30)}
    sizes["hot"] = 3000  # one stratum holding most rows
    rows, i = [], 0
    for cat, n in sizes.items():
        for _ in range(n):
            rows.append((i, f"ins {i}", "", "o" * 20, cat, [], "d", ""))
            i += 1
    items = make_items(spark, rows, items_schema).repartition(7)
    for ratio in (0.5, 0.8, 0.93):
        out = prepare.stratified_split(items, "category", ratio, 11)
        got = {(r.category, r.split): r["count"] for r in out.groupBy("category", "split").count().collect()}
        for cat, n in sizes.items():
            assert got.get((cat, "train"), 0) == int(n * ratio)
            assert got.get((cat, "validation"), 0) == n - int(n * ratio)


def test_conversation_pairs_numbering_equals_window(spark):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    a = {tuple(r) for r in prepare.conversation_pairs(conv, skew_safe=True).select("conv_id", "turn", "instruction").collect()}
    b = {tuple(r) for r in prepare.conversation_pairs(conv, skew_safe=False).select("conv_id", "turn", "instruction").collect()}
    assert a == b and len(a) > 0


def test_split_sizes_hold_with_repeated_ids(spark, items_schema):
    rows = [(1, f"i{k}", "", "o", "a", [], "easy", "") for k in range(10)] + [(2, "same", "", "o", "b", [], "easy", "")] * 10
    out = prepare.stratified_split(make_items(spark, rows, items_schema), "category", 0.8, 42)
    assert sorted((r.category, r.split, r["count"]) for r in out.groupBy("category", "split").count().collect()) == [
        ("a", "train", 8), ("a", "validation", 2), ("b", "train", 8), ("b", "validation", 2)]


def test_dataset_info_with_null_and_empty_category(spark, items_schema):
    rows = [(1, "i", "", "o", None, [], "easy", ""), (2, "i", "", "o", "", [], None, ""), (3, "i", "", "o", "x", [], "easy", "")]
    r = prepare.dataset_info(make_items(spark, rows, items_schema)).first()
    assert r.category_distribution == '{"":2,"x":1}' and r.difficulty_distribution == '{"":1,"easy":2}'

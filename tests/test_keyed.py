import pytest

from weft.sources.keyed import Conflict, KeyedTable


def rows(table):
    return sorted((r.doc_id, r.text) for r in table.read().collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_versions_merge_without_moving_the_base(spark, tmp_path):
    base = spark.range(200).selectExpr("id doc_id", "concat('t', id) text", "array(id) tags", "'x' version")
    table = KeyedTable.create(base.drop("version"), str(tmp_path / "t"), buckets=4)
    assert rows(table) == [(i, f"t{i}") for i in range(200)]
    table.upsert(spark.createDataFrame([(3, "a", 1), (3, "b", 2), (300, "new", 1)], "doc_id long, text string, at int"), order="at")
    table.delete(spark.createDataFrame([(5,), (999,), (5,)], "doc_id long"))
    want = {i: f"t{i}" for i in range(200)} | {3: "b", 300: "new"}
    del want[5]
    assert rows(table) == sorted(want.items())
    assert "Exchange" not in plan(table.read())
    # neither does an aggregate or a join by the key that follows
    once = table.read()
    assert "Exchange" not in plan(once.groupBy("doc_id").count())
    table.upsert(spark.createDataFrame([(5, "back")], "doc_id long, text string"))
    want[5] = "back"
    before = rows(table)
    table.compact()
    assert rows(table) == before == sorted(want.items()) and len(table._manifest()[1]["versions"]) == 1
    # a session that finds the folder reads the same
    assert rows(KeyedTable(spark, str(tmp_path / "t"))) == before


def test_a_version_counts_when_it_is_published(spark, tmp_path, monkeypatch):
    table = KeyedTable.create(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), str(tmp_path / "t"), buckets=2)
    delta = spark.createDataFrame([(1, "new")], "doc_id long, text string")

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_publish", dies)
        with pytest.raises(RuntimeError):
            table.upsert(delta)
    assert rows(table) == [(1, "a"), (2, "b")]
    # two writers that began from the same manifest
    other = KeyedTable(spark, table.path)
    monkeypatch.setattr(other, "_manifest", lambda seen=other._manifest(): seen)
    table.upsert(delta)
    with pytest.raises(Conflict):
        other.delete(spark.createDataFrame([(2,)], "doc_id long"))
    assert rows(table) == [(1, "new"), (2, "b")]


def test_empty_and_missing_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    table = KeyedTable.create(none, str(tmp_path / "t"), buckets=2)
    assert rows(table) == []
    table.upsert(none)
    table.upsert(spark.createDataFrame([(None, "x"), (None, "x"), (1, None)], "doc_id long, text string"))
    assert sorted(table.read().collect(), key=str) == sorted([(None, "x"), (1, None)], key=str)
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, str(tmp_path / "nothing")).read()

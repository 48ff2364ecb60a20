import pytest

from weft.streaming import streams as K


@pytest.mark.parametrize("parts", [0, 3])
def test_a_stream_reads_a_table_of_one_file_or_of_several(spark, tmp_path, parts):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    if parts:
        rows.repartition(parts).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    else:
        (tmp_path / "in").mkdir()
        rows.toPandas().to_parquet(tmp_path / "in" / "documents.parquet")
    # a table beside it is not part of it
    rows.limit(3).write.parquet(str(tmp_path / "in" / "more.parquet"))
    sink, table = str(tmp_path / "sink"), str(tmp_path / "table")
    K.run_available_now(K.event_stream(spark, str(tmp_path / "in"), "documents", max_files=1), sink, sink + "-ckpt")
    assert sorted(r.doc_id for r in spark.read.parquet(sink).collect()) == list(range(30))
    src = K.event_stream(spark, str(tmp_path / "in") + "/", "documents")
    K.stream_documents(spark, src, table).option("checkpointLocation", table + "-ckpt").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.doc_id for r in K.read_collection(spark, table).collect()) == list(range(30))

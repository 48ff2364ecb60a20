"""Registered jobs of the streaming family (K), drained with ``availableNow``."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.sources.io import scratch_path
from weft.streaming import retention
from weft.streaming import streams as K


def q_stream_history(spark, sf):
    h = K.stream_history(spark, sf)
    return h.select("id", "user_id", "query", "response", "model",
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def _ordered_files(spark, sf, parts=4, files=4):
    """The events table as files in time order, so that a stream reads it in several batches: one slice
    of time after the other, each of several files."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    path = scratch_path(spark, "events-by-time")
    days = ev.select(F.min("ts").cast("timestamp").alias("lo"), F.max("ts").cast("timestamp").alias("hi")).first()
    span = max(1.0, (days["hi"] - days["lo"]).total_seconds())
    part = F.least(F.lit(parts - 1), F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit(days["lo"]))) * parts / span)).cast("int")
    for i in range(parts):  # one slice after the other: the file source takes the oldest files first
        ev.where(part == i).repartition(files, "event_id").write.mode("append").parquet(path)
    out = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", files).parquet(path)
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def q_stream_dedupe(spark, sf):
    sink = scratch_path(spark, "dedupe-sink")
    rows = K.stream_dedupe(_ordered_files(spark, sf), bucket="7 days", delay="7 days", keys=("user_id", "event_type"))
    K.run_available_now(rows.select("user_id", "event_type", "bucket_start"), sink, sink + "-ckpt")
    return spark.read.parquet(sink).select("user_id", "event_type", F.date_format("bucket_start", "yyyy-MM-dd HH:mm:ss").alias("bucket"))


def q_stream_user_activity(spark, sf):
    sink = scratch_path(spark, "activity-sink")
    K.run_available_now(K.stream_user_activity(K.event_stream(spark, sf)), sink, sink + "-ckpt")
    return spark.read.parquet(sink).select(
        "user_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "events",
        F.round("value_sum", 6).alias("value_sum"))


def q_stream_expire(spark, sf):
    sink = scratch_path(spark, "expire-sink")
    hist = K.history_rows(_ordered_files(spark, sf), spark.read.parquet(f"{sf}/embeddings.parquet"),
                          spark.read.parquet(f"{sf}/embeddings.parquet").count()).drop("embedding")
    retention.run(hist, 14, sink, sink + "-ckpt")
    return retention.read_retained(spark, sink, 14).select("id")


SQL = {
    "k1_stream_history": """
        SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id,
               concat(event_type, ' ', props) AS query,
               concat('value ', CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)) AS response,
               concat('m', CAST(event_id % 3 AS VARCHAR)) AS model, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
        FROM events""",
    "k3_stream_dedupe": """
        SELECT DISTINCT user_id, event_type, strftime(make_timestamp(CAST(floor(epoch(ts) / 604800) AS BIGINT) * 604800000000),
               '%Y-%m-%d %H:%M:%S') AS bucket FROM events""",
    "k4_stream_user_activity": """
        WITH w AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS ws, count(*) AS events, sum(value) AS value_sum
                   FROM events GROUP BY ALL)
        SELECT user_id, strftime(ws, '%Y-%m-%d') AS day, events, round(value_sum, 6) AS value_sum FROM w
        WHERE ws + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "k5_stream_expire": """
        SELECT CAST(event_id AS VARCHAR) AS id FROM events
        WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY""",
}

QUERIES = {
    "k1_stream_history": q_stream_history,
    "k3_stream_dedupe": q_stream_dedupe,
    "k4_stream_user_activity": q_stream_user_activity,
    "k5_stream_expire": q_stream_expire,
}


def q_stream_documents(spark, sf):
    table = scratch_path(spark, "collection-table")
    src = K.event_stream(spark, sf, "documents").select("doc_id", "text", "source")
    q = K.stream_documents(spark, src, table).option("checkpointLocation", table + "-ckpt") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return K.read_collection(spark, table).select("doc_id", F.size("embedding").cast("long").alias("dim"))


SQL["k2_stream_documents"] = "SELECT doc_id, CAST(64 AS BIGINT) AS dim FROM documents"
QUERIES["k2_stream_documents"] = q_stream_documents

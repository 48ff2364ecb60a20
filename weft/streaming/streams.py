"""Structured Streaming forms of the history and document jobs (K1-K4; K5 is in ``retention``).

Sources are file streams over parquet folders (any file source or Kafka
works the same way); every query keeps its progress in a checkpoint folder
below the session's checkpoint directory, so a restarted job resumes where it
stopped. ``run_available_now`` drains what is there and stops (tests, backfills).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import vectors as VX
from weft.sources.io import scratch_path


def event_stream(spark: SparkSession, folder: str, name: str = "events", max_files: int | None = None) -> DataFrame:
    """Streaming read of ``{folder}/{name}.parquet``, one file or a folder of them, with its declared schema;
    ``ts`` as TIMESTAMP."""
    folder = folder.rstrip("/")
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.format("parquet").schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # as a pattern, for a stream takes a plain path to be a folder
    df = reader.load(f"{folder}/{{{name}}}.parquet")
    if "ts" in df.columns:
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df


def history_rows(events: DataFrame, embeddings: DataFrame, n_vectors: int) -> DataFrame:
    """K1 projection (D1 form): events to history rows; the embedding is a stream-static join."""
    h = events.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat("event_type", F.lit(" "), "props").alias("query"),
        F.concat(F.lit("value "), F.col("value").cast("decimal(18,2)").cast("string")).alias("response"),
        "ts", F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"),
        (F.col("event_id") % F.lit(n_vectors)).alias("_vk"))
    return h.join(embeddings.select(F.col("vec_id").alias("_vk"), "embedding"), "_vk", "left").drop("_vk")


def run_available_now(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", fmt: str = "parquet"):
    """Start ``df`` with ``trigger(availableNow=True)`` into a file sink and wait for it to finish."""
    q = (df.writeStream.format(fmt).outputMode(mode).option("path", sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def stream_history(spark: SparkSession, folder: str, sink: str | None = None) -> DataFrame:
    """K1: history ingest stream (append), drained; returns the sink as a table."""
    emb = spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet")
    n = emb.count()
    sink = sink or scratch_path(spark, "history-sink")
    run_available_now(history_rows(event_stream(spark, folder), emb, n), sink, sink + "-ckpt")
    return spark.read.parquet(sink)


def stream_dedupe(df: DataFrame, bucket: str = "10 minutes", delay: str = "10 minutes",
                  keys=("user_id", "event_type", "props", "value")) -> DataFrame:
    """K3: one record per keys and time bucket. The bucket carries the event time, so state older
    than the watermark is dropped, and the answer does not depend on how the stream is batched
    (as long as no row is later than ``delay``)."""
    timed = df.withWatermark("ts", delay).withColumn("bucket", F.window("ts", bucket))
    return timed.dropDuplicates([*keys, "bucket"]).withColumn("bucket_start", F.col("bucket.start"))


def stream_user_activity(df: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """K4: events per user per window; rows later than the watermark are dropped."""
    return (df.withWatermark("ts", delay).groupBy("user_id", F.window("ts", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum"))
            .select("user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "events", "value_sum"))


def stream_documents(spark: SparkSession, source: DataFrame, table: str, embedder=None, key: str = "doc_id"):
    """K2: embed each micro-batch and upsert it into a collection table (B8), merge-on-read.

    A batch is appended as one new version (``version`` = batch id) instead of
    rewriting the collection; ``read_collection`` resolves the newest version per
    key with a partial aggregate. Re-running a batch after a failure rewrites
    only that batch's version folder (idempotent).
    """
    embedder = embedder or VX.hashed_embedder(64)

    def upsert(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        new = embedder(batch, "text", "embedding")
        new.write.mode("overwrite").parquet(f"{table}/version={epoch}")

    return source.writeStream.foreachBatch(upsert)


def read_collection(spark: SparkSession, table: str, key: str = "doc_id") -> DataFrame:
    """The current collection: the newest version of every key (``max_by``, combined map-side)."""
    versions = spark.read.parquet(table)
    cols = [c for c in versions.columns if c not in (key, "version")]
    latest = versions.groupBy(key).agg(F.max_by(F.struct(*cols), "version").alias("_r"))
    return latest.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])

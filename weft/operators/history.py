"""Response history (D1-D12): save, similarity lookup, timelines, retention.

History rows carry an insertion sequence ``seq`` (storage order), a nullable
``ts`` and the query embedding. Per-user limits use a ranking window whose
limit is a literal, so Spark plans a partial WindowGroupLimit before the
shuffle: a user holding a third of all rows still sends only ``limit`` rows
per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.text import present
from weft.operators import keyword
from weft.operators import vectors as VX

def epoch() -> Column:
    """The epoch instant (timestamp 0), the value a missing timestamp sorts as."""
    return F.timestamp_seconds(F.lit(0))


def ts_or_epoch(c: str | Column = "ts") -> Column:
    """Missing timestamp counts as 0 (the epoch), as in the reference's sort keys."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, epoch())


def save_responses(df: DataFrame, embedder=None, now: Column | None = None) -> DataFrame:
    """History rows ready to append: timestamp defaults to ``now``; query embedded."""
    now = now if now is not None else F.current_timestamp()
    out = df.withColumn("ts", F.coalesce(F.col("ts"), now))
    if embedder is not None and "embedding" not in df.columns:
        out = embedder(out, "query", "embedding")
    return out


def append(df: DataFrame, path: str, partition_by: str | None = "day") -> None:
    """Append rows to a history/document table (partitioned by day for retention pruning)."""
    w = df
    if partition_by == "day" and "ts" in df.columns:
        w = df.withColumn("day", F.to_date(ts_or_epoch("ts")))
    writer = w.write.mode("append")
    if partition_by and partition_by in w.columns:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def similar_responses(queries: DataFrame, history: DataFrame, limit: int = 5, min_score: float = 0.7,
                      filters: dict[str, str] | None = None, fallback_unfiltered: bool = False,
                      mode: str = "post") -> DataFrame:
    """Most similar stored queries per query row.

    ``mode="post"`` (D2): top ``min(limit, 100)`` under the filter, then keep
    similarity >= min_score (threshold after ranking). ``mode="strict"`` (D4):
    threshold inside the search, no retry. With ``fallback_unfiltered`` (D3)
    queries that found nothing under a filter search again without it.
    Similarity is cosine (see README, divergence D-18).
    """
    depth = min(limit, 100)
    docs = history.select(F.col("seq").alias("doc_id"), "embedding", *set((filters or {}).values()))
    if mode == "strict":
        hits = VX.knn(queries, docs, k=limit, filters=filters, min_score=min_score)
    else:
        hits = VX.knn(queries, docs, k=depth, filters=filters).where(F.col("score") >= F.lit(min_score))
    if fallback_unfiltered and filters and mode != "strict":
        missed = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
        extra = VX.knn(missed, docs, k=depth).where(F.col("score") >= F.lit(min_score))
        w = Window.partitionBy("query_id").orderBy("rank")
        extra = extra.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
        hits = hits.unionByName(extra)
    return hits.withColumnRenamed("doc_id", "seq").withColumnRenamed("score", "similarity")


def recent_responses(history: DataFrame, by: str = "user_id", limit: int = 10) -> DataFrame:
    """Per filter value, the first ``limit`` rows in storage order, then newest first.

    Similarity is 1.0. ``position`` is 1-based after the timestamp sort
    (stable, so equal timestamps keep storage order).
    """
    first = history.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy("seq"))) \
        .where(F.col("_rn") <= limit).drop("_rn")
    w = Window.partitionBy(by).orderBy(ts_or_epoch("ts").desc(), F.col("seq").asc())
    return first.withColumn("position", F.row_number().over(w)).withColumn("similarity", F.lit(1.0))


def user_history(history: DataFrame, limit: int = 20, by: str = "user_id") -> DataFrame:
    """Per user the first ``limit`` rows in storage order, sorted by time ascending."""
    first = history.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy("seq"))) \
        .where(F.col("_rn") <= limit).drop("_rn")
    w = Window.partitionBy(by).orderBy(ts_or_epoch("ts").asc(), F.col("seq").asc())
    return first.withColumn("position", F.row_number().over(w))


def expire_history(history: DataFrame, days: int, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows older than ``now - days`` (missing timestamp = 0) are removed.

    Returns (kept rows, one-row removed count). ``now`` must be a parameter in
    tests (never the wall clock); when history is partitioned by day the
    predicate prunes whole partitions.
    """
    now = now if now is not None else F.current_timestamp()
    cutoff = now - F.make_interval(days=F.lit(days))
    keep = ts_or_epoch("ts") >= cutoff
    kept = history.where(keep)
    removed = history.agg(F.sum(F.when(~keep, 1).otherwise(0)).cast("long").alias("removed"))
    return kept, removed


def clear_history(history: DataFrame, users: DataFrame | None = None, by: str = "user_id") -> DataFrame:
    """The history without the rows of ``users`` (a table with the column ``by``); without
    ``users`` everything is cleared and an empty table of the same schema is left."""
    return history.limit(0) if users is None else history.join(users.select(by).distinct(), by, "left_anti").select(*history.columns)


def select_history(queries: DataFrame, history: DataFrame, timeline_limit: int = 10, similar_limit: int = 5,
                   min_score: float = 0.1, similar_fallback: bool = False) -> DataFrame:
    """History items per query row (only rows with a user id).

    Timeline first (``timeline_limit`` in storage order); queries whose user
    has none fall back to user-filtered similar responses. Items are sorted by
    time ascending; ``position`` numbers them from 1.
    """
    q = queries.where(present("user_id"))
    hist_cols = [c for c in history.columns if c != "embedding"]
    tl = user_history(history.select(*hist_cols), timeline_limit).drop("position")
    items = q.select("query_id", "user_id").join(tl, "user_id").select("query_id", *hist_cols)
    if similar_fallback:
        # Only query rows whose user has no timeline reach the similarity search, and it is
        # filtered to that same user: a user without timeline rows has no history rows, so the
        # search cannot find anything. It is kept for stores whose timeline read can fail.
        missed = q.join(items.select("query_id").distinct(), "query_id", "left_anti")
        eligible = missed.join(history.select("user_id").distinct(), "user_id", "left_semi")
        sim = similar_responses(eligible, history, similar_limit, min_score, {"user_id": "user_id"})
        sim_rows = sim.select("query_id", "seq").join(history.select(*hist_cols), "seq")
        items = items.unionByName(sim_rows.select("query_id", *hist_cols))
    w = Window.partitionBy("query_id").orderBy(ts_or_epoch("ts").asc(), F.col("seq").asc())
    return items.withColumn("position", F.row_number().over(w))


def keyword_search(queries: DataFrame, history: DataFrame, limit: int = 5, filter_col: str | None = "user_id",
                   text_col: str = "text") -> DataFrame:
    """History rows whose lower-cased stored query contains any query word.

    Answered by an index of trigrams (``keyword``): no query meets a text that does not hold the rarest
    grams of one of its words, with or without a filter column. Rank is storage order, similarity 0.9.
    """
    return keyword.search(queries, history, limit, filter_col, text_col).withColumn("similarity", F.lit(0.9))


def dialogue_window(history: DataFrame, messages: DataFrame, n: int = 20, history_limit: int = 20,
                    by: str = "user_id") -> DataFrame:
    """Per user, timeline as user/assistant messages followed by the current messages; last ``n`` kept.

    ``messages`` has (user_id, turn, role, content).
    """
    tl = user_history(history, history_limit, by)
    hm = tl.select(by, F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.col("position").alias("ord"), F.lit(0).alias("sub"),
                 F.lit("user").alias("role"), F.col("query").alias("content")),
        F.struct(F.lit(0).alias("part"), F.col("position").alias("ord"), F.lit(1).alias("sub"),
                 F.lit("assistant").alias("role"), F.col("response").alias("content")))).alias("m")).select(by, "m.*")
    cm = messages.select(by, F.lit(1).alias("part"), F.col("turn").cast("int").alias("ord"), F.lit(0).alias("sub"),
                         "role", "content")
    allm = hm.unionByName(cm)
    w = Window.partitionBy(by).orderBy(F.col("part").desc(), F.col("ord").desc(), F.col("sub").desc())
    last = allm.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n)
    return last.withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy(by))) \
        .withColumn("position", F.col("_cnt") - F.col("_back") + 1).drop("_back", "_cnt")


def dedupe_history(history: DataFrame, bucket: str = "10 minutes") -> DataFrame:
    """Drop the later saves of the same (user, query, response) within one time bucket.

    ``min_by`` over the group is a partial aggregate, so a hot group is
    combined map-side instead of being ranked inside one task.
    """
    b = F.window(ts_or_epoch("ts"), bucket).start.alias("_bucket")
    cols = history.columns
    g = history.groupBy("user_id", "query", "response", b).agg(
        F.min_by(F.struct(*cols), F.col("seq")).alias("_r"))
    return g.select("_r.*")

"""Collection statistics that are kept up (B15, F9, H10): one small summary per append.

An append writes its rows and a summary of these rows only: exact counts and sums per group, and sketches
that Spark merges (distinct values, quantiles of lengths, frequent items). The figures of the whole table are the merged
summaries, so neither an append nor a report reads old rows. Counts and sums are exact. Bounds of the others:
distinct counts within 3 standard errors of 1.04 / sqrt(2^lgK), ranks of quantiles within 1.65 per cent for
the default k of 200 (normalised rank error, 99 per cent confidence), and items more frequent than the tracked ones'
error are all listed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 12
QUANTILES = (0.25, 0.5, 0.75)


def summarise(rows: DataFrame, by: list[str], text: str, distinct: str) -> DataFrame:
    """One row per group: exact counts, and sketches of ``distinct`` and of the text's lengths."""
    length = F.coalesce(F.length(text), F.lit(0)).cast("long")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(length).alias("chars"), F.min(length).alias("min_chars"), F.max(length).alias("max_chars"),
        F.hll_sketch_agg(F.col(distinct).cast("string"), F.lit(LG_K)).alias("distinct_sketch"), F.kll_sketch_agg_bigint(length).alias("length_sketch"))


def append(rows: DataFrame, path: str, by: list[str], text: str = "text", distinct: str = "doc_id") -> None:
    """Adds rows to the table at ``path`` together with their summary. Both carry the append's name; an
    append whose summary is missing (its job died) is not part of the table."""
    name = uuid.uuid4().hex
    rows.write.parquet(f"{path}/rows/append={name}")
    # the summary is of what was written, read back from this append only
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows/append={name}")
    summarise(written, by, text, distinct).coalesce(1).write.parquet(f"{path}/summaries/append={name}")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows, of complete appends."""
    done = spark.read.parquet(f"{path}/summaries").select("append").distinct()
    return spark.read.parquet(f"{path}/rows").join(F.broadcast(done), "append", "left_semi").drop("append")


def _merged(summaries: DataFrame, by: list[str]) -> DataFrame:
    return summaries.groupBy(*by).agg(
        F.sum("documents").alias("documents"), F.sum("chars").alias("chars"), F.min("min_chars").alias("min_chars"), F.max("max_chars").alias("max_chars"),
        F.hll_union_agg("distinct_sketch").alias("_d"), F.kll_merge_agg_bigint("length_sketch").alias("_l"))


def _report(merged: DataFrame, by: list[str]) -> DataFrame:
    at: list[Column] = [F.kll_sketch_get_quantile_bigint("_l", F.lit(q)).alias(f"chars_p{int(q * 100)}") for q in QUANTILES]
    return merged.select(*by, "documents", "chars", "min_chars", "max_chars", F.hll_sketch_estimate("_d").alias("distinct_estimate"), *at)


def statistics(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Figures per group from the summaries alone; ``by`` is some of the columns that they were made by
    (none: the whole table)."""
    return _report(_merged(spark.read.parquet(f"{path}/summaries"), by), by)


def compact(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """The summaries as one row per group, in their own form (to be kept in place of many)."""
    return _merged(spark.read.parquet(f"{path}/summaries"), by).withColumnsRenamed({"_d": "distinct_sketch", "_l": "length_sketch"})

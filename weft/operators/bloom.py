"""A stored Bloom filter over the keys of a large table (G6), as a table of blocks.

A key falls on one block and sets one bit in each of its eight words. The blocks are a grouped ``bit_or``, which
Spark combines before its shuffle, so the keys themselves are never gathered or sorted, and new keys are added
by one more ``bit_or`` over both. Rows whose block lacks one of their bits are certainly new; only the
others are compared with the existing keys. All of it is native columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 8
_WORD_BITS = 64


def _blocks_for(keys: int, bits_per_key: int) -> int:
    return max(1, -(-keys * bits_per_key // (WORDS * _WORD_BITS)))


def _place(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), blocks).alias("block")


def _bits(key: Column) -> list[Column]:
    """One bit per word, from six bits of one hash each."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def build(keys: DataFrame, column: str, bits_per_key: int = 12, expected: int | None = None) -> DataFrame:
    """``(block, blocks, w0..w7)`` over the non-null keys; ``expected`` keys (those there, without) set its size."""
    rows = keys.select(F.col(column).alias("_k")).where("_k is not null")
    n = F.lit(_blocks_for(expected if expected is not None else rows.count(), bits_per_key)).cast("long")
    bits = rows.select(_place(F.col("_k"), n), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("_k")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]).withColumn("blocks", n)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filter of both key sets; both have the same size."""
    return a.unionByName(b).groupBy("block", "blocks").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def store(stored: DataFrame, path: str) -> None:
    stored.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def maybe_known(rows: DataFrame, key: Column, stored: DataFrame) -> DataFrame:
    """Adds ``_maybe``: false where the key is certainly not among the filter's (a null key is not). Rows
    meet the filter's blocks by an equi-join; Spark broadcasts a filter that it knows to be small."""
    n = stored.agg(F.max("blocks")).first()[0] or 1
    x = rows.withColumns({"_bk": key, "_block": _place(key, F.lit(n).cast("long"))})
    filled = stored.select(F.col("block").alias("_block"), *[F.col(f"w{i}").alias(f"_w{i}") for i in range(WORDS)])
    x = x.join(filled, "_block", "left")
    has = F.lit(True)
    for i, bit in enumerate(_bits(F.col("_bk"))):
        has = has & (F.col(f"_w{i}").bitwiseAND(bit) != 0)
    return x.withColumn("_maybe", F.coalesce(has & F.col("_bk").isNotNull(), F.lit(False))).drop("_bk", "_block", *[f"_w{i}" for i in range(WORDS)])


def new_rows(rows: DataFrame, key: Column, existing: DataFrame, existing_col: str, stored: DataFrame) -> DataFrame:
    """The rows whose key is not among the existing ones. What the filter excludes skips the exact join."""
    marked = maybe_known(rows, key, stored)
    known = existing.select(F.col(existing_col).alias("_ek")).where("_ek is not null")
    checked = marked.where("_maybe").withColumn("_ek", key).join(known, "_ek", "left_anti").drop("_ek")
    return marked.where("not _maybe").unionByName(checked).drop("_maybe")

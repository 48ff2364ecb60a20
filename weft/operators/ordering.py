"""Global row numbers without a single-partition window.

The table is range-partitioned and sorted on the order key; per-partition row
counts (one small row per partition) give each partition its offset, and a
row's number is the offset plus its position inside the partition. The
numbered table is checkpointed to the session's checkpoint folder, so the
partition layout the offsets were computed from is the one that is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def global_row_number(df: DataFrame, order_col, out: str = "n", partitions: int | None = None) -> DataFrame:
    """1-based row number over the whole table in ``order_col`` order (a name or a list of names)."""
    spark = df.sparkSession
    cols = [order_col] if isinstance(order_col, str) else list(order_col)
    n_parts = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
    placed = (df.repartitionByRange(n_parts, *[F.col(c) for c in cols])
              .sortWithinPartitions(*cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    placed = placed.checkpoint(eager=True)
    counts = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    # one row per partition: a bounded broadcast
    return placed.join(F.broadcast(offsets), "_pid").withColumn(
        out, F.col("_off") + F.col("_local") + 1).drop("_pid", "_local", "_off")

"""Intermediate tables in the storage all executors share.

``spark.checkpoint.dir`` names that storage on a cluster; an unset session (tests) gets a
folder of its own. A materialised table cuts the lineage: an executor lost later costs a
re-read of Parquet files, not a recomputation, and the shuffle files behind a table are
dropped as soon as it is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weft.session import ensure_checkpoint_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back."""
    spark: SparkSession = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/weft-llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)

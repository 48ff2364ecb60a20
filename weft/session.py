"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs depend on for correct results (UTC rendering of timestamps)
# and for scale (AQE re-planning, skew-join splitting, partition coalescing).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # batches handed to Python are bounded by bytes, so long texts do not add up to large batches
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "weft") -> SparkSession:
    """Session for tests and the local bench (no UI, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # the local test tables are single row groups
    spark.conf.set("weft.scan.partitions", str(spark.sparkContext.defaultParallelism))
    ensure_checkpoint_dir(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to a session handed in by a caller."""
    for k, v in REQUIRED_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared cluster session: keep theirs
            pass
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, shared by the driver and all executors.

    ``spark.checkpoint.dir`` names it on a cluster and is kept as given. Only a local session
    (tests, local bench) gets a scratch folder of its own where it is unset; on a cluster an unset
    folder is an error, because a folder of one machine would lose the other machines' files.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local_dir = tempfile.mkdtemp(prefix="weft-ckpt-", dir=os.environ.get("WEFT_SCRATCH", "/tmp"))
    spark.sparkContext.setCheckpointDir(local_dir)
    return local_dir


# Spark's setting by which the shuffle files of a query go when it ends, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Queries that are made and run in here take their shuffle files with them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def kept(df: DataFrame) -> DataFrame:
    """The table as stored rows (a checkpoint); the shuffle files it was made with go at once."""
    with tidy(df.sparkSession):
        return df.select("*").checkpoint()  # a query goes by the setting that it is made under

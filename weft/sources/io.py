"""Sources and sinks of training items and rendered corpora.

Readers take a declared schema (no inference) and apply the reference's
defaults with ``coalesce``; writers emit JSON lines / CSV shards in parallel.
Scratch output of jobs goes below the session's checkpoint folder (a shared
folder on a cluster), never a machine-local temporary folder.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weft.functions.text import present
from weft.operators import formats as FM
from weft.operators import prepare
from weft.sources import ranges
from weft.session import ensure_checkpoint_dir

CONV_MSG = T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])
RAW_ITEM = T.StructType([
    T.StructField("instruction", T.StringType()), T.StructField("context", T.StringType()),
    T.StructField("output", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("difficulty", T.StringType()),
    T.StructField("source_section", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("conversations", T.ArrayType(CONV_MSG)),
    T.StructField("item_id", T.LongType()),
])
ITEM_OUT = ["item_id", "instruction", "context", "output", "category", "tags", "difficulty", "source_section"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's (shared) checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/weft-io/{name}-{uuid.uuid4().hex[:12]}"


def _defaults(df: DataFrame, keep_meta: bool = True) -> DataFrame:
    return df.select(
        "item_id",
        F.col("instruction"),
        F.coalesce("context", F.lit("")).alias("context"),
        F.col("output"),
        F.coalesce("category", F.lit("general")).alias("category"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("difficulty", F.lit("intermediate")).alias("difficulty"),
        (F.coalesce("source_section", F.lit("")) if keep_meta else F.lit("")).alias("source_section"),
    )


def _item_rows(raw: DataFrame, keep_meta: bool = True) -> DataFrame:
    has_keys = F.col("instruction").isNotNull() & F.col("output").isNotNull()
    return _defaults(raw.where(has_keys), keep_meta)


def _conversation_rows(raw: DataFrame, strict_roles: bool = False) -> DataFrame:
    """A2: human/assistant pairs inside each record's ``conversations`` list (G7 rule)."""
    conv = raw.where(F.col("instruction").isNull() | F.col("output").isNull()).where(
        F.col("conversations").isNotNull())
    turns = conv.select(F.col("item_id").alias("conv_id"), F.posexplode("conversations").alias("turn", "m")).select(
        "conv_id", "turn", F.col("m.from").alias("role"), F.col("m.value").alias("text"))
    assistants = ("assistant",) if strict_roles else ("assistant", "gpt")
    pairs = prepare.conversation_pairs(turns, human_roles=("human",), assistant_roles=assistants)
    # a digest names the pair; conversation and turn stay columns of their own
    return pairs.select(F.xxhash64("conv_id", "turn").alias("item_id"), "conv_id", "turn", "instruction", "context",
                        "output", "category", "tags", "difficulty", "source_section")


def _numbered(records: DataFrame, parsed: Column) -> DataFrame:
    """Parsed records; those without an id get a number made from their file and offset."""
    rows = records.select(F.xxhash64("file", "offset").alias("_place"), parsed.alias("_r")).select("_place", "_r.*")
    return rows.withColumn("item_id", F.coalesce("item_id", "_place")).drop("_place")


def read_items_json(spark: SparkSession, path: str, strict_roles: bool = False, one_array: bool = False) -> DataFrame:
    """A1 + A2: JSON files each holding an array of objects; with ``one_array`` the files of a folder are
    parts of one array (``write_items_array``). A file of any size is read by all its splits.

    Objects with instruction and output become items with defaults; objects
    with ``conversations`` become human/assistant pairs.
    """
    raw = _numbered(ranges.json_records(spark, path, one_array), F.from_json("text", RAW_ITEM))
    return _item_rows(raw).unionByName(_conversation_rows(raw, strict_roles), allowMissingColumns=True)


def read_items_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A3: JSON lines; blank lines skipped; only instruction/output objects; drops source_section."""
    raw = spark.read.schema(RAW_ITEM).option("recursiveFileLookup", True).json(path)
    raw = raw.withColumn("item_id", F.coalesce("item_id", F.monotonically_increasing_id()))
    return _item_rows(raw, keep_meta=False)


def read_items_csv(spark: SparkSession, path: str) -> DataFrame:
    """A4: CSV with header; instruction and output columns required; tags split on ',' (no trim). Values may
    hold line breaks; a file of any size is read by all its splits. All files have the columns of the first."""
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    missing = [c for c in ("instruction", "output") if c not in names]
    if missing:
        raise ValueError("CSV must contain columns: ['instruction', 'output']")
    parsed = F.from_csv("text", ", ".join(f"`{c}` string" for c in names), {"escape": '"', "multiLine": "true"})
    records = ranges.csv_records(spark, path).filter("offset > 0")
    df = records.select(F.xxhash64("file", "offset").alias("_place"), parsed.alias("_r")).select("_place", "_r.*")

    def col(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    tags = F.when(present("tags"), F.split(F.col("tags"), ",")) if "tags" in df.columns else F.lit(None)
    out = df.select(
        (F.col("item_id").cast("long") if "item_id" in df.columns else F.col("_place")).alias("item_id"),
        F.coalesce("instruction", F.lit("")).alias("instruction"), col("context", "").alias("context"),
        F.coalesce("output", F.lit("")).alias("output"), col("category", "general").alias("category"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        col("difficulty", "intermediate").alias("difficulty"), F.lit("").alias("source_section"))
    return out


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A5: one row per file (whole text, UTF-8) with its path.

    Read as binary files and decoded: the exact bytes of every file, one row
    each (the line-oriented text reader is not used for whole documents).
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        F.col("path"), F.decode(F.col("content"), "UTF-8").alias("text"))


def route_format(path: Column, first_line: Column) -> Column:
    """Md -> markdown, json, jsonl, csv; txt -> jsonl when the stripped first line starts with '{'."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return (F.when(ext == ".md", "markdown").when(ext == ".json", "json").when(ext == ".jsonl", "jsonl")
            .when(ext == ".csv", "csv")
            .when(ext == ".txt", F.when(F.regexp_replace(first_line, r"(?U)^\s+", "").startswith("{"), "jsonl")
                  .otherwise("markdown")))


def _first_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(_file, _first)``: the first line of each ``.txt`` file, handed on line by line without whole files."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]").text(path)
    head = lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), "value").where("_at = 0")

    def first(batches):
        seen = None
        for batch in batches:
            files = batch.column(0).dictionary_encode()
            code = files.indices.to_numpy(zero_copy_only=False)
            names = files.dictionary.to_pylist()
            rows = [i for i in range(len(code)) if (i == 0 or code[i] != code[i - 1]) and names[code[i]] != seen] if len(code) else []
            yield pa.RecordBatch.from_arrays([pa.array([names[code[i]] for i in rows], pa.string()), batch.column(2).take(pa.array(rows, pa.int64()))], ["_file", "_first"])
            seen = names[code[-1]] if len(code) else seen

    return head.mapInArrow(first, "_file string, _first string")


def route_files(spark: SparkSession, path: str) -> DataFrame:
    """A6 over a folder: path and detected format; an unknown extension is an error. Only ``.txt``
    files are opened; empty files hold nothing and are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("_metadata.file_path").alias("_file"))
    known = route_format(F.col("path"), F.coalesce("_first", F.lit("")))
    return files.join(_first_lines(spark, path), "_file", "left").select(
        "path", F.coalesce(known, F.raise_error(F.concat(F.lit("Unsupported format: "), "path"))).alias("format"))


def write_items(df: DataFrame, path: str, fmt: str = "jsonl") -> None:
    """Items as JSON lines (for 'json' and 'jsonl'); other formats are an error."""
    if fmt not in ("json", "jsonl"):
        raise ValueError(f"Unsupported output format: {fmt}")
    df.select(*[c for c in ITEM_OUT if c in df.columns]).write.mode("overwrite").json(path)


def write_items_array(df: DataFrame, path: str, one_array: bool = False) -> None:
    """A7 ``json``: each partition writes one file that holds a JSON array of its items, row by row.

    With ``one_array`` the files, put together in the order of their names, are one array: the first one
    opens it, the last one closes it, all others begin with a comma. ``read_items_json`` reads such a
    folder as it is. Nothing is gathered; the driver sees the row count of each partition.
    """
    rows = df.select(F.to_json(F.struct(*[c for c in [*ITEM_OUT, "conversations"] if c in df.columns])).alias("value"))
    ends = None
    if one_array:
        rows = rows.checkpoint()  # the same rows in the same partitions when they are written
        held = [r[0] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().select("p").collect()]
        ends = (min(held, default=0), max(held, default=0))

    def lines(batches):
        part = TaskContext.get().partitionId()
        opens, closes = (part == ends[0], part == ends[1]) if ends else (True, True)
        empty, waiting = True, None
        for batch in batches:
            # the last line waits, since what follows it is not known yet
            values = ([] if waiting is None else [waiting]) + batch.column(0).to_pylist()
            if not values:
                continue
            if empty:
                values[0], empty = ("[" if opens else ",") + values[0], False
            waiting = values.pop()
            yield pa.RecordBatch.from_arrays([pa.array([v + "," for v in values], pa.string())], ["value"])
        last = ["[]"] if empty and opens and closes else ([] if empty else [waiting + ("]" if closes else "")])
        yield pa.RecordBatch.from_arrays([pa.array(last, pa.string())], ["value"])

    rows.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def export_items(df: DataFrame, fmt: str, path: str) -> None:
    """A10: convert to the named layout and persist (csv as CSV shards, others as JSON lines)."""
    if fmt not in FM.SUPPORTED:
        raise ValueError(f"Unsupported format: {fmt}. Supported formats: {list(FM.SUPPORTED)}")
    keep = [c for c in ("item_id",) if c in df.columns]
    if fmt == "csv":
        FM.to_flat(df, keep=tuple(keep)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
        return
    if fmt == "alpaca":
        out = FM.to_alpaca(df, keep=tuple(keep)).select(*keep, "alpaca.*")
    elif fmt == "sharegpt":
        out = FM.to_sharegpt(df, keep=tuple(keep)).select(*keep, "sharegpt.*")
    elif fmt == "openai":
        out = FM.to_openai(df, keep=tuple(keep)).select(*keep, "openai.*")
    else:
        out = df.select(*[c for c in ITEM_OUT if c in df.columns])
    out.write.mode("overwrite").json(path)


def import_items(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Read a layout written by ``export_items`` back into items."""
    if fmt not in FM.SUPPORTED:
        raise ValueError(f"Unsupported format: {fmt}")
    if fmt == "csv":
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        return FM.from_flat(df.withColumn("item_id", F.col("item_id").cast("long")))
    if fmt == "alpaca":
        sch = T.StructType([T.StructField("item_id", T.LongType())] + FM.ALPACA_SCHEMA.fields)
        df = spark.read.schema(sch).json(path)
        return FM.from_alpaca(df.select("item_id", F.struct(*[c.name for c in FM.ALPACA_SCHEMA.fields]).alias("alpaca")))
    if fmt == "sharegpt":
        sch = T.StructType([T.StructField("item_id", T.LongType())] + FM.SHAREGPT_SCHEMA.fields)
        df = spark.read.schema(sch).json(path)
        return FM.from_sharegpt(df.select("item_id", F.struct("conversations", "metadata").alias("sharegpt")))
    if fmt == "openai":
        sch = T.StructType([T.StructField("item_id", T.LongType())] + FM.OPENAI_SCHEMA.fields)
        df = spark.read.schema(sch).json(path)
        return FM.from_openai(df.select("item_id", F.struct("messages", "metadata").alias("openai")))
    sch = T.StructType([T.StructField("item_id", T.LongType())] + FM.GENERIC_SCHEMA.fields)
    return FM.from_generic(spark.read.schema(sch).json(path))


# ----------------------------------------------------------------- dataset catalog

CATALOG_SCHEMA = "name string, path string, format string, created_at timestamp, info string"


def register_dataset(spark: SparkSession, base: str, name: str, items: DataFrame, info: DataFrame | None = None,
                     created_at=None) -> str:
    """Write items under ``base/processed/name`` and append a catalog row."""
    path = f"{base.rstrip('/')}/processed/{name}"
    items.write.mode("overwrite").parquet(path)
    info_json = info.select(F.to_json(F.struct(*info.columns)).alias("j")).first()[0] if info is not None else None
    ts = created_at if created_at is not None else F.current_timestamp()
    row = spark.range(1).select(F.lit(name).alias("name"), F.lit(path).alias("path"), F.lit("parquet").alias("format"),
                                (ts if isinstance(ts, Column) else F.lit(ts)).cast("timestamp").alias("created_at"),
                                F.lit(info_json).cast("string").alias("info"))
    row.write.mode("append").parquet(f"{base.rstrip('/')}/catalog")
    return path


def _catalog(spark: SparkSession, base: str) -> DataFrame:
    folder = f"{base.rstrip('/')}/catalog"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):  # no catalog written yet
        return spark.createDataFrame([], CATALOG_SCHEMA)
    cat = spark.read.schema(CATALOG_SCHEMA).parquet(folder)
    # rows of one instant: the larger path, so the choice does not depend on the layout
    w = Window.partitionBy("name").orderBy(F.col("created_at").desc(), F.col("path").desc(), F.col("info").desc())
    return cat.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def list_datasets(spark: SparkSession, base: str) -> DataFrame:
    """Names of the registered datasets, sorted."""
    return _catalog(spark, base).select("name").orderBy("name")


def load_dataset(spark: SparkSession, base: str, name: str) -> DataFrame:
    cat = _catalog(spark, base).where(F.col("name") == name).select("path").collect()
    if not cat:
        raise FileNotFoundError(f"Processed dataset not found: {name}")
    return spark.read.parquet(cat[0][0])


def dataset_info(spark: SparkSession, base: str, name: str):
    """The stored info JSON of a dataset, or None when absent."""
    rows = _catalog(spark, base).where(F.col("name") == name).select("info").collect()
    return rows[0][0] if rows else None

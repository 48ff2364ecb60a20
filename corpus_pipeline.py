"""Corpus pipeline over ``documents``: STAGES in order, each on what the one before kept.

Language identification drops what it rejects; of each group of near duplicates (five-word
shingles, similarity of 0.8 or more) one document stays; secrets are masked in the text; mixing
takes documents as often as the target weights ask; the last stage encodes the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, catalog, jaccard_join, lang_id, mixing, secret_scan
from weft.llm.scratch import materialise
from weft.session import prepare

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.accepted(docs, lang_id.learn(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_per_class(docs, n=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs, *catalog.tiktoken_vocabulary())
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tok = catalog.tokenizer_json()
    both = bpe.encode_and_decode(docs, tok)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def _prepared(stage):
    """The stage under the session settings that the operators rely on."""

    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        return stage(spark, docs, sf_dir)

    return call


STAGES = [(f.__name__, _prepared(f)) for f in (language_id, ngram_jaccard_join, secret_scans, source_mixing, bpe_encode_decode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

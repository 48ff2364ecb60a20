"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import ann, bpe, embed_dedup, jaccard_join, lang_id, license_scan, mixing, ppm, quality, runs, secret_scan, spelling, substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_json(path: str | None = None) -> str:
    """The public byte-level BPE tokenizer (read on the driver, shipped with the tasks)."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def tiktoken_vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """The same vocabulary as tiktoken ranks, and the splitting pattern."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, public_tokenizers.PATTERN


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = tokenizer_json()
    both = bpe.encode_and_decode(_table(spark, sf_dir, "documents"), tok)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90).select(
        "doc_id", "n_shingles", "component_id")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("_key")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op6_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.filter(F.col("vec_id") % 50 == 0), k=5)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"), *tiktoken_vocabulary())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = lang_id.predict(docs, lang_id.learn(docs))
    return out.select("doc_id", F.coalesce(lang_id.fold_of(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
                      "lang_pred", "score", "rejected")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def crc_remainder(doc_id: str, modulus: int):
    """The remainder of the id's crc32, as text; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_remainder("doc_id", 7) == 2, F.lit(False))
    return ppm.score(_table(spark, sf_dir, "documents"), ~held_out).select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """A tenth of the texts, by the id's crc32, repeat some of their words to their end."""
    docs = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    planted = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get(
        "_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    g = F.floor(F.col("_h") / 10)
    some = (docs.filter("_h % 10 = 0 and text is not null").withColumn("_w", words).withColumn("_n", F.size("_w").cast("long"))
            .withColumn("_a", g % F.greatest("_n", F.lit(1))).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
            .select("doc_id", F.when(F.col("_n") > 0, F.array_join(planted, " ")).otherwise("").alias("text")))
    return docs.filter("not (_h % 10 = 0 and text is not null) or _h is null").select("doc_id", "text").unionByName(some)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_period(_table(spark, sf_dir, "documents")))
    # more periods first, then by start and period: exact products instead of quotients
    more = F.array_sort("runs", lambda a, b: F.when(a["length"] * b["period"] != b["length"] * a["period"], F.when(
        a["length"] * b["period"] > b["length"] * a["period"], -1).otherwise(1)).when(a["start"] != b["start"], F.when(
            a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)))
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("_top", F.get(more, F.lit(0))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_top.start").alias("start"), F.col("_top.length").alias("length"),
        F.col("_top.period").alias("period"), F.floor(1000 * F.col("_top.length") / F.col("_top.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), typo_modulus=199)


QUERIES = {
    "op1_bpe_encode_decode": op1_bpe_encode_decode,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_license_scans": op3_license_scans,
    "op4_source_mixing": op4_source_mixing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_approximate_nearest_neighbours": op6_approximate_nearest_neighbours,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_secret_scans": op8_secret_scans,
    "op9_language_id": op9_language_id,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}
SQL: dict[str, str] = {
    "op3_license_scans": license_scan.oracle_sql(),
}

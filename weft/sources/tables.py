"""Driver tables and the derived views every job family reads.

The derived views follow FIXTURES.md §2: they turn the generic driver tables
(documents, embeddings, events, ...) into training items, markdown corpora,
response history, a retrieval collection and a queries table. Each view is a
projection or an equi-join of whole tables, so its size grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Session setting: partitions that every table scan is dealt to. Unset by default (a scan keeps its
# own splits); useful for tables stored as one row group, which Spark reads as one task.
SCAN_PARTITIONS = "weft.scan.partitions"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as it is now, dealt to ``weft.scan.partitions`` partitions where that is set."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


def items_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training items (ITEM schema) derived from ``documents``."""
    docs = read(spark, sf_dir, "documents")
    return docs.selectExpr(
        "doc_id AS item_id",
        "split_part(text, '\\n', 1) AS instruction",
        "CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('about ', lang) END AS context",
        "CASE WHEN doc_id % 13 = 0 THEN 'ok.' "
        "ELSE substr(text, length(split_part(text, '\\n', 1)) + 2) END AS output",
        "CASE doc_id % 7 WHEN 0 THEN 'philosophy' WHEN 1 THEN 'methodology' "
        "WHEN 2 THEN 'process' WHEN 3 THEN 'example' WHEN 4 THEN 'conversation' "
        "WHEN 5 THEN 'misc' ELSE '' END AS category",
        "CASE WHEN doc_id % 5 = 0 THEN CAST(array() AS array<string>) ELSE array(lang, source) END AS tags",
        "CASE doc_id % 4 WHEN 0 THEN 'foundational' WHEN 1 THEN 'intermediate' "
        "WHEN 2 THEN 'advanced' ELSE 'expert' END AS difficulty",
        "CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS source_section",
    )


# Fixed values of the derived markdown corpus (FIXTURES.md §2.2): header cycle.
MARKDOWN_HEADERS = [
    "Core Philosophy",
    "Workflow Steps",
    "Practical Example",
    "Team Framework",
    "Crisis Prevention Protocol",
    "Notes",
]


def markdown_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One markdown document per ``documents`` row: a `## ` section per line."""
    docs = read(spark, sf_dir, "documents")
    heads = "array(" + ", ".join(f"'{h}'" for h in MARKDOWN_HEADERS) + ")"
    section = (
        f"concat('\\n## ', element_at({heads}, CAST((doc_id + i) % 6 AS INT) + 1), '\\n', "
        "CASE i % 3 "
        "WHEN 0 THEN concat('The \"', split_part(l, ' ', 1), '\" idea\\n', l) "
        "WHEN 1 THEN concat('1. ', split_part(l, ' ', 1), '\\n- ', l) "
        "ELSE concat('**', split_part(l, ' ', 1), '** ', l) END)"
    )
    return docs.selectExpr(
        "doc_id",
        f"concat('intro', array_join(transform(split(text, '\\n'), (l, i) -> {section}), '')) AS text",
    )


def dialogue_markdown_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One markdown document per conversation: a section with its turns as quoted speech."""
    said = F.concat(F.lit('"'), F.translate("text", '"', "'"), F.lit('"'))
    piece = (F.when(F.col("role") == "user", F.concat(F.lit("**Human:** "), said))
             .when(F.col("turn") % 4 == 3, F.concat(F.lit("**TRON Response:** "), said))
             .when(F.col("role") == "assistant", F.concat(F.lit("**Assistant:** "), said)).otherwise(F.col("text")))
    turns = conversations(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.struct("turn", piece.alias("piece")).alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["piece"]), "\n")
    return turns.groupBy("doc_id").agg(F.concat(F.lit("intro\n## Conversation Patterns\n"), body).alias("text"))


def anchor_markdown_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One markdown document per ``documents`` row: sections whose passages hold the anchors of the special
    items, made of the text's first two lines."""
    lines = read(spark, sf_dir, "documents").select(
        "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("a"), F.split_part("text", F.lit("\n"), F.lit(2)).alias("b"))
    stop = F.when(F.col("doc_id") % 2 == 0, " STOP ").otherwise(" \U0001F6D1 ")
    return lines.select("doc_id", F.concat(
        F.lit("intro\n## Core Philosophy\nHere 42 means "), "a", F.lit("\n = FOR TWO  and "), "b", F.lit("\n\n"), "a",
        F.lit("\n## Team Framework\nfirst\n**TRON Contribution:** "), "a", F.lit("\n**AI Contribution:** "), "b", F.lit("\n\nend "), "a",
        F.lit("\n## Crisis Prevention Protocol\n"), "a", stop, "b", F.lit("\n\n"), "a").alias("text"))


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response history derived from ``events``, without vectors."""
    return read(spark, sf_dir, "events").selectExpr(
        "CAST(event_id AS STRING) AS id", "event_id AS seq", "CAST(user_id AS STRING) AS user_id",
        "concat(event_type, ' ', props) AS query",
        "concat('value ', CAST(CAST(value AS DECIMAL(18,2)) AS STRING)) AS response",
        "CASE WHEN event_id % 97 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE CAST(ts AS TIMESTAMP) END AS ts",
        "concat('m', CAST(event_id % 3 AS STRING)) AS model")


def history_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response history derived from ``events`` with the query embedding."""
    ev = read(spark, sf_dir, "events")
    emb = read(spark, sf_dir, "embeddings")
    return spark.sql(
        """
        WITH keyed AS (
          SELECT *, event_id % (SELECT count(*) FROM {emb}) AS vec_key FROM {ev}
        )
        SELECT CAST(k.event_id AS STRING) AS id,
               k.event_id AS seq,
               CAST(k.user_id AS STRING) AS user_id,
               concat(k.event_type, ' ', k.props) AS query,
               concat('value ', CAST(CAST(k.value AS DECIMAL(18,2)) AS STRING)) AS response,
               CASE WHEN k.event_id % 97 = 0 THEN CAST(NULL AS TIMESTAMP)
                    ELSE CAST(k.ts AS TIMESTAMP) END AS ts,
               concat('m', CAST(k.event_id % 3 AS STRING)) AS model,
               e.embedding AS embedding
        FROM keyed k LEFT JOIN {emb} e ON e.vec_id = k.vec_key
        """,
        ev=ev,
        emb=emb,
    )


def collection_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval collection: one document per embedding, text from ``documents``."""
    emb = read(spark, sf_dir, "embeddings")
    # the text side is the large one: never broadcast it (its size estimate counts a string as 20 bytes)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang").hint("merge")
    return emb.join(docs, emb.vec_id == docs.doc_id, "left").select(
        emb.vec_id.alias("doc_id"),
        F.coalesce(docs.text, F.lit("")).alias("text"),
        docs.source,
        docs.lang,
        emb.label,
        emb.embedding,
    )


def collection_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring side of the collection: ids, labels and vectors only (no text)."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding")


def collection_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload side of the collection (text and source), joined to the final hits only."""
    return read(spark, sf_dir, "documents").select("doc_id", "text", "source")


def queries_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries table: every embedding row is a question (FIXTURES.md §2.4)."""
    emb = read(spark, sf_dir, "embeddings")
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("text"), "lang").hint("merge")
    j = emb.join(docs, emb.vec_id == docs.doc_id, "left").select(
        emb.vec_id, emb.embedding, emb.label, F.coalesce(docs.text, F.lit("")).alias("text"), docs.lang
    )
    return j.selectExpr(
        "vec_id AS query_id",
        "CASE vec_id % 4 "
        "WHEN 0 THEN concat('\"', split_part(split_part(text, '\\n', 1), ' ', 1), '\" ', split_part(text, '\\n', 1)) "
        "WHEN 1 THEN concat(split_part(text, '\\n', 1), ' ', lower(split_part(split_part(text, '\\n', 1), ' ', 1)), '_', coalesce(lang, 'xx')) "
        "ELSE split_part(text, '\\n', 1) END AS text",
        "CAST(1 + vec_id % 6 AS INT) AS k",
        "CASE WHEN vec_id % 5 = 0 THEN 99 ELSE label END AS filter_label",
        "CAST(vec_id % 200 AS STRING) AS user_id",
        "embedding",
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages")

"""Registered jobs of the document-collection family (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import summaries as SM
from weft.operators import vectors as VX
from weft.operators import word_vectors as WV
from weft.plans.oracle_views import with_views
from weft.sources import tables
from weft.sources.io import scratch_path
from weft.sources.keyed import KeyedTable


def _coll(spark, sf):
    return tables.collection_view(spark, sf)


def _queries(spark, sf):
    return tables.queries_view(spark, sf)


def _out(hits, score="score"):
    return hits.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"),
                       F.round(score, 6).alias("score"))


def q_knn_cosine(spark, sf):
    return _out(VX.knn(_queries(spark, sf), _coll(spark, sf), k=4))


def q_knn_sqeuclidean(spark, sf):
    return _out(VX.knn(_queries(spark, sf), _coll(spark, sf), k=4, metric="sqeuclidean"))


def q_knn_filtered(spark, sf):
    return _out(VX.knn(_queries(spark, sf), _coll(spark, sf), k=6, k_col="k",
                       filters={"filter_label": "label"}))


def q_knn_threshold(spark, sf):
    return _out(VX.knn(_queries(spark, sf), _coll(spark, sf), k=10, min_score=0.2))


def q_rerank(spark, sf):
    q = _queries(spark, sf).withColumn("depth", F.least(F.col("k") * 3, F.lit(12)))
    coll = _coll(spark, sf)
    hits = VX.knn(q, coll, k=12, k_col="depth", filters={"filter_label": "label"})
    rr = VX.rerank(hits, q, coll, "k")
    return rr.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"),
                     F.round("direct_score", 6).alias("direct_score"))


def q_similar_docs(spark, sf):
    return _out(VX.similar_docs(_coll(spark, sf), k=5))


def q_training_query(spark, sf):
    return _out(VX.training_query(_queries(spark, sf), _coll(spark, sf), k=10, min_score=0.7,
                                  filters={"filter_label": "label"}))


def q_ann_knn(spark, sf):
    """Recall of the inverted file against exact search, over all queries."""
    q, docs = _queries(spark, sf), tables.collection_vectors(spark, sf)
    exact = VX.knn(q, docs, k=4).select("query_id", "doc_id")
    near = VX.ann_knn(q, docs, k=4).select("query_id", "doc_id", F.lit(1).alias("_hit"))
    both = exact.join(near, ["query_id", "doc_id"], "left").agg(F.count(F.lit(1)).alias("exact_hits"), F.count("_hit").alias("_found"))
    return both.select("exact_hits", (F.col("_found") >= 0.95 * F.col("exact_hits")).alias("recall_at_least_95"))


def q_collection_stats(spark, sf):
    docs = tables.read(spark, sf, "documents")
    return VX.collection_stats(docs, ("source", "lang")).select(
        "source", "lang", "documents", "chars")


def q_kept_stats(spark, sf):
    """B15 from summaries: the table arrives in two appends, the figures come from their summaries."""
    docs, path = tables.read(spark, sf, "documents"), scratch_path(spark, "summaries")
    for part in (F.col("lang") == "en", F.coalesce(F.col("lang") != "en", F.lit(True))):
        SM.append(docs.where(part).select("doc_id", "source", "lang", "text"), path, ["source", "lang"])
    sets = [SM.statistics(spark, path, by) for by in ([], ["source"], ["lang"])]
    out = [x.select(*[F.col(c) if c in x.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")], "documents", "chars") for x in sets]
    return out[0].unionByName(out[1]).unionByName(out[2])


def q_delete_docs(spark, sf):
    ids = tables.read(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return VX.delete_docs(_coll(spark, sf), ids).select("doc_id", "label")


def q_filter_meta(spark, sf):
    docs = tables.read(spark, sf, "documents").select(
        "doc_id", "lang", F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    return VX.filter_meta(docs, {"lang": "en", "source": "src3"}).select("doc_id")


def q_upsert_docs(spark, sf):
    base = _coll(spark, sf).select("doc_id", "text")
    # some keys come twice in the delta: the newer version counts
    delta = _quality_delta(spark, sf)
    return VX.upsert_docs(base, delta, version="version").select("doc_id", F.md5("text").alias("text_md5"))


def _quality_delta(spark, sf):
    """Rows of good documents in two or three versions."""
    docs = tables.read(spark, sf, "documents")
    lab = tables.read(spark, sf, "labels").where("quality = 1")
    delta = docs.join(lab, "doc_id").select("doc_id", F.explode(F.when(F.col("toxic") == 1, F.array(F.lit(2), F.lit(3))).otherwise(
        F.array(F.lit(2)))).alias("version"), "text")
    return delta.withColumn("text", F.concat("text", F.lit(" [v"), F.col("version").cast("string"), F.lit("]")))


def q_keyed_upsert(spark, sf):
    """B8 and B4 on a table in buckets: an upsert, a delete, and the merged rows."""
    table = KeyedTable.create(_coll(spark, sf).select("doc_id", "text"), scratch_path(spark, "keyed"), "doc_id", 8)
    table.upsert(_quality_delta(spark, sf).withColumnRenamed("version", "_order"), order="_order")
    table.delete(tables.read(spark, sf, "documents").where("lang = 'de'").select("doc_id"))
    return table.read().select("doc_id", F.md5("text").alias("text_md5"))


def q_with_doc_id(spark, sf):
    return VX.with_doc_id(tables.read(spark, sf, "documents"), ("text",)).select("doc_id", "doc_key")


def q_embed_documents(spark, sf):
    docs = tables.read(spark, sf, "documents").select("doc_id", "text")
    e = VX.hashed_embedder(64)(docs)
    return e.select("doc_id", F.size("embedding").alias("dim"))


def q_cooccurrences(spark, sf):
    """The counts under the word vectors."""
    return WV.cooccurrences(tables.read(spark, sf, "documents"))


def q_positive_pmi(spark, sf):
    counts, words = WV.numbered_cooccurrences(tables.read(spark, sf, "documents"))
    return WV.named(WV.positive_pmi(counts, stored=True), words).select("word", "context", F.round("value", 6).alias("value"))


def q_text_vectors(spark, sf):
    """Every document's vector from word vectors fitted on the whole table."""
    docs = tables.read(spark, sf, "documents").select("doc_id", "text")
    embed = WV.embedder(WV.word_vectors(docs, dim=32).checkpoint())
    return embed(docs).select("doc_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.round(x, 3)).alias("embedding"))


def _cos(a, b):
    return (f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / "
            f"(sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * "
            f"sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))")


def _sq(a, b):
    return f"list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _ranked(pairs_where: str, score: str, asc: bool, limit: str, extra_cols: str = "") -> str:
    order = "ASC" if asc else "DESC"
    return f""",
s AS (SELECT q.query_id, c.doc_id, {score} AS score {extra_cols} FROM queries q, collection c {pairs_where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) {order}, doc_id) AS rank FROM s)
SELECT query_id, doc_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM r WHERE rank <= {limit}"""


SQL = {
    "b6_knn_cosine": with_views(["queries", "collection"], _ranked("", _cos("q.embedding", "c.embedding"), False, "4")),
    "b7_knn_sqeuclidean": with_views(["queries", "collection"],
                                     _ranked("", _sq("q.embedding", "c.embedding"), True, "4")),
    "b9_knn_filtered": with_views(["queries", "collection"],
                                  _ranked("WHERE c.label = q.filter_label", _cos("q.embedding", "c.embedding"),
                                          False, "k", ", q.k AS k")),
    "b10_knn_threshold": with_views(["queries", "collection"],
                                    _ranked(f"WHERE {_cos('q.embedding', 'c.embedding')} >= 0.2",
                                            _cos("q.embedding", "c.embedding"), False, "10")),
    "b11_rerank": with_views(["queries", "collection"], f""",
s AS (SELECT q.query_id, c.doc_id, q.k, least(q.k * 3, 12) AS depth, {_cos('q.embedding', 'c.embedding')} AS score
      FROM queries q, collection c WHERE c.label = q.filter_label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
h AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM r WHERE rank <= depth),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(0.0, 1.0 - score), 9), rank) AS rr FROM h)
SELECT query_id, doc_id, CAST(CASE WHEN n > k THEN rr ELSE rank END AS BIGINT) AS rank,
       round(greatest(0.0, 1.0 - score), 6) AS direct_score
FROM rr WHERE n <= k OR rr <= k"""),
    "b13_similar_docs": with_views(["collection"], f""",
s AS (SELECT a.doc_id AS query_id, b.doc_id, {_cos('a.embedding', 'b.embedding')} AS score
      FROM collection a, collection b WHERE a.doc_id <> b.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM r WHERE rank <= 5"""),
    "b14_training_query": with_views(["queries", "collection"],
                                     _ranked(f"WHERE c.label = q.filter_label AND {_cos('q.embedding', 'c.embedding')} >= 0.7",
                                             _cos("q.embedding", "c.embedding"), False, "10")),
    "b15_collection_stats": """
        SELECT source, lang, count(*) AS documents, sum(length(text)) AS chars
        FROM documents GROUP BY GROUPING SETS ((), (source), (lang))""",
    "b4_delete_docs": with_views(["collection"], """
        SELECT doc_id, label FROM collection
        WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""),
    "b5_filter_meta": "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src3'",
    "b12_ann_knn": with_views(["queries", "collection"], """
        SELECT CAST(count(*) AS BIGINT) AS exact_hits, true AS recall_at_least_95 FROM
          queries, range(least(4, (SELECT count(*) FROM collection)))"""),
    "b8_upsert_docs": with_views(["collection"], """
        SELECT doc_id, md5(text) AS text_md5 FROM collection
        WHERE doc_id NOT IN (SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1)
        UNION ALL
        SELECT d.doc_id, md5(concat(d.text, CASE WHEN l.toxic = 1 THEN ' [v3]' ELSE ' [v2]' END))
        FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1"""),
    "b8_keyed_upsert": with_views(["collection"], """,
        u AS (SELECT doc_id, md5(text) AS text_md5 FROM collection
        WHERE doc_id NOT IN (SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1)
        UNION ALL
        SELECT d.doc_id, md5(concat(d.text, CASE WHEN l.toxic = 1 THEN ' [v3]' ELSE ' [v2]' END))
        FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1)
        SELECT doc_id, text_md5 FROM u WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de')"""),
    "b2_with_doc_id": "SELECT doc_id, md5(coalesce(text, '')) AS doc_key FROM documents",
}

SQL["b15_kept_stats"] = SQL["b15_collection_stats"]

_COOCCURRENCES = r"""
WITH t AS (SELECT row_number() OVER () AS r, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
           FROM documents),
tok AS (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS word FROM t),
vocab AS (SELECT word FROM tok GROUP BY word HAVING count(*) >= 10),
near AS (SELECT a.word AS x, b.word AS y FROM tok a JOIN tok b ON a.r = b.r AND b.i BETWEEN a.i + 1 AND a.i + 4
         WHERE a.word IN (FROM vocab) AND b.word IN (FROM vocab)),
c AS (SELECT word, context, count(*) AS n FROM (SELECT x AS word, y AS context FROM near UNION ALL SELECT y, x FROM near) GROUP BY ALL)"""
SQL["b3_cooccurrences"] = _COOCCURRENCES + " SELECT word, context, n FROM c"
SQL["b3_positive_pmi"] = _COOCCURRENCES + """,
s AS (SELECT word, sum(n) AS nw FROM c GROUP BY word),
v AS (SELECT c.word, c.context, ln(c.n * (SELECT CAST(sum(nw) AS DOUBLE) FROM s) / (a.nw * CAST(b.nw AS DOUBLE))) AS value
      FROM c JOIN s a ON a.word = c.word JOIN s b ON b.word = c.context)
SELECT word, context, round(value, 6) AS value FROM v WHERE value > 0"""

QUERIES = {
    "b2_with_doc_id": q_with_doc_id,
    "b3_embed_documents": q_embed_documents,
    "b3_cooccurrences": q_cooccurrences,
    "b3_positive_pmi": q_positive_pmi,
    "b3_text_vectors": q_text_vectors,
    "b4_delete_docs": q_delete_docs,
    "b5_filter_meta": q_filter_meta,
    "b6_knn_cosine": q_knn_cosine,
    "b7_knn_sqeuclidean": q_knn_sqeuclidean,
    "b8_upsert_docs": q_upsert_docs,
    "b8_keyed_upsert": q_keyed_upsert,
    "b9_knn_filtered": q_knn_filtered,
    "b10_knn_threshold": q_knn_threshold,
    "b11_rerank": q_rerank,
    "b12_ann_knn": q_ann_knn,
    "b13_similar_docs": q_similar_docs,
    "b14_training_query": q_training_query,
    "b15_collection_stats": q_collection_stats,
    "b15_kept_stats": q_kept_stats,
}


# ---------------------------------------------------------------- add, tag-filtered training query


def q_add_texts(spark, sf):
    docs = tables.read(spark, sf, "documents").select("doc_id", "text")
    added = VX.add_texts(docs, VX.hashed_embedder(64))
    return added.select("doc_id", "doc_key", F.size("metadata").cast("long").alias("n_meta"),
                        F.size("embedding").cast("long").alias("dim"))


def _tagged(spark, sf):
    q = tables.queries_view(spark, sf)
    lang = tables.read(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "lang")
    q = q.join(lang.hint("merge"), "query_id", "left").withColumn(
        "tags", F.when(F.col("lang").isNotNull(), F.array("lang")).otherwise(F.array().cast("array<string>")))
    c = tables.collection_view(spark, sf).withColumn(
        "tags", F.array(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))))
    return q, c


def q_training_query_tags(spark, sf):
    q, c = _tagged(spark, sf)
    return _out(VX.training_query(q, c, k=10, min_score=0.2, filters={"filter_label": "label"}, tags_col="tags"))


SQL.update({
    "b1_add_texts": "SELECT doc_id, md5(coalesce(text, '')) AS doc_key, CAST(0 AS BIGINT) AS n_meta, "
                    "CAST(64 AS BIGINT) AS dim FROM documents",
    "b14_training_query_tags": with_views(["queries", "collection"], f""",
        qt AS (SELECT q.*, CASE WHEN d.lang IS NOT NULL THEN [d.lang] ELSE []::VARCHAR[] END AS tags
               FROM queries q LEFT JOIN documents d ON d.doc_id = q.query_id),
        ct AS (SELECT c.*, [coalesce(c.lang, ''), coalesce(c.source, '')] AS tags FROM collection c),
        s AS (SELECT q.query_id, c.doc_id, {_cos('q.embedding', 'c.embedding')} AS score FROM qt q, ct c
              WHERE c.label = q.filter_label AND {_cos('q.embedding', 'c.embedding')} >= 0.2
                AND (len(q.tags) = 0 OR len(list_intersect(q.tags, c.tags)) > 0)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
        SELECT query_id, doc_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10"""),
})
QUERIES.update({
    "b1_add_texts": q_add_texts,
    "b14_training_query_tags": q_training_query_tags,
})

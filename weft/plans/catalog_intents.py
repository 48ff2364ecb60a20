"""Registered jobs of the design-note family (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import analyze as A
from weft.operators import intents as L
from weft.plans import catalog_analyze as CA
from weft.plans.oracle_views import with_views
from weft.sources import tables


def q_classify_documents(spark, sf):
    return L.classify_documents(tables.read(spark, sf, "documents")).select("doc_id", "doc_class")


def q_classify_by_automaton(spark, sf):
    return L.classify_by_automaton(tables.read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "doc_class")


def q_query_intent(spark, sf):
    return tables.queries_view(spark, sf).select("query_id", L.query_intent(F.col("text")).alias("intent"))


def q_routed_knn(spark, sf):
    h = L.routed_knn(tables.queries_view(spark, sf), tables.collection_view(spark, sf), 4)
    return h.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _principles(spark, sf):
    s = A.split_sections(tables.markdown_view(spark, sf))
    return s.select(F.explode(A.key_concepts(F.col("content"))).alias("principle")).distinct()


def q_principle_items(spark, sf):
    return L.principle_items(_principles(spark, sf)).select(
        "principle", F.col("template").cast("long").alias("template"), "input", "output", "context")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _score(col: str, inds: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower(coalesce({col}, '')), {_q(i)}) THEN 1 ELSE 0 END"
                            for i in inds) + ")"


def _class(col: str) -> str:
    c, r, g = _score(col, L.CODE_INDICATORS), _score(col, L.RUNTIME_INDICATORS), _score(col, L.GENERAL_INDICATORS)
    return f"(CASE WHEN {c} > greatest({r}, {g}) THEN 'code' WHEN {r} > {g} THEN 'runtime' ELSE 'general' END)"


def _intent(col: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce({col}, '')), {_q(w)})" for w in ws)
                     + f" THEN '{i}'" for i, ws in L.INTENT_WORDS)
    return f"(CASE {whens} ELSE 'general' END)"


_COS = ("list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / "
        "(sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * "
        "sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))))")
_ROUTE = ("(CASE intent " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.INTENT_TO_CLASS.items()) + " END)")


def _templates() -> str:
    rows = []
    for i, (inp, out, ctx) in enumerate(L.PRINCIPLE_TEMPLATES):
        rows.append(f"SELECT principle, CAST({i} AS BIGINT) AS template, "
                    f"replace({_q(inp)}, '{{p}}', principle) AS input, replace({_q(out)}, '{{p}}', principle) AS output, "
                    f"{_q(ctx)} AS context FROM principles")
    return " UNION ALL ".join(rows)


SQL = {
    "l1_classify_documents": f"SELECT doc_id, {_class('text')} AS doc_class FROM documents",
    "l2_query_intent": with_views(["queries"], f"SELECT query_id, {_intent('text')} AS intent FROM queries"),
    "l3_routed_knn": with_views(["queries", "collection"], f""",
        q AS (SELECT *, {_ROUTE} AS route_class FROM (SELECT *, {_intent('text')} AS intent FROM queries)),
        c AS (SELECT *, {_class('text')} AS doc_class FROM collection),
        s AS (SELECT q.query_id, c.doc_id, {_COS} AS score FROM q, c
              WHERE q.route_class IS NULL OR q.route_class = c.doc_class),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
        SELECT query_id, doc_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM r WHERE rank <= 4"""),
    "l4_principle_items": with_views(["markdown_docs"], CA._SECTIONS + f""",
        principles AS (SELECT DISTINCT unnest({CA._distinct_ordered(CA._CONCEPTS)}) AS principle FROM sections)
        {_templates()}"""),
}

SQL["l1_classify_by_automaton"] = SQL["l1_classify_documents"]

QUERIES = {
    "l1_classify_documents": q_classify_documents,
    "l1_classify_by_automaton": q_classify_by_automaton,
    "l2_query_intent": q_query_intent,
    "l3_routed_knn": q_routed_knn,
    "l4_principle_items": q_principle_items,
}

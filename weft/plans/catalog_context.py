"""Registered jobs of the history (D) and retrieval-context (C) families."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import context as C
from weft.operators import history as H
from weft.plans.oracle_views import with_views
from weft.plans.sqlfrag import WS
from weft.sources import tables


def _hist(spark, sf):
    return tables.history_view(spark, sf)


def _queries(spark, sf):
    return tables.queries_view(spark, sf)


def _coll(spark, sf):
    return tables.collection_view(spark, sf)


def q_similar_responses(spark, sf):
    h = H.similar_responses(_queries(spark, sf), _hist(spark, sf), 5, 0.7, {"user_id": "user_id"})
    return h.select("query_id", "seq", F.col("rank").cast("long").alias("rank"),
                    F.round("similarity", 6).alias("similarity"))


def q_similar_fallback(spark, sf):
    h = H.similar_responses(_queries(spark, sf), _hist(spark, sf), 5, 0.7, {"user_id": "user_id"},
                            fallback_unfiltered=True)
    return h.select("query_id", "seq", F.col("rank").cast("long").alias("rank"),
                    F.round("similarity", 6).alias("similarity"))


def q_similar_strict(spark, sf):
    h = H.similar_responses(_queries(spark, sf), _hist(spark, sf), 5, 0.3, mode="strict")
    return h.select("query_id", "seq", F.col("rank").cast("long").alias("rank"),
                    F.round("similarity", 6).alias("similarity"))


def _rows(spark, sf):
    return tables.history_rows(spark, sf)


def q_recent_responses(spark, sf):
    return H.recent_responses(_rows(spark, sf), "user_id", 10).select(
        "user_id", "id", F.col("position").cast("long").alias("position"))


def q_user_history(spark, sf):
    return H.user_history(_rows(spark, sf), 20).select("user_id", "id", F.col("position").cast("long").alias("position"))


def q_expire_history(spark, sf):
    h = _rows(spark, sf)
    now = h.agg(F.max("ts")).first()[0]
    kept, _ = H.expire_history(h, 14, F.lit(now))
    return kept.select("id")


def q_expire_count(spark, sf):
    h = _rows(spark, sf)
    now = h.agg(F.max("ts")).first()[0]
    _, removed = H.expire_history(h, 14, F.lit(now))
    return removed


def q_clear_history(spark, sf):
    # the users with an error event on the last day clear their history
    ev = tables.read(spark, sf, "events")
    last = ev.agg(F.max(F.to_date("ts")).alias("day"))
    users = ev.where("event_type = 'error'").withColumn("day", F.to_date("ts")).join(last, "day").select(
        F.col("user_id").cast("string").alias("user_id"))
    return H.clear_history(_rows(spark, sf), users).select("id")


def q_select_history(spark, sf):
    return H.select_history(_queries(spark, sf), _rows(spark, sf)).select(
        "query_id", "id", F.col("position").cast("long").alias("position"))


def q_keyword_search(spark, sf):
    return H.keyword_search(_queries(spark, sf), _rows(spark, sf), 5, "user_id").select(
        "query_id", "seq", F.col("rank").cast("long").alias("rank"))


def q_dialogue_window(spark, sf):
    conv = tables.conversations(spark, sf)
    msgs = conv.select(F.col("conv_id").cast("string").alias("user_id"), "turn", "role",
                       F.col("text").alias("content"))
    d = H.dialogue_window(_rows(spark, sf), msgs, 20, 20)
    return d.select("user_id", F.col("position").cast("long").alias("position"), "role",
                    F.md5("content").alias("content_md5"))


def q_dedupe_history(spark, sf):
    # every third row was saved twice, the second time under a later number
    h = _rows(spark, sf)
    again = h.where("seq % 3 = 0").withColumn("id", F.concat("id", F.lit("-again"))).withColumn("seq", F.col("seq") + 1_000_000_000)
    return H.dedupe_history(h.unionByName(again), "1 day").select("id")


def q_special_terms(spark, sf):
    q = _queries(spark, sf)
    return q.select("query_id", F.posexplode(C.special_terms(F.col("text"))).alias("pos", "term")).select(
        "query_id", F.col("pos").cast("long").alias("pos"), "term")


def _context(spark, sf):
    return C.assemble_context(_queries(spark, sf), tables.collection_vectors(spark, sf), _rows(spark, sf),
                              filters={"filter_label": "label"}, payload=tables.collection_payload(spark, sf))


def q_assemble_context(spark, sf):
    c = _context(spark, sf)
    return c.select("query_id", "prompt", "document_count", "history_count",
                    F.array_join(F.transform("retrieved_documents", lambda d: F.concat_ws(":", d["doc_id"].cast("string"), F.md5(F.coalesce(d["text"], F.lit(""))))), ",").alias("retrieved"),
                    F.array_join(F.transform("history_items", lambda h: h["id"]), ",").alias("history_ids"))


def _lookup_embedder(spark, sf):
    """A stand-in model that SQL can follow: the stored vector whose id is the text's length (modulo
    their number); texts of every third length have no vector, so their search finds nothing."""
    vectors = tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias("_v"), "embedding")
    n = vectors.count()

    def embed(df, column, out):
        size = F.length(column)
        keyed = df.withColumn("_v", F.when(size % 3 != 0, (size % n).cast("long")))
        return keyed.join(vectors.withColumnRenamed("embedding", out), "_v", "left").drop("_v")

    return embed


def q_term_fallback(spark, sf):
    q = _queries(spark, sf).drop("embedding")
    hits = C.term_fallback(q, tables.collection_vectors(spark, sf), _lookup_embedder(spark, sf), {"filter_label": "label"})
    return hits.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


def q_history_fallback(spark, sf):
    q = _queries(spark, sf)
    items = H.select_history(q, _rows(spark, sf))
    hits = C.history_fallback(q.drop("embedding"), items, tables.collection_vectors(spark, sf), _lookup_embedder(spark, sf), {"filter_label": "label"})
    return hits.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


def q_token_usage(spark, sf):
    conv = tables.conversations(spark, sf)
    pairs = conv.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("completion"))
    prompts = C.transcript_prompt(conv)
    df = prompts.join(pairs, "conv_id")
    u = C.token_usage(df, "prompt", "completion")
    return u.groupBy("conv_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"),
                                    F.sum("completion_tokens").alias("completion_tokens"),
                                    F.sum("total_tokens").alias("total_tokens"))


def q_transcript_prompt(spark, sf):
    return C.transcript_prompt(tables.conversations(spark, sf)).select("conv_id", F.md5("prompt").alias("prompt_md5"),
                                                                       F.length("prompt").alias("prompt_length"))


def q_cut_at_stops(spark, sf):
    conv = tables.conversations(spark, sf)
    return conv.select("conv_id", "turn", C.cut_at_stops(F.col("text"), ["\n", ". "]).alias("cut"))


def q_generate(spark, sf):
    ctx = _context(spark, sf)

    def last_line(prompts):
        return [p.rstrip().split("\n")[-1] for p in prompts]

    return C.generate(ctx.select("query_id", "prompt"), last_line, stops=["ANSWER"]).select("query_id", "completion")


# ---------------------------------------------------------------- DuckDB side


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_COS = ("list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(h.embedding AS DOUBLE[])) / "
        "(sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * "
        "sqrt(list_dot_product(CAST(h.embedding AS DOUBLE[]), CAST(h.embedding AS DOUBLE[]))))")

_SIM = f""",
s AS (SELECT q.query_id, h.seq, {_COS} AS score FROM queries q JOIN history h ON h.user_id = q.user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seq) AS rank FROM s),
found AS (SELECT * FROM r WHERE rank <= 5 AND score >= 0.7)
"""

_EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"

_CONTEXT = f""",
q AS (SELECT *, coalesce(k, 4) AS kk, least(coalesce(k, 4) * 3, 12) AS depth FROM queries),
s AS (SELECT q.query_id, c.doc_id,
             list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) /
             (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) *
              sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))) AS score
      FROM q JOIN collection c ON c.label = q.filter_label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
h AS (SELECT r.*, q.kk, count(*) OVER (PARTITION BY r.query_id) AS n
      FROM r JOIN q USING (query_id) WHERE r.rank <= q.depth),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(0.0, 1.0 - score), 9), rank) AS rr
       FROM h),
-- A first search comes back empty only when no document passes the query's filter;
-- the term and history fallbacks search with the same filter, so they add no rows.
hits AS (SELECT query_id, doc_id, CASE WHEN n > kk THEN rr ELSE rank END AS pos FROM rr WHERE n <= kk OR rr <= kk),
docs_r AS (
  SELECT hits.query_id,
         string_agg('Document ' || CAST(hits.pos AS VARCHAR)
                    || CASE WHEN c.source IS NOT NULL AND c.source <> '' THEN ' (Source: ' || c.source || ')' ELSE '' END
                    || ':' || chr(10) || coalesce(c.text, '') || chr(10), chr(10) ORDER BY hits.pos) AS documents_text,
         string_agg(CAST(hits.doc_id AS VARCHAR) || ':' || md5(coalesce(c.text, '')), ',' ORDER BY hits.pos) AS retrieved,
         count(*) AS document_count
  FROM hits JOIN collection c USING (doc_id) GROUP BY hits.query_id),
tl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM history) WHERE rn <= 10),
-- a user without timeline rows has no history rows, so the user-filtered similarity fallback is empty
hi AS (SELECT q.query_id, tl.* FROM q JOIN tl ON tl.user_id = q.user_id WHERE q.user_id IS NOT NULL AND q.user_id <> ''),
hist_r AS (
  SELECT query_id,
         {_lit(C.HISTORY_HEADING)} || chr(10) ||
         string_agg(CASE WHEN ts IS NOT NULL AND ts <> {_EPOCH} THEN 'Date: ' || strftime(ts, '%Y-%m-%d %H:%M') || chr(10) ELSE '' END
                    || 'User: ' || coalesce(query, '') || chr(10) || 'Assistant: ' || coalesce(response, '') || chr(10),
                    chr(10) ORDER BY coalesce(ts, {_EPOCH}), seq) AS history_text,
         string_agg(id, ',' ORDER BY coalesce(ts, {_EPOCH}), seq) AS history_ids,
         count(*) AS history_count
  FROM hi GROUP BY query_id),
ctx AS (
  SELECT q.query_id, q.text, coalesce(d.document_count, 0) AS document_count,
         coalesce(d.documents_text, {_lit(C.NO_DOCUMENTS)}) AS documents_text,
         coalesce(hr.history_text, '') AS history_text, coalesce(hr.history_count, 0) AS history_count,
         coalesce(d.retrieved, '') AS retrieved, coalesce(hr.history_ids, '') AS history_ids
  FROM q LEFT JOIN docs_r d USING (query_id) LEFT JOIN hist_r hr USING (query_id))
"""

_PROMPT = f"""CASE WHEN document_count > 0 THEN
  {_lit(C.RAG_SYSTEM + chr(10) + chr(10) + C.RAG_PREAMBLE + chr(10) + chr(10) + 'DOCUMENTS:' + chr(10))} || documents_text
  || {_lit(chr(10) + chr(10) + 'PREVIOUS CONVERSATION:' + chr(10))} || history_text
  || {_lit(chr(10) + chr(10) + 'USER QUESTION: ')} || text || {_lit(chr(10) + chr(10) + C.RAG_INSTRUCTIONS)}
ELSE
  {_lit(C.GENERAL_SYSTEM + chr(10) + chr(10) + C.GENERAL_PREAMBLE + chr(10) + chr(10) + 'PREVIOUS CONVERSATION:' + chr(10))}
  || history_text || {_lit(chr(10) + chr(10) + 'USER QUESTION: ')} || text
  || {_lit(chr(10) + chr(10) + C.GENERAL_INSTRUCTIONS)}
END"""

_TRANSCRIPT = """
  SELECT a.conv_id,
         coalesce(string_agg(CASE role WHEN 'system' THEN 'System: ' WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END
                             || coalesce(text, ''), chr(10) ORDER BY turn)
                  FILTER (WHERE role IN ('system', 'user', 'assistant')), '')
         || CASE WHEN count(*) FILTER (WHERE role IN ('system', 'user', 'assistant')) > 0 THEN chr(10) ELSE '' END
         || 'Assistant: ' AS prompt
  FROM conversations a GROUP BY a.conv_id"""

# Searches of texts x(query_id, pos, t): the vector of the stand-in model, filtered like the query.
_LOOKUP_SEARCH = """
        v AS (SELECT x.query_id, x.pos, q.filter_label, coalesce(q.k, 4) AS kk, e.embedding FROM x JOIN queries q USING (query_id)
              JOIN embeddings e ON length(t) % 3 <> 0 AND e.vec_id = length(t) % (SELECT count(*) FROM embeddings)),
        s AS (SELECT q.query_id, q.pos, q.kk, h.doc_id, """ + _COS + """ AS score FROM v q JOIN collection h ON h.label = q.filter_label),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
        SELECT query_id, doc_id, CAST(rank AS BIGINT) AS rank FROM r
        WHERE rank <= kk AND pos = (SELECT min(pos) FROM r r2 WHERE r2.query_id = r.query_id)"""

_WORDS = f"list_filter(regexp_split_to_array(x, '[{WS}]+'), lambda t: t <> '')"


def _wc(col):
    return "len(" + _WORDS.replace("(x,", f"(coalesce({col}, ''),") + ")"


SQL = {
    "d2_similar_responses": with_views(["queries", "history"], _SIM + """
        SELECT query_id, seq, CAST(rank AS BIGINT) AS rank, round(score, 6) AS similarity FROM found"""),
    "d3_similar_fallback": with_views(["queries", "history"], _SIM + f""",
        missed AS (SELECT * FROM queries WHERE query_id NOT IN (SELECT query_id FROM found)),
        s2 AS (SELECT q.query_id, h.seq, {_COS} AS score FROM missed q, history h),
        r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seq) AS rank FROM s2),
        f2 AS (SELECT * FROM r2 WHERE rank <= 5 AND score >= 0.7),
        f2r AS (SELECT query_id, seq, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM f2)
        SELECT query_id, seq, CAST(rank AS BIGINT) AS rank, round(score, 6) AS similarity FROM found
        UNION ALL
        SELECT query_id, seq, CAST(rank AS BIGINT), round(score, 6) FROM f2r"""),
    "d4_similar_strict": with_views(["queries", "history"], f""",
        s AS (SELECT q.query_id, h.seq, {_COS} AS score FROM queries q, history h WHERE {_COS} >= 0.3),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seq) AS rank FROM s)
        SELECT query_id, seq, CAST(rank AS BIGINT) AS rank, round(score, 6) AS similarity FROM r WHERE rank <= 5"""),
    "d5_recent_responses": with_views(["history"], f""",
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM history) WHERE rn <= 10)
        SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(ts, {_EPOCH}) DESC, seq) AS position
        FROM f"""),
    "d6_user_history": with_views(["history"], f""",
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM history) WHERE rn <= 20)
        SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(ts, {_EPOCH}), seq) AS position
        FROM f"""),
    "d7_expire_history": with_views(["history"], f"""
        SELECT id FROM history
        WHERE coalesce(ts, {_EPOCH}) >= (SELECT max(ts) FROM history) - INTERVAL 14 DAY"""),
    "d7_expire_count": with_views(["history"], f"""
        SELECT CAST(count(*) FILTER (WHERE coalesce(ts, {_EPOCH}) < (SELECT max(ts) FROM history) - INTERVAL 14 DAY) AS BIGINT)
               AS removed FROM history"""),
    "d8_clear_history": with_views(["history"], """
        SELECT id FROM history WHERE user_id IS NULL OR user_id NOT IN
          (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'error' AND user_id IS NOT NULL
             AND CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events))"""),
    "d9_select_history": with_views(["queries", "history"], f""",
        tl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM history) WHERE rn <= 10)
        SELECT q.query_id, tl.id,
               row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(tl.ts, {_EPOCH}), tl.seq) AS position
        FROM queries q JOIN tl ON tl.user_id = q.user_id WHERE q.user_id IS NOT NULL AND q.user_id <> ''"""),
    "d10_keyword_search": with_views(["queries", "history"], f""",
        m AS (SELECT q.query_id, h.seq FROM queries q JOIN history h ON h.user_id = q.user_id
              WHERE len(list_filter(regexp_split_to_array(lower(q.text), '[{WS}]+'),
                                    lambda w: w <> '' AND contains(lower(h.query), w))) > 0)
        SELECT query_id, seq, rank FROM (
          SELECT query_id, seq, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS rank FROM m) WHERE rank <= 5"""),
    "d11_dialogue_window": with_views(["history"], f""",
        tl AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(ts, {_EPOCH}), seq) AS ord
               FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM history) WHERE rn <= 20),
        allm AS (
          SELECT user_id, 0 AS part, ord, 0 AS sub, 'user' AS role, query AS content FROM tl
          UNION ALL SELECT user_id, 0, ord, 1, 'assistant', response FROM tl
          UNION ALL SELECT CAST(conv_id AS VARCHAR), 1, turn, 0, role, text FROM conversations),
        b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY part DESC, ord DESC, sub DESC) AS back FROM allm),
        l AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS cnt FROM b WHERE back <= 20)
        SELECT user_id, cnt - back + 1 AS position, role, md5(content) AS content_md5 FROM l"""),
    "d12_dedupe_history": with_views(["history"], f"""
        , h AS (SELECT id, seq, user_id, query, response, ts FROM history
                UNION ALL SELECT id || '-again', seq + 1000000000, user_id, query, response, ts FROM history WHERE seq % 3 = 0)
        SELECT arg_min(id, seq) AS id FROM h
        GROUP BY user_id, query, response, time_bucket(INTERVAL 1 DAY, coalesce(ts, {_EPOCH}))"""),
    "c2_special_terms": with_views(["queries"], r"""
        , m AS (SELECT query_id, regexp_extract_all(text, '"([^"]+)"|''([^'']+)''|([\p{L}\p{N}_]+_[\p{L}\p{N}_]+)', 0) AS ms FROM queries)
        SELECT query_id, CAST(pos - 1 AS BIGINT) AS pos,
               CASE WHEN starts_with(mt, '"') OR starts_with(mt, chr(39)) THEN substr(mt, 2, length(mt) - 2)
                    ELSE mt END AS term
        FROM (SELECT query_id, generate_subscripts(ms, 1) AS pos, unnest(ms) AS mt FROM m)"""),
    "c3_term_fallback": with_views(["queries", "collection"], r"""
        , m AS (SELECT query_id, regexp_extract_all(text, '"([^"]+)"|''([^'']+)''|([\p{L}\p{N}_]+_[\p{L}\p{N}_]+)', 0) AS ms FROM queries),
        x AS (SELECT query_id, pos - 1 AS pos, CASE WHEN starts_with(mt, '"') OR starts_with(mt, chr(39)) THEN substr(mt, 2, length(mt) - 2) ELSE mt END AS t
              FROM (SELECT query_id, generate_subscripts(ms, 1) AS pos, unnest(ms) AS mt FROM m)),""" + _LOOKUP_SEARCH),
    "c4_history_fallback": with_views(["queries", "collection", "history"], f"""
        , tl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM history) WHERE rn <= 10),
        hi AS (SELECT q.query_id, q.text, tl.query, row_number() OVER (PARTITION BY q.query_id
                 ORDER BY coalesce(tl.ts, {_EPOCH}) DESC, tl.seq) AS back
               FROM queries q JOIN tl ON tl.user_id = q.user_id),
        x AS (SELECT query_id, 0 AS pos, query || ' ' || text AS t FROM hi WHERE back = 1),""" + _LOOKUP_SEARCH),
    "c9_assemble_context": with_views(["queries", "collection", "history"], _CONTEXT + f"""
        SELECT query_id, {_PROMPT} AS prompt, CAST(document_count AS BIGINT) AS document_count,
               CAST(history_count AS BIGINT) AS history_count, retrieved, history_ids FROM ctx"""),
    "c13_generate": with_views(["queries", "collection", "history"], _CONTEXT + f"""
        , last AS (SELECT query_id, list_extract(string_split(rtrim({_PROMPT}, ' ' || chr(9) || chr(10) || chr(13)), chr(10)), -1) AS l FROM ctx)
        SELECT query_id, split_part(l, 'ANSWER', 1) AS completion FROM last"""),
    "c10_token_usage": f"""
        WITH p AS ({_TRANSCRIPT}),
        a AS (SELECT conv_id, text AS completion FROM conversations WHERE role = 'assistant')
        SELECT conv_id, sum({_wc('prompt')}) AS prompt_tokens, sum({_wc('completion')}) AS completion_tokens,
               sum({_wc('prompt')} + {_wc('completion')}) AS total_tokens
        FROM p JOIN a USING (conv_id) GROUP BY conv_id""",
    "c11_transcript_prompt": f"""
        WITH p AS ({_TRANSCRIPT})
        SELECT conv_id, md5(prompt) AS prompt_md5, length(prompt) AS prompt_length FROM p""",
    "c12_cut_at_stops": """
        SELECT conv_id, turn, split_part(split_part(text, chr(10), 1), '. ', 1) AS cut FROM conversations""",
}

QUERIES = {
    "c2_special_terms": q_special_terms,
    "c9_assemble_context": q_assemble_context,
    "c10_token_usage": q_token_usage,
    "c11_transcript_prompt": q_transcript_prompt,
    "c12_cut_at_stops": q_cut_at_stops,
    "c13_generate": q_generate,
    "d2_similar_responses": q_similar_responses,
    "d3_similar_fallback": q_similar_fallback,
    "d4_similar_strict": q_similar_strict,
    "d5_recent_responses": q_recent_responses,
    "d6_user_history": q_user_history,
    "d7_expire_history": q_expire_history,
    "d7_expire_count": q_expire_count,
    "c3_term_fallback": q_term_fallback,
    "c4_history_fallback": q_history_fallback,
    "d8_clear_history": q_clear_history,
    "d9_select_history": q_select_history,
    "d10_keyword_search": q_keyword_search,
    "d11_dialogue_window": q_dialogue_window,
    "d12_dedupe_history": q_dedupe_history,
}


# ---------------------------------------------------------------- forced documents, save, append


def q_forced_documents(spark, sf):
    labels = tables.read(spark, sf, "labels").select("doc_id")
    forced = tables.collection_vectors(spark, sf).join(labels, "doc_id", "left_semi").select(
        F.col("doc_id").alias("query_id"), "doc_id", F.lit(1).alias("rank"))
    c = C.assemble_context(_queries(spark, sf), tables.collection_vectors(spark, sf), _rows(spark, sf),
                           filters={"filter_label": "label"}, payload=tables.collection_payload(spark, sf),
                           forced=forced)
    return c.select("query_id", "document_count", F.md5("prompt").alias("prompt_md5"))


def q_save_responses(spark, sf):
    h = _hist(spark, sf)
    now = h.agg(F.max("ts")).first()[0]
    return H.save_responses(h.drop("embedding"), now=F.lit(now)).select(
        "id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def q_append_history(spark, sf):
    from weft.sources.io import scratch_path

    path = scratch_path(spark, "history-table")
    h = _hist(spark, sf).drop("embedding")
    H.append(h, path)
    H.append(h, path)
    back = spark.read.parquet(path)
    return back.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"))


_FORCED = _CONTEXT.replace("docs_r AS (", """forced AS (SELECT e.vec_id AS query_id, e.vec_id AS doc_id, 1 AS pos
            FROM embeddings e WHERE e.vec_id IN (SELECT doc_id FROM labels)),
hitsf AS (SELECT query_id, doc_id, pos FROM forced
          UNION ALL SELECT query_id, doc_id, pos FROM hits WHERE query_id NOT IN (SELECT query_id FROM forced)),
docs_r AS (""", 1).replace("FROM hits JOIN collection c USING (doc_id) GROUP BY hits.query_id",
                           "FROM hitsf AS hits JOIN collection c USING (doc_id) GROUP BY hits.query_id", 1)

SQL.update({
    "c5_forced_documents": with_views(["queries", "collection", "history"], _FORCED + f"""
        SELECT query_id, CAST(document_count AS BIGINT) AS document_count, md5({_PROMPT}) AS prompt_md5 FROM ctx"""),
    "d1_save_responses": with_views(["history"], """
        SELECT id, strftime(coalesce(ts, (SELECT max(ts) FROM history)), '%Y-%m-%d %H:%M:%S') AS ts FROM history"""),
    "a13_append_history": with_views(["history"], f"""
        SELECT strftime(CAST(coalesce(ts, {_EPOCH}) AS DATE), '%Y-%m-%d') AS day, 2 * count(*) AS rows,
               count(DISTINCT id) AS ids FROM history GROUP BY 1"""),
})
QUERIES.update({
    "c5_forced_documents": q_forced_documents,
    "d1_save_responses": q_save_responses,
    "a13_append_history": q_append_history,
})


# ---------------------------------------------------------------- single steps of the assembly


def q_fetch_depth(spark, sf):
    q = _queries(spark, sf)
    return q.select("query_id", F.col("k").cast("long").alias("k"), C.fetch_depth(F.col("k")).cast("long").alias("depth"))


def q_render_documents(spark, sf):
    from weft.operators import vectors as VX

    hits = VX.knn(_queries(spark, sf), tables.collection_vectors(spark, sf), k=6, k_col="k",
                  filters={"filter_label": "label"})
    r = C.render_documents(hits.join(tables.collection_payload(spark, sf), "doc_id", "left"))
    return r.select("query_id", F.md5("documents_text").alias("documents_md5"),
                    F.col("document_count").cast("long").alias("document_count"))


def q_render_history(spark, sf):
    r = C.render_history(H.select_history(_queries(spark, sf), _rows(spark, sf)))
    return r.select("query_id", F.md5("history_text").alias("history_md5"),
                    F.col("history_count").cast("long").alias("history_count"))


SQL.update({
    "c1_fetch_depth": with_views(["queries"], """
        SELECT query_id, CAST(k AS BIGINT) AS k, CAST(least(k * 3, 12) AS BIGINT) AS depth FROM queries"""),
    "c6_render_documents": with_views(["queries", "collection"], f""",
        s AS (SELECT q.query_id, q.k, c.doc_id, c.text, c.source,
                     {_COS.replace('h.embedding', 'c.embedding')} AS score
              FROM queries q JOIN collection c ON c.label = q.filter_label),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
        SELECT query_id,
               md5(string_agg('Document ' || CAST(rank AS VARCHAR)
                   || CASE WHEN source IS NOT NULL AND source <> '' THEN ' (Source: ' || source || ')' ELSE '' END
                   || ':' || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY rank)) AS documents_md5,
               count(*) AS document_count
        FROM r WHERE rank <= k GROUP BY query_id"""),
    "c7_render_history": with_views(["queries", "history"], ",\n" + _CONTEXT[_CONTEXT.index("tl AS ("):
                                                                       _CONTEXT.index("ctx AS (")].rstrip().rstrip(",")
                                    .replace("FROM q JOIN tl", "FROM queries q JOIN tl") + """
        SELECT query_id, md5(history_text) AS history_md5, CAST(history_count AS BIGINT) AS history_count
        FROM hist_r"""),
})
QUERIES.update({
    "c1_fetch_depth": q_fetch_depth,
    "c6_render_documents": q_render_documents,
    "c7_render_history": q_render_history,
})

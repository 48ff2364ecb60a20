"""Retrieval-context assembly for a whole queries table.

``assemble_context`` is the batch form of one retrieval request per query row:
over-fetch search, term and history fallbacks (run only over the misses),
history selection, re-rank, rendering of documents and history, and the
prompt. The queries table is broadcast (size-checked) into the kNN kernel;
the collection and the history are scanned, never shuffled whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.text import cut_at_stops, present, words
from weft.operators import history as H
from weft.operators import vectors as VX

# Prompt texts of the retrieval answer (grounded and general form).
RAG_SYSTEM = ("You are an AI assistant that answers questions based on the provided DOCUMENTS and "
              "conversation history.")
GENERAL_SYSTEM = "You are a helpful AI assistant that provides accurate and relevant information."
RAG_INSTRUCTIONS = """CRITICAL INSTRUCTIONS:
1. If the DOCUMENTS section contains information to answer the question, quote EXACT phrases, terms, and names from the documents.
2. Never paraphrase, replace, or alter specific terms and names from the documents. Use VERBATIM any proper nouns, names, or technical terms.
3. If the documents mention a system by a specific name like "ai_xyz123", always repeat that EXACT name in your answer, never remove underscores or change the format.
4. If the documents list components, features, or steps, reproduce them EXACTLY as they appear, with the SAME numbering, wording, and order.
5. If the DOCUMENTS section does NOT contain relevant information, say "I don't have specific information about this topic in my knowledge base."
6. Avoid making up information not explicitly stated in the documents.
7. If the documents contain contradictions or inaccuracies, report those exactly as given without correction.
8. For follow-up questions, link to information from previous exchanges if relevant.

ANSWER:"""
GENERAL_INSTRUCTIONS = """INSTRUCTIONS:
1. Provide a helpful and accurate response based on your general knowledge.
2. If the question requires very specific or technical information that you're uncertain about, acknowledge the limitations.
3. For follow-up questions, consider the context from previous exchanges if relevant.

ANSWER:"""
RAG_PREAMBLE = "IMPORTANT: You must ONLY use information from these DOCUMENTS to answer the question."
GENERAL_PREAMBLE = ("I don't have specific documents in my knowledge base about this topic, but I'll try to "
                    "help based on my general knowledge.")
NO_DOCUMENTS = "No relevant documents found."
HISTORY_HEADING = "PREVIOUS QUESTIONS AND ANSWERS:"
DEFAULT_K = 4
MAX_DEPTH = 12
DEFAULT_TEMPERATURE = 0.7
DEFAULT_MAX_TOKENS = 100

# C2 pattern: double-quoted, single-quoted, or word_word term, in order of appearance.
SPECIAL_TERM_PATTERN = r"(?U)\"([^\"]+)\"|'([^']+)'|(\w+_\w+)"


def fetch_depth(k: Column) -> Column:
    """Over-fetch depth ``min(3k, 12)``."""
    return F.least(k * 3, F.lit(MAX_DEPTH))


def special_terms(c: Column) -> Column:
    """The special terms of a query, in order (first non-empty group of each match)."""
    g1 = F.regexp_extract_all(c, F.lit(SPECIAL_TERM_PATTERN), 1)
    g2 = F.regexp_extract_all(c, F.lit(SPECIAL_TERM_PATTERN), 2)
    g3 = F.regexp_extract_all(c, F.lit(SPECIAL_TERM_PATTERN), 3)
    z = F.arrays_zip(g1.alias("a"), g2.alias("b"), g3.alias("c"))
    picked = F.transform(z, lambda t: F.coalesce(F.nullif(t["a"], F.lit("")), F.nullif(t["b"], F.lit("")),
                                                 F.nullif(t["c"], F.lit(""))))
    return F.filter(picked, lambda t: t.isNotNull())


def render_documents(hits: DataFrame, key: str = "query_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``Document {i}{ (Source: s)}:\\n{text}\\n`` joined by newline, in rank order; ``keep`` names hit
    columns that ``retrieved_documents`` lists in the same order (at most k per query)."""
    piece = F.concat(F.lit("Document "), F.col("rank").cast("string"),
                     F.when(present("source"), F.concat(F.lit(" (Source: "), F.col("source"), F.lit(")")))
                     .otherwise(F.lit("")),
                     F.lit(":\n"), F.coalesce(F.col("text"), F.lit("")), F.lit("\n"))
    g = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), piece.alias("p"), *keep))).alias("_d"),
                              F.count(F.lit(1)).alias("document_count"))
    listed = [F.transform("_d", lambda x: F.struct(*[x[c].alias(c) for c in keep])).alias("retrieved_documents")] if keep else []
    return g.select(key, F.array_join(F.transform("_d", lambda x: x["p"]), "\n").alias("documents_text"),
                    "document_count", *listed)


def render_history(items: DataFrame, key: str = "query_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Heading, then per item an optional ``Date:`` line, ``User:``, ``Assistant:`` and a blank line."""
    date_line = F.when(F.col("ts").isNotNull() & (F.col("ts") != H.epoch()),
                       F.concat(F.lit("Date: "), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("\n")))
    piece = F.concat(F.coalesce(date_line, F.lit("")), F.lit("User: "), F.coalesce("query", F.lit("")),
                     F.lit("\nAssistant: "), F.coalesce("response", F.lit("")), F.lit("\n"))
    g = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", piece.alias("p"), *keep))).alias("_h"),
                               F.count(F.lit(1)).alias("history_count"))
    listed = [F.transform("_h", lambda x: F.struct(*[x[c].alias(c) for c in keep])).alias("history_items")] if keep else []
    return g.select(key, F.concat(F.lit(HISTORY_HEADING + "\n"),
                                  F.array_join(F.transform("_h", lambda x: x["p"]), "\n")).alias("history_text"),
                    "history_count", *listed)


def render_prompt(document_count: Column, documents_text: Column, history_text: Column, query: Column) -> Column:
    """Grounded template with at least one document, general template otherwise."""
    grounded = F.concat(F.lit(RAG_SYSTEM + "\n\n" + RAG_PREAMBLE + "\n\nDOCUMENTS:\n"), documents_text,
                        F.lit("\n\nPREVIOUS CONVERSATION:\n"), history_text, F.lit("\n\nUSER QUESTION: "), query,
                        F.lit("\n\n" + RAG_INSTRUCTIONS))
    general = F.concat(F.lit(GENERAL_SYSTEM + "\n\n" + GENERAL_PREAMBLE + "\n\nPREVIOUS CONVERSATION:\n"),
                       history_text, F.lit("\n\nUSER QUESTION: "), query, F.lit("\n\n" + GENERAL_INSTRUCTIONS))
    return F.when(document_count > 0, grounded).otherwise(general)


def _eligible(misses: DataFrame, docs: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Misses whose filter values exist in the collection (others provably stay empty)."""
    out = misses
    for qc, dc in filters.items():
        vals = docs.select(F.col(dc).alias(qc)).distinct()
        out = out.join(vals, qc, "left_semi")
    return out


def term_fallback(misses: DataFrame, docs: DataFrame, embedder, filters: dict[str, str]) -> DataFrame:
    """For queries without hits, search each special term in order; the first term with hits wins."""
    terms = misses.select("query_id", "k", *filters.keys(),
                          F.posexplode(special_terms(F.col("text"))).alias("pos", "term"))
    emb = embedder(terms, "term", "embedding")
    # a search per (query, term position); both stay columns of their own
    hits = VX.knn(emb, docs, k=MAX_DEPTH, k_col="k", filters=filters, extra_keys=("pos",))
    best = hits.groupBy("query_id").agg(F.min("pos").alias("pos"))
    return hits.join(best, ["query_id", "pos"]).select("query_id", "doc_id", "score", "rank")


def history_fallback(misses: DataFrame, hist_items: DataFrame, docs: DataFrame, embedder,
                     filters: dict[str, str]) -> DataFrame:
    """C4: search again with ``"{latest history query} {query}"`` (k results)."""
    w = Window.partitionBy("query_id").orderBy(H.ts_or_epoch("ts").desc(), F.col("position").asc())
    latest = hist_items.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
        "query_id", F.col("query").alias("_hq"))
    q = misses.join(latest, "query_id").withColumn("enhanced", F.concat_ws(" ", "_hq", "text"))
    emb = embedder(q.select("query_id", "k", "enhanced", *filters.keys()), "enhanced", "embedding")
    return VX.knn(emb, docs, k=MAX_DEPTH, k_col="k", filters=filters)


def assemble_context(queries: DataFrame, docs: DataFrame, history: DataFrame | None, embedder=None,
                     filters: dict[str, str] | None = None, use_history: bool = True,
                     forced: DataFrame | None = None, payload: DataFrame | None = None) -> DataFrame:
    """Per query row the prompt, the retrieved documents and the counts.

    queries: query_id, text, k (default 4), user_id, embedding, filter columns.
    docs: doc_id, embedding, filter columns (+ text, source unless ``payload`` is given).
    payload: optional (doc_id, text, source); only the final k hits per query are joined to it.
    forced (C5): optional (query_id, doc_id, rank) rows that replace retrieval.
    """
    filters = filters or {}
    q = queries.withColumn("k", F.coalesce(F.col("k"), F.lit(DEFAULT_K)).cast("int")) \
        .withColumn("depth", fetch_depth(F.col("k")))
    q = q.checkpoint()  # read by every step below; a table, so nothing stays in the executors' memory
    # scoring carries only ids, vectors and filter columns; text is joined after ranking
    vecs = docs.select("doc_id", "embedding", *sorted(set(filters.values())))
    pay = payload if payload is not None else docs.select("doc_id", "text", "source")
    searched = q if forced is None else q.join(forced.select("query_id").distinct(), "query_id", "left_anti")
    first = VX.knn(searched, vecs, k=MAX_DEPTH, k_col="depth", filters=filters)
    if forced is not None:
        first = first.unionByName(
            forced.select("query_id", "doc_id", F.lit(None).cast("double").alias("score"),
                          F.col("rank").cast("int")))
    first = first.checkpoint()
    # a query without hits either has a filter no document passes (then every fallback, which
    # searches under the same filter, is empty too) or a vector that cannot be scored
    misses = q.join(first.select("query_id").distinct(), "query_id", "left_anti")
    misses = _eligible(misses, vecs, filters).checkpoint()
    # one action decides whether any fallback search has work
    has_misses = not misses.isEmpty()
    if has_misses and embedder is None:
        dim = q.agg(F.max(F.size("embedding"))).first()[0] or 64
        embedder = VX.hashed_embedder(int(dim))
    hits = first
    term_hits = None
    if has_misses:
        term_hits = term_fallback(misses, vecs, embedder, filters)
        hits = hits.unionByName(term_hits)

    if use_history and history is not None:
        hist_items = H.select_history(q, history)
        if has_misses:
            still = misses.join(term_hits.select("query_id").distinct(), "query_id", "left_anti")
            hits = hits.unionByName(history_fallback(still, hist_items, vecs, embedder, filters))
    else:
        hist_items = None

    # Re-rank by cosine distance only where more than k hits came back
    # (hits carry their kernel cosine; only forced documents, which have none, are scored by a join)
    hits = VX.rerank(hits, q.select("query_id", "k", "embedding"), vecs, "k", use_scores=True,
                     score_missing=forced is not None).drop("direct_score")
    # a vector without a payload row is still a hit (empty text), as in the collection view
    hits = hits.join(pay, "doc_id", "left")
    rendered = render_documents(hits, keep=("doc_id", "source", "text"))
    out = q.select("query_id", "text").join(rendered, "query_id", "left")
    if hist_items is not None:
        out = out.join(render_history(hist_items, keep=("id", "query", "response", "ts")), "query_id", "left")
    else:
        out = out.withColumn("history_text", F.lit(None).cast("string")).withColumn("history_count", F.lit(0)).withColumn(
            "history_items", F.lit(None).cast("array<struct<id:string,query:string,response:string,ts:timestamp>>"))
    doc_n = F.coalesce(F.col("document_count"), F.lit(0))
    hist_text = F.coalesce(F.col("history_text"), F.lit(""))
    docs_text = F.coalesce(F.col("documents_text"), F.lit(NO_DOCUMENTS))
    return out.select(
        "query_id",
        render_prompt(doc_n, docs_text, hist_text, F.col("text")).alias("prompt"),
        doc_n.cast("long").alias("document_count"),
        F.coalesce(F.col("history_count"), F.lit(0)).cast("long").alias("history_count"),
        F.coalesce("retrieved_documents", F.array()).alias("retrieved_documents"),
        F.coalesce("history_items", F.array()).alias("history_items"),
    )


def token_usage(df: DataFrame, prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """Whitespace-token counts of prompt, completion and their total."""
    p = F.size(words(F.coalesce(F.col(prompt), F.lit(""))))
    c = F.size(words(F.coalesce(F.col(completion), F.lit(""))))
    return df.withColumn("prompt_tokens", p).withColumn("completion_tokens", c).withColumn(
        "total_tokens", p + c)


def transcript_prompt(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """C11: ``System:/User:/Assistant:`` lines in turn order, unknown roles skipped, trailing ``Assistant: ``."""
    label = F.when(F.col("role") == "system", "System: ").when(F.col("role") == "user", "User: ").when(
        F.col("role") == "assistant", "Assistant: ")
    t = turns.where(label.isNotNull()).select(key, "turn", F.concat(label, F.coalesce("text", F.lit(""))).alias("l"))
    g = t.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "l"))).alias("_ls"))
    all_keys = turns.select(key).distinct()
    return all_keys.join(g, key, "left").select(
        key, F.concat(F.coalesce(F.array_join(F.transform("_ls", lambda x: x["l"]), "\n"), F.lit("")),
                      F.when(F.size(F.coalesce("_ls", F.array())) > 0, F.lit("\n")).otherwise(F.lit("")),
                      F.lit("Assistant: ")).alias("prompt"))


def generation_params(temperature: Column | None = None, max_tokens: Column | None = None) -> list[Column]:
    """C13 defaults: temperature 0.7 and 100 tokens; a temperature below 0.2 is forced to 0.01."""
    t = F.coalesce(temperature, F.lit(DEFAULT_TEMPERATURE)) if temperature is not None else F.lit(DEFAULT_TEMPERATURE)
    t = F.when(t < 0.2, F.lit(0.01)).otherwise(t)
    m = F.coalesce(max_tokens, F.lit(DEFAULT_MAX_TOKENS)) if max_tokens is not None else F.lit(DEFAULT_MAX_TOKENS)
    return [t.alias("temperature"), m.cast("int").alias("max_tokens")]


def generate(prompts: DataFrame, fn, stops: list[str] | None = None, prompt_col: str = "prompt") -> DataFrame:
    """Apply a user text generator (``list[str] -> list[str]``) to prompts in Arrow batches.

    The generator is the user's; this hook only batches rows through it and
    cuts answers at the stop strings (C12).
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def _gen(s: pd.Series) -> pd.Series:
        return pd.Series(list(fn(s.fillna("").tolist())), dtype="object")

    out = prompts.withColumn("completion", _gen(F.col(prompt_col)))
    if stops:
        out = out.withColumn("completion", cut_at_stops(F.col("completion"), stops))
    return out

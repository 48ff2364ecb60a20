"""Document collection: ids, embedding, delete, upsert, filters and kNN.

Exact kNN scores blocks of documents against the queries whose filters allow them (``topk``), keeps the
top k per query in each task, and merges the partial lists with a per-query window. Row pairs are never
materialised; queries of a checked size travel to the documents, larger sets meet them in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weft.functions import vector as V
from weft.operators import list_index, topk
from weft.session import kept

# Rows of a block of queries and of documents at most, where both sides are dealt to blocks, and their bytes.
# Documents travel once per block of queries of their value: large blocks of queries spare the shuffle.
QUERY_BLOCK_ROWS = 32768
DOC_BLOCK_ROWS = 32768
BLOCK_BYTES = 16 << 20
# Blocks of documents that may come together, and cells of a round at least: queries are met in rounds, so that documents travel few times at once.
DOC_BLOCKS = 4
ROUND_CELLS = 64
# The largest query side that travels to the documents.
QUERY_SIDE_ROWS = 1 << 15
QUERY_SIDE_BYTES = 16 << 20

HIT_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("rank_score", T.DoubleType()),
    T.StructField("_kq", T.LongType()),
])


# ----------------------------------------------------------------- ids, add, delete, upsert


def with_doc_id(df: DataFrame, cols=("text",), out: str = "doc_key") -> DataFrame:
    """B2: content-derived id (md5 of the given columns), stable across reruns."""
    return df.withColumn(out, F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                                                          for c in cols])))


def add_texts(texts: DataFrame, embedder, text_col: str = "text", meta_col: str = "metadata") -> DataFrame:
    """B1: one collection row per text: id, text, metadata (``{}`` when missing), embedding."""
    df = texts
    if meta_col not in df.columns:
        df = df.withColumn(meta_col, F.create_map().cast("map<string,string>"))
    else:
        df = df.withColumn(meta_col, F.coalesce(F.col(meta_col), F.create_map().cast("map<string,string>")))
    df = with_doc_id(df, (text_col,), "doc_key")
    return embedder(df, text_col, "embedding")


def delete_docs(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drop the documents whose id is in ``ids`` (left-anti equi-join)."""
    return docs.join(ids.select(key).distinct(), key, "left_anti")


def upsert_docs(base: DataFrame, delta: DataFrame, key: str = "doc_id", version: str | None = None) -> DataFrame:
    """Delta rows replace base rows of the same id; other rows kept.

    A key that repeats in the delta counts once: its row with the largest ``version`` (a delta
    column; without one, the largest row digest, so that the choice does not depend on the layout).
    A partial aggregate, a left-anti join and a union: no key is ranked inside one task.
    """
    order = F.struct(*([F.col(version)] if version else []), F.xxhash64(*delta.columns))
    newest = delta.groupBy(key).agg(F.max_by(F.struct(*delta.columns), order).alias("_r")).select("_r.*")
    return base.join(newest.select(key), key, "left_anti").unionByName(newest, allowMissingColumns=True)


def filter_meta(df: DataFrame, flt: dict | None, meta_col: str = "metadata") -> DataFrame:
    """Conjunction of equality conditions; real columns push down to the scan.

    Keys that are columns of ``df`` are compared directly (parquet pushdown);
    other keys are looked up in the ``metadata`` map.
    """
    if not flt:
        return df
    conds = []
    for k, v in flt.items():
        if k in df.columns:
            conds.append(F.col(k) == F.lit(v))
        else:
            conds.append(F.col(meta_col).getItem(k) == F.lit(str(v)))
    return df.where(reduce(lambda a, b: a & b, conds))


# ----------------------------------------------------------------- search


def _sides(queries: DataFrame, docs: DataFrame, filters: dict, overlap: dict, k_col, query_id, doc_id, embedding, extra_keys):
    """Both sides with the kernel's column names: filter columns ``_f0..``, tag columns ``_t0..``."""
    q = [F.col(query_id).cast("long").alias("query_id"), *[F.col(c) for c in extra_keys], F.col(embedding).alias("embedding")]
    d = [F.col(doc_id).cast("long").alias("doc_id"), F.col(embedding).alias("embedding")]
    types = dict(docs.dtypes)
    for i, (qc, dc) in enumerate(filters.items()):
        q.append(F.col(qc).cast(types[dc]).alias(f"_f{i}"))
        d.append(F.col(dc).alias(f"_f{i}"))
    for i, (qc, dc) in enumerate(overlap.items()):
        q.append(F.col(qc).alias(f"_t{i}"))
        d.append(F.col(dc).alias(f"_t{i}"))
    if k_col:
        q.append(F.col(k_col).cast("int").alias("_k"))
    return queries.select(*q).where(F.col("embedding").isNotNull()), docs.select(*d).where(F.col("embedding").isNotNull())


def _dealt(q: DataFrame, d: DataFrame, names: list[str], row_bytes: int = 1) -> Iterator[tuple[DataFrame, DataFrame, int]]:
    """Both sides dealt to cells: documents meet the queries of their filter values only, and the rows of
    one value are cut into blocks on both sides, of rows of ``row_bytes``; many documents come as several blocks
    at once. Values that one side does not have drop out here. The counts per value read the filter columns only.

    A pair of sides for each round of queries, and the rows of a block of documents. What travels in a round does not
    grow with the queries: a document goes once to each of the round's blocks of queries of its value, which are as many
    as ``ROUND_CELLS`` cells need."""
    most = max(1, BLOCK_BYTES // max(1, row_bytes))
    query_rows, doc_rows = min(QUERY_BLOCK_ROWS, most), min(DOC_BLOCK_ROWS, most)
    value = F.xxhash64(*names) if names else F.lit(0).cast("long")
    q, d = (x.dropna(subset=names).withColumn("_v", value) if names else x.withColumn("_v", value) for x in (q, d))
    n = F.count(F.lit(1))
    n_q = q.groupBy("_v").agg(F.ceil(n / query_rows).cast("int").alias("_nq"))
    n_d = d.groupBy("_v").agg(F.ceil(n / F.least(F.lit(DOC_BLOCKS * doc_rows), F.greatest(F.lit(doc_rows), n / ROUND_CELLS))).cast("int").alias("_nd"))
    cells = kept(n_q.join(n_d, "_v"))
    n_cells, n_blocks = cells.agg(F.sum("_nd"), F.max("_nq")).first()
    step = max(1, -(-ROUND_CELLS // max(n_cells or 1, 1)))
    for lo in range(0, n_blocks or 1, step):
        last = F.least(F.col("_nq"), F.lit(lo + step)) - 1
        here = cells.where(F.col("_nq") > lo)
        left = q.join(here, "_v").withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.col("_nq")).cast("int")).where(F.col("_qb").between(F.lit(lo), last))
        left = left.withColumn("_db", F.explode(F.sequence(F.lit(0), F.col("_nd") - 1))).drop("_nq", "_nd")
        right = d.join(here, "_v").withColumn("_db", F.pmod(F.xxhash64("doc_id"), F.col("_nd")).cast("int"))
        yield left, right.withColumn("_qb", F.explode(F.sequence(F.lit(lo), last))).drop("_nq", "_nd"), doc_rows


def _small_side(q: DataFrame, k: int) -> tuple[pa.Table | None, int]:
    """The queries, where they and their lists of hits stay within ``QUERY_SIDE_BYTES``, else None; and the
    bytes of a query's vector, which all vectors share."""
    rows = max(1, min(QUERY_SIDE_ROWS, QUERY_SIDE_BYTES // (24 * max(k, 1))))
    held = q.limit(rows + 1).toArrow()
    size = 8 * len(held.column("embedding")[0]) if held.num_rows else 1
    return (held if held.num_rows <= rows and held.nbytes <= QUERY_SIDE_BYTES else None), size


def knn(queries: DataFrame, docs: DataFrame, k: int = 4, metric: str = "cosine",
        filters: dict[str, str] | None = None, k_col: str | None = None,
        min_score: float | None = None, max_score: float | None = None,
        query_id: str = "query_id", doc_id: str = "doc_id", embedding: str = "embedding",
        overlap: dict[str, str] | None = None, extra_keys: tuple[str, ...] = (), counter=None) -> DataFrame:
    """Exact top-k per query (B6 cosine, B7 squared L2, B9 filters, B10 threshold).

    ``filters`` maps a query column to a docs column that must be equal (a
    per-query metadata filter; null equals nothing); ``overlap`` maps a query list column to a docs
    list column that must share an element (an empty query list does not
    restrict). ``k_col`` gives a per-query k (``k`` is the upper bound then);
    ``extra_keys`` are query columns that name a query together with its id. Returns
    the keys, ``doc_id, score, rank`` with rank 1 = best; ties by ascending ``doc_id``.

    A query is scored against the documents that its filters allow and no others (``topk.Queries``);
    ``counter``, an accumulator, adds up these products. Queries within ``QUERY_SIDE_BYTES`` travel
    to the documents, which stay where they are. Beyond that both sides are dealt by filter value to
    blocks, and the blocks of one value are paired by an equi-join, in rounds of queries: all but the last are
    stored as their hits.
    """
    filters, overlap, keys = filters or {}, overlap or {}, ["query_id", *extra_keys]
    q, d = _sides(queries, docs, filters, overlap, k_col, query_id, doc_id, embedding, extra_keys)
    schema = T.StructType([q.schema[c] for c in keys] + HIT_SCHEMA.fields[1:])
    fs, ts = [f"_f{i}" for i in range(len(filters))], [f"_t{i}" for i in range(len(overlap))]
    held, row_bytes = _small_side(q, k)

    def met(table: pa.Table, blocks) -> pa.Table:
        side = topk.Queries(table, keys, k, fs, ts, metric)
        for block in blocks:
            side.meet(block, fs, ts, min_score, max_score)
        if counter is not None:
            counter.add(side.scored)
        return side.hits()

    if held is not None:
        return _ranked(d.mapInArrow(lambda batches: met(held, batches).to_batches(), schema), keys, k)

    def in_blocks(rows: int):
        return lambda a, b: met(a, (b.slice(lo, rows) for lo in range(0, b.num_rows, rows)))

    found = []
    for left, right, rows in _dealt(q, d, fs, row_bytes):
        found = [kept(x) if x is found[-1] else x for x in found]
        hits = left.groupBy("_v", "_qb", "_db").cogroup(right.groupBy("_v", "_qb", "_db")).applyInArrow(in_blocks(rows), schema)
        found.append(_ranked(hits, keys, k))
    return reduce(DataFrame.unionByName, found)


def _ranked(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("rank_score").desc(), F.col("doc_id").asc())
    # the literal limit lets the planner cut each partition to k rows per query before the shuffle;
    # the per-query k travels with the rows, so no join back to the queries is needed
    ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.where(F.col("rank") <= F.col("_kq")).drop("rank_score", "_kq")


# ----------------------------------------------------------------- expression forms


def score_pairs(hits: DataFrame, queries: DataFrame, docs: DataFrame, metric: str = "cosine") -> DataFrame:
    """Score given (query_id, doc_id) pairs with native expressions (re-rank input)."""
    qe = queries.select(F.col("query_id"), F.col("embedding").alias("_qe"))
    de = docs.select(F.col("doc_id"), F.col("embedding").alias("_de"))
    j = hits.join(qe, "query_id").join(de, "doc_id")
    if metric == "cosine":
        s = V.cosine("_qe", "_de")
    elif metric == "sqeuclidean":
        s = V.sq_euclidean("_qe", "_de")
    else:
        s = V.dot("_qe", "_de")
    return j.withColumn("pair_score", s).drop("_qe", "_de")


def rerank(hits: DataFrame, queries: DataFrame, docs: DataFrame, k_col: str = "k", use_scores: bool = False,
           score_missing: bool = True) -> DataFrame:
    """Re-score hits by cosine distance (1 - cos) to the query, ascending, keep k.

    Only queries with more than k hits are re-ranked (a stable sort, so ties
    keep the incoming rank order); a missing score counts as 1.0. With
    ``use_scores`` the hits' own cosine scores (from the kernel, against the same
    stored vectors) are used and only rows without a score are scored by a join
    with the vectors (``score_missing``), so the collection is not joined at all
    when every hit carries its score.
    """
    if use_scores:
        scored = hits.withColumn("pair_score", F.col("score"))
        if score_missing:
            need = score_pairs(hits.where(F.col("score").isNull()), queries, docs, "cosine")
            scored = scored.where(F.col("score").isNotNull()).unionByName(need)
    else:
        scored = score_pairs(hits, queries, docs, "cosine")
    scored = scored.withColumn(
        "direct_score", F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("pair_score")), F.lit(1.0)))
    kq = queries.select("query_id", F.col(k_col).alias("_kq"))
    s = scored.join(kq, "query_id").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    w = Window.partitionBy("query_id").orderBy(F.round("direct_score", 9).asc(), F.col("rank").asc())
    s = s.withColumn("_rr", F.row_number().over(w))
    s = s.where((F.col("_n") <= F.col("_kq")) | (F.col("_rr") <= F.col("_kq")))
    s = s.withColumn("rank", F.when(F.col("_n") > F.col("_kq"), F.col("_rr")).otherwise(F.col("rank")))
    return s.drop("_rr", "_n", "_kq", "pair_score")


def similar_docs(docs: DataFrame, k: int = 5) -> DataFrame:
    """For every document the k nearest other documents (self excluded)."""
    q = docs.select(F.col("doc_id").alias("query_id"), "embedding")
    hits = knn(q, docs, k=k + 1)
    hits = hits.where(F.col("query_id") != F.col("doc_id"))
    w = Window.partitionBy("query_id").orderBy(F.col("rank"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def training_query(queries: DataFrame, docs: DataFrame, k: int = 10, min_score: float = 0.7,
                   filters: dict[str, str] | None = None, tags_col: str | None = None) -> DataFrame:
    """Filtered kNN with threshold; optional tag overlap between query and document."""
    # every condition (equality filters, tag overlap, threshold) applies before ranking
    return knn(queries, docs, k=k, filters=filters, min_score=min_score,
               overlap={tags_col: tags_col} if tags_col else None)


def collection_stats(docs: DataFrame, keys=("source", "lang")) -> DataFrame:
    """Document count and characters overall and per value of each metadata key
    (grouping sets: the total plus one set per key, aggregated in one pass)."""
    cols = [F.col(k) for k in keys]
    sets = [[]] + [[c] for c in cols]
    return docs.groupingSets(sets, *cols).agg(F.count(F.lit(1)).alias("documents"),
                                              F.sum(F.length("text")).alias("chars"))


# ----------------------------------------------------------------- embedding


def hashed_embedder(dim: int = 64, use_idf: bool = False):
    """B3 default: native hashed-token vectors (tokenize, hash, optional IDF, L2 normalise)."""

    def embed(df: DataFrame, text_col: str = "text", out: str = "embedding") -> DataFrame:
        from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
        from pyspark.ml.functions import vector_to_array

        tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"(?U)\W+", toLowercase=True)
        tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
        x = tf.transform(tok.transform(df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))))
        src = "_tf"
        if use_idf:
            x = IDF(inputCol="_tf", outputCol="_idf").fit(x).transform(x)
            src = "_idf"
        x = Normalizer(inputCol=src, outputCol="_n", p=2.0).transform(x)
        x = x.withColumn(out, vector_to_array("_n", "float32"))
        return x.drop("_tok", "_tf", "_idf", "_n")

    return embed


def pandas_embedder(fn, dim: int):
    """B3 plug-in: wrap a user ``list[str] -> 2-D array`` model as an iterator pandas UDF.

    The model is created once per Python worker by ``fn``'s own caching.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            m = np.asarray(fn(s.fillna("").tolist()), dtype=np.float32).reshape(len(s), dim)
            yield pd.Series(list(m))

    def embed(df: DataFrame, text_col: str = "text", out: str = "embedding") -> DataFrame:
        return df.withColumn(out, _embed(F.col(text_col)))

    return embed


def openai_style_embeddings(df: DataFrame, text_col: str = "text", embedding_col: str = "embedding",
                            id_col: str = "request_id", order_col: str = "pos") -> DataFrame:
    """B3 response shape: per request a list of {index, embedding} and whitespace-token usage."""
    w = Window.partitionBy(id_col).orderBy(order_col)
    x = df.withColumn("index", F.row_number().over(w) - 1)
    return x.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("index", F.col(embedding_col).alias("embedding")))).alias("data"),
        F.sum(F.size(F.filter(F.split(F.col(text_col), r"(?U)\s+"), lambda t: t != ""))).alias("prompt_tokens"),
    )


# ----------------------------------------------------------------- approximate


def ann_knn(queries: DataFrame, docs: DataFrame, k: int = 4, visits: int | None = None, index=None, recall: float = 0.95, counter=None) -> DataFrame:
    """Approximate kNN over a two-level tree of quantised lists (``list_index``). Without an ``index`` one is
    built; ``visits`` overrides how many lists a query meets, which the index sets for ``recall``."""
    index = index if index is not None else list_index.build(docs, queries, k, recall)
    return list_index.search(queries, docs, index, k, visits, counter)

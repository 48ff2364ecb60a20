"""Operator 6: approximate nearest neighbours over learned partitions.

Fitting, on a bounded sample: a neighbour graph of the sample is cut into balanced parts with few
edges between them, and a small softmax classifier learns the part from the vector. Indexing: the
classifier puts every row into its most probable part. Searching: each query goes to its most
probable parts and is compared there exactly, in double precision; how many parts is set on held-out
vectors of the sample so that ``TARGET_RECALL`` of their neighbours in it are found, and a query
takes more parts until these hold ``MIN_ROWS`` rows.

Parts are cut into blocks of at most ``BLOCK`` rows or queries, so no task holds more than two
blocks, however unequal the parts are; only the best ``k`` rows of a block leave a task.

Parameters that bound the fit: ``SAMPLE_PER_PART`` vectors per part and ``MAX_SAMPLE`` in all; the
number of parts follows the row count (about the square root of it over 16, at least 16 when the
table fills them).

Defined results: vectors that are null, zero, hold null or non-finite components, or have another
length than most, and rows without an id take no part. Repeated equal query rows are one query; a
query is never compared with rows of its own id. Ties go to the smaller vec_id. Empty tables give
no rows; fewer candidates than k give them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weft.llm import vectors as V

SAMPLE_PER_PART = 256
MAX_SAMPLE = 16384
GRAPH_K = 10
TARGET_RECALL = 0.96
MIN_ROWS = 256
BLOCK = 4096
_HELD_OUT = 512


def sample_graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    """The k nearest other rows of each row, by cosine, in steps of bounded memory."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at:at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -2
        out[at:at + 1024] = np.argpartition(-s, k, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Parts of nearly equal size with few graph edges between them: grown around far-apart seeds,
    then refined by moving rows to the part of most of their neighbours while room is left."""
    n = len(x)
    room = int(np.ceil(n / parts * 1.05))
    rng = np.random.default_rng(7)
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.full(n, -1)
    for _ in range(10):
        s = x @ centres.T
        part[:] = -1
        size = np.zeros(parts, np.int64)
        choice = np.argsort(-s, axis=1)
        for i in np.argsort(-(s.max(axis=1) - s.mean(axis=1))):
            p = next(p for p in choice[i] if size[p] < room)
            part[i] = p
            size[p] += 1
        centres = V.unit(np.stack([x[part == p].sum(axis=0) + 1e-12 for p in range(parts)]))
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()], 1),
                           np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])], 1)])
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (both[:, 0], part[both[:, 1]]), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain):
            if gain[i] <= 0:
                break
            to = int(votes[i].argmax())
            if size[to] < room and size[part[i]] > n // parts * 0.9:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


def train_router(x: np.ndarray, part: np.ndarray, parts: int, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression from vector to part (full-batch Adam)."""
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    goal = np.eye(parts)[part]
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        p = np.exp(x @ w + b - (x @ w + b).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - goal) / len(x)
        for j, (value, g) in enumerate(((w, x.T @ d + 1e-4 * w), (b, d.sum(axis=0)))):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.999 * v[j] + 0.001 * g * g
            value -= 0.1 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-9)
    return w, b


def fit(vectors: DataFrame, width: int, rows: int, k: int = 5):
    """Router weights and the number of parts to probe, from the sample."""
    parts = int(min(max(16, 2 ** np.round(np.log2(max(1.0, rows**0.5 / 16)))), MAX_SAMPLE // SAMPLE_PER_PART, max(1, rows // SAMPLE_PER_PART)))
    if parts == 1:
        return (np.zeros((width, 1)), np.zeros(1)), 1
    want = min(MAX_SAMPLE, SAMPLE_PER_PART * parts)
    rows_ = vectors.select("embedding").orderBy(F.xxhash64("vec_id", "embedding")).limit(want).toArrow()
    x = V.unit(V.matrix(rows_.column(0), width))
    held = x[:min(_HELD_OUT, len(x) // 8)]
    x = x[len(held):]
    router = train_router(x, balanced_parts(sample_graph(x), x, parts), parts)
    # the fewest parts that hold enough of the held-out vectors' neighbours
    near = np.argpartition(-(held @ x.T), k, axis=1)[:, :k]
    home = (x @ router[0] + router[1]).argmax(axis=1)
    order = np.argsort(-(held @ router[0] + router[1]), axis=1)
    place = np.argsort(order, axis=1)
    depth = place[np.arange(len(held))[:, None], home[near]]
    probes = next(p for p in range(1, parts + 1) if (depth < p).mean() >= TARGET_RECALL)
    return router, probes


def _route(vectors: DataFrame, router, probes: int, width: int, sizes: np.ndarray | None) -> DataFrame:
    """Each row with its ``probes`` most probable parts (more while they hold too few rows)."""
    model = vectors.sparkSession.sparkContext.broadcast((router, sizes))

    def run(batches):
        (w, b), sizes = model.value
        for batch in batches:
            order = np.argsort(-(V.unit(V.matrix(batch.column(1), width)) @ w + b), axis=1, kind="stable")
            lists = []
            for row in order:
                n = probes
                if sizes is not None:
                    n = max(n, int(np.searchsorted(np.cumsum(sizes[row]), MIN_ROWS)) + 1)
                lists.append(row[:n].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], ["vec_id", "embedding", "parts"])

    out = vectors.select("vec_id", "embedding").mapInArrow(run, vectors.select("vec_id", "embedding").schema.add("parts", T.ArrayType(T.IntegerType())))
    return out.select("vec_id", "embedding", F.explode("parts").alias("part"))


def _blocked(rows: DataFrame, name: str) -> tuple[DataFrame, dict[int, int]]:
    """Rows dealt to blocks of their part, about ``BLOCK`` rows each; blocks per part."""
    counts = dict(rows.groupBy("part").count().collect())  # one row per part
    blocks = {p: -(-n // BLOCK) for p, n in counts.items()}
    per_part = F.create_map(*[F.lit(x) for kv in sorted(blocks.items()) for x in kv]) if blocks else F.create_map().cast("map<int,int>")
    n = F.element_at(per_part, F.col("part"))
    return rows.withColumn("_n", n).withColumn(name, F.pmod(F.xxhash64("vec_id", "embedding"), F.col("_n")).cast("int")).drop("_n"), blocks


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``vectors(vec_id, embedding)``, ``queries`` alike: ``(query_id, rank, vec_id, score)``."""
    spark = vectors.sparkSession
    width = V.common_length(vectors, "embedding")
    fine = F.col("vec_id").isNotNull() & V.usable(F.col("embedding")) & (F.size("embedding") == width)
    vectors = vectors.select("vec_id", "embedding").filter(fine)
    queries = queries.select("vec_id", "embedding").filter(fine).distinct()
    rows = vectors.count()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router, probes = fit(vectors, width, rows, k)
    base, blocks = _blocked(_route(vectors, router, 1, width, None), "c")
    sizes = np.zeros(len(router[1]), np.int64)
    for p, n in base.groupBy("part").count().collect():
        sizes[p] = n
    asked, q_blocks = _blocked(_route(queries, router, probes, width, sizes), "q")

    def times(counts: dict[int, int]):
        per_part = F.create_map(*[F.lit(x) for kv in sorted(counts.items()) for x in kv]) if counts else F.create_map().cast("map<int,int>")
        return F.explode(F.sequence(F.lit(0), F.coalesce(F.try_element_at(per_part, F.col("part")), F.lit(0)) - 1, F.lit(1)))

    # every block of rows of a part meets every block of queries of it
    some = [p for p in blocks if p in q_blocks]
    base = base.filter(F.col("part").isin(some)).withColumn("q", times(q_blocks))
    asked = asked.filter(F.col("part").isin(some)).withColumn("c", times(blocks)).withColumn("_key", F.xxhash64("embedding"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, x = left.column("vec_id").to_numpy(), V.matrix(left.column("embedding"), width)
            own, y = right.column("vec_id").to_numpy(), V.matrix(right.column("embedding"), width)
            keys = right.column("_key").to_numpy()
            xu, yu = V.unit(x), V.unit(y)
            for at in range(0, len(y), 256):
                s = yu[at:at + 256] @ xu.T
                s[own[at:at + 256][:, None] == ids[None, :]] = -2
                take = min(k, len(x))
                edge = -np.partition(-s, take - 1, axis=1)[:, take - 1]
                for i, (row, e) in enumerate(zip(s, edge, strict=True)):
                    near = np.flatnonzero((row >= e - 1e-9) & (row > -2))
                    exact = V.cosines(np.broadcast_to(y[at + i], (len(near), width)), x[near])
                    order = np.lexsort((ids[near], -exact))[:k]
                    found += [(int(own[at + i]), int(keys[at + i]), int(ids[near[j]]), float(exact[j])) for j in order]
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()),
                         "_key": pa.array([f[1] for f in found], pa.int64()),
                         "vec_id": pa.array([f[2] for f in found], pa.int64()), "score": pa.array([f[3] for f in found], pa.float64())})

    met = base.groupBy("part", "c", "q").cogroup(asked.groupBy("part", "c", "q")).applyInArrow(
        best, "query_id long, _key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "_key").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

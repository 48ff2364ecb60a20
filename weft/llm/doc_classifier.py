"""A document classifier over the labelled table, for the operators that need posteriors.

Features are the words of a text (A-Z lower-cased, letters, digits and non-ASCII characters only),
by fingerprint in ``BUCKETS`` buckets, and a few shape classes (capitals, punctuation, digits,
distinct words, word length, text length). On one half of the labelled sample Spark counts each
bucket by label; of the buckets whose log odds are at least ``MIN_Z`` standard errors from 0 the
``MAX_FEATURES`` clearest are kept, so rare words add no noise. Logistic regression on the other
half turns them into posteriors.

The labelled sample is bounded: ``SAMPLE`` rows of the label table, by hash of the id. Its ids and
labels (not its texts) are broadcast; the counts are one row per bucket. Scoring reads every text
whole. Labels are 0/1; null ids or labels are left out, repeated ids count by their mean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import textvec

SAMPLE = 20_000
BUCKETS = 1 << 18
SHAPES = 7 * 16
MIN_Z = 3.0
MAX_FEATURES = 512
_LETTERS = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256)).lower()
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.array([c < 0x80 and not chr(c).isalnum() and c > 32 for c in range(256)])


def _shape(raw: bytes, n_words: int, n_distinct: int) -> list[int]:
    """Buckets of the shape classes of a text."""
    b = np.frombuffer(raw, np.uint8)
    n = max(1, len(b))
    lines = raw.split(b"\n")
    shares = [_UPPER[b].sum() / n, _PUNCT[b].sum() / n, _DIGIT[b].sum() / n, n_distinct / max(1, n_words), len(set(lines)) / len(lines)]
    classes = [min(15, int(16 * s**0.5)) for s in shares] + [min(15, int(n / max(1, n_words))), min(15, int(np.log2(n_words + 1)))]
    return [BUCKETS + 16 * i + c for i, c in enumerate(classes)]


def features(texts: list[bytes | None]):
    """For each text its number of words and its distinct feature buckets."""
    plain = [(t or b"").translate(_LETTERS) for t in texts]
    for raw, words in zip(texts, textvec.word_hashes(plain), strict=True):
        own = np.unique((words >> np.uint64(46)).astype(np.int64))
        yield len(words), np.concatenate([own, _shape(raw or b"", len(words), len(own))]).astype(np.int64)


def _sample(labels: DataFrame, names: list[str], size: int) -> DataFrame:
    rows = labels.select("doc_id", *names).dropna().groupBy("doc_id").agg(*[(F.avg(n) >= 0.5).cast("int").alias(n) for n in names])
    return rows.withColumn("_half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def learn(docs: DataFrame, labels: DataFrame, names: list[str], size: int = SAMPLE):
    """``(weights, shifts)``: a weight matrix (bucket by label) and a shift per label."""
    spark = docs.sparkSession
    chosen = spark.createDataFrame(_sample(labels, names, size).collect() or [], f"doc_id long, {', '.join(f'{n} int' for n in names)}, _half int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "_half", *names)

    def count(batches):
        total = np.zeros((BUCKETS + SHAPES + 1, 1 + len(names)), np.int64)
        for batch in batches:
            half = batch.column(1).to_numpy()
            y = np.stack([np.ones(len(half), np.int64), *[c.to_numpy().astype(np.int64) for c in batch.columns[2:]]], 1)
            for (_, f), h, one in zip(features(batch.column(0).cast(pa.binary()).to_pylist()), half, y, strict=True):
                if h == 0:
                    total[f] += one
                    total[-1] += one
        at = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *[pa.array(total[at, j], pa.int64()) for j in range(total.shape[1])]], ["f", "n", *names])

    columns = ", ".join(f"{n} long" for n in names)
    counts = rows.mapInArrow(count, f"f long, n long, {columns}").groupBy("f").agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names]).toArrow()
    table = np.zeros((BUCKETS + SHAPES + 1, 1 + len(names)))
    if counts.num_rows:
        table[counts.column(0).to_numpy()] = np.stack([counts.column(j).to_numpy() for j in range(1, 2 + len(names))], 1)
    weights = np.zeros((BUCKETS + SHAPES, len(names)))
    shifts = np.zeros(len(names))
    n_all = table[-1, 0]
    clear = np.zeros((BUCKETS + SHAPES, len(names)))
    for j in range(len(names)):
        yes, yes_all = table[:-1, 1 + j], table[-1, 1 + j]
        no, no_all = table[:-1, 0] - yes, n_all - yes_all
        odds = np.log((yes + 0.5) / (yes_all + 1)) - np.log((no + 0.5) / (no_all + 1))
        clear[:, j] = np.abs(odds) / np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))
    found = np.flatnonzero(clear.max(axis=1) >= MIN_Z)
    kept = found[np.argsort(-clear[found].max(axis=1), kind="stable")[:MAX_FEATURES]]
    held = _rows_of(rows.filter("_half = 1").select("text", *names), np.sort(kept), names).toArrow()
    lists = held.column("f").combine_chunks()
    x = np.zeros((held.num_rows, len(kept)), np.float32)
    if held.num_rows:
        x[np.repeat(np.arange(held.num_rows), np.diff(lists.offsets.to_numpy())), lists.values.to_numpy()] = 1
    for j, n in enumerate(names):
        weights[np.sort(kept), j], shifts[j] = _regress(x, held.column(n).to_numpy().astype(np.float32))
    return weights, shifts


def _rows_of(rows: DataFrame, kept: np.ndarray, names: list[str]) -> DataFrame:
    """Numbers of the kept features in each row, with its labels."""
    send = rows.sparkSession.sparkContext.broadcast(kept)

    def run(batches):
        kept = send.value
        place = np.full(BUCKETS + SHAPES, -1)
        place[kept] = np.arange(len(kept))
        for batch in batches:
            f = [place[f][place[f] >= 0].tolist() for _, f in features(batch.column(0).cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.int32())), *batch.columns[1:]], ["f", *names])

    return rows.mapInArrow(run, ", ".join(["f array<int>", *[f"`{n}` int" for n in names]]))


def _regress(x: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression, lightly regularised (full-batch Adam)."""
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1 if len(y) else 1):
        d = (1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(np.float32) + w[-1], -30, 30))) - y) / len(y)
        g = np.append(x.T @ d.astype(np.float32) + 1e-4 * w[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def posteriors(docs: DataFrame, model, names: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with ``n_words`` and a posterior ``p_<name>`` for each label
    (rounded to 9 places, so that they do not depend on the order of a sum)."""
    weights, shifts = model
    at = np.flatnonzero(np.abs(weights).sum(axis=1))
    send = docs.sparkSession.sparkContext.broadcast((weights.shape, at, weights[at], shifts))
    types = dict(docs.dtypes)

    def run(batches):
        shape, at, values, shifts = send.value
        w = np.zeros(shape)
        w[at] = values
        for batch in batches:
            n, s = [], []
            for size, f in features(batch.column(0).cast(pa.binary()).to_pylist()):
                n.append(size)
                s.append(w[f].sum(axis=0))
            p = np.round(1 / (1 + np.exp(-np.clip(np.array(s).reshape(-1, shape[1]) + shifts, -30, 30))), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), *[pa.array(p[:, j]) for j in range(shape[1])]],
                                             [*keep, "n_words", *[f"p_{x}" for x in names]])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], "n_words long", *[f"`p_{x}` double" for x in names]])
    return docs.select("text", *keep).mapInArrow(run, schema)

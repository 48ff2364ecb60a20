"""Operator 9: language identification by compression.

For every language of the labelled rows a raw-content zstandard dictionary is filled from a
bounded sample of its texts. A text is compressed whole, in blocks of ``BLOCK`` bytes, with each
dictionary; the language whose dictionary leaves the fewest bytes wins. The score is the relative
margin to the runner-up, and a margin below ``MIN_MARGIN`` marks the row as rejected.

Below ``COARSE`` bytes one byte is about that margin, and short texts tie. There the languages within
two bytes of the best are measured in fractions of a bit: the length of the text under a model of up to
``ORDER`` preceding bytes, counted in the language's dictionary. Winner and margin come from it.

The sample is bounded by ``SAMPLE_DOCS`` texts per language, ``SAMPLE_CHARS`` characters of each,
and ``DICT_BYTES`` bytes of dictionary; what reaches the driver grows with the number of
languages, not of rows. Prediction reads whole texts.

Defined results: text null or without a letter gives ``und``, score 0, rejected; no labelled
row at all gives ``und`` for every row; one language only gives that language with score 1;
what is still equal is decided by the language's name and has margin 0. A null doc_id is never
learned from and counts as not held out.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE_DOCS = 96
SAMPLE_CHARS = 2000
DICT_BYTES = 64 << 10
BLOCK = 16 << 10
LEVEL = 6
MIN_MARGIN = 0.005
COARSE = 400
ORDER = 4
UNKNOWN = "und"


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3 (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Raw dictionaries by language, from rows with a language whose fold is not 1."""
    usable = docs.filter(F.col("lang").isNotNull() & (fold_of(F.col("doc_id")) != 1))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= sample_docs)
    ids = [r[0] for r in chosen.select("doc_id").distinct().collect()]  # at most sample_docs per language
    rows = (usable.filter(F.col("doc_id").isin(ids)).filter("text is not null")
            .select("lang", "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
            .withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id", "text")))
            .filter(F.col("_n") <= sample_docs).orderBy("lang", F.xxhash64("doc_id")).collect()) if ids else []
    out: dict[str, bytes] = {}
    for r in rows:
        out[r["lang"]] = (out.get(r["lang"], b"") + r["text"].lower().encode() + b"\n")[:DICT_BYTES]
    return {k: v for k, v in out.items() if len(v) >= 8}


def _coders(dictionaries: list[tuple[str, bytes]]):
    import zstandard as zstd

    out = []
    for name, raw in dictionaries:
        d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        params = zstd.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(raw), write_checksum=False, write_content_size=False, write_dict_id=False)
        out.append((name, zstd.ZstdCompressor(dict_data=d, compression_params=params), _Bits(raw)))
    return out


class _Bits:
    """Length of a text in bits under a dictionary's byte sequences (counted on first use)."""

    def __init__(self, raw: bytes):
        self.raw, self.seen = raw, None

    def __call__(self, data: bytes) -> float:
        if self.seen is None:
            n = len(self.raw)
            self.seen = [Counter(self.raw[i:i + k] for i in range(n - k + 1)) for k in range(ORDER + 2)]
        text, total = b"\n" + data + b"\n", 0.0
        for at in range(1, len(text)):
            p = 1 / 256
            for k in range(min(at, ORDER) + 1):  # each order leans on the one below it
                p = (self.seen[k + 1][text[at - k:at + 1]] + p) / (self.seen[k][text[at - k:at]] + 1)
            total -= math.log2(p)
        return total


def _judge(text: str | None, coders) -> tuple[str, float, bool]:
    """Language, score, and whether the text is rejected."""
    if not coders or not text or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, True
    data = text.lower().encode()
    blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), name) for name, c, _ in coders)
    score = 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    if score < MIN_MARGIN and sizes[0][0] < COARSE:
        close = {name for n, name in sizes if n <= sizes[0][0] + 2}
        sizes = sorted((bits(data), name) for name, _, bits in coders if name in close)
        score = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][1], score, score < MIN_MARGIN


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, lang_pred, score, rejected)``, one row per row."""
    model = docs.sparkSession.sparkContext.broadcast(sorted(dictionaries.items()))
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        coders = _coders(model.value)
        for batch in batches:
            out = [_judge(t, coders) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not rejected."""
    model = docs.sparkSession.sparkContext.broadcast(sorted(dictionaries.items()))
    at = docs.columns.index("text")

    def run(batches):
        coders = _coders(model.value)
        for batch in batches:
            yield batch.filter(pa.array([not _judge(t, coders)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

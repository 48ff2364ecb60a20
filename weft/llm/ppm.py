"""Operator 11: language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ``ORDER`` bytes, learned from all texts that ``learn``
selects; its size follows the corpus. It is kept as a table of grams (``ORDER`` context bytes and the
byte that follows, with a count); all shorter contexts are sums over it. A byte costs what escape
method C says: in a context with ``T`` observations of ``D`` different bytes, a byte seen ``n`` times
has probability ``n / (T + D)`` and the escape to the next shorter context ``D / (T + D)``; there, the
bytes of the longer context are excluded from ``T`` and ``D``. Below the empty context the bytes not
seen at all are equally likely. Bytes 0xFF, which UTF-8 never holds, stand before each text, and one
follows it as the end symbol, so the probabilities of all texts sum to one.

Texts are dealt to buckets of about ``BUCKET_BYTES``. A bucket asks once for each gram and each word
that it holds, with its counts in the texts to learn from. Sums over all buckets are the model; a
gram's cost needs only grams that end in the same two context bytes (a group of at most 256^3 rows,
read as a sorted stream) and the 65,536 counts of the two shortest orders, which travel with the
tasks. Each bucket gets the answers to its own questions, so no task holds the whole model, and what is
shuffled grows with the distinct grams and words of a bucket, not with its bytes.

Defined results: A-Z are lower-cased; a null text is empty and has one token, its end; ``learn`` null
counts as not to be learned from; an empty selection gives uniform bytes and unknown tokens; every
row is learned from and scored, repeated ones too. Words are compared as strings, grams as numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.scratch import materialise
from weft.llm.stream import whole_groups

ORDER = 4
BUCKET_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PAD = b"\xff" * ORDER
_TABLE = 1 << 22  # dense numbering of codes up to this many, by sorting beyond


def _slices(texts: pa.ChunkedArray):
    """Lower-cased texts, about ``SLICE_BYTES`` at a time: the first row and the texts."""
    held, size, first = [], 0, 0
    for i, value in enumerate(texts):
        t = value.as_buffer()
        held.append(b"" if t is None else t.to_pybytes().translate(_LOWER))
        size += len(held[-1])
        if size >= SLICE_BYTES:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _numbered(code: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes (below ``top``) in order, and the place of each code among them."""
    if top > _TABLE:
        return np.unique(code, return_inverse=True)
    seen = np.zeros(top, bool)
    seen[code] = True
    found = np.flatnonzero(seen)
    place = np.zeros(top, np.int32)
    place[found] = np.arange(len(found), dtype=np.int32)
    return found, place[code]


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of some texts as numbers in ascending order, the gram of each scored position
    (all bytes of all texts and their end symbols), and the first position of each text."""
    buf = np.frombuffer(_PAD + b"".join(t + _PAD for t in texts), np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes + ORDER) - sizes  # behind the padding before each text
    scored = np.ones(len(buf), bool)
    scored[:ORDER] = False
    for k in range(1, ORDER):
        scored[starts + sizes + k] = False
    used, code = _numbered(buf.astype(np.int32), 256)
    base = len(used)
    grams, place = used.astype(np.int64), code[: len(buf) - ORDER]
    for k in range(1, ORDER + 1):  # one more byte to the right each time
        found, place = _numbered(place.astype(np.int64) * base + code[k: len(buf) - ORDER + k], len(grams) * base)
        grams = grams[found // base] << 8 | used[found % base]
    place = place[scored[ORDER:]]
    return grams, place, np.cumsum(sizes + 1) - sizes - 1


def _tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens (the end is the empty string), the token at each place, tokens per text."""
    lists = [t.split() for t in texts]  # bytes split at \x20 and \x09-\x0D
    sizes = np.fromiter((len(w) + 1 for w in lists), np.int64, len(lists))
    coded = pa.array([w for ws in lists for w in (*ws, b"")], pa.binary()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), sizes


def _questions(table: pa.Table) -> pa.Table:
    """What one bucket asks: its distinct grams and tokens with their counts in texts to learn from."""
    learn = table.column("_learn").to_numpy()
    grams, counts, words, n_words = [], [], [], []
    for first, texts in _slices(table.column("_text")):
        take = learn[first:first + len(texts)]
        g, place, starts = _grams(texts)
        weight = np.repeat(take, np.diff(np.append(starts, len(place))))
        n = np.bincount(place[weight], minlength=len(g))
        # grams that stand at places without a score only are not asked for
        held = np.zeros(len(g), bool)
        held[place] = True
        grams.append(g[held])
        counts.append(n[held])
        w, at, sizes = _tokens(texts)
        words.append(w)
        n_words.append(np.bincount(at[np.repeat(take, sizes)], minlength=len(w)))
    gram, where = np.unique(np.concatenate(grams), return_inverse=True)
    coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
    n = np.concatenate([np.bincount(where, np.concatenate(counts), len(gram)),
                        np.bincount(coded.indices.to_numpy(), np.concatenate(n_words), len(coded.dictionary))]).astype(np.int64)
    bucket = table.column("_bucket")[0].as_py()
    return pa.table({
        "bucket": pa.array(np.full(len(n), bucket, np.int64)),
        "gram": pa.concat_arrays([pa.array(gram), pa.nulls(len(coded.dictionary), pa.int64())]),
        "word": pa.concat_arrays([pa.nulls(len(gram), pa.binary()), coded.dictionary]),
        "n": pa.array(n)})


class _Order:
    """One order of the trie: distinct grams (context and byte), their counts, and per context the
    observations ``total``, the different bytes ``kinds``, and what these bytes count in the context
    that is one byte shorter."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self.grams, self.n = grams, n
        self.contexts, self.at = np.unique(grams >> 8, return_inverse=True)
        self.total = np.bincount(self.at, n, len(self.contexts))
        self.kinds = np.bincount(self.at, n > 0, len(self.contexts))

    def exclude(self, shorter_n: np.ndarray) -> None:
        self.shorter = np.bincount(self.at, np.where(self.n > 0, shorter_n, 0), len(self.contexts))


def costs_of(grams: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each gram. ``grams`` are distinct, ascending, and whole
    groups of grams with the same two last context bytes; ``pairs[a, b]`` counts byte b after byte a."""
    by_order = [_Order(grams, n)]
    suffix = []
    for k in range(ORDER - 1, 1, -1):
        short, to = np.unique(by_order[-1].grams & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        o = _Order(short, np.bincount(to, by_order[-1].n, len(short)))
        by_order[-1].exclude(o.n[to])
        by_order.append(o)
        suffix.append(to)
    # orders 1 and 0 from the table of pairs
    pairs = pairs.astype(float)
    single = pairs.sum(axis=0)
    last = by_order[-1]
    last.exclude(pairs[(last.grams >> 8) & 255, last.grams & 255])
    out = np.zeros(len(grams))
    left = np.ones(len(grams), bool)
    at = np.arange(len(grams))  # the gram's place in the current order

    def step(seen, total, kinds):
        """Codes what this order has seen, escapes from the rest; contexts with nothing left are passed."""
        nonlocal left
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = left & (seen > 0)
            out[hit] += np.log10(seen[hit] / (total[hit] + kinds[hit]))
            left &= ~hit
            esc = left & (kinds > 0)
            out[esc] += np.log10(kinds[esc] / (total[esc] + kinds[esc]))

    less, fewer = np.zeros(len(grams)), np.zeros(len(grams))  # excluded: observations, bytes
    for k, o in enumerate(by_order):
        c = o.at[at]
        step(o.n[at], o.total[c] - less, o.kinds[c] - fewer)
        less, fewer = o.shorter[c], o.kinds[c].astype(float)
        if k < len(suffix):
            at = suffix[k][at]
    before, byte = (grams >> 8) & 255, grams & 255
    step(pairs[before, byte], pairs.sum(axis=1)[before] - less, (pairs > 0).sum(axis=1)[before] - fewer)
    less = (np.where(pairs > 0, single, 0).sum(axis=1))[before]
    fewer = (pairs > 0).sum(axis=1)[before].astype(float)
    kinds = (single > 0).sum()
    step(single[byte], single.sum() - less, kinds - fewer)
    out[left] -= np.log10(256 - kinds)
    return out


def gram_costs(trie: DataFrame) -> DataFrame:
    """``trie(gram, n)``, one row per gram, to ``(gram, value)``: log10 of the probability of the last
    byte after the others, from the counts of the whole table (grams may count 0)."""
    pairs = np.zeros((256, 256), np.int64)
    for r in trie.groupBy(F.col("gram").bitwiseAND(F.lit(65535)).alias("pair")).agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        pairs[r.pair >> 8, r.pair & 255] = r.n

    def run(batches):
        for table, _ in whole_groups(batches, "tail"):
            gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
            order = np.argsort(gram)
            value = costs_of(gram[order], n[order], pairs)
            yield pa.RecordBatch.from_arrays([pa.array(gram[order]), pa.array(value)], ["gram", "value"])

    tail = F.shiftright("gram", 8).bitwiseAND(F.lit(65535)).alias("tail")
    return trie.select(tail, "gram", "n").repartition("tail").sortWithinPartitions("tail").mapInArrow(run, "gram long, value double")


def _answered(left: pa.Table, right: pa.Table) -> pa.Table:
    """Scores the texts of one bucket with the answers to its questions."""
    is_gram = pc.is_valid(right.column("gram"))
    known = right.filter(is_gram)
    order = np.argsort(known.column("gram").to_numpy())
    gram, cost = known.column("gram").to_numpy()[order], known.column("value").to_numpy()[order]
    known = right.filter(pc.invert(is_gram))
    words, word_value = known.column("word").combine_chunks(), known.column("value").to_numpy()
    n = left.num_rows
    score, base, n_tokens, n_known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for first, texts in _slices(left.column("_text")):
        rows = slice(first, first + len(texts))
        g, place, starts = _grams(texts)
        here = np.minimum(np.searchsorted(gram, g), len(gram) - 1)  # grams without a score are not used
        score[rows] = np.add.reduceat(cost[here][place], starts)
        w, at, sizes = _tokens(texts)
        value = word_value[pc.index_in(w, value_set=words).to_numpy()]
        starts = np.cumsum(sizes) - sizes
        base[rows] = np.add.reduceat(value[at], starts)
        n_known[rows] = np.add.reduceat((value > 0)[at].astype(np.int64), starts)
        n_tokens[rows] = sizes
    return pa.table({"doc_id": left.column("doc_id"), "_learn": left.column("_learn"), "n_tokens": n_tokens, "n_known": n_known, "base_sum": base, "score": score})


def score(docs: DataFrame, learn: Column, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` to one row per document: ``doc_id, learned, n_tokens, n_known,
    train_tokens, base_score, score``. base_score is the add-one unigram log10 probability of the
    tokens, score the model's log10 probability of the bytes of the text and its end."""
    flat = [c for c, t in docs.dtypes if not t.startswith(("map", "variant"))]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    dealt = docs.select("doc_id", F.col("text").cast("binary").alias("_text"), F.coalesce(learn, F.lit(False)).alias("_learn"),
                        F.pmod(F.xxhash64(*flat), F.lit(buckets)).alias("_bucket"))
    asked = materialise(dealt.groupBy("_bucket").applyInArrow(_questions, "bucket long, gram long, word binary, n long"), "ppm-questions")

    grams = asked.filter("gram is not null").select("bucket", "gram", "n")
    costs = gram_costs(materialise(grams.groupBy("gram").agg(F.sum("n").alias("n")), "ppm-trie"))
    by_gram = grams.select("bucket", "gram").join(costs, "gram").select("bucket", "gram", F.lit(None).cast("binary").alias("word"), "value")

    by_word = Window.partitionBy("word")
    tokens = asked.filter("word is not null").select(
        "bucket", "word", "n", F.sum("n").over(by_word).alias("c"), (F.min("bucket").over(by_word) == F.col("bucket")).alias("once"))
    tokens = materialise(tokens.select("bucket", "word", "n", "once", F.log10(F.col("c") + 1).alias("value")), "ppm-tokens")
    answers = by_gram.unionByName(tokens.select("bucket", F.lit(None).cast("long").alias("gram"), "word", "value"))

    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("once") & (F.col("value") > 0)).alias("v")).first()
    id_type = dict(docs.dtypes)["doc_id"]
    out = dealt.groupBy("_bucket").cogroup(answers.groupBy("bucket")).applyInArrow(
        _answered, f"doc_id {id_type}, _learn boolean, n_tokens long, n_known long, base_sum double, score double")
    return out.select("doc_id", F.col("_learn").alias("learned"), "n_tokens", "n_known", F.lit(total.n).cast("long").alias("train_tokens"),
                      (F.col("base_sum") - F.col("n_tokens") * F.log10(F.lit(float(total.n + total.v + 1)))).alias("base_score"), "score")

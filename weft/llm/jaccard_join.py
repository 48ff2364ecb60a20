"""Operator 2: n-gram Jaccard join with PartEnum signatures.

A text's set is its distinct word n-grams (64-bit fingerprints). Sizes fall into bands; two sets
with Jaccard similarity of at least ``percent`` per cent, the smaller of size at most u, differ
in at most k = u * (100 - percent) / percent features. Features are dealt to n1 partitions, each
to n2 parts, and every subset of n2 - k2 parts of a partition is a signature: its partition, its
parts, and the projection of the set on them. With n1 * (k2 + 1) > k some partition holds at most
k2 of the differences, so one of its subsets is free of them and the two sets share a signature.
For k <= 3 there is one partition of k + 2 parts, all pairs of parts enumerated. Beyond ``most``
differences a band enumerates single partitions: a set's signatures are then k + 1 instead of 1.5 k. A set also signs
in the lower band that its smaller partners may fall in.

Empty projections would tie unrelated sets together. A band therefore has some spare partitions;
a set signs its empty projections only if more partitions than the spare ones have any, which
keeps every qualifying pair (a partition without differences and without empty projections is
left for one of the two, or both sign the empty ones).

Candidates are checked exactly, and no signature's members are all paired. First every node tries
one hub of its signatures. Members that are linked already (through whatever) need no further
comparison; the members of one signature in different components are compared in blocks of at most
``BLOCK`` members, by their sketches: bits of the parity of the features that fall on them, 8 to 16
for each feature. Two sketches differ in no more bits than the sets in features, and in nearly as many,
so what is left to check are pairs that qualify or nearly do.
In ``NEAR_ROUNDS`` each node tries the nearest such member of its largest signature that still holds
several components, which joins components as a minimum spanning forest grows; the closing pass looks at
all signatures and tries every pair that is left.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; fewer than n
words give one n-gram of all words; null or empty texts, and texts without words, have an empty
set and link with nothing. Equal sets are one node, so copies and repeated rows cost nothing.
component_id is the smallest non-null doc_id of the component (null if all are null); every
input row gives one output row. Equality of sets and of n-grams is that of 64-bit fingerprints.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm import textvec
from weft.llm.graph import components, joined
from weft.llm.scratch import materialise
from weft.llm.stream import whole_groups

NEAR_ROUNDS = 3
BLOCK = 1024
ALL = 1 << 60
_SKETCH_BITS = 1 << 14  # of the longest sets; 8 to 16 times the size of others


def ngram_sets(texts: list[bytes | None], n: int):
    """For each text the sorted distinct fingerprints of its n-grams of words."""
    for w in textvec.word_hashes([None if t is None else t.lower() for t in texts]):
        if len(w) >= n:
            yield np.unique(textvec.fold(*(w[i:len(w) - n + 1 + i] for i in range(n))))
        elif len(w):
            yield textvec.fold(*(w[i:i + 1] for i in range(len(w))))
        else:
            yield w


def _bands() -> list[int]:
    """Lower ends of the size bands, each half as large again as the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


_EDGES = _bands()
_PLANS: dict[tuple, tuple] = {}


def _plan(*key: int) -> tuple:
    if key not in _PLANS:
        _PLANS[key] = _new_plan(*key)
    return _PLANS[key]


def _new_plan(low: int, high: int, percent: int, n2: int, k2: int, most: int) -> tuple:
    """Partitions, spare ones, and the subsets of parts (as a 0/1 matrix) of the band."""
    k = high * (100 - percent) // percent
    if k == 0:
        return 1, 0, np.ones((1, 1), np.uint64)
    if k <= 3:
        n1, n2, k2, spare = 1, k + 2, k, 0
    else:
        if k > most:
            n2, k2 = 1, 0
        n1 = k // (k2 + 1) + 1
        subsets = len(list(itertools.combinations(range(n2), n2 - k2)))
        empty = n1 * subsets * np.exp(-low / n1 * (n2 - k2) / n2)
        spare = int(empty * 1.5) + 2
        n1 += spare
    return n1, spare, np.array([[i in c for i in range(n2)] for c in itertools.combinations(range(n2), n2 - k2)], np.uint64)


def signatures(features: np.ndarray, percent: int, n2: int, k2: int, most: int = ALL) -> np.ndarray:
    """Signatures of one set of distinct fingerprints."""
    size = len(features)
    edges = _EDGES
    own = bisect_right(edges, size) - 1
    first = bisect_right(edges, max(1, -(-size * percent // 100))) - 1
    place, value = textvec.mix(features ^ np.uint64(0x1234567887654321)), textvec.mix(features)
    out = []
    for band in range(first, own + 1):
        n1, spare, subsets = _plan(edges[band], edges[band + 1] - 1, percent, n2, k2, most)
        parts = subsets.shape[1]
        at = ((place >> np.uint64(32)) * np.uint64(n1 * parts) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(n1 * parts, np.uint64)
        np.add.at(sums, at, value)
        projections = sums.reshape(n1, parts) @ subsets.T
        names = np.arange(projections.size, dtype=np.uint64).reshape(projections.shape)
        signed = textvec.fold(projections, names, np.full(projections.shape, band, np.uint64))
        empty = (np.bincount(at, minlength=n1 * parts).reshape(n1, parts) @ subsets.T.astype(np.int64)) == 0
        out.append(signed[~empty] if empty.any(axis=1).sum() <= spare else signed.ravel())
    return np.concatenate(out)


def _sketch(features: np.ndarray) -> bytes:
    """Parity of the features on each bit; the number of bits is a power of two."""
    bits = min(_SKETCH_BITS, 1 << (8 * len(features) - 1).bit_length())
    odd = np.bincount((textvec.mix(features ^ np.uint64(0x7A5C39E6D18B4F02)) >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sketches(held: list[bytes]) -> np.ndarray:
    """Sketches as rows of words; longer ones are folded to the length of the shortest."""
    bits = min(map(len, held))

    def folded(x: bytes) -> bytes:
        return x if len(x) == bits else np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, bits), axis=0).tobytes()

    return np.frombuffer(b"".join(folded(x) for x in held), np.uint8 if bits < 8 else np.uint64).reshape(len(held), -1)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the features in one set only, for rows of sketches."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _fingerprint(features: np.ndarray) -> int:
    total = np.array([textvec.mix(features).sum(dtype=np.uint64)])
    return int(textvec.fold(total, np.array([len(features)], np.uint64)).view(np.int64)[0])


def _describe(docs: DataFrame, n: int) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, node, text_key, sketch`` (node and sketch null
    for an empty set)."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            size, node, sketch = [], [], []
            for s in ngram_sets(batch.column(1).cast(pa.binary()).to_pylist(), n):
                size.append(len(s))
                node.append(_fingerprint(s) if len(s) else None)
                sketch.append(_sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(node, pa.int64()), batch.column(2), pa.array(sketch, pa.binary())],
                ["doc_id", "n_shingles", "node", "text_key", "sketch"])

    return docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("text_key")).mapInArrow(
        run, f"doc_id {id_type}, n_shingles long, node long, text_key binary, sketch binary")


def _signed(docs: DataFrame, n: int, percent: int, n2: int, k2: int, most: int) -> DataFrame:
    """``(sig, node)`` rows of all sets."""

    def run(batches):
        seen: set[int] = set()  # copies within a task sign once
        for batch in batches:
            node, sigs = [], []
            for s in ngram_sets(batch.column(0).cast(pa.binary()).to_pylist(), n):
                name = _fingerprint(s) if len(s) else None
                if name is not None and name not in seen:
                    seen.add(name)
                    node.append(name)
                    sigs.append(signatures(s, percent, n2, k2, most).view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sigs])))
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], ["node", "sigs"])

    rows = docs.select("text").mapInArrow(run, "node long, sigs array<long>")
    return rows.select(F.explode("sigs").alias("sig"), "node")


def _close_enough(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches leave room for the threshold."""
    def side(x):
        return nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))

    def run(batches):
        for batch in batches:
            col = dict(zip(["a", "b", "n_a", "n_b", "s_a", "s_b"], batch.columns, strict=True))
            n = [col[x].to_numpy().astype(np.int64) for x in ("n_a", "n_b")]
            # |A - B| + |B - A| <= (100 - p) / (100 + p) * (|A| + |B|) when the similarity is p per cent
            apart = np.array([_differ(x[:1], x[1:])[0] for x in map(_sketches, zip(col["s_a"].to_pylist(), col["s_b"].to_pylist(), strict=True))], np.int64)
            ok = apart * (100 + percent) <= (n[0] + n[1]) * (100 - percent)
            yield pa.RecordBatch.from_arrays([col["a"].filter(pa.array(ok)), col["b"].filter(pa.array(ok))], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _may_link(members: DataFrame, nodes: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """``members(sig, node, label, size, asks)`` to the pairs ``(a, b)`` that share a signature, have
    different labels, and may qualify by their sketches; for each row that asks the nearest one, or all."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    other = F.sequence(F.lit(0), n - 1)
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    cells = F.transform(other, lambda j: F.struct(F.least(own, j).alias("x"), F.greatest(own, j).alias("y"), (own > j).alias("second")))
    rows = members.select("sig", "node", "label", "asks", F.explode(cells).alias("_c")).join(nodes.select("node", "n_shingles", "sketch"), "node")
    rows = rows.select(F.xxhash64("sig", "_c.x", "_c.y").alias("cell"), F.col("_c.second").alias("second"), (F.col("_c.x") < F.col("_c.y")).alias("two"),
                       "node", "label", "asks", F.col("n_shingles").alias("n"), "sketch")

    def run(batches):
        for t, edges in whole_groups(batches, "cell"):
            node, label, n = (t.column(c).to_numpy() for c in ("node", "label", "n"))
            second, two, asks = (t.column(c).to_numpy() for c in ("second", "two", "asks"))
            held = t.column("sketch").to_pylist()
            best: dict[int, tuple] = {}
            out = set()
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                sketch = _sketches(held[x:y])
                for i in (x + np.flatnonzero(asks[x:y])).tolist():
                    # in a cell of two blocks each node meets the other block's
                    at = x + np.flatnonzero((label[x:y] != label[i]) & ((second[x:y] != second[i]) | (not two[x])))
                    if not nearest:
                        at = at[node[at] < node[i]] if not two[x] else at[:0] if second[i] else at
                    if not len(at):
                        continue
                    apart = _differ(sketch[at - x], sketch[i - x])
                    ok = apart * (100 + percent) <= (n[at] + n[i]) * (100 - percent)
                    if nearest and ok.any():
                        found = min(zip(apart[ok].tolist(), node[at[ok]].tolist(), strict=True))
                        best[node[i].item()] = min(best.get(node[i].item(), found), found)
                    elif not nearest:
                        out.update((max(v, node[i].item()), min(v, node[i].item()), 0) for v in node[at[ok]].tolist())
            out = [(k, v, d) for k, (d, v) in best.items()] if nearest else list(out)
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in out], pa.int64()) for j in range(3)], ["a", "b", "apart"])

    pairs = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long, apart long")
    if nearest:
        pairs = pairs.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _largest(members: DataFrame) -> DataFrame:
    """Each node asks in its largest signature; the members of the signatures that some node asks in."""
    asked = members.groupBy("node").agg(F.max_by("sig", F.struct("size", "sig")).alias("sig")).withColumn("asks", F.lit(True))
    rows = members.join(asked.select("sig").distinct(), "sig", "left_semi").join(asked, ["node", "sig"], "left")
    return rows.select("sig", "node", "label", "size", F.coalesce("asks", F.lit(False)).alias("asks"))


def _linked(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``(u, v)`` of the pairs that truly qualify."""
    def run(batches):
        for batch in batches:
            a, b, ta, tb = batch.columns
            hubs, keys = b.to_pylist(), tb.cast(pa.binary()).to_pylist()
            new = dict(zip(hubs, keys, strict=True))
            right = dict(zip(new, ngram_sets(list(new.values()), n), strict=True))
            keep = []
            for x, hub in zip(ngram_sets(ta.cast(pa.binary()).to_pylist(), n), hubs, strict=True):
                y = right[hub]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["u", "v"])

    return (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("t_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("t_b")), "b")
            .select("a", "b", "t_a", "t_b").mapInArrow(run, "u long, v long"))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, n2: int = 3, k2: int = 1, most: int = ALL) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_shingles, component_id, class, text_key)``; class names
    the component (null for an empty set), text_key is the md5 of the text (null for a null text)."""
    described = materialise(_describe(docs, n), "jaccard-sets")
    nodes = described.filter("node is not null").groupBy("node").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min("text_key").alias("text_key"))
    # members of signatures that more than one node has; a sorted stream per signature, which spills
    w = Window.partitionBy("sig")
    members = (_signed(docs, n, percent, n2, k2, most)
               .withColumn("hub", F.min("node").over(w)).withColumn("_far", F.max("node").over(w))
               .filter("hub <> _far").select("sig", "node", "hub").distinct())
    members = materialise(members, "jaccard-members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "text_key")
    texts = materialise(
        docs.select(F.unhex(F.md5("text")).alias("text_key"), "text").join(wanted, "text_key")
        .groupBy("node").agg(F.first("text").alias("text")), "jaccard-texts")

    # each node tries the hub that it has most signatures in common with
    pairs = members.filter("node <> hub").groupBy("node", "hub").count().groupBy("node").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
    pairs = _close_enough(pairs.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct(), nodes, percent)
    edges = materialise(_linked(pairs, texts, n, percent), "jaccard-links")
    labels = materialise(components(edges), "jaccard-classes")
    left = NEAR_ROUNDS
    while left >= 0:
        now = members.select("sig", "node").join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))
        open_ = now.groupBy("sig").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("size")).filter("_lo <> _hi")
        met = now.join(open_.select("sig", "size"), "sig").withColumn("asks", F.lit(True))
        if left > 0:
            met = _largest(materialise(met.drop("asks"), "jaccard-open"))
        pairs = _may_link(met, nodes, percent, nearest=left > 0)
        new = materialise(_linked(pairs, texts, n, percent), "jaccard-links")
        if new.isEmpty():
            left = 0 if left > 0 else -1  # nothing near is left to join: on to the closing pass
            continue
        labels = materialise(joined(labels, new), "jaccard-classes")
        left -= 1
    grouped = described.join(labels, "node", "left").withColumn("_class", F.coalesce("label", "node"))
    least = grouped.filter("_class is not null").groupBy("_class").agg(F.min("doc_id").alias("_least"))
    return grouped.join(least, "_class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("_class").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"),
        F.col("_class").alias("class"), "text_key")


def one_per_class(docs: DataFrame, n: int = 5, percent: int = 80, n2: int = 3, k2: int = 1, most: int = 64) -> DataFrame:
    """The rows of ``docs``, all columns, with one row left of each component: that of the smallest
    doc_id (then text digest). Rows with an empty set all stay."""
    classes = jaccard_components(docs.select("doc_id", "text"), n, percent, n2, k2, most)
    stay = (classes.filter("class is not null").groupBy("class", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
            .groupBy("class").agg(F.min_by(F.struct("doc_id", "text_key", "copies"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("_s")).select("_s.*"))
    empty = classes.filter("class is null").groupBy("doc_id", "text_key").agg(F.lit(1).alias("copies")).select("doc_id", "text_key", "copies")
    stay = materialise(stay.unionByName(empty), "jaccard-stay").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text_key"), "copies")
    # the table's own columns travel as one, so no name of theirs meets one of these
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_own"), F.unhex(F.md5("text")).alias("_digest"))
    met = keyed.join(stay, F.col("_own").eqNullSafe(F.col("_id")) & F.col("_digest").eqNullSafe(F.col("_text_key")))
    # rows that repeat an id with its text: one of them
    again = met.filter("copies > 1").dropDuplicates(["_id", "_text_key"])
    return met.filter("copies = 1").unionByName(again).select("_row.*")

"""Operator 5: removal of repeated passages, located by recompression.

Each text is a string of words. Rounds name it again and again: first every run of one word, then,
in each round, every pair of a left symbol and a right one (the side is a fixed bit of the symbol's
name) gets a new name. Names are fingerprints of what they stand for, so all tasks give equal runs
and pairs the same global name without exchanging dictionaries, and equal passages get the same
interior symbols wherever they stand. For each symbol the stretch of words that decides its
existence is tracked; whoever holds this stretch holds the symbol.

A window (``window`` consecutive words) picks one anchor among the symbols decided inside it that
also have ``REACH`` words on both sides there: of the highest round that has one, the one with the
least name. Equal windows pick equal anchors, and neighbouring windows mostly share theirs, so there
are several times fewer anchors than windows. The windows of one anchor make a stretch of words.

Only anchors that two documents share can belong to repeats. Where a stretch as a whole also stands
in a smaller document, all its windows are repeats; inside long passages that settles everything.
What is left are the ends of passages: stretches of one anchor that differ, of which only the
smallest document's copies need a look. Their windows are compared by their own fingerprints. (The
smallest document that holds a window is the smallest that holds its own stretch, else there would
be a smaller one, so no window's first place is missed.) Windows inside one long run have no decided
symbol and are their own anchor.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has none; texts shorter
than a window lose nothing. Rows that share a doc_id are one document for "smaller", and a null
doc_id is larger than all others (rows without an id do not remove each other's words). Every
input row gives one output row. Equality is that of 64-bit fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm import textvec
from weft.llm.scratch import materialise

WINDOW = 13
ROUNDS = 2
REACH = 3
_NO_ID = (1 << 63) - 1


_FAR = 1 << 40


def _runs(name, start, low, high, text):
    """Names maximal runs of one symbol. A symbol or run is decided by itself and both neighbours,
    which show where it ends; at a text's end it stays undecided."""
    n = len(name)
    fresh = np.concatenate(([True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], n) - 1
    size = (last - first + 1).astype(np.uint64)
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    lo = np.where((first > 0) & (text[before] == text[first]), low[before], -_FAR)
    hi = np.where((last < n - 1) & (text[after] == text[first]), high[after], _FAR)
    named = name[first]
    long = size > 1
    named[long] = textvec.fold(named[long], size[long])
    return named, start[first], lo, hi, text[first]


def _pairs(name, start, low, high, text):
    """Names pairs of a left symbol and a right one. A pair is decided by its two symbols, a left
    symbol alone by its right neighbour too, a right one by its left neighbour."""
    n = len(name)
    left = (textvec.mix(name ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(1)).astype(bool)
    joined = text[1:] == text[:-1]
    opens = np.append(left[:-1] & ~left[1:] & joined, False)
    at = np.flatnonzero(~np.concatenate(([False], opens[:-1])))
    paired = opens[at]
    after, before = np.minimum(at + 1, n - 1), np.maximum(at - 1, 0)
    named = name[at]
    named[paired] = textvec.fold(named[paired], name[at[paired] + 1])
    lone_left, lone_right = ~paired & left[at], ~paired & ~left[at]
    has_before, has_after = (at > 0) & (text[before] == text[at]), (at < n - 1) & (text[after] == text[at])
    lo = np.where(lone_right, np.where(has_before, low[before], -_FAR), low[at])
    hi = np.where(paired | lone_left, np.where(has_after, high[after], _FAR), high[at])
    return named, start[at], lo, hi, text[at]


def _window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    return textvec.fold(*(words[i:len(words) - size + 1 + i] for i in range(size)))


def anchors(words: np.ndarray, text: np.ndarray, window: int = WINDOW):
    """Anchors of the windows of several texts, joined (``text`` numbers each word's text in
    ascending order): names of the anchors, one per stretch of windows with the same anchor, and the
    stretch's first and last window as positions in the joined words."""
    n = len(words) - window + 1
    inner = np.flatnonzero(text[:max(n, 0)] == text[window - 1:]) if n > 0 else np.zeros(0, np.int64)
    if not len(inner):
        return np.zeros(0, np.uint64), inner, inner
    at = np.arange(len(words))
    state = (words, at, at, at + 1, text)
    levels = []
    for level in range(ROUNDS):
        # equal neighbours that come up in later rounds have the same side, so they stay apart
        state = _pairs(*(state if level else _runs(*state)))
        levels.append(state[:4])
    chosen, where = np.zeros(len(inner), np.uint64), np.full(len(inner), -1, np.int64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(textvec.mix(words))))  # tells the words around symbols apart
    left = np.arange(len(inner))  # windows without an anchor so far
    for level, (name, start, low, high) in reversed(list(enumerate(levels))):
        # the words around the symbol make its anchor rare enough to tell passages apart
        low, high = np.minimum(low, start - REACH), np.maximum(high, start + REACH + 1)
        low[low < 0] = -_FAR
        high[high > len(words)] = _FAR
        fit = np.flatnonzero(high - low <= window)
        fit = fit[text[low[fit]] == text[high[fit] - 1]]
        if not len(fit) or not len(left):
            continue
        low, high, name = low[fit], high[fit], name[fit]
        name = textvec.fold(name, np.full(len(name), level, np.uint64), (high - low).astype(np.uint64), sums[high] - sums[low])
        # the symbols decided inside window i are those with low >= i and high <= i + window
        a = np.searchsorted(low, inner[left], side="left")
        b = np.searchsorted(high, inner[left] + window, side="right")
        best = _least(name, a, b)
        ok = best >= 0
        chosen[left[ok]] = name[best[ok]]
        where[left[ok]] = low[best[ok]] * (ROUNDS + 1) + level
        left = left[~ok]
    if len(left):
        starts = inner[left]
        chosen[left] = textvec.fold(*(words[starts + i] for i in range(window)))
    first = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (chosen[1:] != chosen[:-1]) | (inner[1:] != inner[:-1] + 1))))
    last = np.append(first[1:], len(inner)) - 1
    return chosen[first], inner[first], inner[last]


def _least(rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Position of the leftmost least rank in each range [a, b), or -1 (ranges are short)."""
    best = np.where(a < b, a, -1)
    for step in range(1, int(max((b - a).max(initial=0), 1))):
        at = a + step
        inside = at < b
        new = np.where(inside, at, best)
        better = inside & (rank[new] < rank[best])
        best = np.where(better, new, best)
    return best


def _texts(col: pa.Array) -> list[bytes | None]:
    return col.cast(pa.binary()).to_pylist()


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64), pa.int64())


def _stretches(docs: DataFrame, window: int) -> DataFrame:
    """``(anchor, span, doc, key, at)``: stretches of windows by anchor. span is the fingerprint of
    the stretch's words, key tells texts apart, at packs the first and last window."""
    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            out: list[list[np.ndarray]] = [[] for _ in range(4)]
            for rows, words, starts in _joined(textvec.word_hashes(_texts(batch.column(1)))):
                name, first, last = anchors(words, np.repeat(np.arange(len(rows)), np.diff(starts)), window)
                span = textvec.range_hashes(words, first, last + window)
                own = np.searchsorted(starts, first, side="right") - 1
                # empty texts share their start with the text after them, which is the one found
                for col, x in zip(out, (name, span, (first - starts[own]) * _PACK + last - starts[own], rows[own]), strict=True):
                    col.append(x)
            if not any(len(c) for c in out[0]):
                continue  # no text here has a whole window
            name, span, at, row = (np.concatenate(c) for c in out)
            doc, key = ids[row], keys[row]
            # what a smaller document of the batch holds as well is settled here: a passage that very
            # many documents share is one row of a batch in its anchor's group, not one per document
            group = textvec.fold(name, span)
            order = np.lexsort((doc, group))
            first = np.concatenate(([True], group[order][1:] != group[order][:-1]))
            least = np.empty(len(order), doc.dtype)
            least[order] = doc[order][np.flatnonzero(first)][np.cumsum(first) - 1]
            settled = doc > least
            name[settled] = textvec.fold(key[settled].view(np.uint64), at[settled].view(np.uint64))
            yield pa.RecordBatch.from_arrays([_longs([name]), _longs([span]), pa.array(doc), pa.array(key), pa.array(at), pa.array(settled)],
                                             ["anchor", "span", "doc", "key", "at", "done"])

    return docs.select("_doc", "text", "_key").mapInArrow(run, "anchor long, span long, doc long, key long, at long, done boolean")


def _joined(texts):
    """Word fingerprints of many texts at a time: row numbers, joined words, starts of the rows."""
    rows, parts, size = [], [], 0
    for i, w in enumerate(texts):
        rows.append(i)
        parts.append(w)
        size += len(w)
        if size > 1 << 16:
            yield np.array(rows), np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts])
            rows, parts, size = [], [], 0
    if parts:
        yield np.array(rows), np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts])


def _windows_of(texts: DataFrame, window: int) -> DataFrame:
    """``(window, doc, key, at)`` for the windows in the given stretches of each text."""
    def run(batches):
        for batch in batches:
            ids, keys, spans = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), batch.column(3).to_pylist()
            name, at, row = [], [], []
            for i, words in enumerate(textvec.word_hashes(_texts(batch.column(1)))):
                h = _window_hashes(words, window)
                inside = np.unique(np.concatenate([np.arange(s // _PACK, s % _PACK + 1) for s in spans[i]]))
                name.append(h[inside])
                at.append(inside)
                row.append(np.full(len(inside), i))
            row = np.concatenate(row) if row else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([_longs(name), pa.array(ids[row]), pa.array(keys[row]), _longs(at)], ["window", "doc", "key", "at"])

    return texts.select("_doc", "text", "_key", "spans").mapInArrow(run, "window long, doc long, key long, at long")


_PACK = 1 << 31  # two window numbers in one long


def _kept(docs: DataFrame, window: int) -> DataFrame:
    """Removes the words covered by the windows in ``spots`` (packed first and last ones)."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            total, removed, digest, text_out = [], [], [], []
            for text, spots in zip(_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                if spots:
                    cover = np.zeros(len(words) + 1, np.int64)
                    at = np.array(spots)
                    np.add.at(cover, at // _PACK, 1)
                    np.add.at(cover, at % _PACK + window, -1)
                    drop = np.cumsum(cover[:-1]) > 0
                    left = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                else:
                    left = words
                kept = b" ".join(left)
                total.append(len(words))
                removed.append(len(words) - len(left))
                digest.append(hashlib.sha256(kept).hexdigest())
                text_out.append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(text_out, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return docs.select("doc_id", "text", "spots").mapInArrow(
        run, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_words, n_removed, kept_sha256, kept_text)``."""
    # rows of one document and equal text have the same windows and the same answer: one key
    docs = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_doc"),
                       F.xxhash64("doc_id", "text").alias("_key"))
    by_anchor, by_span = Window.partitionBy("anchor"), Window.partitionBy("anchor", "span")
    rows = _stretches(docs, window).select(
        "key", "at", "doc", "done", F.min("doc").over(by_span).alias("_own"), F.min("doc").over(by_anchor).alias("_lo"),
        F.max("doc").over(by_anchor).alias("_hi"), F.min("span").over(by_anchor).alias("_s0"), F.max("span").over(by_anchor).alias("_s1"))
    settled = F.col("done") | (F.col("doc") > F.col("_own"))
    shared = (F.col("_lo") != F.col("_hi")) & (settled | (F.col("_s0") != F.col("_s1")))
    rows = rows.filter(F.col("done") | shared).select("key", "at", settled.alias("settled"))
    rows = materialise(rows, "repeat-stretches")
    spans = rows.filter("not settled").groupBy(F.col("key").alias("_key")).agg(F.collect_set("at").alias("spans"))
    windows = materialise(_windows_of(docs.join(spans, "_key"), window), "repeat-windows")
    least = windows.groupBy("window").agg(F.min("doc").alias("_lo"), F.max("doc").alias("_hi")).filter("_lo <> _hi").select("window", "_lo")
    single = windows.join(least, "window").filter("doc > _lo").select("key", (F.col("at") * _PACK + F.col("at")).alias("at"))
    spots = rows.filter("settled").select("key", "at").unionByName(single).groupBy(F.col("key").alias("_key")).agg(F.collect_set("at").alias("spots"))
    spots = materialise(spots, "repeat-spots")
    return _kept(docs.join(spots, "_key", "left"), window)

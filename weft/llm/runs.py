"""Operator 12: periodic runs of words, by branching tandem repeats over a suffix array.

A run is a stretch of words with smallest period ``q`` and at least ``max(min_length, min_copies * q)``
words that neither neighbour extends. Texts are handled many at a time: their words become numbers,
joined with a separator of its own behind each text, so nothing matches across texts.

1. Ranks of all stretches of 1, 2, 4, ... words (prefix doubling, in which only ties are sorted
   again) end as the inverse suffix array. A run holds two equal stretches of 16 words; texts in which
   no stretch of the largest such power of two repeats are settled there and leave the array.
2. LCP values come from the ranks. LCP intervals need no tree: an interval of depth ``d`` is an index
   with the nearest smaller values on both sides, its children lie between its own indices.
3. Each suffix ``i`` of all children but an interval's largest looks up ``ISA[i + d]`` and
   ``ISA[i - d]``: inside the interval but in another child, the two suffixes share exactly ``d``
   words, so a square of period ``d`` ends where its run ends.
4. The square is rotated to the left as far as the words agree (by ranks again), which gives the run;
   runs of the same stretch keep the least period.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, compared whole; a null text has none. Every input
row gives one row; a text without a run gives an empty list and keeps all its words. All words of all
texts take part, however long; memory follows the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_LENGTH = 24
MIN_COPIES = 3
GROUP_WORDS = 1 << 18


def _refine(rank: np.ndarray, width: int, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of stretches of ``2 * width`` words from those of ``width`` words; ``ties`` are the places
    whose rank is shared. A rank is the number of stretches that are smaller."""
    behind = np.full(len(ties), -1, np.int64)
    inside = ties + width < len(rank)
    behind[inside] = rank[ties[inside] + width]
    order = np.lexsort((behind, rank[ties]))
    at, first, second = ties[order], rank[ties][order], behind[order]
    new_group = np.concatenate(([True], first[1:] != first[:-1]))
    fresh = new_group.copy()
    fresh[1:] |= second[1:] != second[:-1]
    index = np.arange(len(at))
    group_start = np.maximum.accumulate(np.where(new_group, index, 0))
    value_start = np.maximum.accumulate(np.where(fresh, index, 0))
    out = rank.copy()
    out[at] = first + (value_start - group_start)
    alone = fresh & np.append(fresh[1:], True)
    return out, np.sort(at[~alone])


def _ranks(words: np.ndarray) -> np.ndarray:
    """Rank of each number: how many of them are smaller."""
    count = np.bincount(words)
    return (np.cumsum(count) - count)[words].astype(np.int32)


def _shared(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """Words that the stretches from ``a`` and ``b`` on (or up to before them) have in common."""
    n, size = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        x, y = (a + size, b + size) if forward else (a - size - step, b - size - step)
        fit = (np.minimum(x, y) >= 0) & (np.maximum(x, y) + step <= n)
        same = fit.copy()
        same[fit] = levels[k][x[fit]] == levels[k][y[fit]]
        # a longer stretch can only be the same where this one is
        size[same] += step
    return size


def _nearest_smaller(value: np.ndarray, or_equal: bool) -> np.ndarray:
    """For each index with a positive value the nearest one to its left with a smaller (or equal) value;
    the value of index 0 is negative. All indices jump at once, each over what others have passed."""
    to = np.arange(-1, len(value) - 1)
    to[0] = 0
    open_ = np.flatnonzero(value > 0)
    while len(open_):
        there = value[to[open_]]
        stop = (there <= value[open_]) if or_equal else (there < value[open_])
        open_ = open_[~stop]
        to[open_] = to[to[open_]]
    return to


def _squares(isa: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all branching squares."""
    n = len(isa)
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    # lcp[k] between the suffixes k - 1 and k of the order; sentinels at both ends
    lcp = np.full(n + 1, -1, np.int64)
    lcp[1:n] = _common(levels, sa[:-1], sa[1:], True)
    left = _nearest_smaller(lcp, False)
    left_equal = _nearest_smaller(lcp, True)
    right = n - _nearest_smaller(lcp[::-1], False)[::-1]
    right_equal = n - _nearest_smaller(lcp[::-1], True)[::-1]
    k = np.flatnonzero(lcp > 0)
    # the child that ends before an index; the interval's last child begins at its last index
    last = lcp[right_equal[k]] != lcp[k]
    index = np.concatenate([k, k[last]])
    lo = np.concatenate([left_equal[k], k[last]])
    hi = np.concatenate([k, right[k[last]]])
    top, end, depth = left[index], right[index], lcp[index]
    size = hi - lo
    # all children of an interval but its largest
    order = np.lexsort((-size, end, top))
    largest = np.concatenate(([True], (top[order][1:] != top[order][:-1]) | (end[order][1:] != end[order][:-1])))
    small = order[~largest]
    lo, hi, top, end, depth, size = (x[small] for x in (lo, hi, top, end, depth, size))
    starts, periods = [], []
    cut = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(size) // (4 * GROUP_WORDS))) + 1, [len(size)])) if len(size) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        s = size[a:b]
        owner = np.repeat(np.arange(a, b), s)
        suffix = sa[np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + lo[owner]]
        for sign in (1, -1):
            other = suffix + sign * depth[owner]
            ok = np.flatnonzero((other >= 0) & (other < n))
            place, own = isa[other[ok]], owner[ok]
            hit = (place >= top[own]) & (place < end[own]) & ((place < lo[own]) | (place >= hi[own]))
            own, ok = own[hit], ok[hit]
            starts.append(np.minimum(suffix[ok], other[ok]))
            periods.append(depth[own])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def find_runs(words: np.ndarray, text: np.ndarray, min_length: int = MIN_LENGTH, min_copies: int = MIN_COPIES):
    """Runs in several texts. ``words`` are numbers from 0, all texts joined, each with a number of
    its own behind it; ``text`` numbers the text of each place in ascending order. Gives starts (in the
    joined words), lengths and periods, ordered by start and period."""
    min_copies = max(min_copies, 2)
    none = np.zeros(0, np.int64)
    # a run's first word and the one a period later start equal stretches of this many words
    least = min_length - min_length // min_copies
    settled = least < 2
    place = np.arange(len(words))
    levels, width = [_ranks(words)], 1
    ties = _shared(levels[0])
    while len(ties):
        rank, ties = _refine(levels[-1], width, ties)
        levels.append(rank)
        width *= 2
        if settled or not width <= least < width * 2:
            continue
        # a text without a repeat of this length has no run: the others begin anew
        settled = True
        order = ties[np.lexsort((rank[ties], text[ties]))]
        twice = (text[order][1:] == text[order][:-1]) & (rank[order][1:] == rank[order][:-1])
        inside = np.flatnonzero(np.isin(text, np.unique(text[order][1:][twice])))
        if len(inside) < len(words):
            place, text = inside, text[inside]
            words = np.unique(words[inside], return_inverse=True)[1]
            levels, width = [_ranks(words)], 1
            ties = _shared(levels[0])
    if not settled or not len(words):
        return none, none, none
    start, period = _squares(levels[-1].astype(np.int64), levels)
    back = _common(levels, start, start + period, False)
    end = start + 2 * period
    start = start - back
    length = end - start
    ok = length >= np.maximum(min_length, min_copies * period)
    start, length, period = start[ok], length[ok], period[ok]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    least_period = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1]))) if len(start) else np.zeros(0, bool)
    start, length, period = start[least_period], length[least_period], period[least_period]
    order = np.lexsort((period, start))
    return place[start[order]], length[order], period[order]


def _groups(column: pa.Array):
    """Texts with about ``GROUP_WORDS`` words at a time, as lists of words."""
    held, size = [], 0
    for value in column:
        t = value.as_buffer()
        held.append([] if t is None else t.to_pybytes().split())
        size += len(held[-1])
        if size >= GROUP_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _texts_with_runs(lists: list[list[bytes]], min_length: int, min_copies: int):
    """For each list of words: its runs and the words that stay."""
    sizes = np.fromiter((len(w) for w in lists), np.int64, len(lists))
    coded = pa.array([x for w in lists for x in w], pa.binary()).dictionary_encode()
    base = np.cumsum(sizes + 1) - sizes - 1
    own = np.repeat(np.arange(len(lists)), sizes)
    words = np.empty(int(sizes.sum()) + len(lists), np.int64)
    words[np.arange(len(own)) + own] = coded.indices.to_numpy()
    words[base + sizes] = len(coded.dictionary) + np.arange(len(lists))
    text = np.repeat(np.arange(len(lists)), sizes + 1)
    start, length, period = find_runs(words, text, min_length, min_copies)
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    drop = np.cumsum(drop[:-1]) > 0
    whose = np.searchsorted(base, start, side="right") - 1
    bounds = np.searchsorted(whose, np.arange(len(lists) + 1))
    for i, w in enumerate(lists):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            yield [], w
            continue
        gone = drop[base[i]:base[i] + len(w)].tolist()
        runs = [{"start": int(s), "length": int(n), "period": int(p)} for s, n, p in zip(start[a:b] - base[i], length[a:b], period[a:b], strict=True)]
        yield runs, [x for x, d in zip(w, gone, strict=True) if not d]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_copies: int = MIN_COPIES) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_words, runs, collapsed_text)``: ``runs`` is an array of
    ``(start, length, period)`` in words, by start and period; the collapsed text is left with the first
    period of each run, its words joined by one space."""
    id_type = dict(docs.dtypes)["doc_id"]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            done = 0
            for lists in _groups(batch.column(1)):
                runs, kept = zip(*_texts_with_runs(lists, min_length, min_copies), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(lists)), pa.array([len(w) for w in lists], pa.int64()), pa.array(runs, run_type),
                     pa.array([b" ".join(w) for w in kept], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed_text"])
                done += len(lists)

    return docs.select("doc_id", docs["text"].cast("binary")).mapInArrow(
        run, f"doc_id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string")

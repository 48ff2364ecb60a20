"""Scoring kernel of the vector searches: blocks of documents against a set of queries, in Arrow batches.

The queries are grouped by what they ask of a document (equal filter values, tags of which it must
have one). A block of documents is divided by its filter values, and its rows per asked tag are
listed; a group of queries is multiplied with the rows that it allows and with no others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Scores of one step, and queries of one step: the memory of a task does not grow with its tables.
TILE = 1 << 19
TILE_QUERIES = 512
FIRST_ROWS = 64  # documents of a step's first tile; the tiles after it double, so that few pairs pass the last place


def matrix(column) -> np.ndarray:
    """A list column as a float64 matrix; all lists have one length (else an error)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten()
    sizes = pc.list_value_length(column)
    if pc.min(sizes).as_py() != pc.max(sizes).as_py():
        raise ValueError("vectors of one table must have one length")
    return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _values(table, names) -> list[tuple]:
    return list(zip(*(table.column(n).to_pylist() for n in names), strict=True)) if names else [()] * table.num_rows


def _asked_rows(table, names) -> dict[tuple, np.ndarray]:
    """Rows per filter values; rows with a null among them match nothing."""
    if not names:
        return {(): np.arange(table.num_rows)}
    code = np.zeros(table.num_rows, np.int64)
    dictionaries = []
    for n in names:
        column = table.column(n)
        coded = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
        dictionaries.append(coded.dictionary)
        code = code * (len(coded.dictionary) + 1) + coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    found, first = np.unique(code[order], return_index=True)
    out = {}
    for c, rows in zip(found.tolist(), np.split(order, first[1:]), strict=True):
        value = []
        for d in reversed(dictionaries):
            c, at = divmod(c, len(d) + 1)
            value.append(d[at].as_py() if at < len(d) else None)
        if None not in value:
            out[tuple(reversed(value))] = rows
    return out


class Queries:
    """The query side: matrices, per-query k, and groups of queries that ask the same."""

    def __init__(self, table: pa.Table, keys: list[str], kmax: int, filters: list[str], tags: list[str], metric: str):
        self.keys, self.metric = table.select(keys), metric
        self.matrix = matrix(table.column("embedding"))
        n = len(self.matrix)
        norm = np.linalg.norm(self.matrix, axis=1) if n else np.zeros(0)
        if metric == "cosine":
            self.matrix = self.matrix / np.where(norm > 0, norm, 1)[:, None]
        self.unscored = norm == 0
        self.small = self.matrix.astype(np.float32) if metric == "cosine" else None
        # what a product of unit vectors in single precision may be off by
        self.slack = (self.matrix.shape[1] + 16) * 2.0 ** -23
        self.square = (self.matrix * self.matrix).sum(axis=1) if metric == "sqeuclidean" else None
        self.k = np.full(n, kmax)
        if "_k" in table.schema.names:
            self.k = np.minimum(kmax, table.column("_k").fill_null(0).to_numpy().astype(np.int64))
        self.kmax = int(max(self.k.max(initial=0), 0))
        asked: dict[tuple, dict[tuple, list[int]]] = {}
        lists = [[frozenset(x or ()) for x in table.column(t).to_pylist()] for t in tags]
        for i, value in enumerate(_values(table, filters)):
            if None not in value:
                asked.setdefault(value, {}).setdefault(tuple(x[i] for x in lists), []).append(i)
        self.asked = {v: {t: np.array(rows) for t, rows in g.items()} for v, g in asked.items()}
        self.vocabulary = [{t for x in col for t in x} for col in lists]
        self.scores = np.full((n, self.kmax), -np.inf)
        self.raw = np.full((n, self.kmax), -np.inf)
        self.docs = np.full((n, self.kmax), np.iinfo(np.int64).max)
        self.scored = 0  # products of a query and a document

    def meet(self, table, filters: list[str], tags: list[str], min_score, max_score) -> None:
        """Ranks one block of documents ``(doc_id, embedding, filters, tags)``."""
        if not table.num_rows or not self.kmax:
            return
        d = None
        ids = table.column("doc_id").to_numpy()
        postings = [_postings(table.column(t), words) for t, words in zip(tags, self.vocabulary, strict=True)]
        for value, rows in _asked_rows(table, filters).items():
            for wanted, who in self.asked.get(value, {}).items():
                allowed = rows
                for words, posting in zip(wanted, postings, strict=True):
                    if words:  # none wanted: no restriction
                        hit = [posting[w] for w in words if w in posting]
                        allowed = np.intersect1d(allowed, np.concatenate(hit)) if hit else allowed[:0]
                if not len(allowed):
                    continue
                if d is None:
                    d = matrix(table.column("embedding"))
                    norm = np.linalg.norm(d, axis=1)
                    if self.metric == "cosine":
                        d = d / np.where(norm > 0, norm, 1)[:, None]
                self._rank(who, d[allowed], ids[allowed], norm[allowed], min_score, max_score)

    def _rank(self, who, d, ids, norm, min_score, max_score) -> None:
        self.scored += len(who) * len(d)
        if self.metric == "cosine":  # a vector of zeros has no cosine
            who, some = who[~self.unscored[who]], norm > 0
            d, ids = d[some], ids[some]
        for a in range(0, len(who), TILE_QUERIES):
            asked = who[a:a + TILE_QUERIES]
            lo, step, most = 0, FIRST_ROWS, max(1, TILE // len(asked))
            while lo < len(d):
                rows = slice(lo, lo + min(step, most))
                self._tile(asked, d[rows], ids[rows], min_score, max_score)
                lo, step = rows.stop, 2 * step

    def _tile(self, who, part, ids, min_score, max_score) -> None:
        """Ranks a tile. A pair whose score, on 9 decimals, is below its query's last place is left out."""
        floor = self.scores[who, -1] - 1e-9
        s = None
        if self.metric == "cosine":
            if min_score is not None:
                floor = np.maximum(floor, min_score)
            near = self.small[who] @ part.astype(np.float32).T
            close = near >= (floor - self.slack).astype(np.float32)[:, None]
        else:
            s = self._scores(who, part)
            close = s >= floor[:, None]
        if np.count_nonzero(close) <= TILE // 64:
            r, c = np.divmod(np.flatnonzero(close), close.shape[1])  # much faster than nonzero on two dimensions
            raw = s[r, c] if s is not None else np.einsum("ij,ij->i", self.matrix[who[r]], part[c])
            self._join(who, r, raw, ids[c], self._allowed(raw, min_score, max_score))
            return
        s = self._scores(who, part) if s is None else s
        s[~self._allowed(s, min_score, max_score)] = -np.inf
        # ranked on 9 decimals, so last-bit noise of the float sum never reorders ties
        self._merge(who, np.round(s, 9), s, ids)

    def _scores(self, who, part) -> np.ndarray:
        """Larger is better: squared distances are negated."""
        s = self.matrix[who] @ part.T
        if self.metric == "sqeuclidean":
            s = -np.maximum(self.square[who][:, None] - 2.0 * s + (part * part).sum(axis=1)[None, :], 0.0)
        return s

    def _allowed(self, s, min_score, max_score) -> np.ndarray:
        value = -s if self.metric == "sqeuclidean" else s
        out = np.ones(s.shape, bool)
        if min_score is not None:
            out &= ~(value < min_score)
        if max_score is not None:
            out &= ~(value > max_score)
        return out

    def _join(self, who, r, raw, ids, allowed) -> None:
        """Takes single pairs (the r-th of ``who``, a document, a score) into the lists of their queries."""
        r, raw, ids = r[allowed], raw[allowed], ids[allowed]
        hit, own = np.unique(r, return_inverse=True)
        rows = who[hit]
        own = np.concatenate([np.repeat(np.arange(len(hit)), self.kmax), own])
        scores = np.concatenate([self.scores[rows].ravel(), np.round(raw, 9)])
        values = np.concatenate([self.raw[rows].ravel(), raw])
        docs = np.concatenate([self.docs[rows].ravel(), ids])
        order = np.lexsort((docs, -scores, own))
        own = own[order]
        first = order[np.arange(len(own)) - np.searchsorted(own, own) < self.kmax].reshape(len(hit), self.kmax)
        self.scores[rows], self.raw[rows], self.docs[rows] = scores[first], values[first], docs[first]

    def _merge(self, who, rounded, raw, ids) -> None:
        k = min(self.kmax, rounded.shape[1])
        at = np.argpartition(-rounded, k - 1, axis=1)[:, :k] if k < rounded.shape[1] else np.broadcast_to(np.arange(k), rounded.shape)
        if k < rounded.shape[1]:
            # where the last place is a tie, the smaller ids take it
            last = np.take_along_axis(rounded, at, axis=1).min(axis=1)
            tied = np.isfinite(last) & ((rounded >= last[:, None]).sum(axis=1) > k)
            for r in np.flatnonzero(tied):
                close = np.flatnonzero(rounded[r] >= last[r])
                at[r] = close[np.lexsort((ids[close], -rounded[r, close]))[:k]]
        scores = np.concatenate([self.scores[who], np.take_along_axis(rounded, at, axis=1)], axis=1)
        values = np.concatenate([self.raw[who], np.take_along_axis(raw, at, axis=1)], axis=1)
        docs = np.concatenate([self.docs[who], ids[at]], axis=1)
        order = np.lexsort((docs, -scores), axis=1)[:, :self.kmax]
        self.scores[who] = np.take_along_axis(scores, order, axis=1)
        self.raw[who] = np.take_along_axis(values, order, axis=1)
        self.docs[who] = np.take_along_axis(docs, order, axis=1)

    def hits(self) -> pa.Table:
        """``keys, doc_id, score, rank_score, _kq``: at most k rows per query."""
        keep = np.isfinite(self.scores) & (np.arange(self.kmax)[None, :] < self.k[:, None])
        who = np.nonzero(keep)[0]
        raw = self.raw[keep]
        out = self.keys.take(pa.array(who))
        for name, column in (("doc_id", self.docs[keep]), ("score", -raw if self.metric == "sqeuclidean" else raw),
                             ("rank_score", self.scores[keep]), ("_kq", self.k[who])):
            out = out.append_column(name, pa.array(column))
        return out


def _postings(column, words: set) -> dict:
    """Rows per tag, for the tags that some query wants."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    tags, rows = column.flatten(), pc.list_parent_indices(column)
    wanted = pc.is_in(tags, value_set=pa.array(sorted(words), tags.type))
    coded = tags.filter(wanted).dictionary_encode()
    rows, code = rows.filter(wanted).to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((rows, code))
    bounds = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
    return {t: np.unique(rows[order[a:b]]) for t, a, b in zip(coded.dictionary.to_pylist(), bounds[:-1], bounds[1:], strict=True)}

"""Which of many strings a text contains, in one pass over its characters (E2, L1, L2 with long rule lists).

All strings become one automaton with suffix links, compiled on the driver and carried by the tasks. A batch of
texts is one run of it: the texts are joined with a separator that no string holds, and the places it
reports are told apart by the texts' bounds. The work follows the texts and what is found in them, not the
number of strings. Short lists are better served by one ``contains`` column each.
"""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x00"
SLICE_CHARS = 1 << 20


def compiled(patterns: Sequence[str]) -> ahocorasick.Automaton:
    """The automaton; each string's value is its length and the numbers under which it is listed."""
    listed: dict[str, list[int]] = {}
    for i, p in enumerate(patterns):
        if not p or SEPARATOR in p:
            raise ValueError("a string is empty or holds the separator")
        listed.setdefault(p, []).append(i)
    automaton = ahocorasick.Automaton()
    for p, numbers in listed.items():
        automaton.add_word(p, numbers)
    automaton.make_automaton()
    return automaton


def _slices(texts: list[str | None]):
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= SLICE_CHARS:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def found(automaton, texts: list[str | None]) -> list[list[int]]:
    """For each text the numbers of the strings in it, ascending."""
    out: list[list[int]] = [[] for _ in texts]
    for first, held in _slices(texts):
        ends, numbers = [], []
        for end, which in automaton.iter(SEPARATOR.join(held)):
            ends += [end] * len(which)
            numbers += which
        if not ends:
            continue
        bounds = np.cumsum([len(t) + 1 for t in held])
        pairs = np.unique(np.stack([np.searchsorted(bounds, np.array(ends), side="right"), np.array(numbers)]), axis=1)
        cut = np.searchsorted(pairs[0], np.arange(len(held) + 1))
        for i in np.unique(pairs[0]).tolist():
            out[first + i] = pairs[1, cut[i]:cut[i + 1]].tolist()
    return out


def with_found(df: DataFrame, text_col: str, patterns: Sequence[str], out: str = "found") -> DataFrame:
    """Adds the numbers of the strings that each text contains, as an array (empty for a null text)."""
    automaton = compiled(patterns)

    schema = df.withColumn(out, F.array().cast("array<int>")).schema
    place = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            hits = pa.array(found(automaton, batch.column(place).to_pylist()), pa.list_(pa.int32()))
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != out]
            names = [f.name for f in schema.fields]
            cols = dict(kept) | {out: hits}
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return df.mapInArrow(run, schema)


def counts(found_col, groups: dict[str, Sequence[int]]) -> dict:
    """Per group the number of its strings that were found, as columns."""
    return {name: F.size(F.array_intersect(found_col, F.array(*[F.lit(i) for i in numbers]))) for name, numbers in groups.items()}

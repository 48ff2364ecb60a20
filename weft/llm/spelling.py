"""Operator 13: groups of spelling variants, found by pivotal grams.

Words that differ by one inserted, deleted or replaced code point are near. Bigrams are put in one
global order, rare ones first (the alphabet is bounded, so their counts fit on the driver). A word's
prefix is its ``2 * 1 + 1`` first bigrams in this order, and all others of the last one's kind. Its
pivots are two disjoint bigrams of these three, the rarest such pair by dynamic programming: one edit
touches at most one of them. Of two near words, take the one whose last prefix gram is not later: a
pivot that the edit leaves whole also stands in the other word, and not behind that word's last prefix
gram, so it is in its prefix. Its place is limited as well: with the edit behind it everything up to
the pivot is the same, with the edit before it everything from the pivot on. Pivots are therefore
joined with prefixes on the word's part up to or from the gram, which makes few candidates; their
lengths may differ by one, and the edit distance settles each.

Words lean on their most frequent near word where that is ``ratio`` times as frequent; roots follow
these steps to their end by pointer doubling, since every step raises the count.

Defined results: runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased; a null text has none; words
shorter than ``min_length`` or rarer than ``min_count`` are left out; rows are counted as often as
they occur. With ``typo_modulus`` (a test of the method on any corpus) a run whose crc32 of
``<doc_id>:<run>`` is divisible by it loses one code point; rows without an id keep all.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.scratch import materialise

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HELD_WORDS = 1 << 17
_EDITS = 1
_PREFIX = 2 * _EDITS + 1


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_modulus: int | None = None) -> DataFrame:
    """``(word, n)`` of all texts. Each task adds up its words and hands them on now and then."""
    # in UTF-8 the letters from U+00C0 to U+00FF are 0xC3 and a second byte; no shorter run can count
    runs = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % min_length)

    def emit(total: Counter):
        words = [w for w in total]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([total[w] for w in words], pa.int64())], ["word", "n"])

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_buffer()
                if text is None:
                    continue
                own = Counter(runs.findall(text.to_pybytes().translate(_LOWER)))
                if typo_modulus and key is not None:
                    begin = zlib.crc32(key.encode() + b":")
                    for word in [w for w in own if not zlib.crc32(w, begin) % typo_modulus]:
                        letters = word.decode()
                        at = zlib.crc32(word, begin) % len(letters)
                        n = own.pop(word)
                        letters = letters[:at] + letters[at + 1:]
                        if len(letters) >= min_length:
                            total[letters.encode()] += n
                total.update(own)
                if len(total) > _HELD_WORDS:
                    yield emit(total)
                    total = Counter()
        yield emit(total)

    rows = docs.select(docs["doc_id"].cast("string"), docs["text"].cast("binary")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def pivots(grams: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The disjoint pair of bigrams ``(place, count)`` with the least sum of counts, by dynamic
    programming over the places: the best gram that ends before each one."""
    best, single = None, None
    behind: list[tuple[int, int]] = []
    for place, count in sorted(grams):
        while behind and behind[0][0] + 2 <= place:
            first = behind.pop(0)
            if single is None or first[1] < single[1]:
                single = first
        behind.append((place, count))
        if single is not None and (best is None or single[1] + count < best[0]):
            best = (single[1] + count, [single, (place, count)])
    return best[1] if best else []


def _signatures(words: DataFrame) -> DataFrame:
    """``(word, n, size, last, key, pivot)``: the parts up to and from each prefix gram of a word, each
    with whether the gram is a pivot. last is the place of the last prefix gram in the global order."""
    gram = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2))))).alias("gram")
    counts = {r.gram: r.n for r in words.filter(F.length("word") > 1).select(gram).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}  # the square of the alphabet at most: 90^2
    order = {g: i for i, (_, g) in enumerate(sorted((n, g) for g, n in counts.items()))}

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = sorted((order[word[i:i + 2]], i) for i in range(len(word) - 1))
                if len(grams) < _PREFIX:
                    raise ValueError("words need at least four code points")
                last = grams[_PREFIX - 1][0]
                chosen = {i for i, _ in pivots([(i, counts[word[i:i + 2]]) for _, i in grams[:_PREFIX]])}
                for rank, i in grams:
                    if rank > last:
                        break
                    for key in ("<" + word[:i + 2], ">" + word[i:]):
                        for col, x in zip(out, (word, n, len(word), last, key, i in chosen), strict=True):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_()), strict=True)],
                                             ["word", "n", "size", "last", "key", "pivot"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, size int, last int, key string, pivot boolean")


def near_pairs(words: DataFrame) -> DataFrame:
    """``words(word, n)``, distinct and of four code points or more, to the near pairs, each once:
    ``(a, an, b, bn)``."""
    signed = materialise(_signatures(words), "spelling-signatures")
    r, s = signed.filter("pivot").alias("r"), signed.alias("s")
    fit = ((F.col("r.key") == F.col("s.key")) & (F.col("r.last") <= F.col("s.last")) & (F.col("r.word") != F.col("s.word"))
           & (F.abs(F.col("r.size") - F.col("s.size")) <= _EDITS))
    near = F.levenshtein(F.col("r.word"), F.col("s.word"), _EDITS) == _EDITS
    found = r.join(s, fit).filter(near)
    first = F.col("r.word") < F.col("s.word")
    return found.select(*[F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for name, x, y in (
        ("a", "r.word", "s.word"), ("an", "r.n", "s.n"), ("b", "s.word", "r.word"), ("bn", "s.n", "r.n"))]).distinct()


def _roots(steps: DataFrame) -> DataFrame:
    """``steps(word, form)`` to ``(word, root)``: the end of each word's chain, its length halved by
    each round."""
    chain = materialise(steps.select("word", F.col("form").alias("root")), "spelling-chain")
    while True:
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = chain.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        longer = materialise(longer, "spelling-chain")
        if not longer.filter("_moved").take(1):
            return chain
        chain = longer.drop("_moved")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words(word, n)`` to ``(word, form, root, n, n_near, form_n)``, one row per word."""
    words = materialise(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("near"), F.col("bn").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("near"), F.col("an").alias("near_n")))).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best, F.first("n").alias("n"))
    leads = F.col("n") * ratio <= -F.col("best.m")
    near = materialise(near.select("word", "n_near", F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.m")).alias("form_n")), "spelling-near")
    roots = _roots(near.filter("form is not null"))
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, typo_modulus: int | None = None) -> DataFrame:
    """Variants among the words of ``docs(doc_id, text)``."""
    return variants(word_counts(docs, min_length, min_count, typo_modulus), ratio)

"""Text vectors with meaning (B3): windowed co-occurrence, positive PMI, and a randomised SVD on Spark.

Words are near when they are used near the same words. The counts and the positive pointwise mutual information
are tables; their matrix is factored in cells, between blocks of words, without ever being whole in one place. The counts
travel and are stored as tiles, the pairs between two blocks of words in a few bytes each, as long as the tasks can hold the
vocabulary; larger ones have rows of numbers. A sketch of the matrix (its
product with a few random directions, made from a hash of each word) is sharpened by further products
with the matrix, made orthogonal through its Gram matrix, and the small matrix between the sketch's
directions gives the factors. The driver sees square matrices of ``dim + OVERSAMPLE`` rows, a vocabulary of bounded size and
a bounded number of the vectors' dimensions at a time. A text is
the mean of its words' vectors, rare words weighing more.

Words are runs of letters and digits, lower-cased; words rarer than ``min_count`` have no vector, a text
without any has none (null). The sign of each dimension is fixed, so reruns agree.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.operators import topk
from weft.session import kept, tidy

WINDOW = 4
MIN_COUNT = 10
OVERSAMPLE = 12
POWER_ROUNDS = 3
# Pairs that a task sorts at once, pairs of a batch it returns, and pairs whose counts are added up in one place.
PAIRS = 1 << 21
BATCH_ROWS = 1 << 16
PART_PAIRS = 1 << 20
# The largest vocabulary that travels to the pairs.
BROADCAST_WORDS = 1 << 19
# The vectors that travel whole to the matrix: a vocabulary of 190,000 words at 44 numbers.
BROADCAST_BYTES = 64 << 20
# The vocabulary that the tasks hold, with 16 bytes a word besides its letters, and the vectors that they hold at a time.
CARRIED_BYTES = 64 << 20
HELD_BYTES = 32 << 20
# Words of a block of a tile, and pairs that a task counts at once for tiles.
TILE_WORDS = 1 << 13
SPAN_PAIRS = 1 << 23
# The largest table with a number per word that travels to the pairs.
BROADCAST_NUMBERS = 1 << 21
# Words of a block of vectors, entries of the matrix in a cell, and rows of a batch of vectors.
BLOCK_WORDS = 1 << 15
CELL_ENTRIES = 1 << 21
ROWS = 1 << 12


def _words(text):
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT, text_col: str = "text") -> DataFrame:
    """``(word, n)`` of the words that occur ``min_count`` times or more."""
    return docs.select(F.explode(_words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _keyed_words(docs: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """``(word, n, id)`` of all words, and the seed of the hash that numbers them: a seed for which no two words share
    their number, so that counts by number are counts by word."""
    words = kept(vocabulary(docs, 1, text_col))  # read for the numbers and for the names
    for seed in itertools.count():
        keyed = words.withColumn("id", _id(F.col("word"), seed))
        if keyed.groupBy("id").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").isEmpty():
            return keyed, seed


def _id(word, seed: int):
    return F.xxhash64(word, F.lit(seed))


def _pairs_of(ids: np.ndarray, text: np.ndarray, window: int, parts: int):
    """Record batches ``(part, word, context, n)`` of the pairs of words of one text within ``window`` words of each other, the
    smaller number first. Pairs are sorted and counted a span of words at a time; a row holds the pairs of a part, which a
    pair's numbers decide, as lists."""
    for a in range(0, len(ids), span := max(1, PAIRS // window)):
        coded, of = pa.array(ids[a:a + span + window]).dictionary_encode(), text[a:a + span + window]
        known = coded.dictionary.to_numpy()
        order = np.argsort(known)
        known, place = known[order], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code = place[coded.indices.to_numpy()]
        first = min(span, len(code))
        pairs = []
        for s in range(1, window + 1):
            x, y = code[:first][:len(code) - s], code[s:first + s]
            same = of[:first][:len(code) - s] == of[s:first + s]
            x, y = x[same], y[same]
            pairs.append(np.minimum(x, y) * len(known) + np.maximum(x, y))
        pairs = np.concatenate(pairs)
        if not len(pairs):
            continue
        pairs.sort()
        at = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        n = np.diff(np.r_[at, len(pairs)])
        x, y = np.divmod(pairs[at], len(known))
        x, y = known[x], known[y]
        part = ((x.view(np.uint64) + y.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)
        order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
        x, y, n, part = x[order], y[order], n[order], part[order]
        start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        bounds = np.r_[start, len(part)]
        rows = max(1, len(start) * BATCH_ROWS // len(part))
        for lo in range(0, len(start), rows):
            cut = bounds[lo:lo + rows + 1]
            lists = [pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), pa.array(v[cut[0]:cut[-1]])) for v in (x, y, n)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int64)), *lists], ["part", "word", "context", "n"])


def _numbers(docs: DataFrame, text_col: str, seed: int) -> DataFrame:
    return docs.select(F.transform(_words(F.col(text_col)), lambda w: _id(w, seed)).alias("_w")).where(F.size("_w") > 1)


def _held(batches, most: int):
    """The words' numbers of the texts, and the number of the text of each, ``most`` words and the last batch's rest at a time."""
    held, sizes, size = [], [], 0
    for batch in batches:
        column = batch.column(0)
        held.append(column.flatten().to_numpy(zero_copy_only=False))
        sizes.append(pc.list_value_length(column).to_numpy(zero_copy_only=False))
        size += len(held[-1])
        if size >= most:
            yield np.concatenate(held), np.repeat(np.arange(len(x := np.concatenate(sizes))), x)
            held, sizes, size = [], [], 0
    if size:
        yield np.concatenate(held), np.repeat(np.arange(len(x := np.concatenate(sizes))), x)


def _pair_counts(docs: DataFrame, window: int, text_col: str, seed: int, n_words: int) -> DataFrame:
    """``(word, context, n)`` by the words' numbers, the smaller one first: texts become numbers in Spark, a task counts
    the pairs of its spans, and the counts of a part of all pairs are added up in one place. There are as many parts
    as the ``n_words`` words of the texts need."""
    parts = max(1, -(-n_words * window // PART_PAIRS))

    def run(batches):
        for ids, text in _held(batches, PAIRS // window):
            yield from _pairs_of(ids, text, window, parts)

    def added(part: pa.Table) -> pa.Table:
        rows = pa.table({c: part.column(c).combine_chunks().flatten() for c in ("word", "context", "n")})
        rows = rows.group_by(["word", "context"], use_threads=False).aggregate([("n", "sum")])
        return rows.rename_columns({"n_sum": "n"}).select(["word", "context", "n"])

    lists = _numbers(docs, text_col, seed).mapInArrow(run, "part long, word array<long>, context array<long>, n array<long>")
    return lists.groupBy("part").applyInArrow(added, "word long, context long, n long")


def _side(words: DataFrame, most: int | None = None) -> DataFrame:
    """A table with a row per word, to join with many rows: it travels to them where it is small, else they meet it in
    shuffles without a sort."""
    return words.hint("broadcast" if words.count() <= (BROADCAST_WORDS if most is None else most) else "shuffle_hash")


# Tiles: a vocabulary that the tasks hold gives its words dense numbers, in the order of their hashes, and blocks of ``TILE_WORDS`` of them.
# A row ``(rows, columns, size, data)`` holds the counts of the pairs between two blocks, the smaller number in the first.


def _carried(known: DataFrame):
    """The vocabulary as a broadcast ``(hashes, words)`` in the order of the hashes, where it stays within ``CARRIED_BYTES``, else None."""
    n, letters = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if 16 * n + letters > CARRIED_BYTES:
        return None
    table = known.select("id", "word").toArrow()
    ids = table.column("id").to_numpy()
    order = np.argsort(ids)
    return known.sparkSession.sparkContext.broadcast((ids[order], table.column("word").combine_chunks().take(pa.array(order))))


def _dense(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The places of hashes among the known ones, -1 for the others."""
    if not len(known):
        return np.full(len(ids), -1)
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    return np.where(known[at] == ids, at, -1)


def _packed(codes: np.ndarray, n: np.ndarray) -> bytes:
    """Rising numbers and their counts: the differences and the counts, byte by byte of all of them, compressed."""
    planes = [np.ascontiguousarray(x.astype(t).view(np.uint8).reshape(-1, w).T).tobytes() for x, t, w in ((np.diff(codes, prepend=0), "<u4", 4), (n, "<u8", 8))]
    return pa.Codec("zstd", 1).compress(b"".join(planes), asbytes=True)


def _unpacked_counts(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, 12 * size, asbytes=True), np.uint8)
    steps = np.ascontiguousarray(raw[:4 * size].reshape(4, size).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.int64), np.ascontiguousarray(raw[4 * size:].reshape(8, size).T).view("<i8").ravel()


def _tile_parts(number: np.ndarray, text: np.ndarray, window: int, blocks: int, side: int, pieces: int):
    """Record batches ``(part, size, data)`` of the pairs of known words of one text within ``window`` words of each other. A part is
    a tile, or one of its ``pieces`` by the first word. Pairs are sorted and counted a span of words at a time."""
    for a in range(0, len(number), span := max(1, SPAN_PAIRS // window)):
        own, of = number[a:a + span + window], text[a:a + span + window]
        first = min(span, len(own))
        keys = []
        for s in range(1, window + 1):
            x, y = own[:first][:len(own) - s], own[s:first + s]
            fits = (of[:first][:len(own) - s] == of[s:first + s]) & (x >= 0) & (y >= 0)
            x, y = x[fits], y[fits]
            x, y = np.minimum(x, y), np.maximum(x, y)
            keys.append((x // side * blocks + y // side) * (side * side) + x % side * side + y % side)
        key = np.concatenate(keys)
        if not len(key):
            continue
        key.sort()
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[at, len(key)])
        tile, code = np.divmod(key[at], side * side)
        part = tile * pieces + code // side * pieces // side
        bounds = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
        rows = max(1, (len(bounds) - 1) * BATCH_ROWS // len(part))
        for lo in range(0, len(bounds) - 1, rows):
            cut = bounds[lo:lo + rows + 1]
            data = [_packed(code[u:v], n[u:v]) for u, v in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), pa.array(np.diff(cut).astype(np.int32)), pa.array(data, pa.binary())], ["part", "size", "data"])


def _tiles(docs: DataFrame, window: int, text_col: str, seed: int, n_words: int, words) -> DataFrame:
    """``(rows, columns, size, data)``: a task counts the pairs of its spans, and the counts of a part are added up in one place.
    There are as many parts as the ``n_words`` words of the texts need."""
    side, blocks = TILE_WORDS, max(1, -(-len(words.value[0]) // TILE_WORDS))
    pieces = min(side, max(1, -(-n_words * window // (PART_PAIRS * blocks * (blocks + 1) // 2))))

    def run(batches):
        known = words.value[0]
        for ids, text in _held(batches, SPAN_PAIRS // window):
            coded = pa.array(ids).dictionary_encode()
            number = _dense(coded.dictionary.to_numpy(), known)[coded.indices.to_numpy()]
            yield from _tile_parts(number, text, window, blocks, side, pieces)

    def added(key, table):
        rows, columns = divmod(key[0].as_py() // pieces, blocks)
        codes, n = (np.concatenate(x) for x in zip(*(_unpacked_counts(d.as_py(), s.as_py()) for d, s in zip(table.column("data"), table.column("size"), strict=True)), strict=True))
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        data = _packed(codes[at], np.add.reduceat(n[order], at))
        return pa.table([pa.array([rows], pa.int32()), pa.array([columns], pa.int32()), pa.array([len(at)], pa.int32()), pa.array([data], pa.binary())], names=["rows", "columns", "size", "data"])

    lists = _numbers(docs, text_col, seed).mapInArrow(run, "part long, size int, data binary")
    return lists.groupBy("part").applyInArrow(added, "rows int, columns int, size int, data binary")


def _tile_pairs(batch: pa.RecordBatch, side: int):
    """Per tile its blocks, and the pairs' places in them and counts; in a block met with itself, both ways."""
    for k in range(batch.num_rows):
        rows, columns, size, data = (batch.column(c)[k].as_py() for c in ("rows", "columns", "size", "data"))
        codes, n = _unpacked_counts(data, size)
        i, j = np.divmod(codes, side)
        if rows == columns:
            n = np.where(i == j, 2 * n, n)
            i, j, n = np.r_[i, j[i != j]], np.r_[j, i[i != j]], np.r_[n, n[i != j]]
        yield rows, columns, i, j, n


def _tile_counts(tiles: DataFrame, words, named: bool = False) -> DataFrame:
    """``(word, context, n)`` of the tiles in both directions, by dense number or by word."""
    side = TILE_WORDS

    def run(batches):
        for batch in batches:
            for rows, columns, i, j, n in _tile_pairs(batch, side):
                for a, b in ((rows * side + i, columns * side + j), (columns * side + j, rows * side + i))[:1 + (rows != columns)]:
                    for lo in range(0, len(n), BATCH_ROWS):
                        x, y = (pa.array(v[lo:lo + BATCH_ROWS]) for v in (a, b))
                        x, y = (words.value[1].take(v) for v in (x, y)) if named else (x, y)
                        yield pa.RecordBatch.from_arrays([x, y, pa.array(n[lo:lo + BATCH_ROWS])], ["word", "context", "n"])

    return tiles.mapInArrow(run, f"word {(kind := 'string' if named else 'long')}, context {kind}, n long")


def _known_pairs(docs: DataFrame, window: int, min_count: int, text_col: str) -> tuple[DataFrame, DataFrame, object]:
    """The pair counts, ``(id, word)`` of the vocabulary, and the vocabulary that the tasks hold: the counts are tiles then,
    without (None) pairs by hash of all words."""
    keyed, seed = _keyed_words(docs, text_col)
    known = keyed.where(F.col("n") >= min_count).select("id", "word")
    n_words = keyed.agg(F.sum("n")).first()[0] or 0
    words = _carried(known)
    return (_pair_counts(docs, window, text_col, seed, n_words) if words is None else _tiles(docs, window, text_col, seed, n_words, words)), known, words


def _only_known(pairs: DataFrame, known: DataFrame) -> DataFrame:
    known = _side(known, BROADCAST_NUMBERS)
    for c in ("word", "context"):
        pairs = pairs.join(known.select(F.col("id").alias(c)), c, "left_semi")
    return pairs


def _both_ways(pairs: DataFrame) -> DataFrame:
    both = F.when(F.col("word") == F.col("context"), F.array(F.struct("word", "context", (2 * F.col("n")).alias("n")))).otherwise(
        F.array(F.struct("word", "context", "n"), F.struct(F.col("context").alias("word"), F.col("word").alias("context"), "n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def cooccurrences(docs: DataFrame, window: int = WINDOW, min_count: int = MIN_COUNT, text_col: str = "text") -> DataFrame:
    """``(word, context, n)``: how often two words of the vocabulary stand within ``window`` words of each
    other, in both directions."""
    pairs, known, words = _known_pairs(docs, window, min_count, text_col)
    return named(_both_ways(pairs), known) if words is None else _tile_counts(pairs, words, named=True)


def numbered_cooccurrences(docs: DataFrame, window: int = WINDOW, min_count: int = MIN_COUNT, text_col: str = "text") -> tuple[DataFrame, object]:
    """The co-occurrences with numbers for words, stored once to be read again, and the words that ``named`` gives them back."""
    pairs, known, words = _known_pairs(docs, window, min_count, text_col)
    return (_both_ways(kept(_only_known(pairs, known))), known) if words is None else (_tile_counts(kept(pairs), words), words)


def named(pairs: DataFrame, words) -> DataFrame:
    """Pairs ``(word, context, ..)`` with words for their numbers, those of other words left out. ``words`` is a table
    ``(id, word)``, or the vocabulary that the tasks hold."""
    if isinstance(words, DataFrame):
        words = _side(words)
        for c in ("word", "context"):
            pairs = pairs.join(words.select(F.col("id").alias(c), F.col("word").alias("_name")), c).drop(c).withColumnRenamed("_name", c)
        return pairs

    def run(batches):
        for batch in batches:
            columns = [words.value[1].take(c) if name in ("word", "context") else c for name, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return pairs.mapInArrow(run, ", ".join(f"{c} {'string' if c in ('word', 'context') else kind}" for c, kind in pairs.dtypes))


def positive_pmi(counts: DataFrame, stored: bool = False) -> DataFrame:
    """``(word, context, value)``: max(0, log(n_wc N / (n_w n_c))), the positive ones. The counts are read twice; they
    are stored for it, unless the caller keeps them already. Words may be numbers as well."""
    counts = counts if stored else kept(counts)
    totals = kept(counts.groupBy("word").agg(F.sum("n").alias("_nw")))
    whole = totals.agg(F.sum("_nw")).first()[0] or 0
    totals = _side(totals, BROADCAST_NUMBERS if dict(totals.dtypes)["word"] == "bigint" else None)
    value = F.log(F.col("n") * F.lit(float(whole)) / (F.col("_nw") * F.col("_nc").cast("double")))
    joined = counts.join(totals, "word").join(totals.select(F.col("word").alias("context"), F.col("_nw").alias("_nc")), "context")
    return joined.select("word", "context", value.alias("value")).where("value > 0")


# The factorisation keeps the words' vectors as blocks: a row ``(block, vec)`` holds a matrix of ``size`` rows and one column per
# word of the block. The matrix is kept as cells: a row holds entries between the words of two blocks.


def _placed(words: DataFrame, n_words: int) -> DataFrame:
    """The words with ``block`` and ``pos``, their place in it: hashed to blocks, and numbered there."""
    blocks = max(1, -(-n_words // BLOCK_WORDS))
    dealt = words.withColumn("block", F.pmod(F.xxhash64("word", F.lit(0)), F.lit(blocks)).cast("int"))
    return dealt.withColumn("pos", (F.row_number().over(Window.partitionBy("block").orderBy("word")) - 1).cast("int"))


def _cells(matrix: DataFrame, placed: DataFrame, n_entries: int, blocks: int) -> DataFrame:
    """``(rows, columns, i, j, value)``: the entries between two blocks, at most about ``CELL_ENTRIES`` a row."""

    def packed(key, table):
        one = pa.array([0, table.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(one, table.column(c).combine_chunks()) for c in ("i", "j", "value")]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *lists], ["rows", "columns", "i", "j", "value"])

    pieces = max(1, -(-n_entries // (blocks * blocks * CELL_ENTRIES)))
    at = _side(placed.select("word", "block", "pos"))
    rows = at.select("word", F.col("block").alias("rows"), F.col("pos").alias("i"))
    columns = at.select(F.col("word").alias("context"), F.col("block").alias("columns"), F.col("pos").alias("j"))
    piece = F.pmod(F.xxhash64("word", "context"), F.lit(pieces)).cast("int")
    entries = matrix.join(rows, "word").join(columns, "context").select("rows", "columns", piece.alias("piece"), "i", "j", "value")
    return entries.groupBy("rows", "columns", "piece").applyInArrow(packed, "rows int, columns int, i array<int>, j array<int>, value array<double>")


def _block(column, size: int) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False).reshape(size, -1) for x in column]


def _as_blocks(block, matrices) -> pa.RecordBatch:
    sizes = np.cumsum([0, *(m.size for m in matrices)])
    flat = np.concatenate([np.zeros(0), *(m.ravel() for m in matrices)])
    return pa.RecordBatch.from_arrays([block.cast(pa.int32()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))], ["block", "vec"])


def _times(cells: DataFrame, vectors: DataFrame, size: int, n_words: int) -> DataFrame:
    """The matrix times the vectors: a cell meets the vectors of its columns and gives sums for its rows, which are
    added up per block."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, value = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("i", "j", "value"))
                own = _block(batch.column("vec").slice(k, 1), size)[0]
                n = batch.column("n")[k].as_py()
                sums = np.stack([np.bincount(i, weights=value * x[j], minlength=n) for x in own])
                yield _as_blocks(batch.column("rows").slice(k, 1), [sums])

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, 0.0
        for part in parts:
            for m in _block(part.column("vec"), size):
                block, total = part.column("block")[:1], total + m
        yield _as_blocks(block, [total])

    sizes = vectors.select(F.col("block").alias("rows"), (F.size("vec") / size).cast("int").alias("n"))
    columns = vectors.select(F.col("block").alias("columns"), "vec")
    if 8 * size * n_words <= BROADCAST_BYTES:
        met = cells.join(F.broadcast(sizes), "rows").join(F.broadcast(columns), "columns")
    else:  # a copy of a block for each block of rows: all pairs of blocks are met apart
        met = cells.join(columns.join(F.broadcast(sizes)).hint("shuffle_hash"), ["rows", "columns"])
    sums = met.select("rows", "n", "i", "j", "value", "vec").mapInArrow(run, "block int, vec array<double>")
    return sums.groupBy("block").applyInArrow(added, "block int, vec array<double>")


def _summed(vectors: DataFrame, size: int, measure) -> np.ndarray:
    """The sum over all blocks of a small array made from each."""

    def run(batches):
        for batch in batches:
            for m in zip(*(_block(batch.column(c), size) for c in range(batch.num_columns)), strict=True):
                out = measure(*m).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["at", "value"])

    with tidy(vectors.sparkSession):
        sums = vectors.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()  # size * size rows
    return np.array([r["value"] for r in sums])


def _products(blocks: DataFrame, size: int) -> np.ndarray:
    """The sum over all words of the outer products of two vectors."""
    found = _summed(blocks, size, lambda a, b: a @ b.T)
    return found.reshape(size, size) if len(found) else np.zeros((size, size))


def _mapped(vectors: DataFrame, by: np.ndarray) -> DataFrame:
    """Each vector times a small matrix."""

    def run(batches):
        for batch in batches:
            yield _as_blocks(batch.column("block"), [by.T @ m for m in _block(batch.column("vec"), len(by))])

    return vectors.select("block", "vec").mapInArrow(run, "block int, vec array<double>")


def _orthogonal(vectors: DataFrame, size: int) -> DataFrame:
    """An orthonormal basis of the vectors' dimensions, from their Gram matrix; directions without weight are zero."""
    value, direction = np.linalg.eigh(_products(vectors.select("vec", F.col("vec").alias("_other")), size))
    keep = value > max(value.max(initial=0.0), 1e-300) * 1e-12
    return _mapped(vectors, direction * np.where(keep, 1 / np.sqrt(np.where(keep, value, 1.0)), 0.0))


def _random(placed: DataFrame, size: int) -> DataFrame:
    """Blocks of normal numbers: two hashes of a word give one for each dimension (Box-Muller)."""
    u = [F.pmod(F.xxhash64("name", F.lit(f"{i}a")), F.lit(1 << 30)) / (1 << 30) for i in range(size)]
    v = [(F.pmod(F.xxhash64("name", F.lit(f"{i}b")), F.lit(1 << 30)) + 1) / ((1 << 30) + 1) for i in range(size)]
    numbers = placed.select("block", "pos", F.array(*[F.sqrt(-2 * F.log(b)) * F.cos(2 * np.pi * a) for a, b in zip(u, v, strict=True)]).alias("vec"))

    def packed(key, table):
        m = topk.matrix(table.column("vec"))[np.argsort(table.column("pos").to_numpy())]
        return pa.Table.from_batches([_as_blocks(pa.array([key[0].as_py()]), [np.ascontiguousarray(m.T)])])

    return numbers.groupBy("block").applyInArrow(packed, "block int, vec array<double>")


def _unpacked(vectors: DataFrame, size: int) -> DataFrame:
    """``(block, pos, vec)``: a row per word."""

    def run(batches):
        for batch in batches:
            for k, m in enumerate(_block(batch.column("vec"), size)):
                for lo in range(0, m.shape[1], ROWS):
                    part = np.ascontiguousarray(m[:, lo:lo + ROWS].T)
                    vec = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), size).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), batch.column("block")[k].as_py(), np.int32)), pa.array(np.arange(lo, lo + len(part), dtype=np.int32)), vec], ["block", "pos", "vec"])

    return vectors.select("block", "vec").mapInArrow(run, "block int, pos int, vec array<double>")


def factor(matrix: DataFrame, dim: int, names: DataFrame | None = None) -> tuple[DataFrame, np.ndarray]:
    """``(word, vec)`` with ``dim`` numbers per word, the leading eigenvectors of the symmetric matrix scaled by the
    root of their eigenvalues' size, and these eigenvalues. Where the matrix has numbers for words, ``names``
    ``(id, word)`` has the words that the result shall show."""
    size = dim + OVERSAMPLE
    words = matrix.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    n_words, n_entries = words.agg(F.count(F.lit(1)), F.sum("_n")).first()
    words = words.select("word", F.col("word").alias("name")) if names is None else words.join(
        names.select("id", F.col("word").alias("name")), words["word"] == names["id"]).select(words["word"], "name")
    placed = _placed(words, n_words).checkpoint()
    cells = _cells(matrix, placed, n_entries or 0, max(1, -(-n_words // BLOCK_WORDS))).checkpoint()
    return _leading(placed, dim, lambda vectors: _times(cells, vectors, size, n_words).checkpoint())


def _leading(placed: DataFrame, dim: int, times) -> tuple[DataFrame, np.ndarray]:
    """``factor`` of the matrix by which ``times`` multiplies blocks of vectors, for words that are ``placed``."""
    size = dim + OVERSAMPLE
    basis = kept(_orthogonal(times(kept(_random(placed, size))), size))
    for _ in range(POWER_ROUNDS):
        basis = kept(_orthogonal(times(basis), size))
    image = times(basis).withColumnRenamed("vec", "_image")
    between = _products(basis.join(image, "block").select("vec", "_image"), size)
    value, direction = np.linalg.eigh((between + between.T) / 2)
    order = np.argsort(-np.abs(value), kind="stable")[:dim]
    vectors = _mapped(basis, direction[:, order] * np.sqrt(np.abs(value[order])))
    # the sign for which the cubes' sum is positive
    cubes = _summed(vectors.select("vec"), dim, lambda m: (m * m * m).sum(axis=1))
    sign = np.where(cubes < 0, -1.0, 1.0) if len(cubes) else np.ones(dim)
    rows = _unpacked(_mapped(vectors, np.diag(sign)), dim)
    held = placed.where("held") if "held" in placed.columns else placed
    return held.join(rows, ["block", "pos"]).select(F.col("name").alias("word"), "vec"), value[order]


def _collected(vectors: DataFrame, size: int, dims: slice, side: int, n_words: int) -> np.ndarray:
    """Some dimensions of all vectors, a row each."""

    def run(batches):
        for batch in batches:
            for k, m in enumerate(_block(batch.column("vec"), size)):
                yield _as_blocks(batch.column("block").slice(k, 1), [m[dims]])

    out = np.zeros((dims.stop - dims.start, n_words))
    for r in vectors.select("block", "vec").mapInArrow(run, "block int, vec array<double>").toArrow().to_batches():
        for block, m in zip(r.column("block").to_pylist(), _block(r.column("vec"), dims.stop - dims.start), strict=True):
            out[:, block * side:block * side + m.shape[1]] = m
    return out


def _tile_times(cells: DataFrame, held: np.ndarray, side: int, value) -> DataFrame:
    """The matrix of the tiles, both ways in ``cells``, times vectors (columns of ``held``), stored: ``value`` makes entries of counts. A
    task adds up its cells per block."""
    x = cells.sparkSession.sparkContext.broadcast(held)
    n_words = held.shape[1]

    def run(batches):
        total = {}
        for batch in batches:
            turned = batch.column("turned").to_pylist()
            for k, (rows, columns, i, j, n) in enumerate(_tile_pairs(batch, side)):
                if turned[k]:
                    rows, columns, i, j = columns, rows, j, i
                i, j, v = value(rows, columns, i, j, n)
                size = min(side, n_words - rows * side)
                sums = np.stack([np.bincount(i, weights=v * own[j], minlength=size) for own in x.value[:, columns * side:(columns + 1) * side]])
                total[rows] = total[rows] + sums if rows in total else sums
        for rows, sums in total.items():
            yield _as_blocks(pa.array([rows]), [sums])

    def added(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_as_blocks(table.column("block").combine_chunks()[:1], [sum(m for c in table.column("vec").chunks for m in _block(c, len(held)))])])

    out = kept(cells.mapInArrow(run, "block int, vec array<double>").groupBy("block").applyInArrow(added, "block int, vec array<double>"))
    x.destroy()
    return out


def _tile_vectors(tiles: DataFrame, known: DataFrame, words, dim: int) -> DataFrame:
    """``(word, vec)``: the leading eigenvectors of the positive PMI of the counts in ``tiles``."""
    size, side, n_words = dim + OVERSAMPLE, TILE_WORDS, len(words.value[0])
    columns = ["rows", "columns", "size", "data"]
    other = tiles.where("rows <> columns").select(*columns, F.lit(True).alias("turned"))
    # all cells that add to a block's sums are together
    cells = kept(tiles.select(*columns, F.lit(False).alias("turned")).unionByName(other).repartition(F.when(F.col("turned"), F.col("columns")).otherwise(F.col("rows"))))

    def per_word(value) -> np.ndarray:
        sums = _tile_times(cells, np.ones((1, n_words)), side, value)
        return _collected(sums, 1, slice(0, 1), side, n_words)[0]

    totals = per_word(lambda rows, columns, i, j, n: (i, j, n.astype(float)))
    whole = float(totals.sum())
    shared = cells.sparkSession.sparkContext.broadcast(totals)

    def positive(rows, columns, i, j, n):
        v = np.log(n * whole / (shared.value[rows * side + i] * shared.value[columns * side + j]))
        return i[v > 0], j[v > 0], v[v > 0]

    def ones(*cell):
        i, j, v = positive(*cell)
        return i, j, np.ones(len(v))

    # words without a positive entry have no vector
    held = cells.sparkSession.sparkContext.broadcast(per_word(ones) > 0)
    step = max(1, HELD_BYTES // (8 * max(n_words, 1)))

    def stacked(key, table):
        order = np.argsort(table.column("part").to_numpy())
        flat = [table.column("vec")[int(k)].values.to_numpy() for k in order]
        return pa.Table.from_batches([_as_blocks(pa.array([key[0].as_py()]), [np.concatenate(flat)])])

    def times(vectors: DataFrame) -> DataFrame:
        parts = [_tile_times(cells, _collected(vectors, size, slice(lo, min(size, lo + step)), side, n_words), side, positive) for lo in range(0, size, step)]
        if len(parts) == 1:
            return parts[0]
        parts = reduce(DataFrame.unionByName, [x.withColumn("part", F.lit(k)) for k, x in enumerate(parts)])
        return parts.groupBy("block").applyInArrow(stacked, "block int, vec array<double>")

    def place(batches):
        for batch in batches:
            at = _dense(batch.column("id").to_numpy(), words.value[0])
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array((at // side).astype(np.int32)), pa.array((at % side).astype(np.int32)), pa.array(held.value[at])], ["name", "block", "pos", "held"])

    placed = kept(known.select("id", "word").mapInArrow(place, "name string, block int, pos int, held boolean"))
    vectors, _ = _leading(placed, dim, times)
    return vectors


def word_vectors(docs: DataFrame, dim: int = 64, window: int = WINDOW, min_count: int = MIN_COUNT, text_col: str = "text") -> DataFrame:
    """``(word, vec, weight)``: the vectors of the vocabulary, and the inverse document frequency. The words stay
    numbers until they have vectors."""
    pairs, known, words = _known_pairs(docs, window, min_count, text_col)
    if words is None:
        vectors, _ = factor(positive_pmi(_both_ways(kept(_only_known(pairs, known))), stored=True), dim, known)
    else:
        vectors = _tile_vectors(kept(pairs), known, words, dim)
    n = docs.count()
    held = docs.select(F.explode(F.array_distinct(_words(F.col(text_col)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("_d"))
    return vectors.join(held, "word").select("word", "vec", F.log(F.lit(float(n + 1)) / F.col("_d")).alias("weight"))


def embedder(vectors: DataFrame):
    """An embedding hook (``embed(df, text_col, out)``) over fitted word vectors: unit vectors, null without a known word."""

    def embed(df: DataFrame, text_col: str = "text", out: str = "embedding") -> DataFrame:
        # equal texts have one vector, and the table's columns stay as they are; a text's digest goes with its words
        digest = F.unhex(F.sha2(F.col(text_col), 256))
        texts = df.select(digest.alias("_text"), _words(F.col(text_col)).alias("_w")).where("_text is not null").dropDuplicates(["_text"])
        words = texts.select("_text", F.explode("_w").alias("word")).groupBy("_text", "word").agg(F.count(F.lit(1)).alias("_n"))
        n = vectors.count()
        dim = len(vectors.first()["vec"]) if n else 0
        parts = -(-8 * dim * n // BROADCAST_BYTES) or 1

        def sums(known: DataFrame) -> DataFrame:
            met = words.join(F.broadcast(known.select("word", F.col("vec").alias("_v"), "weight")), "word").withColumn("_m", F.col("_n") * F.col("weight"))
            found = met.groupBy("_text").agg(F.count(F.lit(1)).alias("_c"), *[F.sum(F.get("_v", F.lit(i)) * F.col("_m")).alias(f"_s{i}") for i in range(dim)])
            return found.select("_text", F.array(*[F.col(f"_s{i}") for i in range(dim)]).cast("array<double>").alias("_s"))

        if parts == 1:
            found = sums(vectors)
        else:  # a part of the vocabulary at a time travels to the texts
            dealt = reduce(DataFrame.unionByName, [kept(sums(vectors.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == k))) for k in range(parts)])
            found = dealt.groupBy("_text").agg(F.array(*[F.sum(F.get("_s", F.lit(i))) for i in range(dim)]).alias("_s"))
        norm = F.sqrt(F.aggregate("_s", F.lit(0.0), lambda a, x: a + x * x))
        unit = found.withColumn("_l", norm).where("_l > 0").select("_text", F.transform("_s", lambda x: (x / F.col("_l")).cast("float")).alias(out))
        return df.withColumn("_text", digest).join(unit, "_text", "left").drop("_text")

    return embed

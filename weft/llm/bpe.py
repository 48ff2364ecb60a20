"""Operator 1: byte-level BPE encoding and decoding over a distinct-word table.

Spark splits every whole text into words (a space followed by a non-space starts one, which is
also where the tokenizer splits, so a word encodes alike alone and inside its text), counts the
distinct words of the corpus, encodes each table word once, and joins the ids back by position:

* the table holds the ``HEAD_WORDS`` most frequent words (of at most ``HEAD_WORD_BYTES``), so its
  size is bounded; it is broadcast and joined map-side against the words of each text, in order,
  and neither texts nor ids are shuffled;
* a word outside the table is rarer than any in it; each task keeps a distinct-word table of its
  own for these and encodes each of them once.

Decoding joins ids to pieces (the vocabulary: bounded, broadcast) and concatenates.

Defined results: a null or empty text has no ids and decodes to the empty string; the special
token's string in a text becomes its one id, as the tokenizers library does; repeated rows and
ids give one output row each; other columns of the input are neither read nor needed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import textvec
from weft.llm.scratch import materialise

HEAD_WORDS = 1 << 19
HEAD_WORD_BYTES = 64
_FLUSH_WORDS = 100_000
_OWN_WORDS = 50_000
_GROUP_BYTES = 1 << 18  # text worked on at a time

# A space starts a word when the next character is certainly no white space and no special token.
_STOP = np.zeros(256, bool)
_STOP[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x3C, 0xE1]] = True
_LONG_CUT = re.compile(rb" (?=[A-Za-z0-9])")


def _pieces(text: bytes) -> list[bytes]:
    """A long text in pieces of about ``_GROUP_BYTES`` that begin with a word."""
    out, at = [], 0
    while len(text) - at > _GROUP_BYTES:
        m = _LONG_CUT.search(text, at + _GROUP_BYTES)
        if not m:
            break
        out.append(text[at:m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def _groups(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts (or pieces of long ones) with their numbers, about ``_GROUP_BYTES`` at a time."""
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        for p in _pieces(t) if len(t) > _GROUP_BYTES else (t,):
            if parts and size + len(p) > _GROUP_BYTES:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(p)
            size += len(p)
    if parts:
        yield rows, parts


def _words(parts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined bytes, word starts, word ends, word fingerprints, first word of each part."""
    joined = b"".join(parts)
    buf = np.frombuffer(joined, np.uint8)
    begins = np.cumsum([0] + [len(p) for p in parts])
    if not len(buf):
        none = np.zeros(0, np.int64)
        return joined, none, none, np.zeros(0, np.uint64), np.zeros(len(parts) + 1, np.int64)
    nxt = np.concatenate((buf[1:], [32])).astype(np.uint8)
    third = np.concatenate((buf[2:], [32, 32])).astype(np.uint8)[: len(buf)]
    stop = _STOP[nxt] | ((nxt == 0xC2) & ((third == 0x85) | (third == 0xA0))) \
        | ((nxt == 0xE2) & ((third == 0x80) | (third == 0x81))) | ((nxt == 0xE3) & (third == 0x80))
    cut = (buf == 32) & ~stop
    cut[begins[1:][begins[1:] > 0] - 1] = False
    cut[begins[:-1][begins[:-1] < len(buf)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(buf))
    return joined, starts, ends, textvec.span_hashes(buf, starts, ends), np.searchsorted(starts, begins)


def _texts(col: pa.Array) -> list[bytes]:
    return [t or b"" for t in col.cast(pa.binary()).to_pylist()]


def word_counts(docs: DataFrame) -> DataFrame:
    """Distinct words of all texts with their counts: ``(word binary, n long)``."""

    def count(batches):
        seen: dict[bytes, int] = {}
        for batch in batches:
            for _, parts in _groups(_texts(batch.column(0))):
                joined, starts, ends, hashes, _ = _words(parts)
                _, first, n = np.unique(hashes, return_index=True, return_counts=True)
                for s, e, c in zip(starts[first].tolist(), ends[first].tolist(), n.tolist(), strict=True):
                    w = joined[s:e]
                    seen[w] = seen.get(w, 0) + c
                if len(seen) > _FLUSH_WORDS:
                    yield pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.binary()), "n": pa.array(seen.values(), pa.int64())})
                    seen = {}
        yield pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.binary()), "n": pa.array(seen.values(), pa.int64())})

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _tokenizer(tokenizer_json: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _encoded(tok, words: list[bytes]) -> list[bytes]:
    """Ids of each word as little-endian 32-bit integers."""
    return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]


def encode_words(words: DataFrame, tokenizer_json: str) -> DataFrame:
    """Each word of a distinct-word table encoded once: ``(word, ids)``."""
    model = words.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        tok = _tokenizer(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_encoded(tok, batch.column(0).to_pylist()), pa.binary())], ["word", "ids"])

    return words.select("word").mapInArrow(run, "word binary, ids binary")


def _head(counts: DataFrame, tokenizer_json: str, head_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The head as (fingerprints, offsets, ids), sorted by fingerprint.

    The least count of a head word is found on a histogram of counts (at most some hundred rows),
    so that no more than ``head_words`` rows reach the driver."""
    short = counts.filter(F.length("word") <= HEAD_WORD_BYTES)
    bucket = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n") * 16) - 32).cast("int")
    low, left = 1 << 62, head_words
    for _, rows, least in sorted(short.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)), F.min("n")).collect(), reverse=True):
        if rows > left:
            break
        low, left = least, left - rows
    rows = encode_words(short.filter(F.col("n") >= low), tokenizer_json).toArrow().combine_chunks()
    buf, ends = _flat(rows.column(0))
    data, id_ends = _flat(rows.column(1))
    hashes = np.empty(len(ends) - 1, np.uint64)
    for at in range(0, len(hashes), 1 << 16):  # in slices, so that the working memory stays small
        e = ends[at:at + (1 << 16) + 1]
        hashes[at:at + len(e) - 1] = textvec.span_hashes(buf[e[0]:e[-1]], e[:-1] - e[0], e[1:] - e[0])
    order = np.argsort(hashes)
    lens = (id_ends[1:] - id_ends[:-1])[order] // 4
    ids = data.view("<u4")[_gather(lens, id_ends[:-1][order] // 4)]
    if not len(ids) or ids.max() < 1 << 16:
        ids = ids.astype(np.uint16)
    return hashes[order], np.concatenate(([0], np.cumsum(lens))).astype(np.uint32), ids


def _flat(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, joined, and the offsets of its values."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    one = pa.concat_arrays(col.chunks).cast(pa.large_binary())
    _, offsets, data = one.buffers()
    at = np.frombuffer(offsets, np.int64)[one.offset:one.offset + len(one) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def _lookup(head_hashes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Row of each fingerprint in the head, or -1."""
    if not len(head_hashes):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(head_hashes, hashes), len(head_hashes) - 1)
    return np.where(head_hashes[at] == hashes, at, -1)


def _gather(lens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Source positions of consecutive runs: ``begins[i] .. begins[i] + lens[i]`` for each i."""
    ends = np.cumsum(lens)
    return np.repeat(begins - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


def _encoder(docs: DataFrame, tokenizer_json: str, head_words: int):
    """Builds the head table; the batch function from ``doc_id, text`` to ``doc_id, n_tokens, ids``."""
    context = docs.sparkSession.sparkContext
    counts = materialise(word_counts(docs), "bpe-words")
    head = context.broadcast(_head(counts, tokenizer_json, head_words))
    model = context.broadcast(tokenizer_json)

    def put_ids(batches):
        hashes_of_head, offsets, ids = head.value
        tok = _tokenizer(model.value)
        own: dict[bytes, bytes] = {}  # ids of this task's words that the head lacks
        for batch in batches:
            texts = _texts(batch.column(1))
            done: list[list[bytes]] = [[] for _ in texts]
            for rows, parts in _groups(texts):
                joined, starts, ends, hashes, first = _words(parts)
                at = _lookup(hashes_of_head, hashes)
                miss = np.flatnonzero(at < 0)
                begins = offsets[at].astype(np.int64)
                lens = offsets[at + 1].astype(np.int64) - begins
                if len(miss):
                    words = [joined[s:e] for s, e in zip(starts[miss].tolist(), ends[miss].tolist(), strict=True)]
                    if len(own) > _OWN_WORDS:
                        own = {}
                    new = list({w: None for w in words if w not in own})
                    own.update(zip(new, _encoded(tok, new), strict=True))
                    late_ids = [own[w] for w in words]
                    lens[miss] = [len(o) // 4 for o in late_ids]
                    begins[miss] = len(ids) + np.concatenate(([0], np.cumsum(lens[miss])[:-1]))
                    source = _gather(lens, begins)
                    late = source >= len(ids)
                    flat = np.empty(len(source), "<u4")
                    flat[~late] = ids[source[~late]]
                    flat[late] = np.frombuffer(b"".join(late_ids), "<u4")[source[late] - len(ids)]
                else:
                    flat = ids[_gather(lens, begins)].astype("<u4")
                bounds = np.concatenate(([0], np.cumsum(lens)))[first]
                for i, r in enumerate(rows):
                    done[r].append(flat[bounds[i]:bounds[i + 1]].tobytes())
            out = [b"".join(d) for d in done]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(o) // 4 for o in out], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return put_ids


def _encoded_schema(docs: DataFrame) -> str:
    return f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids binary"


def encode(docs: DataFrame, tokenizer_json: str, head_words: int = HEAD_WORDS) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_tokens long, ids binary)``."""
    return docs.select("doc_id", "text").mapInArrow(_encoder(docs, tokenizer_json, head_words), _encoded_schema(docs))


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte, by the public byte-level BPE rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_table(tokenizer_json: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces joined in id order, and their offsets (one more than ids)."""
    j = json.loads(tokenizer_json)
    alphabet = _byte_alphabet()
    pieces = {i: bytes(alphabet[c] for c in p) for p, i in j["model"]["vocab"].items()}
    pieces |= {a["id"]: a["content"].encode() for a in j["added_tokens"]}
    flat = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
    return np.frombuffer(b"".join(flat), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in flat], dtype=np.int64)))


def _decoder(df: DataFrame, tokenizer_json: str, names: list[str]):
    """The batch function that adds ``text`` to columns ``names`` with ``ids``."""
    table = df.sparkSession.sparkContext.broadcast(piece_table(tokenizer_json))

    def put_text(batches):
        data, offsets = table.value
        for batch in batches:
            out = []
            for ids in batch.column(names.index("ids")).to_pylist():
                at = np.frombuffer(ids or b"", "<u4").astype(np.int64)
                parts = [data[_gather(offsets[a + 1] - offsets[a], offsets[a])].tobytes() for a in np.split(at, range(1 << 18, len(at), 1 << 18))]
                out.append(b"".join(parts).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*names, "text"])

    return put_text


def decode(encoded: DataFrame, tokenizer_json: str) -> DataFrame:
    """Adds ``text`` to rows with ``ids``: the pieces of the ids, joined; bytes that are no
    UTF-8 become U+FFFD. Null ids decode to the empty string."""
    return encoded.mapInArrow(_decoder(encoded, tokenizer_json, encoded.columns), encoded.select("*").schema.add("text", "string"))


def encode_and_decode(docs: DataFrame, tokenizer_json: str, head_words: int = HEAD_WORDS) -> DataFrame:
    """``encode`` and ``decode`` in one pass: ``(doc_id, n_tokens, ids, text)``. Both run in the same
    Python worker, which takes half the memory of one worker each."""
    encoder, decoder = _encoder(docs, tokenizer_json, head_words), _decoder(docs, tokenizer_json, ["doc_id", "n_tokens", "ids"])
    return docs.select("doc_id", "text").mapInArrow(lambda batches: decoder(encoder(batches)), _encoded_schema(docs) + ", text string")

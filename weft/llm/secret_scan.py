"""Operator 8: secret scans by rules and by token efficiency.

Rules find assignments, access keys and long hex strings. Beyond these, a run of key characters
is reported as ``random`` when a public BPE vocabulary needs so many tokens for it that it has
few characters per token: words and identifiers compress well, random strings do not. Left out
before that test: runs inside a span that a rule already reports, hex digests of the known
lengths, UUIDs, and identifiers (every part between separators is all letters or all digits).

Defined results: null text counts as empty; no match gives zeros, the digest of the empty
string and an empty span list; every input row gives one output row.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# The rules and their kinds in order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "random"]

RUN = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
MAX_CHARS_PER_TOKEN = 2.2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the rules' matches, sorted."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _known(run: str) -> bool:
    """Digests and identifiers, which are not secrets."""
    if UUID.fullmatch(run):
        return True
    if len(run) in DIGEST_LENGTHS and not run.strip("0123456789abcdefABCDEF"):
        return True
    return all(p.isalpha() or p.isdigit() for p in re.split(r"[+/=_-]+", run) if p)


def random_spans(text: str, base: list[tuple[int, int, int]], n_tokens, limit: float = MAX_CHARS_PER_TOKEN):
    """Runs with at most ``limit`` characters per token; ``n_tokens(string)`` counts tokens."""
    out = []
    for m in RUN.finditer(text):
        s, e = m.span()
        if any(a <= s and e <= b for a, _, b in base) or _known(m.group()):
            continue
        if e - s <= limit * n_tokens(m.group()):
            out.append((s, 3, e))
    return out


def _line(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _counter(vocabulary, pattern):
    import tiktoken

    enc = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})
    return lambda s: len(enc.encode_ordinary(s))


def scan(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``docs(doc_id, text)`` to one row per document with counts, the digest of the rules' spans
    and all spans. ``ranks`` and ``pattern`` are a tiktoken vocabulary (bounded, broadcast)."""
    model = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches):
        n_tokens = _counter(*model.value)
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                spans = sorted(base + random_spans(text or "", base, n_tokens))
                row = [*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(_line(base).encode()).hexdigest(), _line(spans), len(spans)]
                for col, value in zip(cols, row, strict=True):
                    col.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, ranks: dict[bytes, int], pattern: str, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs``, all columns, with every span of ``text`` replaced by ``mask`` (a null text
    stays null)."""
    model = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    at = docs.columns.index("text")

    def run(batches):
        n_tokens = _counter(*model.value)
        for batch in batches:
            clean = []
            for text in batch.column(at).to_pylist():
                base = base_spans(text or "")
                clean.append(masked(text, sorted(base + random_spans(text or "", base, n_tokens)), mask))
            yield batch.set_column(at, "text", pa.array(clean, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def masked(text: str | None, spans, mask: str) -> str | None:
    """The text with each maximal stretch of overlapping spans replaced."""
    if not spans:
        return text
    out, at = [], 0
    for s, _, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]])

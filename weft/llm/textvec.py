"""Word fingerprints of whole texts, vectorised with numpy inside Spark tasks.

A word's fingerprint mixes its bytes eight at a time; that of a range of words is a pair of polynomials
modulo primes. Neither has the regular collisions that polynomials modulo a power of two have. Equal words
have equal fingerprints in every task. Texts are processed in groups of about
``GROUP_BYTES``; longer texts are cut at white space, so working memory does not grow with
the length of a text (a single word longer than that is the exception).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GROUP_BYTES = 1 << 20
_PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
_BASES = (1270812569, 1911338771)
_POWERS = [np.ones(1, np.uint64) for _ in range(4)]  # of each base, and of its inverse, modulo the prime
# \x20 \x09-\x0D
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of both bases and of their inverses."""
    if len(_POWERS[0]) < n:
        size = max(n, GROUP_BYTES + 1)
        for i, (prime, base) in enumerate(zip(_PRIMES * 2, (*_BASES, *(pow(b, -1, int(p)) for b, p in zip(_BASES, _PRIMES, strict=True))), strict=True)):
            row = np.ones(1, np.uint64)
            while len(row) < size:  # twice as many each time
                row = np.concatenate([row, row * np.uint64(pow(base, len(row), int(prime))) % prime])
            _POWERS[i] = row
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing permutation of 64-bit values (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fold(*parts: np.ndarray) -> np.ndarray:
    """Order-dependent fingerprint of several 64-bit columns."""
    out = np.uint64(0x243F6A8885A308D3) + np.zeros_like(parts[0])
    for i, p in enumerate(parts):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + p + np.uint64(i + 1))
    return out


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the byte spans ``buf[starts:ends]``: eight bytes at a time, mixed each time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    windows = np.lib.stride_tricks.as_strided(padded, (len(buf) + 1, 8), (1, 1), writeable=False)
    size = (ends - starts).astype(np.uint64)
    out = mix(size + np.uint64(0x243F6A8885A308D3))
    left, at = np.arange(len(starts)), starts
    while len(left):
        block = windows[at].view("<u8").ravel()
        rest = (ends[left] - at).astype(np.uint64)
        short = rest < 8
        block[short] &= (np.uint64(1) << (rest[short] * np.uint64(8))) - np.uint64(1)
        out[left] = mix(out[left] * np.uint64(0x9E3779B97F4A7C15) + block)
        more = rest > 8
        left, at = left[more], at[more] + 8
    return out


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the ranges ``values[starts:ends]`` of 64-bit values, in order: polynomials
    modulo two primes, from sums over prefixes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power = _powers(len(values) + 1)
    mixed = mix(values)
    halves = []
    for i, prime in enumerate(_PRIMES):
        part = (mixed >> np.uint64(32 * i)) % prime * power[i][: len(values)] % prime
        sums = np.concatenate(([np.uint64(0)], np.cumsum(part)))
        halves.append((sums[ends] - sums[starts]) % prime * power[i + 2][starts] % prime)
    return mix(mix(halves[0] << np.uint64(32) | halves[1]) + (ends - starts).astype(np.uint64))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of a byte buffer."""
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    return edge[0::2], edge[1::2]


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about ``GROUP_BYTES``, cut at white space."""
    at = 0
    while len(text) - at > GROUP_BYTES:
        cut = max(text.rfind(c, at, at + GROUP_BYTES) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        if cut <= at:
            nxt = [p for p in (text.find(c, at + GROUP_BYTES) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if p >= 0]
            if not nxt:
                break
            cut = min(nxt)
        yield text[at:cut + 1]
        at = cut + 1
    yield text[at:]


def word_hashes(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """For each text the fingerprints of its words, in order (none for a null text)."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        t = t or b""
        if len(t) > GROUP_BYTES:
            yield from _group(group)
            group, size = [], 0
            yield np.concatenate([h for p in _pieces(t) for h in _group([p])])
            continue
        if size + len(t) > GROUP_BYTES:
            yield from _group(group)
            group, size = [], 0
        group.append(t)
        size += len(t) + 1
    yield from _group(group)


def _group(group: list[bytes]) -> Iterator[np.ndarray]:
    if not group:
        return
    buf = np.frombuffer(b"\n".join(group), np.uint8)
    starts, ends = word_spans(buf)
    hashes = span_hashes(buf, starts, ends)
    at = np.searchsorted(starts, np.cumsum([0] + [len(g) + 1 for g in group]))
    for i in range(len(group)):
        yield hashes[at[i]:at[i + 1]]

"""Vectorised 64-bit hashes of byte runs and words, equal on every machine."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of `h` over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


# longer words are hashed one by one
LONG_WORD = 64
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWERED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space in order, A-Z lower-cased, and the number of words of each text.

    All words take in their next byte together, the longest first, so no word is built.
    """
    x = _LOWERED[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]  # each text ends in a space
    edges = np.diff(_SPACE[x].view(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    size = end - start
    h = mixed(size.astype(np.uint64) + np.uint64(MULTIPLIER))
    order = np.argsort(-np.minimum(size, LONG_WORD + 1).astype(np.int8), kind="stable")
    places, part, sizes = start[order], h[order], size[order]
    upto = len(sizes) - np.cumsum(np.bincount(np.minimum(sizes, LONG_WORD), minlength=LONG_WORD + 1))
    for j in range(LONG_WORD):
        n = int(upto[j])  # words of more than j bytes
        if not n:
            break
        step = (part[:n] ^ x[places[:n] + j]) * np.uint64(MULTIPLIER)
        part[:n] = step ^ (step >> np.uint64(32))
    h[order] = mixed(part)
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(x[start[i] : end[i]].tobytes())
    stops = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(start, stops), prepend=0)


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of `k` entries (bytes, or 64-bit words): a polynomial joined from runs of doubling length."""
    if len(x) < k:
        return np.empty(0, np.uint64)
    part, width, out, done = x.astype(np.uint64), 1, None, 0
    while True:
        if k & width:
            power = np.uint64(pow(MULTIPLIER, width, 1 << 64))
            n = len(x) - done - width + 1
            out = part[:n] if out is None else out[:n] * power + part[done : done + n]
            done += width
        if done == k:
            return mixed(out)
        part = part[:-width] * np.uint64(pow(MULTIPLIER, width, 1 << 64)) + part[width:]
        width *= 2


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


def span_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every run x[start:end], by content and length."""
    inverse = pow(MULTIPLIER, -1, 1 << 64)
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _powers(MULTIPLIER, len(x)))])
    low = _powers(inverse, len(x) + 1)
    return mixed((before[ends] - before[starts]) * low[starts] + mixed((ends - starts).astype(np.uint64)))

"""Word-shingle sets as sorted 64-bit hashes, computed with numpy per text.

A-Z are lower-cased; words are runs of non-separator bytes; a set holds the
hash of every five consecutive words, or of the whole sequence when there are
fewer. Equal shingles have equal hashes; a clash of unlike ones has chance
2**-64 a pair. Needs about 50 bytes of memory for each byte of the longest text."""

from __future__ import annotations

import numpy as np

WORDS = 5
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACE = _rng.integers(1, 1 << 63, WORDS, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = {"n": 0}


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n``."""
    if _powers["n"] < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of one UTF-8 text."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not text:
        return none
    b = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([False], ~_SPACE[b], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return none
    up, down = _grow(len(b) + 1)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[:len(b)])))
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64)), start


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes (int64) of one UTF-8 text."""
    word, _ = word_hashes(text)
    if not len(word):
        return np.zeros(0, np.int64)
    if len(word) < WORDS:
        h = (word * _PLACE[:len(word)]).sum(keepdims=True) + np.uint64(len(word))
    else:
        n = len(word) - WORDS + 1
        h = word[:n] * _PLACE[0]
        for j in range(1, WORDS):
            h = h + word[j:j + n] * _PLACE[j]
    return np.unique(mix(h).view(np.int64))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set: equal sets have equal fingerprints."""
    u = s.view(np.uint64)
    return tuple(int(mix(u ^ np.uint64(c)).sum().view(np.int64)) if len(s) else 0 for c in (0x51ED27, 0xA24BAED4963EE407))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))

"""Flat files of arrays, and an n-gram trie over them: on each level the nodes'
words as ranks in the file's word list, monotone Elias-Fano pointers to their
children on the next level, quantised log10 probabilities and back-off weights.
A trie is a compressed file in the shared folder, read whole by who searches it."""

from __future__ import annotations

import os

import numpy as np
import zstandard
from pyarrow import fs

RANGE = 32.0        # log10 probabilities from -RANGE to 0 in 16 bits
_KINDS = ["<u1", "<u2", "<u4", "<u8", "<i8"]


def narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(next(k for k, bits in zip(_KINDS, (8, 16, 32, 64), strict=False) if top < 1 << bits))


def pack(*arrays: np.ndarray) -> bytes:
    arrays = [a if a.dtype.str.replace("|", "<") in _KINDS else narrow(a) for a in arrays]
    head = [len(arrays)]
    for a in arrays:
        head += [_KINDS.index(a.dtype.str.replace("|", "<")), len(a)]
    return b"".join([np.array(head, "<i8").tobytes(), *[a.tobytes() for a in arrays]])


def unpack(raw) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8)
    out, at = [], 8 + 16 * n
    for kind, size in head.reshape(-1, 2).tolist():
        out.append(np.frombuffer(raw, _KINDS[kind], size, at))
        at += out[-1].nbytes
    return out


def _bytewise(a: np.ndarray, back: bool = False) -> np.ndarray:
    """First bytes first: numbers of like size compress better so."""
    shape = (a.itemsize, len(a)) if back else (len(a), a.itemsize)
    return np.ascontiguousarray(a.view(np.uint8).reshape(shape).T).reshape(-1).view(a.dtype)


def squeezed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pack(*[_bytewise(a) for a in map(np.ascontiguousarray, arrays)]))


def unsqueezed(raw: bytes) -> list[np.ndarray]:
    return [_bytewise(a, True) for a in unpack(zstandard.ZstdDecompressor().decompress(raw))]


def put(uri: str, raw: bytes) -> None:
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        f.write(raw)


def get(uri: str):
    """The file's bytes, memory-mapped on a local store."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, "<u1", "r")
    with store.open_input_stream(path) as f:
        return f.read()


def quantised(log10p: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(-log10p, 0, RANGE) * (65535 / RANGE)).astype("<u2")


def log10_of(code: np.ndarray) -> np.ndarray:
    return code * (-RANGE / 65535)


class Ids:
    """Numbers as their low 16 bits and the rest, in 3 bytes up to 2**24."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high = low, high

    @staticmethod
    def arrays(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return narrow(values & 0xFFFF).astype("<u2"), narrow(values >> 16)

    def __len__(self) -> int:
        return len(self.low)

    def __getitem__(self, i) -> np.ndarray:
        return self.low[i].astype(np.int64) | self.high[i].astype(np.int64) << 16


class EliasFano:
    """A non-decreasing sequence: low bits as they are, high bits in unary, read by select."""

    def __init__(self, low_bits: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.bits, self.low, self.high = int(low_bits[0]), low, high
        self.ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64))))

    @staticmethod
    def arrays(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, top = len(values), int(values[-1])
        bits = max(0, (max(top, 1) // n).bit_length() - 1)
        at = (values >> bits) + np.arange(n)
        words = np.zeros((int(at[-1]) // 64 + 1) * 8, np.uint8)
        np.bitwise_or.at(words, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return np.array([bits]), narrow(values & ((1 << bits) - 1)), words.view("<u8")

    def every(self) -> np.ndarray:
        """The whole sequence: the place of each one bit less the ones before it, then the low bits."""
        at = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[:len(self.low)]
        return ((at - np.arange(len(at))) << self.bits) | self.low

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for s in range(0, len(i), 1 << 15):
            j = i[s:s + (1 << 15)]
            w = np.searchsorted(self.ones, j, "right") - 1
            bits = np.unpackbits(self.high[w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at = (bits.cumsum(1, dtype=np.uint8) == (j - self.ones[w] + 1)[:, None]).argmax(1)
            out[s:s + (1 << 15)] = ((w * 64 + at - j) << self.bits) | self.low[j].astype(np.int64)
        return out


ABSENT = 65535      # the code of a node that the trie does not have


def firsts(grams: np.ndarray) -> list[np.ndarray]:
    """For n-grams as columns whose equal prefixes stand together: the first column of every node, level by level."""
    new, out = np.zeros(grams.shape[1], bool), []
    new[:1] = True
    for row in grams:
        new[1:] |= row[1:] != row[:-1]
        out.append(np.flatnonzero(new))
    return out


class Trie:
    """Levels of n-grams: level 1 holds words with their counts, the last level the longest n-grams."""

    def __init__(self, uri: str):
        order, frequent, rare, self.counts, *arrays = unsqueezed(get(uri))
        self.words = np.concatenate([frequent.astype("<u8"), rare])
        self.levels, self.keys = [], None
        for i in range(int(order[0])):
            last = i == int(order[0]) - 1
            low, high, own, back, *pointers = arrays[7 * i:7 * i + (4 if last else 7)]
            self.levels.append((Ids(low, high), own, back, None if last else EliasFano(*pointers)))

    def open(self) -> Trie:
        """For many searches: ids and pointers decoded once, as a shard has as many requests as nodes. A node's key, its
        parent's place and its word, ascends over a level."""
        self.levels = [(ids[:].astype(np.int32), own, back, pointers and pointers.every()) for ids, own, back, pointers in self.levels]
        above = [np.zeros(len(self.levels[0][0]), np.int64)] + [np.repeat(np.arange(len(p) - 1), np.diff(p)) for _, _, _, p in self.levels[:-1]]
        self.keys = [parent * len(self.words) + ids for parent, (ids, *_) in zip(above, self.levels, strict=True)]
        return self

    @staticmethod
    def build(uri: str, words: np.ndarray, grams: np.ndarray, counts: np.ndarray, mu: float, whole=None) -> None:
        """``grams``: distinct n-grams as ascending columns of ranks in the ascending ``words``; ``whole``: the counts of
        words of which other files hold n-grams too, by rank. A node's own part is n / (n of its context + mu)."""
        cut = np.searchsorted(words, np.uint64(1 << 32))
        first, out = firsts(grams), [np.array([len(grams)]), words[:cut].astype("<u4"), words[cut:].astype("<u8"), None]
        sums = np.concatenate(([0], np.cumsum(counts)))
        above = None
        for i, at in enumerate(first):
            n = np.diff(sums[np.append(at, grams.shape[1])])
            if i == 0:
                for rank, total in (whole or {}).items():
                    n[grams[0, at] == rank] = total
                out[3] = narrow(n)
                own = np.zeros(0, "<u2")
            else:
                parent = np.searchsorted(first[i - 1], at, "right") - 1
                own = np.minimum(quantised(np.log10(n / (above[parent] + mu))), ABSENT - 1)
            last = i == len(first) - 1
            out += [*Ids.arrays(grams[i, at]), own, np.zeros(0, "<u2") if last else quantised(np.log10(mu / (n + mu)))]
            if not last:
                out += EliasFano.arrays(np.searchsorted(first[i + 1], np.append(at, grams.shape[1])))
            above = n
        put(uri, squeezed(*out))

    def descend(self, words: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """For the nodes of ``grams`` (ranks in ``words``), level by level in their order: the counts of the words (0: absent),
        own parts of levels 2 on (``ABSENT``) and back-off weights of all but the last (0, a weight of 1)."""
        rank = _found(self.words, words)
        first, counts, own, back = firsts(grams), None, [], []
        place = None
        for i, (at, (ids, codes, weights, _)) in enumerate(zip(first, self.levels, strict=True)):
            word = rank[grams[i, at]]
            parent = np.zeros(len(at), np.int64) if i == 0 else place[np.searchsorted(first[i - 1], at, "right") - 1]
            if self.keys is not None:
                place = _found(self.keys[i], np.where((parent < 0) | (word < 0), -1, parent * len(self.words) + word))
            elif i == 0:
                place = _successor(ids, parent, parent + len(ids), word)
            else:
                known, p = parent >= 0, np.maximum(parent, 0)
                pointers = self.levels[i - 1][3]
                lo = pointers[p]
                place = _successor(ids, lo, np.where(known, pointers[p + 1], lo), word)
            hit, near = place >= 0, np.maximum(place, 0)
            if i == 0:
                counts = np.where(hit, self.counts[near], 0)
            else:
                own.append(np.where(hit, codes[near], ABSENT).astype("<u2"))
            if i < len(first) - 1:
                back.append(np.where(hit, weights[near], 0).astype("<u2"))
        return counts, own, back


def _found(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The places in ascending ``keys`` of those that are among them, else -1."""
    near = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[near] == asked, near, -1)


def _successor(ids: np.ndarray, lo: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Within each range of ``ids`` the place of the first id not below ``word`` if it is the word, else -1."""
    lo, hi = lo.copy(), end.copy()
    open_ = np.flatnonzero((lo < hi) & (word >= 0))
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        less = ids[mid] < word[open_]
        lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
        open_ = open_[lo[open_] < hi[open_]]
    near = np.minimum(lo, len(ids) - 1)
    return np.where((word >= 0) & (lo < end) & (ids[near] == word), near, -1)

"""Token counts by rank-synchronous array merging: the pre-tokens of a batch
are ragged numpy arrays of symbol ids; each round applies every sequence's
lowest-rank pair at once, until no pair is left; the surviving symbols are
counted. Distinct chunks between spaces are merged once and their counts kept
in a bounded cache. Null text counts as empty (0 tokens)."""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents

MAX_CHUNKS = 1_000_000
LIMIT = 2048
LONG = 512  # bytes from which a pre-token is merged on its own, so that it does not set the rounds of the others
_BIG = np.iinfo(np.int64).max


def _byte_chars() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in keep else chr(256 + extra))
        extra += b not in keep
    return out


class Counter(dict):
    """chunk -> number of tokens, for the lower-casing word tokenizer with word-end symbols."""

    def __init__(self, path: str):
        import regex
        super().__init__()
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        vocab = j["model"]["vocab"]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + "</w>"] for c in chars], np.int64)
        left, right, new = [], [], []
        for a, b in j["model"]["merges"]:
            left.append(vocab[a])
            right.append(vocab[b])
            new.append(vocab[a + b])
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key)
        self.keys_, self.rank, self.new = key[order], order.astype(np.int64), np.array(new, np.int64)
        specials = [t["content"] for t in j["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials)))
        self.pre = regex.compile(j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.ranks: dict[int, int] | None = None  # pair -> rank, made when the first long pre-token comes
        self.space = regex.compile(r"[\t-\r \x85\xa0\p{Z}]+")

    def pre_tokens(self, chunk: str) -> tuple[list[bytes], int]:
        found, n = [], len(self.special.findall(chunk)) if "<|" in chunk else 0
        for piece in self.special.split(chunk) if n else [chunk]:
            s = unicodedata.normalize("NFC", piece)
            s = self.space.sub(" ", s).replace("Σ", "σ").lower()
            found += [x.encode() for x in self.pre.findall(s)]
        return found, n

    def merge(self, tokens: list[bytes]) -> np.ndarray:
        """Surviving symbols of each pre-token."""
        out = np.ones(len(tokens), np.int64)
        short = [i for i, t in enumerate(tokens) if len(t) < LONG]
        for i, t in enumerate(tokens):
            if len(t) >= LONG:
                out[i] = self.merge_long(t)
        if short:
            out[short] = self.merge_short([tokens[i] for i in short])
        return out

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys_, pair), len(self.keys_) - 1)
        return np.where(self.keys_[at] == pair, self.rank[at], _BIG)

    def merge_long(self, token: bytes) -> int:
        """Surviving symbols of one long pre-token. The rounds are the same (all places of the lowest rank at once),
        but the places of every rank are kept, so a round costs what it merges and not the whole token."""
        raw = np.frombuffer(token, np.uint8)
        sym = self.inner[raw]
        sym[-1] = self.last[raw[-1]]
        n = len(sym)
        rank = np.append(self.ranks_of(sym[:-1], sym[1:]), _BIG).tolist()
        sym, after, before = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        for i, r in enumerate(rank):
            if r != _BIG:
                places.setdefault(r, []).append(i)
        if self.ranks is None:
            self.ranks = dict(zip(self.keys_.tolist(), self.rank.tolist(), strict=True))
        heap, left = list(places), n
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            new = int(self.new[r])
            for i in sorted(places.pop(r)):
                if rank[i] != r:
                    continue  # merged or changed since
                j = after[i]
                sym[i], after[i], rank[j] = new, after[j], _BIG
                if after[i] < n:
                    before[after[i]] = i
                left -= 1
                for k in (before[i], i):
                    if k < 0:
                        continue
                    m = after[k]
                    x = self.ranks.get(sym[k] << 32 | sym[m], _BIG) if m < n else _BIG
                    rank[k] = x
                    if x != _BIG:
                        if x not in places:
                            places[x] = []
                            heapq.heappush(heap, x)
                        places[x].append(k)
        return left

    def merge_short(self, tokens: list[bytes]) -> np.ndarray:
        lens = np.array([len(t) for t in tokens], np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        ends = np.cumsum(lens)
        sym = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        seq = np.repeat(np.arange(len(tokens)), lens)
        out = np.ones(len(tokens), np.int64)
        while len(sym) > 1:
            pair = np.where(seq[:-1] == seq[1:], sym[:-1] << 32 | sym[1:], -1)
            at = np.minimum(np.searchsorted(self.keys_, pair), len(self.keys_) - 1)
            rank = np.where(self.keys_[at] == pair, self.rank[at], _BIG)
            start = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            best = np.minimum.reduceat(np.append(rank, _BIG), start)
            size = np.diff(np.append(start, len(seq)))
            done = best == _BIG
            out[seq[start[done]]] = size[done]
            if done.all():
                return out
            hit = np.append((rank == np.repeat(best, size)[:-1]) & (rank != _BIG), False)
            # overlapping hits (a a a) merge from the left: keep every other hit of a run
            idx = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), idx, -1))
            hit &= (idx - run) % 2 == 0
            sym = sym.copy()
            sym[hit] = self.new[rank[hit[:-1]]]
            stay = ~np.append(False, hit[:-1]) & ~np.repeat(done, size)
            sym, seq = sym[stay], seq[stay]
        if len(sym):
            out[seq] = 1
        return out

    def learn(self, chunks: list[str]) -> None:
        pre, owner, counts = [], [], np.zeros(len(chunks), np.int64)
        for i, c in enumerate(chunks):
            p, n = self.pre_tokens(c)
            counts[i] = n
            pre += p
            owner += [i] * len(p)
        if pre:
            np.add.at(counts, np.array(owner), self.merge(pre))
        self.update(zip(chunks, counts.tolist(), strict=True))

    def count_all(self, texts: list[str]) -> list[int]:
        out = []
        for i in range(0, len(texts), 256):
            lot = texts[i:i + 256]
            todo = list({c for t in lot for c in t.replace("\n", " ").split(" ") if c not in self})
            for k in range(0, len(todo), 50_000):
                self.learn(todo[k:k + 50_000])
            out += [sum(map(self.__getitem__, t.replace("\n", " ").split(" "))) for t in lot]
            if len(self) > MAX_CHUNKS:
                self.clear()
        return out


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``."""

    def count(batches):
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = _COUNTERS[path].count_all(texts)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column(0), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                 "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))

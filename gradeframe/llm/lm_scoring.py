"""LM scoring with an n-gram trie in Elias-Fano levels, dealt over files by first word.

1. ``encoded`` writes the documents in blocks of about ``BLOCK`` bytes to the
   shared folder: a block's distinct words (64-bit hashes) and its tokens.
2. ``train`` counts the words. Those that make up more than one in ``RARE``
   tokens (so at most that many, about 16 bytes each, in a file that tasks map)
   are numbered by frequency from then on; the others keep 63 bits of their
   hashes. It then sums the blocks' distinct n-grams of the highest order and keeps
   one ``ef_trie.Trie`` a shard: all n-grams that begin with a word lie in one
   file, those of a word seen more than ``HOT`` times in several, by their
   second word. A document ends with padding, so that these n-grams hold all
   shorter ones as prefixes and a node's count is the sum of its children's.
3. ``score`` deals every block's distinct n-grams to the same shards. A task
   opens its file and descends it once for each n-gram: the path gives the
   word's count, and every prefix's own part and back-off weight. What one token
   needs at lower orders is on the paths of the n-grams that begin after it.
   A reply leaves out what follows from the rest of it, without loss (``_reply``).

The disk holds the blocks, the tries (both compressed), and what is dealt to the
shards and back: for every block a row each way for each shard, so that their
number grows with the square of the input and their fixed parts weigh more then.

Smoothing is hierarchical with ``MU`` pseudo-counts of the lower order:
P(w|c) = n(cw) / (n(c) + MU) + MU / (n(c) + MU) * P(w|c'). The trie keeps the
log10 of both factors in 16 bits. The lowest order is the add-0.5 estimate of
the base score, so the probabilities of all words and one unknown word add up
to 1. The context of a document's first word is the end token.

Null and empty texts are one end token. A null id counts as training. Rows
that repeat an id are documents of their own. Other columns, of any name, are
not read. An empty table gives no rows; with no training rows, the base
estimate of N = V = 0 scores. Two words with equal hashes would count as
one. A task holds one block, or the distinct n-grams of one shard (those of one
pair of words at least) and ``FOLD`` more."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.session import scratch_path

from .common import documents, written
from .ef_trie import ABSENT, RANGE, Trie, firsts, get, log10_of, narrow, pack, put, quantised, squeezed, unpack, unsqueezed
from .shingles import mix, word_hashes

BLOCK = 8 << 20
SLICE = 1 << 20
SHARD = 1_000_000       # training tokens a shard
FOLD = 1_000_000        # n-grams that wait to be summed
HOT = 250_000
RARE = 10_000_000
MU = 4.0
END, PAD, TOP = np.uint64(0x5851F42D4C957F2D), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1 << 63)
BLOCKS = "block string, n_tokens long"
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
REQUEST = "shard int, block string, payload binary"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def _small(*arrays) -> bytes:
    return squeezed(*[a if a.dtype.str == "<i8" and len(a) and a.min() < 0 else narrow(a) for a in arrays])


def _written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written; Spark drops the shuffle files that only this needed."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, "false")
    conf.set(CLEAN, "true")
    try:
        return written(df, label)
    finally:
        conf.set(CLEAN, before)


def _slices(sizes: np.ndarray, most: int):
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n + 1
    if at < len(sizes):
        yield at, len(sizes)


def _encode(root: str, block: int):
    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column("text").to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            for lo, hi in _slices(sizes, block):
                hashes, per_doc = [], []
                for s, e in _slices(sizes[lo:hi], SLICE):
                    ends = np.cumsum(sizes[lo + s:lo + e] + 1)
                    h, start = word_hashes(b"\n".join(texts[lo + s:lo + e]))
                    hashes.append(h)
                    per_doc.append(np.bincount(np.searchsorted(ends, start, "right"), minlength=e - s))
                n = np.concatenate(per_doc)
                coded = pa.array(np.concatenate([*hashes, [END]]).astype("<u8")).dictionary_encode()
                words, tok = coded.dictionary.to_numpy(), coded.indices.to_numpy()
                seq = np.full(int(n.sum()) + 2 * len(n), tok[-1])
                seq[np.arange(len(tok) - 1) + 2 * np.repeat(np.arange(len(n)), n) + 1] = tok[:-1]
                often = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")
                place = np.empty(len(words), np.int64)
                place[often] = np.arange(len(words))
                ids, held = b.column("doc_id").slice(lo, hi - lo), np.array(b.column("held").slice(lo, hi - lo), bool)
                name = f"{root}/block-{uuid.uuid4().hex}"
                put(name, _small(ids.fill_null(0).to_numpy().astype("<i8"), np.array(ids.is_null(), np.uint8), held.astype(np.uint8),
                                 n, words[often], place[seq]))
                yield pa.RecordBatch.from_pydict({"block": [name], "n_tokens": pa.array([int(n.sum()) + len(n)], pa.int64())})
    return run


def _word_counts(batches):
    """The words of each block in documents that are not held out."""
    for block, in _rows(batches, "block"):
        _, _, held, n, words, seq = unsqueezed(get(block))
        n = n.astype(np.int64) + 2
        scored = np.repeat(held == 0, n)
        scored[np.cumsum(n) - n] = False              # the end token before a document is context only
        count = np.bincount(seq[scored], minlength=len(words))
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"word": words[seen].view("<i8"), "n": count[seen]})


def _ascending(grams, size: int) -> np.ndarray:
    """The places of n-grams (a row for each word, of numbers below ``size``) in ascending order."""
    key, top = grams[0].astype(np.int64), size
    for row in grams[1:]:
        if top * size >> 63:
            kept, key = np.unique(key, return_inverse=True)
            top = len(kept)
        key, top = key * size + row, top * size
    return np.argsort(key)


class Block:
    """A block's n-grams as a trie of its own: ``at[i]`` is the node on level i + 1 of the n-gram that begins at each
    token, ``grams`` the distinct n-grams of the highest order, ``above[i]`` their nodes on level i + 1, ``nodes[i]`` the number
    of nodes there."""

    def __init__(self, name: str, model: Model):
        order = model.order
        self.ids, self.null, held, n, words, seq = unsqueezed(get(name))
        self.ids = self.ids.astype(np.int64)
        keys = np.append(model.keys(words), PAD)
        by = np.argsort(keys, kind="stable")
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        self.held, self.n, self.words, seq = held.astype(bool), n.astype(np.int64), keys[by], number[seq]
        m, w = self.n + 1, len(self.words)
        self.used, self.rank = np.zeros(w, bool), np.zeros(w, np.int64)     # of the words of one request
        self.starts = np.cumsum(m) - m
        self.place = np.arange(int(m.sum())) - np.repeat(self.starts, m)
        doc = np.repeat(np.arange(len(m)), m)
        padded = np.full(len(seq) + (order - 2) * len(m), w - 1)
        padded[np.arange(len(seq)) + (order - 2) * np.repeat(np.arange(len(m)), m + 1)] = seq
        begin = np.arange(len(doc)) + (order - 1) * doc
        rows = [padded[begin + i] for i in range(order)]
        self.token = rows[1]
        by = _ascending(rows, w)
        new = np.zeros(len(by), bool)
        new[:1] = True
        self.at, rows, above = [], [row[by] for row in rows], []
        for row in rows:
            new[1:] |= row[1:] != row[:-1]
            above.append(np.cumsum(new, dtype=np.int32) - np.int32(1))
            self.at.append(np.empty(len(by), np.int32))
            self.at[-1][by] = above[-1]
        last = np.flatnonzero(new)
        self.nodes = [int(a[-1]) + 1 for a in above]
        self.grams, self.above = np.array([row[last] for row in rows]), [a[last] for a in above]
        self.count = np.bincount(self.at[-1][np.repeat(~self.held, m)], minlength=len(last))

    def firsts(self, g: np.ndarray) -> list[np.ndarray]:
        """Among the n-grams ``g`` (ascending) the first of every node, level by level."""
        return [np.flatnonzero(np.diff(above[g], prepend=-1)) for above in self.above]

    def dealt(self, model: Model, only: np.ndarray):
        """(shard, its distinct n-grams) of those of ``only``."""
        if not len(only):
            return ()
        (a, b), often, mixed, parts = self.grams[:2, only], model.often(), mix(self.words), np.ones(len(self.words), np.uint64)
        known = self.words[:np.searchsorted(self.words, np.uint64(len(often)))].astype(np.int64)
        parts[:len(known)] = -(-often[known].astype(np.int64) // model.hot)
        shard = (mix(mixed) % np.uint64(model.shards))[a]
        hot = np.flatnonzero((parts > 1)[a])
        shard[hot] = mix(mixed[a[hot]] + mixed[b[hot]] % parts[a[hot]] * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(model.shards)
        order = np.argsort(narrow(shard), kind="stable")
        found, first = np.unique(shard[order], return_index=True)
        return zip(found.tolist(), np.split(only[order], first[1:]), strict=True)

    def request(self, g: np.ndarray, *more: np.ndarray) -> bytes:
        """N-grams as nested nodes: the words, on each level their ranks, and the children's number on all but the last."""
        first = self.firsts(g)
        ranks = [row[g[at]] for row, at in zip(self.grams, first, strict=True)]
        for row in ranks:
            self.used[row] = True
        used = np.flatnonzero(self.used)
        self.rank[used], self.used[used] = np.arange(len(used)), False
        words, ranks = self.words[used], [self.rank[row] for row in ranks]
        sizes = [np.diff(np.searchsorted(below, np.append(at, len(g)))) for at, below in zip(first, first[1:], strict=False)]
        cut = np.searchsorted(words, TOP)
        return _small(np.diff(words[:cut], prepend=np.uint64(0)), np.diff(words[cut:], prepend=np.uint64(0)), *ranks, *sizes, *more)


def _nested(raw: bytes, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A request's words, its n-grams as columns of ranks, and what came with them."""
    often, rare, *arrays = unsqueezed(raw)
    ranks, sizes, more = arrays[:order], arrays[order:2 * order - 1], arrays[2 * order - 1:]
    grams = [ranks[-1].astype(np.int64)]
    repeat = np.ones(len(ranks[-1]), np.int64)
    for r, s in zip(reversed(ranks[:-1]), reversed(sizes), strict=True):
        repeat = np.add.reduceat(repeat, np.cumsum(s, dtype=np.int64) - s)
        grams.insert(0, np.repeat(r.astype(np.int64), repeat))
    return np.concatenate([np.cumsum(often, dtype=np.uint64), np.cumsum(rare, dtype=np.uint64)]), np.array(grams), more


def _folded(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts (words, n-grams, counts) as one, its n-grams distinct and ascending."""
    words = np.unique(np.concatenate([p[0] for p in parts]))
    grams = np.concatenate([np.searchsorted(words, p[0])[p[1]] for p in parts], axis=1)
    counts = np.concatenate([p[2].astype(np.int64) for p in parts])
    by = _ascending(grams, len(words))
    grams = grams[:, by]
    first = firsts(grams)[-1]
    return words, grams[:, first], np.add.reduceat(counts[by], first)


LEVEL = 1 << 15
_COUNTS = np.rint(MU * 10.0 ** ((LEVEL - np.arange(1 << 16)) * (RANGE / 65535)))
_WEIGHTS = quantised(np.log10(MU / (_COUNTS + MU)))
_WEIGHTS[0] = 0
_POWERS = 10.0 ** log10_of(np.arange(1 << 16))


def _reply(first: list[np.ndarray], counts: np.ndarray, own: list, back: list) -> bytes:
    """What ``Trie.descend`` found, without what follows from it. An own part less its context's weight is log10(n / MU), a
    small set of numbers; 0 marks an absent node. A weight is sent as what it differs from that of so found an n."""
    out = []
    for i, code in enumerate(own):
        begins = np.zeros(int(first[i + 1][-1]) + 1, bool)
        begins[first[i]] = True
        parent = (np.cumsum(begins) - 1)[first[i + 1]]
        out.append(np.where(code == ABSENT, 0, code.astype(np.int64) - back[i][parent] + LEVEL))
        if i + 1 < len(back):
            out.append((back[i + 1] - _WEIGHTS[out[-1]].astype(np.int64)) & 0xFFFF)
    return _small(counts, *out)


def _told(b: Block, count: np.ndarray, told: list[np.ndarray]):
    """The own parts and weights, as probabilities, of the nodes of a block: from the counts of its words and the rest of the replies."""
    own, back, last = [], [], b.firsts(np.arange(b.grams.shape[1]))
    weight = quantised(np.log10(MU / (count[b.grams[0, last[0]]] + MU))).astype(np.int64)
    for i in range(len(last) - 1):
        back.append(_POWERS[weight])
        less = told[2 * i]
        own.append(np.where(less == 0, 0.0, _POWERS[(less + weight[b.above[i][last[i + 1]]] - LEVEL) & 0xFFFF]))
        if 2 * i + 1 < len(told):
            weight = (told[2 * i + 1] + _WEIGHTS[less]) & 0xFFFF
    return own, back


@dataclass
class Model:
    """A trained model: tries of ``manifest`` (shard, file), ``frequent`` (file of the frequent words: hashes ascending,
    their numbers, and counts by number), the number of training tokens and of their distinct words."""
    manifest: DataFrame | None
    order: int
    shards: int
    tokens: int
    vocabulary: int
    frequent: str
    hot: int

    def often(self) -> np.ndarray:
        return unpack(get(self.frequent))[2]

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the frequent words, marked hashes of the others."""
        hashes, number, _ = unpack(get(self.frequent))
        if not len(hashes):
            return words | TOP
        i = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
        return np.where(hashes[i] == words, number[i].astype("<u8"), words | TOP)


def _rows(batches, *columns: str):
    for b in batches:
        yield from zip(*[b.column(c).to_pylist() for c in columns], strict=True)


def _folder(spark, label: str) -> str:
    root = scratch_path(spark, label)
    return root if "://" in root or root.startswith("file:") else f"file://{root}"


def encoded(docs: DataFrame, held_out, block: int = BLOCK) -> DataFrame:
    """A row for each block of documents: its file, tokens, and the counts of its words in rows that are not held out."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held"))
    return written(rows.mapInArrow(_encode(_folder(docs.sparkSession, "lm"), block), BLOCKS), "lm-blocks")


def train(blocks: DataFrame, order: int = 3, hot: int = HOT) -> Model:
    """The model of the blocks' documents that are not held out."""
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = blocks.sparkSession
    root = _folder(spark, "lm-model")
    counts = _spread(blocks).mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = _written(counts, "lm-words")
    vocabulary, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    name = f"{root}/frequent-{uuid.uuid4().hex}"

    def save(batches):
        table = [(b.column("word").to_numpy(), b.column("n").to_numpy()) for b in batches]
        words = np.concatenate([t[0] for t in table] or [np.zeros(0, "<i8")]).view("<u8")
        n = np.concatenate([t[1] for t in table] or [np.zeros(0, "<i8")])
        number, by = np.empty(len(n), np.int64), np.argsort(words)
        number[np.lexsort((words, -n))] = np.arange(len(n))
        put(name, pack(words[by], narrow(number[by]), narrow(-np.sort(-n))))
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(n)], pa.int64())})
    often = counts.where(F.col("n") > F.greatest(F.lit(1), F.lit(tokens) / RARE))
    often.coalesce(1).mapInArrow(save, "n long").count()
    model = Model(None, order, max(1, math.ceil(tokens / SHARD)), tokens, vocabulary, name, hot)

    def ask(batches):
        for block, in _rows(batches, "block"):
            b = Block(block, model)
            for shard, g in b.dealt(model, np.flatnonzero(b.count)):
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": [block],
                                                  "payload": pa.array([b.request(g, b.count[g])], pa.binary())})

    def build(batches):
        parts, waiting, shard = [], 0, None
        for shard, payload in _rows(batches, "shard", "payload"):  # noqa: B007
            words, grams, (n,) = _nested(payload, order)
            parts.append((words, grams, n))
            waiting += len(n)
            if waiting > FOLD:
                parts, waiting = [_folded(parts)], 0
        if parts:
            words, grams, n = _folded(parts)
            often, file = model.often(), f"{root}/trie-{uuid.uuid4().hex}"
            shared = words[:np.searchsorted(words, np.uint64(len(often)))]
            total = often[shared.astype(np.int64)].astype(np.int64)
            Trie.build(file, words, grams, n, MU, {i: int(total[i]) for i in np.flatnonzero(total > hot).tolist()})
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [file]})
    asked = _spread(blocks).mapInArrow(ask, REQUEST).repartitionById(model.shards, "shard")
    model.manifest = _written(asked.mapInArrow(build, "shard int, file string"), "lm-tries")
    return model


def _spread(blocks: DataFrame) -> DataFrame:
    """Block names over the tasks: a name is a small row and much work."""
    n = blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return blocks.select("block").repartition(max(int(n), blocks.count()), "block")


def score(model: Model, blocks: DataFrame) -> DataFrame:
    """Scores of every document of the blocks."""
    m, order = replace(model, manifest=None), model.order

    def ask(batches):
        for block, in _rows(batches, "block"):
            b = Block(block, m)
            for shard, g in b.dealt(m, np.arange(b.grams.shape[1])):
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": [block],
                                                  "payload": pa.array([b.request(g)], pa.binary())})

    def answer(batches):
        trie = None
        for shard, block, payload in _rows(batches, "shard", "block", "payload"):
            if block is None:                       # the first row of a shard names its file
                trie = Trie(payload.decode()).open()
                continue
            words, grams, _ = _nested(payload, order)
            first = firsts(grams)
            counts, own, back = trie.descend(words, grams) if trie else (
                np.zeros(len(first[0]), np.int64), [np.full(len(f), ABSENT) for f in first[1:]], [np.zeros(len(f), np.int64) for f in first[:-1]])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": [block],
                                              "payload": pa.array([_reply(first, counts, own, back)], pa.binary())})

    def add(batches):
        for block, replies in groupby(_rows(batches, "block", "shard", "payload"), lambda r: r[0]):
            yield _scored(Block(block, m), m, {shard: payload for _, shard, payload in replies})
    files = model.manifest.select("shard", F.lit(None).cast("string").alias("block"), F.col("file").cast("binary").alias("payload"))
    names = _spread(blocks)
    asked = names.mapInArrow(ask, REQUEST).unionByName(files)
    replies = asked.repartitionById(model.shards, "shard").sortWithinPartitions(F.col("block").asc_nulls_first()).mapInArrow(answer, REQUEST)
    return replies.repartition(names.rdd.getNumPartitions(), "block").sortWithinPartitions("block").mapInArrow(add, SCORES)


def _scored(b: Block, m: Model, replies: dict[int, bytes]) -> pa.RecordBatch:
    count = np.zeros(len(b.words), np.int64)
    told = [np.zeros(b.nodes[level // 2 + 1], np.int64) for level in range(2 * len(b.nodes) - 3)]
    for shard, g in b.dealt(m, np.arange(b.grams.shape[1])):
        first, (c, *codes) = b.firsts(g), unsqueezed(replies[shard])
        count[b.grams[0, g[first[0]]]] = c
        node = [above[g[at]] for above, at in zip(b.above, first, strict=True)]
        for level, (values, code) in enumerate(zip(told, codes, strict=True)):
            values[node[level // 2 + 1]] = code
    # a part of a hot word may hold none of its training n-grams: its count is known without the trie
    often = m.often()
    hot = np.flatnonzero(b.words < np.uint64(len(often) - np.searchsorted(often[::-1], m.hot, "right")))
    count[hot] = often[b.words[hot].astype(np.int64)]
    p = (count + 0.5) / (m.tokens + 0.5 * (m.vocabulary + 1))
    base, p, c = np.log10(p)[b.token], p[b.token], count[b.token]
    for i, (mine, weight) in enumerate(zip(*_told(b, count, told), strict=True)):
        to = np.flatnonzero(b.place >= i)           # tokens that have as long a context; it begins i + 1 tokens before
        p[to] = mine[b.at[i + 1][to - i]] + weight[b.at[i][to - i]] * p[to]
    total = lambda v: np.add.reduceat(v, b.starts)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(b.ids, pa.int64(), mask=b.null.astype(bool)), "held_out": pa.array(b.held), "n_tokens": pa.array(b.n + 1),
        "n_known": pa.array(total((c > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(b.ids), m.tokens, np.int64)),
        "base_score": pa.array(total(base)), "score": pa.array(total(np.log10(p)))})


def score_documents(docs: DataFrame, held_out, order: int = 3, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """Scores of every row; the model learns from the rows where the column ``held_out`` is not true."""
    blocks = encoded(docs, held_out, block)
    return score(train(blocks, order, hot), blocks)


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return score_documents(docs, held)

"""LM scores against a brute-force model; trie levels against plain search."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

TEXTS = [None, "", " ", "a b c A B c d", "the cat sat on the mat", "the cat sat on a mat", "x " * 500, "unseen words only é😀",
         "the\x0bdog\tran\nto the cat", *[f"the cat number {i % 3} sat" for i in range(30)], "same", "same"]


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\0end"]


@pytest.mark.parametrize("order", [2, 3])
def test_scores(spark, monkeypatch, order):
    from gradeframe.llm import lm_scoring as lm
    monkeypatch.setattr(lm, "SHARD", 100)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, score string").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = {r.doc_id: r for r in lm.score_documents(docs, held, order, block=200, hot=20).collect()}
    train = [tokens(t) for i, t in enumerate(TEXTS) if zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(x for t in train for x in t)
    n, v = sum(c.values()), len(c)
    grams = collections.Counter()
    for t in train:
        s = ["\0end", *t]
        for k in range(2, order + 1):
            grams.update(tuple(s[i:i + k]) for i in range(len(s) - k + 1))

    def p(gram):
        if len(gram) == 1:
            return (c[gram[0]] + 0.5) / (n + 0.5 * (v + 1))
        ctx = c[gram[0]] if len(gram) == 2 else grams[gram[:-1]]
        return (grams[gram] + lm.MU * p(gram[1:])) / (ctx + lm.MU)
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        w, r = tokens(t), got[i]
        s = ["\0end", *w]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10(p((x,))) for x in w), rel_tol=1e-9)
        want = sum(math.log10(p(tuple(s[max(0, j - order + 1):j + 1]))) for j in range(1, len(s)))
        assert abs(r.score - want) < 0.002 * len(w)


def test_trie(tmp_path):
    from gradeframe.llm.ef_trie import ABSENT, EliasFano, Trie, firsts, log10_of
    rng = np.random.default_rng(1)
    for top in (1, 50, 10**9):
        x = np.sort(rng.integers(0, top, 5000))
        a = EliasFano.arrays(x)
        assert (EliasFano(*a)[np.arange(5000)] == x).all() and (EliasFano(*a).every() == x).all()
    words = np.unique(rng.integers(0, 1 << 63, 40, np.uint64))
    every = np.array(np.unravel_index(np.arange(40 ** 3), (40, 40, 40)))
    kept = np.sort(rng.choice(np.arange(40 ** 3), 3000, replace=False))
    n = rng.integers(1, 9, 3000)
    Trie.build(f"file://{tmp_path}/a/trie", words, every[:, kept], n, 4.0, {7: 12345})
    tree = collections.Counter()
    for g, k in zip(every[:, kept].T.tolist(), n.tolist(), strict=True):
        for i in (1, 2, 3):
            tree[tuple(g[:i])] += k
    tree[(7,)] = 12345
    more = np.append(words, np.uint64((1 << 64) - 5))           # a word that the trie lacks
    grams = np.concatenate([every, [[40, 3], [3, 40], [3, 3]]], axis=1)
    counts, own, back = Trie(f"file://{tmp_path}/a/trie").descend(more, grams)
    again = Trie(f"file://{tmp_path}/a/trie").open().descend(more, grams)
    assert all((x == y).all() for x, y in zip([counts, *own, *back], [again[0], *again[1], *again[2]], strict=True))
    nodes = [[tuple(g) for g in grams[:i + 1, at].T.tolist()] for i, at in enumerate(firsts(grams))]
    assert counts.tolist() == [tree[g] for g in nodes[0]]
    for level, codes in zip(nodes[1:], own, strict=True):
        for g, code in zip(level, codes.tolist(), strict=True):
            assert (code == ABSENT) == (g not in tree)
            if g in tree:
                assert abs(log10_of(code) - math.log10(tree[g] / (tree[g[:-1]] + 4))) < 0.0003
    for level, codes in zip(nodes[:-1], back, strict=True):
        for g, code in zip(level, codes.tolist(), strict=True):
            assert abs(log10_of(code) - math.log10(4 / (tree[g] + 4))) < 0.0003


def test_model_is_kept_and_scores_other_documents(spark):
    from gradeframe.llm import lm_scoring as lm
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    model = lm.train(lm.encoded(docs, F.lit(False)))
    new = spark.createDataFrame([(None, "the cat sat"), (5, "the cat sat"), (5, "cat the sat"), (6, "nothing of these")], "doc_id long, text string")
    rows = [lm.score(model, lm.encoded(new, F.lit(True))).collect() for _ in range(2)]
    assert sorted(map(str, rows[0])) == sorted(map(str, rows[1])) and len(rows[0]) == 4
    by = {(r.doc_id, r.n_known): sorted(x.score for x in rows[0] if x.doc_id == r.doc_id) for r in rows[0]}
    assert by[(None, 4)][0] == by[(5, 4)][1] > by[(5, 4)][0] and by[(6, 1)]


def test_hot_words_over_several_shards(spark, monkeypatch):
    from gradeframe.llm import lm_scoring as lm
    monkeypatch.setattr(lm, "SHARD", 20)
    docs = spark.createDataFrame([(i, f"a w{i} b w{i % 7} a a w{i % 5}") for i in range(200)], "doc_id long, text string")
    held = F.col("doc_id") % 4 == 1
    split, whole = ({r.doc_id: (r.n_known, r.base_score, r.score) for r in lm.score_documents(docs, held, 3, hot=h).collect()}
                    for h in (10, 10**9))
    assert split == whole and len(split) == 200


def test_no_training_rows(spark):
    from gradeframe.llm.lm_scoring import score_documents
    r = score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert (r.n_known, r.train_tokens, r.score) == (0, 0, 0.0)


def test_empty_table(spark):
    from gradeframe.llm.lm_scoring import score_documents
    assert score_documents(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).count() == 0


def test_query_scores_with_trigrams(spark, tmp_path):
    from gradeframe.llm.lm_scoring import op8_lm_scoring, score_documents
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got, two, three = ({r.doc_id: r.score for r in d.collect()} for d in (
        op8_lm_scoring(spark, str(tmp_path)), score_documents(docs, held, 2), score_documents(docs, held, 3)))
    assert got == pytest.approx(three) and got != pytest.approx(two)


def test_files_and_replies_are_small_and_exact(tmp_path):
    """Bytes a trigram in the trie and in its replies, which the disk holds for every block; nothing is lost in either."""
    import os

    import pyarrow as pa

    from gradeframe.llm import lm_scoring as lm
    from gradeframe.llm.ef_trie import ABSENT, Trie, firsts, log10_of, narrow, pack, put
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in np.minimum(rng.zipf(1.3, 400), 5000)) for _ in range(100)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(100), pa.int64()), "text": pa.array([t.encode() for t in texts]),
                                        "held": pa.array([i % 5 == 1 for i in range(100)])})
    name = next(lm._encode(f"file://{tmp_path}/blocks", 1 << 22)([batch])).column("block")[0].as_py()
    put(f"file://{tmp_path}/frequent", pack(np.zeros(0, "<u8"), *[narrow(np.zeros(0, np.int64))] * 2))
    model = lm.Model(None, 3, 1, 32080, 4000, f"file://{tmp_path}/frequent", lm.HOT)
    b = lm.Block(name, model)
    every = np.arange(b.grams.shape[1])
    seen = np.flatnonzero(b.count)
    assert [(s, g.tolist()) for s, g in b.dealt(model, seen)] == [(0, seen.tolist())] and len(seen) < len(every)
    words, grams, (n,) = lm._nested(b.request(seen, b.count[seen]), 3)
    Trie.build(f"file://{tmp_path}/trie", words, grams, n.astype(np.int64), lm.MU)
    assert os.path.getsize(f"{tmp_path}/trie") < 6 * len(seen)
    words, grams, _ = lm._nested(b.request(every), 3)
    counts, own, back = Trie(f"file://{tmp_path}/trie").open().descend(words, grams)
    raw = lm._reply(firsts(grams), counts, own, back)
    assert len(raw) < 1.2 * len(every)
    count = np.zeros(len(b.words), np.int64)
    c, *told = lm.unsqueezed(raw)
    count[b.grams[0, b.firsts(every)[0]]] = c
    mine, weights = lm._told(b, count, [t.astype(np.int64) for t in told])
    assert all((x == np.where(y == ABSENT, 0.0, 10.0 ** log10_of(y))).all() for x, y in zip(mine, own, strict=True))
    assert all((x == 10.0 ** log10_of(y)).all() for x, y in zip(weights, back, strict=True))


def test_order_of_ngrams_past_64_bits():
    from gradeframe.llm.lm_scoring import _ascending
    grams = np.random.default_rng(5).integers(0, 1 << 30, (4, 2000)) // [[1 << 28], [1 << 29], [1], [1]]
    assert (grams[:, _ascending(grams, 1 << 30)] == grams[:, np.lexsort(grams[::-1])]).all()

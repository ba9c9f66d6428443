"""Resampling against a brute-force count over the fixture, and the CRC matrices against zlib."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np

TEXTS = [None, "", "  ", "The cat, the CAT! sat.", "ÀÉ straße İx 12-34 don't", "a", "a b", "same words here " * 12, "same words here " * 12,
         "x" * 9000 + " y " + "z" * 9000 + " w " + "x" * 9000, " ".join(f"w{i % 97}" for i in range(2500)), "tab\tnew\nline\x00nul\x7fdel"]
TEXTS += [" ".join(f"t{(i * j) % 23}" for j in range(15 + i)) for i in range(40)]
BENCH = [None, "", "t1 t2 t3 w5 w6 w7", "The cat sat on the mat " * 3, "t1 t2 t3 w5 w6 w7"]


def runs(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, bench):
    def bucket(f):
        return zlib.crc32(f.encode()) % 10_000
    every = [(i, *runs(t)) for i, t in rows]
    s = collections.Counter(bucket(f) for _, _, fs in every for f in fs)
    t = collections.Counter(bucket(f) for x in bench for f in runs(x)[1])
    S, T = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for i, n, fs in every:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([n, (i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))])
    fit = sorted((r for n, r in out if n >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    ranked = [(*r, k if k <= 5 * len(fit) // 100 else None) for k, r in enumerate(fit, 1)]
    return ranked + [(*r, None) for n, r in out if n < 20]


def frame(spark, rows, bench, d):
    spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, n_words int, rank int, buckets string") \
        .repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")


def key(r):
    return tuple((x is not None, x) for x in r)


def test_against_brute_force(spark, tmp_path):
    from gradeframe.llm.resampling import op11_importance_resampling
    rows = [*enumerate(TEXTS), (None, TEXTS[7]), (8, "another text of the same id " * 9)]
    frame(spark, rows, BENCH, tmp_path)
    got = [tuple(r) for r in op11_importance_resampling(spark, str(tmp_path)).collect()]
    want = brute(rows, BENCH)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[4] is not None for r in got) == 2


def test_empty_target(spark, tmp_path):
    from gradeframe.llm.resampling import op11_importance_resampling
    rows = [*enumerate(TEXTS[:12])]
    frame(spark, rows, [], tmp_path)
    got = [tuple(r) for r in op11_importance_resampling(spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, []), key=key)


def test_lots_cut_anywhere(monkeypatch):
    """A text gives the same runs whatever the lot size, words longer than a lot included."""
    from gradeframe.llm import resampling as r
    text = " ".join(["ab", "c", "ä" * 30, "d" * 5000] * 20 + [f"w{i}" for i in range(300)])
    want = sorted(zlib.crc32(f.encode()) % 10_000 for f in runs(text)[1])
    for lot in (1, 7, 64, 5000, 1 << 20):
        monkeypatch.setattr(r, "LOT", lot)
        (n, got), = r._buckets_of([text], 10_000)
        assert n == len(text.split()) and got.tolist() == want


def test_crc_matrix():
    from gradeframe.llm.resampling import crc_matrix
    rows = np.random.default_rng(3).integers(0, 256, (50, 17), dtype=np.uint8)
    assert crc_matrix(rows).tolist() == [zlib.crc32(r.tobytes()) for r in rows]
    assert crc_matrix(np.empty((2, 0), np.uint8)).tolist() == [0, 0]

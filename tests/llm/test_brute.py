"""The operators against brute force on a small fixture with nulls, empty, repeated and odd texts."""

import collections
import re
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", " ", "a b c d e a b c d e f", "Hello <|endoftext|> world's end, ok.", "x  y\n\nz\t1 2,3",
         "Straße ÀÉ İstanbul ΣΑΣ aaaa aaaaaaa", "word " * 3000, "same text", "same text"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", 0, "clash") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string") \
        .write.parquet(f"{d}/documents.parquet")
    return d


def encode(t):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(t or "", add_special_tokens=False).ids


def test_op1(spark, sf):
    from gradeframe.llm.token_files import op1_token_files
    got = {r.doc_id: tuple(r)[1:] for r in op1_token_files(spark, sf).collect()}
    at = 0
    for i, t in enumerate(TEXTS):
        ids = [*encode(t), 1]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op4(spark, sf):
    from gradeframe.llm.token_counts import op4_token_counts
    for r in op4_token_counts(spark, sf).collect():
        n = len(encode(TEXTS[r.doc_id]))
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 2048, len((TEXTS[r.doc_id] or "").encode()))


def test_op4_long_words():
    """Long pre-tokens count as in the library and take time in proportion (32,000 letters once took 8 s)."""
    import random
    import time

    from gradeframe.llm.token_counts import Counter
    draw = random.Random(1)
    odd = ["".join(draw.choice("abcdefghijklmnop0123ABüß") for _ in range(n)) for n in (511, 512, 513, 32_000)]
    odd += ["a" * 5000, "ab" * 3000, "aaab" * 1000 + "a", "naïve" * 700, "x " + "aab" * 400 + " y" + "b" * 600]
    c = Counter(P.path("word_bpe_49k.json"))
    began = time.time()
    got = c.count_all(odd)
    assert time.time() - began < 2 and got == [len(encode(t)) for t in odd]
    assert c.count_all(odd) == got


def test_op5(spark, sf):
    from gradeframe.llm.shards import op5_shards
    rows = op5_shards(spark, sf).collect()
    by = collections.defaultdict(list)
    for r in rows:
        b = (TEXTS[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(b) + 1, zlib.crc32(b), "key")
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        by[r.shard].append(r.slot)
    assert len(rows) == len(TEXTS) and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_op5_law_at_any_count(spark):
    """A shard added to any count, or to one that grew before, takes keys and no key moves elsewhere."""
    from pyspark.sql import functions as F

    from gradeframe.llm.shards import shard_of, tree
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    for created in (1, 3, 6, 16):
        cols = [shard_of(F.col("k"), tree(n, created)).alias(f"s{n}") for n in range(created, created + 5)]
        rows = keys.select(*cols).collect()
        for i in range(4):
            assert all(r[i + 1] in (r[i], created + i) for r in rows)
            took = sum(r[i + 1] == created + i for r in rows)
            assert 0.6 < took * (created + i + 1) / len(rows) < 1.4


def test_op6(spark, sf):
    from gradeframe.llm.quality import op6_quality
    for r in op6_quality(spark, sf).collect():
        t = TEXTS[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        c = collections.Counter(win)
        rep = len({i + k for i, x in enumerate(win) if c[x] > 1 for k in range(5)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * rep > 20 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, failed)
        assert not (failed and r.kept)


def test_empty(spark, sf, tmp_path):
    from gradeframe.llm.queries import QUERIES
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, f in QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name

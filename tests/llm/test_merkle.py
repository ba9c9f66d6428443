"""The manifest against a plain Merkle tree in memory, over nulls, ties and groups of every small size."""

import zlib
from hashlib import sha256

import pytest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    return [(lv[i ^ 1], (i ^ 1) < i) if (i ^ 1) < len(lv) else None for k, lv in enumerate(tree[:-1]) if (i := i if k == 0 else i // 2) >= 0]


def brute(rows):
    by = {}
    for doc_id, text, lang, source, n in rows:
        leaf = h(*map(field, (doc_id, source, lang, n, text)))
        bad = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        claimed = h(*map(field, (doc_id, source, lang, n + 1, text))) if bad else leaf
        by.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, doc_id, claimed))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([r[2] for r in sorted(by[x], key=lambda r: r[:3])]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for j, x in enumerate(langs):
        for i, (_, _, leaf, doc_id, claimed) in enumerate(sorted(by[x], key=lambda r: r[:3])):
            p = path(trees[x], i) + path(top, j)
            at = claimed
            for s in p:
                at = h(at) if s is None else h(s[0], at) if s[1] else h(at, s[0])
            out.append((doc_id, leaf, trees[x][-1][0], top[-1][0], h(*[s[0] for s in p if s]), at, at == top[-1][0]))
    return out


def run(spark, rows, d, step=10):
    from gradeframe.llm.merkle import op12_merkle
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, "
                          "g string, pos int, path string").repartition(3).write.parquet(f"{d}/documents.parquet")
    return [tuple(r) for r in op12_merkle(spark, str(d), step).collect()]


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("step", [1, 2, 10])
def test_groups_of_every_size(spark, tmp_path, step):
    """Groups of 1 to 9 rows, a null group, null fields, empty and long texts, repeated rows, null and repeated keys."""
    rows, k = [], 0
    for size, lang in enumerate(["ü", None, "de", "en", "", "z" * 300, "fr", "a b", "EN"], 1):
        for _ in range(size):
            rows.append((k, "t" * (k % 4) or None, lang, None if k % 5 == 0 else "sß", None if k % 6 == 0 else k))
            k += 1
    rows += [(7, "word " * 50_000, "en", "s", 3), (7, "", "en", "s", 3), (7, "", "en", "s", 3), (None, "null id", "en", "s", 1),
             (None, None, None, None, None)]
    got, want = run(spark, rows, tmp_path, step), brute(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[6] for r in got} == {True, False}


def test_several_stored_levels(spark, tmp_path):
    """More than one subtree of 2**STEP leaves, and a second stored level above the subroots' tree."""
    rows = [(i, str(i), "en" if i % 3 else "de", "s", i) for i in range(2600)]
    assert sorted(run(spark, rows, tmp_path), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("rows", [[(1, "a", "en", "s", 1)], [(i, "a", None, "s", 1) for i in range(2)], []])
def test_small(spark, tmp_path, rows):
    assert sorted(run(spark, rows, tmp_path), key=key) == sorted(brute(rows), key=key) if rows else run(spark, rows, tmp_path) == []

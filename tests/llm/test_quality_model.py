"""The classifier: its numbers against plain counts, its model on known functions, the query on held-out rows."""

import random
import zlib

import numpy as np
import pytest


def clean(draw):
    words = ["time", "house", "Grüße", "river", "answer", "people", "often", "small", "light", "paper", "stone", "called"]
    return "\n".join(" ".join(draw.choice(words).capitalize() if k == 0 else draw.choice(words) for k in range(draw.randint(5, 14))) + "."
                     for _ in range(draw.randint(1, 9)))


def junk(draw):
    kind = draw.randrange(4)
    if kind == 0:
        return clean(draw).upper().replace(" ", "!! ")
    if kind == 1:
        return " ".join([draw.choice(["buy", "now", "The"])] * draw.randint(20, 60))
    if kind == 2:
        return clean(draw).replace(" ", " | ")
    return clean(draw).replace(" ", "### ")


def texts(n, seed=5):
    draw = random.Random(seed)
    return [(clean(draw), 1) if draw.random() < 0.8 else (junk(draw), 0) for _ in range(n)]


def test_numbers():
    from gradeframe.llm.quality_model import FEATURES, numbers_of
    t = "The The cat sat.\nThe The cat sat.\n\n12 |# ÀÉ! x\tx x x x x x"
    got = dict(zip(FEATURES, numbers_of(t), strict=True))
    words = t.split()
    assert got["log_words"] == pytest.approx(np.log1p(len(words)))
    assert got["next_same"] == pytest.approx(8 / len(words)) and got["distinct"] == pytest.approx(len(set(words)) / len(words))
    assert got["line_repeats"] == pytest.approx(1 / 3) and got["stopped_lines"] == pytest.approx(2 / 3)
    assert got["symbol_share"] == pytest.approx(2 / len(t.encode())) and got["upper_share"] == pytest.approx(4 / 31)
    assert got["letterless"] == pytest.approx(2 / len(words)) and got["marks"] == pytest.approx(1 / len(words))
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    assert got["window_repeats"] == pytest.approx((len(windows) - len(set(windows))) / len(words))
    for empty in ("", " \n\t "):
        assert all(np.isfinite(numbers_of(empty)))


def test_pairs_are_needed_and_found():
    """Labels that depend on two numbers together only: single features learn nothing, the pair does."""
    from gradeframe.llm.quality_model import Gam
    x = np.random.default_rng(2).random((3000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    both, single = Gam(pairs=2).fit(x[:2000], y[:2000]), Gam(pairs=0).fit(x[:2000], y[:2000])
    assert both.pairs[0] == (1, 3)
    assert ((both.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert ((single.score(x[2000:]) > 0.5) == y[2000:]).mean() < 0.65


def test_score_is_a_sum_of_table_entries():
    from gradeframe.llm.quality_model import Gam
    x = np.random.default_rng(3).normal(size=(800, 3))
    g = Gam(pairs=2).fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    for row, score in zip(x[:20], g.score(x[:20]), strict=True):
        at = g.intercept + sum(t[np.searchsorted(c, v)] for t, c, v in zip(g.tables, g.cuts, row, strict=True))
        at += sum(t[np.searchsorted(g.coarse[a], row[a]), np.searchsorted(g.coarse[b], row[b])]
                  for (a, b), t in zip(g.pairs, g.grids, strict=True))
        assert score == pytest.approx(1 / (1 + np.exp(-at)))


def test_one_label_or_none():
    from gradeframe.llm.quality_model import Gam
    x = np.ones((9, 2))
    assert Gam().fit(x, np.ones(9)).score(x) == pytest.approx(9.5 / 10)
    assert Gam().fit(x[:0], np.ones(0)).score(x) == pytest.approx(0.5)


def frame(spark, rows, labels, d):
    spark.createDataFrame(rows, "doc_id long, text string, x string, score int, id string").repartition(3) \
        .write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")


def test_query(spark, tmp_path):
    """Held-out rows are judged right, labels of held-out rows teach nothing, odd rows get a score."""
    from gradeframe.llm.quality_model import op13_quality_classifier
    made = texts(700)
    odd = [(9000, None), (9001, ""), (9002, "word " * 200_000), (9003, "a"), (None, "null id text."), (5, made[5][0])]
    rows = [(i, t, "clash", 1, "x") for i, (t, _) in enumerate(made)] + [(i, t, None, None, None) for i, t in odd]
    held = {i for i in range(700) if zlib.crc32(str(i).encode()) % 4 == 2}
    labels = [(i, y, 0) for i, (_, y) in enumerate(made)] + [(1, made[1][1], 0), (None, 0, 0), (9003, None, 0)]
    frame(spark, rows, labels, tmp_path / "a")
    got = op13_quality_classifier(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (r.doc_id in held or (
        r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)) for r in got)
    by = {r.doc_id: r for r in got}
    right = [by[i].predicted == made[i][1] for i in held]
    assert len(right) > 100 and np.mean(right) > 0.97
    # turned labels of the held-out rows change no score
    frame(spark, rows, [(i, 1 - y if i in held else y, z) for i, y, z in labels], tmp_path / "b")
    turned = {r.doc_id: r.score for r in op13_quality_classifier(spark, str(tmp_path / "b")).collect()}
    assert turned == {i: r.score for i, r in by.items()}

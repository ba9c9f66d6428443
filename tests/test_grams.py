"""The Arrow step of the lexical job: bounded memory, and per-row counts that equal those Spark groups by key."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gradeframe.functions import grams
from gradeframe.operators.lexical import ALL_METRICS, lexical_scores, stem_tokens


def brute(toks, n):
    return Counter(tuple(toks[i:i + n]) for i in range(len(toks) - n + 1))


def _lists(rng, n):
    return [None if rng.random() < 0.1 else [rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(n)]


def test_clipped_matches_against_brute_force():
    rng = random.Random(7)
    a, b = _lists(rng, 300), _lists(rng, 300)
    ref, cand = (pa.array([[], *x], pa.list_(pa.string())).slice(1) for x in (a, b))
    got = np.concatenate([grams.clipped_matches(grams.coded(r, c)[0], grams.lengths(r), grams.lengths(c), 4)
                          for r, c in grams.runs(ref, cand, most=40)])
    assert got.tolist() == [[sum((brute(x or [], k) & brute(y or [], k)).values()) for k in range(1, 5)] for x, y in zip(a, b)]


def test_runs_hold_every_row_once():
    lists = pa.array([["a"] * n for n in (0, 3, 50, 1, 0, 2, 9)], pa.list_(pa.string()))
    parts = [r.to_pylist() for (r,) in grams.runs(lists, most=5)]
    assert sum(parts, []) == lists.to_pylist() and all(len(p) == 1 or sum(map(len, p)) <= 5 for p in parts)
    assert [*grams.runs(lists.slice(0, 0))] == []


def test_python_objects_do_not_grow_with_the_batch():
    """Ten times the rows of a batch: the same distinct tokens, so hardly more Python objects (they were 10 x)."""
    def peak(n):
        lists = pa.array([[f"word{(i * 7 + k) % 500}" for k in range(60)] for i in range(n)], pa.list_(pa.string()))
        tracemalloc.start()
        for r, c in grams.runs(lists, lists, most=12_000):
            codes, _ = grams.coded(r, c, str.upper)
            grams.clipped_matches(codes, grams.lengths(r), grams.lengths(c), 2)
            grams.lcs_lengths(codes, grams.lengths(r), grams.lengths(c))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top
    assert peak(5_000) < 1.5 * peak(500)


def test_rows_counted_in_place_equal_grouped_rows(spark):
    rng = random.Random(3)
    words = ["Running", "runs", "cats", "3.5", "the", "the", "generalization", "e-mail,", "x"]
    text = lambda: None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(30)))
    pairs = spark.createDataFrame([(i, text(), text()) for i in range(200)], "pair_id long, reference string, candidate string")
    for stem in (True, False):
        for metrics in (ALL_METRICS, ["rouge2"], ["rougeL"]):
            grouped, own = (sorted(map(tuple, lexical_scores(pairs, stem=stem, metrics=metrics, unique=u).collect())) for u in (False, True))
            assert grouped == own and len(own) == 200


def test_rows_counted_in_place_make_no_gram_records(spark):
    pairs = spark.createDataFrame([(1, "a b", "a")], "pair_id long, reference string, candidate string")
    plan = lexical_scores(pairs, unique=True)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_stem_lists(spark):
    df = spark.createDataFrame([(0, ["running", "cat"]), (1, None), (2, []), (3, ["cats", None])], "i int, t array<string>")
    rows = df.where("i < 3").select("i", stem_tokens(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in rows] == [["run", "cat"], [], []]

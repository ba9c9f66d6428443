"""Waves behind the commit log: what a killed job keeps, what a started-again job calls, how far a quota error reaches,
which rows repeated ids give, calls that hang, and the log itself."""

import json
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeframe.operators.ids import Ordered, narrow_row_number, wave_ranges
from gradeframe.operators.inference import infer
from gradeframe.plans import pipelines as P
from gradeframe.plans.pipelines import CallOptions, run_evaluate, run_label, run_query
from gradeframe.sources.commitlog import CommitLog
from gradeframe.sources.sinks import append_scores, read_responses, read_scores, read_versioned, write_versioned

ONCE = CallOptions(attempts=1, delay=0.0)


def counted(folder, answer):
    """A backend that notes every prompt it is called with in a file of ``folder``."""
    def make(model):
        def call(prompt):
            with open(os.path.join(folder, f"{os.getpid()}"), "a") as f:
                f.write(json.dumps([model.get("model_name"), prompt]) + "\n")
            return answer(model, prompt)
        return call
    return make


def made(folder):
    return Counter(tuple(json.loads(x)) for n in os.listdir(folder) for x in open(os.path.join(folder, n)))


def questions(spark, n):
    return spark.createDataFrame([(i, f"q{i:03d}", f"text {i}", f"reference {i}") for i in range(n)],
                                 "n int, question_id string, question_text string, ground_truth_answer string")


def models(spark, *names):
    return spark.createDataFrame([(i, m, "a", m, 0.0) for i, m in enumerate(names)],
                                 "model_ord int, model_name string, api string, model_id string, temperature double")


class Killed(Exception):
    pass


def killer(fn, at):
    """``fn`` that raises instead of its call number ``at``."""
    count = [0]

    def wrapped(*a, **kw):
        count[0] += 1
        if count[0] == at:
            raise Killed
        return fn(*a, **kw)
    return wrapped


@pytest.mark.parametrize("cut", ["between waves", "calls committed, rows not"])
def test_query_killed_and_started_again(spark, tmp_path, monkeypatch, cut):
    calls, out = str(tmp_path / "calls"), str(tmp_path / "out.csv")
    os.makedirs(calls)
    q, m = questions(spark, 30), models(spark, "x", "y")
    backend = {"a": counted(calls, lambda model, p: f"{model['model_name']} {p}")}
    if cut == "between waves":
        monkeypatch.setattr(P, "infer", killer(P.infer, 3))
    else:
        monkeypatch.setattr(P, "_commit_responses", killer(P._commit_responses, 2))
    with pytest.raises(Killed):
        run_query(spark, q, m, backend, out, ["n"], wave_size=8)
    kept = read_responses(spark, out).count()
    assert kept == (24 if cut == "between waves" else 8)       # 8 + 16 tasks, or the first 8
    monkeypatch.undo()
    rows = run_query(spark, q, m, backend, out, ["n"], wave_size=8).collect()
    assert len(rows) == 60 and sorted(r["response_id"] for r in rows) == [f"resp_{i:06d}" for i in range(1, 61)]
    assert set(made(calls).values()) == {1} and len(made(calls)) == 60   # no finished prompt was called twice
    by = sorted(rows, key=lambda r: r["response_id"])
    assert [(r["question_id"], r["model_name"]) for r in by] == [(f"q{i:03d}", x) for i in range(30) for x in "xy"]
    run_query(spark, q, m, backend, out, ["n"])
    assert len(made(calls)) == 60 and read_responses(spark, out).count() == 60


def test_quota_error_stops_calls_within_a_wave(spark, tmp_path):
    calls, out = str(tmp_path / "calls"), str(tmp_path / "out")
    os.makedirs(calls)

    def answer(model, prompt):
        if model["model_name"] == "x":
            raise RuntimeError("HTTP 429")
        return "ok"
    rows = run_query(spark, questions(spark, 100), models(spark, "x", "y"), {"a": counted(calls, answer)}, out, ["n"],
                     wave_size=10, calls=CallOptions(partitions=1)).collect()
    n = Counter(name for name, _ in made(calls))
    assert n == {"x": 1, "y": 100}                              # one task: the next prompt is already left out
    got = Counter(r["model_name"] for r in rows)
    assert got == {"x": 1, "y": 100}
    more = str(tmp_path / "more")
    os.makedirs(more)
    run_query(spark, questions(spark, 100), models(spark, "x", "y"), {"a": counted(more, answer)}, f"{out}2", ["n"],
              wave_size=10, calls=CallOptions(partitions=4))
    assert Counter(name for name, _ in made(more))["x"] <= 5    # at most the model's share of the first wave
    # what had no row is called by the next run, which goes on from the ids
    again = run_query(spark, questions(spark, 100), models(spark, "x", "y"), {"a": counted(calls, lambda *_: "ok")}, out, ["n"])
    assert again.count() == 200 and again.select("response_id").distinct().count() == 200
    assert again.where("error").count() == 1
    fixed = run_query(spark, questions(spark, 100), models(spark, "x", "y"), {"a": counted(calls, lambda *_: "ok")}, out, ["n"],
                      retry_errors=True)
    assert fixed.count() == 201 and fixed.where("not error").select("question_id", "model_name").distinct().count() == 200


def test_evaluate_killed_after_judge_calls(spark, tmp_path, monkeypatch):
    calls, out = str(tmp_path / "calls"), str(tmp_path / "scores")
    os.makedirs(calls)
    q = questions(spark, 40)
    r = q.select(F.concat(F.lit("r"), "question_id").alias("response_id"), "question_id", F.lit("x").alias("model_name"),
                 F.concat(F.lit("answer "), "n").alias("response_text"))
    judge = counted(calls, lambda model, p: f"CORRECTNESS: {len(p) % 10}\nJUSTIFICATION: {model['model_id']} {model['temperature']}")
    monkeypatch.setattr(P, "scored", killer(P.scored, 2))
    kw = {"judge_model": {"model_id": "j1", "temperature": 0.3}, "wave_size": 10, "calls": ONCE}
    with pytest.raises(Killed):
        run_evaluate(spark, q, r, models(spark, "x"), out, judge, **kw)
    assert read_scores(spark, out).count() == 10 and len(made(calls)) == 30
    monkeypatch.undo()
    rows = run_evaluate(spark, q, r, models(spark, "x"), out, judge, **kw).collect()
    assert len(rows) == 40 and set(made(calls).values()) == {1} and len(made(calls)) == 40
    assert sorted(x["score_id"] for x in rows) == [f"score_{i:06d}" for i in range(1, 41)]
    assert {x["justification"] for x in rows} == {"j1 0.3"}     # the judge is told its model by the documented keys
    assert CommitLog(spark, out).open_waves(P.CALLS) == []


def test_label_killed_between_waves(spark, tmp_path, monkeypatch):
    calls, base = str(tmp_path / "calls"), str(tmp_path / "questions")
    os.makedirs(calls)
    write_versioned(questions(spark, 30), base)
    labeller = counted(calls, lambda model, p: f"LEVEL: {len(p) % 6 + 1}\nJUSTIFICATION: {model['model_id']}")
    monkeypatch.setattr(P, "label_calls", killer(P.label_calls, 2))
    kw = {"model": {"model_id": "l1"}, "wave_size": 8, "calls": ONCE}
    with pytest.raises(Killed):
        run_label(spark, base, labeller, **kw)
    assert read_versioned(spark, base).columns == questions(spark, 1).columns      # the old version is whole
    monkeypatch.undo()
    assert tuple(run_label(spark, base, labeller, **kw).first()) == (30, 30)
    assert set(made(calls).values()) == {1} and len(made(calls)) == 30
    assert {r["bloom_justification"] for r in read_versioned(spark, base).collect()} == {"l1"}
    run_label(spark, base, labeller, relabel=True, **kw)                           # a relabel calls anew
    assert set(made(calls).values()) == {2}


def test_null_and_repeated_response_ids(spark, tmp_path):
    q = questions(spark, 3)
    r = spark.createDataFrame([(None, "q000", "x", "a"), (None, "q001", "x", "b"), ("r", "q000", "x", "reference 0"),
                               ("r", "q000", "x", "reference 0"), ("r", "q002", "x", ""), ("s", "missing", "x", "c")],
                              "response_id string, question_id string, model_name string, response_text string")
    rows = P.evaluate_frame(q, r, models(spark, "x")).collect()
    assert sorted((x["response_id"] or "", x["question_id"], x["response_text"], round(x["rouge1"], 3)) for x in rows) == [
        ("", "q000", "a", 0.0), ("", "q001", "b", 0.0), ("r", "q000", "reference 0", 1.0), ("r", "q000", "reference 0", 1.0),
        ("r", "q002", "", 0.0)]
    assert len({x["score_id"] for x in rows}) == 5
    out = run_evaluate(spark, q, r, models(spark, "x"), str(tmp_path / "s"))
    assert out.count() == 5 and run_evaluate(spark, q, r, models(spark, "x"), str(tmp_path / "s")).count() == 5


def test_nothing_to_do(spark, tmp_path):
    """Jobs over no rows give an empty table, and go on from there."""
    q, m = questions(spark, 2), models(spark, "x")
    none = spark.createDataFrame([], "response_id string, question_id string, model_name string, response_text string")
    assert run_evaluate(spark, q, none, m, str(tmp_path / "s")).count() == 0
    backend = {"a": counted(str(tmp_path), lambda *_: "ok")}
    out = str(tmp_path / "r")
    assert run_query(spark, q.limit(0), m, backend, out, ["n"]).count() == 0
    assert run_query(spark, q, m, backend, out, ["n"]).count() == 2
    assert run_evaluate(spark, q, read_responses(spark, out), m, str(tmp_path / "s")).count() == 2


def test_a_call_that_hangs_is_an_error_row(spark):
    def make(model):
        def call(prompt):
            if prompt == "hang":
                time.sleep(600)
            return prompt
        return call
    df = spark.createDataFrame([("a", "hang"), ("a", "fine"), ("a", "hang"), ("a", "too")], "api string, prompt string")
    began = time.time()
    rows = infer(df, {"a": make}, deadline=1.0, in_flight=2, partitions=1).collect()
    assert time.time() - began < 20
    assert {(r["prompt"], r["error"], r["error_message"]) for r in rows} == {
        ("hang", True, "no answer within 1 s"), ("fine", False, ""), ("too", False, "")}
    assert len({r["called_at"] for r in rows}) > 1


def test_log_of_commits(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "t"))
    df = spark.range(10).toDF("a")
    assert log.read(df.schema).count() == 0 and log.count() == 0
    log.write(df, "rows", "w1")
    log.write(df, "calls", "w2")
    df.write.parquet(f"{log.base}/rows/cut-off")                       # files without a commit
    with open(f"{log.folder}/000000000002.json", "w") as f:            # a commit cut off while it was written
        f.write('{"kind": "rows", "wave": "w3", "fi')
    assert log.read(df.schema).count() == 10 and log.count() == 10
    assert log.open_waves("calls") == ["w2"]
    log.commit("rows", "w2", [], 0)                                    # takes the next free number
    assert log.open_waves("calls") == [] and sorted(log._numbers()) == [0, 1, 2, 3]


def test_folder_of_parquet_becomes_the_first_wave(spark, tmp_path):
    from gradeframe.schemas import SCORES_SCHEMA
    old = str(tmp_path / "old.csv")
    spark.createDataFrame([tuple([None] * len(SCORES_SCHEMA))] * 3, SCORES_SCHEMA).write.parquet(old)
    append_scores(spark.createDataFrame([tuple([None] * len(SCORES_SCHEMA))], SCORES_SCHEMA), old)
    assert read_scores(spark, old).count() == 4


def test_ordered_ranges(spark):
    o = Ordered(spark.range(1000).select((999 - F.col("id")).alias("v")).repartition(7), ["v"])
    assert o.count == 1000
    for a, b in [(0, 1), (0, 1000), (333, 700), (999, 1000), (500, 500)]:
        got = sorted((r["_n"], r["v"]) for r in o.rows(a, b).collect())
        assert got == [(i, i) for i in range(a, b)]
    assert Ordered(spark.range(0), ["id"]).count == 0
    assert wave_ranges(100, 10, 30) == [(0, 10), (10, 30), (30, 60), (60, 90), (90, 100)] and wave_ranges(0, 5, 9) == []


def test_narrow_numbers_sort_no_wide_row(spark, tmp_path):
    spark.range(50).select("id", F.repeat(F.lit("wide"), 100).alias("w")).write.parquet(str(tmp_path / "w"))
    out = narrow_row_number(spark.read.parquet(str(tmp_path / "w")), [-F.col("id")], "id", "n")
    assert sorted((r["id"], r["n"]) for r in out.collect()) == [(i, 50 - i) for i in range(50)]

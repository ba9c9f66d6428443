"""Jobs end to end with stand-in backends: resume idempotence (running
twice adds nothing), breaker across waves, label versions, catalog."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from gradeframe.plans import stubs
from gradeframe.plans.pipelines import (CallOptions, EvaluationRun, QueryRun, effective_skip, expand, run_evaluate,
                                        run_label, run_query)
from gradeframe.plans.views import view
from gradeframe.sources.sinks import read_responses, read_versioned, write_versioned


def test_query_then_evaluate_resume(spark, tmp_dir):
    q = view(spark, SF_SMALL, "questions_v")
    m = view(spark, SF_SMALL, "models_v")
    out = f"{tmp_dir}/responses"
    first = run_query(spark, q, m, {"stub": stubs.copy_backend}, out, ["conv_id", "turn"])
    n1 = first.count()
    assert n1 > 0 and first.select("response_id").distinct().count() == n1
    again = run_query(spark, q, m, {"stub": stubs.copy_backend}, out, ["conv_id", "turn"])
    # only tasks dropped by the breaker can come back; ids continue from the count
    ids = [r[0] for r in again.select("response_id").collect()]
    assert len(ids) == len(set(ids))
    scores = f"{tmp_dir}/scores"
    s1 = run_evaluate(spark, q, read_responses(spark, out), m, scores, stem=False)
    s2 = run_evaluate(spark, q, read_responses(spark, out), m, scores, stem=False)
    assert s1.count() == s2.count() == again.join(q, "question_id").count()
    assert len(s2.columns) == 42


def test_waves_stop_calling_disabled_models(spark, tmp_dir):
    q = view(spark, SF_SMALL, "questions_v")
    m = view(spark, SF_SMALL, "models_v")
    calls = run_query(spark, q, m, {"stub": stubs.copy_backend}, f"{tmp_dir}/w", ["conv_id", "turn"], wave_size=5)
    single = run_query(spark, q, m, {"stub": stubs.copy_backend}, f"{tmp_dir}/s", ["conv_id", "turn"])
    cols = ["question_id", "model_name", "response_text", "error"]
    assert sorted(map(tuple, calls.select(*cols).collect())) == sorted(map(tuple, single.select(*cols).collect()))


def test_label_versions(spark, tmp_dir):
    q = view(spark, SF_SMALL, "questions_v").select("question_id", "question_text", "domain", "bloom_level")
    base = f"{tmp_dir}/questions"
    write_versioned(q, base)
    cov = run_label(spark, base, stubs.labeller_backend, calls=CallOptions(attempts=3, delay=0.0)).first()
    assert cov["total"] == q.count() and cov["labelled"] >= q.filter(F.col("bloom_level").isNotNull()).count()
    assert read_versioned(spark, base).count() == q.count()


def test_catalog():
    cat = {"a": QueryRun(["m"], ["q.csv"], "o.csv", ["ds1"]), "b": QueryRun(["m"], ["q.csv"], "p.csv")}
    assert [n for n, _ in expand(cat, "all")] == ["a", "b"] and expand(cat, "b")[0][0] == "b"
    with pytest.raises(KeyError):
        expand(cat, "c")
    assert effective_skip(None, cat["a"]) == ["ds1"] and effective_skip(["x"], cat["a"]) == ["x"]
    assert EvaluationRun(["q"], "r", "o", "judge").judge_model == "judge"


def test_judge_over_written_responses(spark, tmp_dir):
    """Responses from the query job (timestamps, doubles, ints) pass through
    the judge step unchanged; judged rows get parsed scores."""
    q = view(spark, SF_SMALL, "questions_v")
    m = view(spark, SF_SMALL, "models_v")
    out = run_query(spark, q, m, {"stub": stubs.copy_backend}, f"{tmp_dir}/r", ["conv_id", "turn"])
    scores = run_evaluate(spark, q, out, m, f"{tmp_dir}/s", judge=stubs.judge_backend, stem=False,
                          calls=CallOptions(attempts=3, delay=0.0))
    rows = scores.collect()
    assert len(rows) == out.count()
    ok = [r for r in rows if not r["error"]]
    assert ok and all(r["correctness"] is not None and r["justification"].startswith("length ") for r in ok)
    assert all(r["timestamp"] is not None for r in rows)
    ts = {r["response_id"]: r["timestamp"] for r in out.collect()}
    assert all(r["timestamp"] == ts[r["response_id"]] for r in rows)

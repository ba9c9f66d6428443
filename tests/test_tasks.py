"""Task grid, resume, quota predicate, circuit breaker, sequential ids."""

import random

from pyspark.sql import functions as F

from gradeframe.operators.ids import global_exclusive_sum, global_row_number
from gradeframe.operators.tasks import (active_models, circuit_breaker, quota_error, resume_tasks,
                                        task_grid, with_response_ids)


def models(spark):
    return spark.createDataFrame([(0, "m1", "a", "id1", 0.0), (1, "m2", "b", "id2", 0.0), (2, "m3", "zz", "id3", 0.0)],
                                 "model_ord int, model_name string, api string, model_id string, temperature double")


def test_grid_resume_and_active(spark):
    q = spark.createDataFrame([(i, f"q{i}") for i in range(5)], "n int, question_id string")
    act = active_models(models(spark), ["a", "b"])
    grid = task_grid(q, act, ["n"])
    rows = grid.orderBy("task_order").select("question_id", "model_name").collect()
    assert [tuple(r) for r in rows][:4] == [("q0", "m1"), ("q0", "m2"), ("q1", "m1"), ("q1", "m2")]
    done = spark.createDataFrame([("q0", "m1"), ("q3", "m2"), ("zz", "m1")], "question_id string, model_name string")
    left = {tuple(r) for r in resume_tasks(grid, done).select("question_id", "model_name").collect()}
    assert len(left) == 8 and ("q0", "m1") not in left and ("q3", "m2") not in left
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_no_active_models_raises(spark):
    import pytest
    with pytest.raises(RuntimeError, match="zz"):
        active_models(models(spark).filter(F.col("api") == "zz"), ["a"])


def test_quota_predicate(spark):
    df = spark.createDataFrame([(True, "Rate_Limit hit"), (True, "HTTP 429"), (True, "no CREDIT"), (True, "quota"),
                                (True, "timeout"), (False, "429"), (None, "429"), (True, None)],
                               "error boolean, error_message string")
    got = [r[0] for r in df.select(quota_error("error", "error_message")).collect()]
    assert got == [True, True, True, True, False, False, False, False]


def brute_breaker(rows):
    disabled, out = set(), []
    for model, seq, err, msg in sorted(rows, key=lambda r: r[1]):
        if model in disabled:
            continue
        out.append((model, seq))
        if err and any(k in (msg or "").lower() for k in ("rate_limit", "quota", "429", "credit")):
            disabled.add(model)
    return sorted(out)


def test_breaker_and_ids_vs_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 3), i, rnd.random() < 0.2, rnd.choice(["429 quota", "timeout", ""])) for i in range(400)]
    df = spark.createDataFrame(rows, "m int, seq long, error boolean, error_message string").repartition(5)
    kept = circuit_breaker(df, "m", "seq")
    assert sorted(tuple(r) for r in kept.select("m", "seq").collect()) == brute_breaker(rows)
    ids = with_response_ids(kept, ["seq"], offset=10).orderBy("seq").collect()
    assert [r["response_id"] for r in ids] == [f"resp_{10 + i + 1:06d}" for i in range(len(ids))]


def test_global_row_number_and_prefix_sum(spark):
    df = spark.range(0, 5000).withColumn("w", (F.col("id") % 3 == 0).cast("int")).repartition(7)
    out = global_row_number(df, ["id"], "rn", start=1).orderBy("id").collect()
    assert [r["rn"] for r in out] == list(range(1, 5001))
    ex = global_exclusive_sum(df, ["id"], F.col("w"), "s").orderBy("id").collect()
    acc, want = 0, []
    for r in ex:
        want.append(acc)
        acc += r["w"]
    assert [r["s"] for r in ex] == want
    assert f"{1234567:06d}" == "1234567"

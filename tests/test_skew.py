"""A key holding a third of all rows: results stay exact and whole, and the
plans aggregate map-side before the shuffle."""

from pyspark.sql import functions as F

from gradeframe.operators.scoring import join_responses
from gradeframe.operators.tasks import circuit_breaker
from gradeframe.sources.questions import dedupe_first
from gradeframe.sources.sinks import union_runs

N = 30_000


def test_hot_question_copies(spark):
    df = (spark.range(N).withColumn("question_id", F.when(F.col("id") % 3 == 0, F.lit("hot"))
                                    .otherwise(F.concat(F.lit("q"), F.col("id").cast("string"))))
          .withColumn("text", F.concat(F.lit("t"), F.col("id").cast("string")))
          .withColumn("file_ord", (F.col("id") % 2).cast("int")).withColumn("row_ord", F.col("id")))
    out = dedupe_first(df, "question_id", ["file_ord", "row_ord"])
    assert out.count() == 1 + (N - N // 3)
    hot = out.filter(F.col("question_id") == "hot").first()
    assert hot["text"] == "t0"        # file 0, smallest row among the hot copies
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan   # map-side reduction before the Exchange


def test_hot_model_breaker(spark):
    log = (spark.range(N).withColumn("model", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50))
           .withColumn("error", F.col("id") == 20_001).withColumn("error_message", F.lit("429 quota"))
           .withColumnRenamed("id", "seq"))
    kept = circuit_breaker(log, "model", "seq")
    # seq 20001 is a multiple of 3, so the hot model errs: its later rows go, all others stay
    m = log.filter(F.col("seq") == 20_001).first()["model"]
    assert m == 0
    dropped = log.filter((F.col("model") == m) & (F.col("seq") > 20_001)).count()
    assert kept.count() == N - dropped
    assert "partial_min" in kept._jdf.queryExecution().executedPlan().toString()


def test_hot_question_join_is_whole(spark):
    resp = (spark.range(N).withColumn("question_id", F.when(F.col("id") % 3 == 0, F.lit("hot"))
                                      .otherwise(F.concat(F.lit("q"), (F.col("id") % 100).cast("string"))))
            .withColumn("response_id", F.col("id").cast("string")).drop("id"))
    q = spark.createDataFrame([("hot", "x")] + [(f"q{i}", "y") for i in range(100)], "question_id string, domain string")
    assert join_responses(resp, q).count() == N


def test_union_runs(spark):
    a = spark.createDataFrame([("resp_000001",)], "response_id string")
    b = spark.createDataFrame([("resp_000001",)], "response_id string")
    u = union_runs({"r1": a, "r2": b})
    assert u.select("run", "response_id").distinct().count() == 2

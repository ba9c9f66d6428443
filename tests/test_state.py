"""Done keys kept bucketed: only the new side is shuffled; pairs of texts that repeat are scored once."""

from pyspark.sql import functions as F

from gradeframe.operators import lexical
from gradeframe.operators.lexical import content_key, lexical_by_content, lexical_scores
from gradeframe.sources.commitlog import CommitLog
from gradeframe.sources.donestate import DoneState

KEYS = ("question_id", "model_name")


def test_resume_shuffles_the_new_side_only(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("q"), "id").alias("question_id"),
                                   F.when(F.col("id") % 2 == 0, F.lit("a")).otherwise(F.lit("b")).alias("model_name"))
    log = CommitLog(spark, str(tmp_path / "out"))
    log.write(rows.where("model_name = 'a'"), "rows", "w1")
    state = DoneState(log, rows.schema, KEYS, buckets=4)
    rows.write.parquet(str(tmp_path / "tasks"))
    tasks = spark.read.parquet(str(tmp_path / "tasks"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = state.remaining(tasks)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "SortMergeJoin" in plan
        assert left.count() == 250 and {r[0] for r in left.select("model_name").distinct().collect()} == {"b"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    log.write(rows.where("model_name = 'b'").limit(100), "rows", "w2")
    log.write(rows.limit(0), "rows", "w3")
    again = DoneState(log, rows.schema, KEYS)           # a later job: as many buckets as before, waves caught up
    assert again.buckets == 4 and again.remaining(tasks).count() == 150
    spark.sql(f"drop table {again.table}")              # another session does not know the table
    assert DoneState(log, rows.schema, KEYS).remaining(tasks).count() == 150


def test_null_keys_are_done_once(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a"), ("", "a"), ("1:x", None)], "question_id string, model_name string")
    log = CommitLog(spark, str(tmp_path / "out"))
    log.write(rows.limit(1), "rows", "w1")
    left = DoneState(log, rows.schema, KEYS).remaining(rows).collect()
    assert sorted(map(str, left)) == sorted(map(str, rows.collect()[1:]))


def test_repeated_pairs_are_scored_once(spark, monkeypatch):
    texts = [("the cat sat", "a cat sat"), ("the cat sat", "the cat sat"), ("ab", "c"), ("a", "bc"), (None, "x"), ("", "x")]
    pairs = spark.createDataFrame([(i, *texts[i % len(texts)]) for i in range(60)], "k long, reference string, candidate string")
    pairs = pairs.withColumn("_pair", content_key("reference", "candidate"))
    scored = []

    def seen(df, *a, **kw):
        scored.append(df.count())
        return lexical_scores(df, *a, **kw)
    want = sorted(map(tuple, lexical_scores(pairs, "k").collect()))
    monkeypatch.setattr(lexical, "lexical_scores", seen)
    assert sorted(map(tuple, lexical_by_content(pairs, "k").collect())) == want
    assert sorted(map(tuple, lexical_by_content(pairs.where("k < 5"), "k").collect())) == [r for r in want if r[0] < 5]
    assert scored == [5, 5]                            # five different pairs (null is the empty text); none repeats

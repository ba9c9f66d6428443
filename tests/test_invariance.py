"""Results do not depend on how the input is partitioned (1 vs 8 input
partitions, 1 vs 8 shuffle partitions)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from gradeframe.operators.lexical import lexical_scores
from gradeframe.operators.tasks import with_response_ids
from gradeframe.plans.views import view
from gradeframe.sources.questions import dedupe_first, union_inputs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lexical_partition_invariance(spark):
    pairs = view(spark, SF_SMALL, "pairs_v")
    one = lexical_scores(pairs.coalesce(1), num_partitions=1)
    many = lexical_scores(pairs.repartition(8), num_partitions=8)
    assert rows(one) == rows(many)


def test_dedupe_and_ids_partition_invariance(spark):
    u = union_inputs([view(spark, SF_SMALL, "questions_file1"), view(spark, SF_SMALL, "questions_file2")])
    a = dedupe_first(u.coalesce(1), "question_id", ["file_ord", "row_ord"]).select("question_id", "question_text")
    b = dedupe_first(u.repartition(8), "question_id", ["file_ord", "row_ord"]).select("question_id", "question_text")
    assert rows(a) == rows(b)
    log = view(spark, SF_SMALL, "call_log_v")
    x = with_response_ids(log.coalesce(1), ["seq"]).select("seq", "response_id")
    y = with_response_ids(log.repartition(8, F.col("model_key")), ["seq"]).select("seq", "response_id")
    assert rows(x) == rows(y)

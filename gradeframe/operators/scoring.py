"""Evaluate-side operators: join responses to questions, unmatched rows,
resume on response ids, model lookup, error short-circuit, MCQ guard, score
ids and the 42-column projection (J1, J2, J5, J6, P3, P4, P5, W2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ID_DIGITS, MCQ_TYPE, SCORE_ID_PREFIX
from ..functions.text import py_strip, text_or_empty
from .ids import format_id, global_exclusive_sum, global_row_number
from .tasks import inline_rows

QUESTION_SIDE = ["dataset_name", "dataset_subset", "domain", "difficulty", "bloom_level", "bloom_name",
                 "bloom_confidence", "question_type", "question_text", "ground_truth_answer", "context",
                 "choices_json", "bloom_justification"]


def join_responses(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """Responses inner-joined to questions on question_id; null ids
    match each other (null-safe equality, still an equi-join plan). For a
    column present on both sides, the question side wins for question
    fields and the response side for the rest."""
    r, q = responses.alias("r"), questions.alias("q")
    cond = F.col("r.question_id").eqNullSafe(F.col("q.question_id"))
    cols = [F.col(f"r.{c}") for c in responses.columns if c not in questions.columns or c == "question_id"]
    cols += [F.col(f"q.{c}") for c in questions.columns
             if c != "question_id" and (c not in responses.columns or c in QUESTION_SIDE)]
    cols += [F.col(f"r.{c}") for c in responses.columns
             if c in questions.columns and c != "question_id" and c not in QUESTION_SIDE]
    return r.join(q, cond, "inner").select(*cols)


def unmatched_responses(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """Responses whose question_id has no question (null-safe)."""
    q = questions.select(F.col("question_id").alias("_qid"))
    return responses.join(q, responses["question_id"].eqNullSafe(q["_qid"]), "left_anti")


def resume_scores(rows: DataFrame, done: DataFrame, key: str = "response_id") -> DataFrame:
    """Rows whose response_id is not in the prior score table (null-safe:
    a null id already scored counts as done)."""
    d = done.select(F.col(key).alias("_done"))
    return rows.join(d, rows[key].eqNullSafe(d["_done"]), "left_anti")


def model_lookup(df: DataFrame, models: DataFrame) -> DataFrame:
    """model_version and temperature by model_name; unknown -> null. A
    model table of configuration size is inlined as map literals (no join), a
    larger one is joined."""
    cols = models.select("model_name", "model_id", F.col("temperature").cast("double").alias("temperature"))
    rows = inline_rows(cols)
    if rows is None:
        found = cols.groupBy("model_name").agg(F.first("model_id").alias("model_version"), F.first("temperature").alias("temperature"))
        return df.drop("model_version", "temperature").join(found, "model_name", "left")
    known = {r["model_name"]: r for r in rows if r["model_name"] is not None}

    def lookup(field: str, kind: str) -> Column:
        pairs = [x for name, r in known.items() for x in (F.lit(name), F.lit(r[field]).cast(kind))]
        return F.try_element_at(F.create_map(*pairs).cast(f"map<string,{kind}>"), F.col("model_name"))
    return df.withColumns({"model_version": lookup("model_id", "string"), "temperature": lookup("temperature", "double")})


def is_error(df: DataFrame) -> Column:
    """P3 truthiness: a missing or null ``error`` means no error (D3)."""
    return F.coalesce(F.col("error").cast("boolean"), F.lit(False)) if "error" in df.columns else F.lit(False)


def skipped_justification(message) -> Column:
    return F.concat(F.lit("Skipped: model error: "), text_or_empty(message))


def lexical_applies(df: DataFrame, skip_mcq: bool = True) -> Column:
    """Lexical metrics only for non-error rows that are not MCQ (type
    compared after trimming, as when prompting: D10)."""
    ok = ~is_error(df)
    if skip_mcq and "question_type" in df.columns:
        ok = ok & ~F.coalesce(py_strip(F.col("question_type")) == MCQ_TYPE, F.lit(False))
    return ok



def with_score_ids(df: DataFrame, order: list, offset: int = 0, compat: bool = False) -> DataFrame:
    """``score_`` + number. Default: unique row numbers in ``order``
    (D1). ``compat=True`` reproduces the original counter, which advances
    only on non-error rows, so an error row shares the next row's id."""
    if compat:
        out = global_exclusive_sum(df, order, (~is_error(df)).cast("int"), "_n")
        out = out.withColumn("_n", F.col("_n") + F.lit(offset + 1))
    else:
        out = global_row_number(df, order, "_n", start=offset + 1)
    return out.withColumn("score_id", format_id(SCORE_ID_PREFIX, "_n", ID_DIGITS)).drop("_n")


def score_metadata(df: DataFrame) -> DataFrame:
    """P5: the non-score columns of the score table: copied, looked up or
    defaulted (human_validated false; absent columns null)."""
    out = df
    if "human_validated" not in out.columns:
        out = out.withColumn("human_validated", F.lit(False))
    else:
        out = out.withColumn("human_validated", F.coalesce(F.col("human_validated").cast("boolean"), F.lit(False)))
    if "justification" not in out.columns:
        out = out.withColumn("justification", F.lit(""))
    return out


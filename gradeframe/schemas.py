"""Declared table schemas (ids are always strings; no type inference)."""

from __future__ import annotations

from pyspark.sql import types as T

from .constants import RESPONSE_COLUMNS, SCORE_COLUMNS

S, I, L, D, B, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

QUESTION_TYPES = {
    "question_id": S, "domain": S, "difficulty": S, "bloom_level": I, "bloom_name": S,
    "question_text": S, "ground_truth_answer": S, "question_type": S, "context": S,
    "choices_json": S, "dataset_name": S, "dataset_subset": S,
    "bloom_confidence": D, "bloom_justification": S,
}

RESPONSE_TYPES = {
    "response_id": S, "question_id": S, "model_name": S, "response_text": S,
    "response_time_sec": D, "token_count": I, "error": B, "error_message": S, "timestamp": TS,
}

SCORE_TYPES = {
    **{c: S for c in SCORE_COLUMNS},
    "bloom_level": I, "bloom_confidence": D, "response_time_sec": D, "token_count": I,
    "error": B, "timestamp": TS, "temperature": D,
    "correctness": L, "completeness": L, "clarity": L, "cognitive_alignment": L,
    "overall_score": D, "bleu": D, "rouge1": D, "rouge2": D, "rougeL": D,
    "keyword_precision": D, "keyword_recall": D, "keyword_f1": D,
    "human_validated": B, "human_score": D,
}

MODEL_TYPES = {"model_name": S, "api": S, "model_id": S, "temperature": D, "max_tokens": I}


def struct(types: dict, order: list[str] | None = None) -> T.StructType:
    cols = order or list(types)
    return T.StructType([T.StructField(c, types[c], True) for c in cols])


QUESTIONS_SCHEMA = struct(QUESTION_TYPES)
RESPONSES_SCHEMA = struct(RESPONSE_TYPES, RESPONSE_COLUMNS)
SCORES_SCHEMA = struct(SCORE_TYPES, SCORE_COLUMNS)
MODELS_SCHEMA = struct(MODEL_TYPES)

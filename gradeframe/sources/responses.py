"""Response and label-table sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import REQUIRED_RESPONSE_COLUMNS
from ..schemas import QUESTION_TYPES, RESPONSE_TYPES
from .files import path_exists
from .questions import ORDER_COLS, coerce_types, ordered_input, validate_columns
from .sinks import read_table

BLOOM_COLUMNS = {c: QUESTION_TYPES[c] for c in
                 ("bloom_level", "bloom_name", "bloom_confidence", "bloom_justification")}


def load_responses(spark: SparkSession, path: str, fmt: str | None = None, keep_order: bool = False) -> DataFrame:
    """The path must exist and carry the required response columns;
    declared columns are cast (``error`` read from text as boolean).
    ``keep_order`` adds the order of the rows in the input."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Responses file not found: {path}")
    df = ordered_input(read_table(spark, path, None, fmt), 0)
    validate_columns(df, REQUIRED_RESPONSE_COLUMNS, "response")
    df = coerce_types(df, RESPONSE_TYPES)
    return df if keep_order else df.drop(*ORDER_COLS)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, fmt: str | None = None) -> DataFrame:
    """Prior output if it exists (its committed rows, if a sink wrote it), else an empty table of ``schema``."""
    if path and path_exists(spark, path):
        return read_table(spark, path, schema, fmt)
    return spark.createDataFrame([], schema)


def coerce_bloom(df: DataFrame) -> DataFrame:
    """Make sure the four bloom columns exist with their types; absent
    columns are typed nulls, uncastable cells become null one by one."""
    if "question_text" not in df.columns:
        raise ValueError("questions table must have a 'question_text' column")
    for c, t in BLOOM_COLUMNS.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    return coerce_types(df, BLOOM_COLUMNS)

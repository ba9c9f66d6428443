"""Question sources: multi-file scan, union by name, dataset skip list,
first-copy-wins dedupe, optional-column defaults, validation, null audit.

S1 load_questions, S3 missing-path tolerance, S7 required columns,
S8 optional defaults, P1 skip datasets, U1 union, W3/A4 dedupe, A1 audit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import OPTIONAL_QUESTION_COLUMNS, REQUIRED_QUESTION_COLUMNS
from ..schemas import QUESTION_TYPES
from .files import path_exists, read_any
from .reconcile import reconcile

FILE_ORD = "_file_ord"
ROW_ORD = "_row_ord"
ORDER_COLS = [FILE_ORD, ROW_ORD]


def with_row_order(df: DataFrame, file_ord: int) -> DataFrame:
    """Attach (file ordinal, row ordinal). Within one input, rows keep file
    order: ordered by file path, split start and the position inside the
    split (monotonic within a task)."""
    return (df.withColumn(FILE_ORD, F.lit(file_ord))
            .withColumn(ROW_ORD, F.struct(F.col("_metadata.file_path").alias("path"),
                                          F.col("_metadata.file_block_start").alias("block"),
                                          F.monotonically_increasing_id().alias("pos"))))


def coerce_types(df: DataFrame, types: dict = QUESTION_TYPES) -> DataFrame:
    """Cast known columns to their declared types; an uncastable cell becomes
    null on its own (never the whole column). Unknown columns are kept."""
    return reconcile([df], types)[0]


def skip_datasets(df: DataFrame, skip: list[str] | None) -> DataFrame:
    """Drop rows whose dataset_name is in ``skip``; null names are kept
    (pandas ``~isin`` semantics), and only inputs that have the column are
    filtered."""
    if not skip or "dataset_name" not in df.columns:
        return df
    return df.filter(F.col("dataset_name").isNull() | ~F.col("dataset_name").isin(list(skip)))


def union_inputs(frames: list[DataFrame], keep_rescued: bool = False) -> DataFrame:
    """Union by column name; a column missing from an input is null there.
    Inputs may hold a column in different types: each is cast first, and a
    cell without a value in the common type is null (its text is kept in
    ``_rescued`` if asked for)."""
    frames = reconcile(frames, QUESTION_TYPES, keep_rescued)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def dedupe_first(df: DataFrame, key: str = "question_id", order: list[str] = ORDER_COLS) -> DataFrame:
    """Keep the first row per key in (file, row) order.

    Expressed as an aggregate (``min_by``) rather than a ranking window, so
    a key holding a large share of the rows is reduced map-side (partial
    aggregation) before the shuffle instead of landing whole on one task.
    Null keys form one group, as in pandas."""
    payload = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*[F.col(c) for c in payload]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(key).agg(best.alias("_first")).select(key, *[F.col(f"_first.{c}").alias(c) for c in payload])


def with_optional_defaults(df: DataFrame) -> DataFrame:
    """Optional columns absent from every input default to ''."""
    for c in OPTIONAL_QUESTION_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    return df


def validate_columns(df: DataFrame, required: list[str] = REQUIRED_QUESTION_COLUMNS,
                     what: str = "question") -> DataFrame:
    """Fail naming every missing required column (no Spark job)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required {what} columns: {missing}")
    return df


def null_audit(df: DataFrame, columns=("question_text", "ground_truth_answer")) -> DataFrame:
    """A1: one row with the null count of each column (single pass)."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def load_questions(spark: SparkSession, paths: list[str], skip: list[str] | None = None,
                   fmt: str | None = None, keep_order: bool = False, keep_rescued: bool = False,
                   na_values: list[str] | None = None) -> DataFrame:
    """Read every existing path (CSV/Parquet/JSON/XLSX by suffix), filter
    the skip list per input, cast declared types, union by name, keep the
    first copy of each question_id, default optional columns, validate.

    Missing paths are skipped; if none exists, FileNotFoundError (S3). Text
    cells equal to one of ``na_values`` read as null; ``keep_rescued`` keeps
    the cells that have no value in their column's type."""
    frames = []
    for i, p in enumerate(paths):
        if not path_exists(spark, p):
            continue
        df = without_na(read_any(spark, p, fmt), na_values)
        frames.append(ordered_input(skip_datasets(df, skip), i))
    if not frames:
        raise FileNotFoundError(f"No question files found at: {list(paths)}")
    combined = dedupe_first(union_inputs(frames, keep_rescued))
    combined = with_optional_defaults(combined)
    validate_columns(combined)
    return combined if keep_order else combined.drop(*ORDER_COLS)


def without_na(df: DataFrame, na_values: list[str] | None) -> DataFrame:
    """Text cells that stand for a missing value (``NA``, ``null``, ...) as null."""
    if not na_values:
        return df
    return df.withColumns({f.name: F.when(~F.col(f"`{f.name}`").isin(na_values), F.col(f"`{f.name}`"))
                           for f in df.schema.fields if isinstance(f.dataType, T.StringType) and not f.name.startswith("_xlsx")})


def ordered_input(df: DataFrame, file_ord: int) -> DataFrame:
    """One input with the order of its rows, from whatever its source knows of it."""
    if "_xlsx_row" in df.columns:
        return (df.withColumn(FILE_ORD, F.lit(file_ord))
                .withColumn(ROW_ORD, F.struct(F.col("_xlsx_path").alias("path"), F.lit(0).cast("long").alias("block"),
                                              F.col("_xlsx_row").alias("pos")))
                .drop("_xlsx_path", "_xlsx_row"))
    return with_row_order(df, file_ord) if _has_metadata(df) else _ordinal_fallback(df, file_ord)


def _has_metadata(df: DataFrame) -> bool:
    try:
        df.select("_metadata.file_path")
        return True
    except Exception:  # noqa: BLE001 - sources without file metadata
        return False


def _ordinal_fallback(df: DataFrame, file_ord: int) -> DataFrame:
    return (df.withColumn(FILE_ORD, F.lit(file_ord))
            .withColumn(ROW_ORD, F.struct(F.lit("").alias("path"), F.lit(0).cast("long").alias("block"),
                                          F.monotonically_increasing_id().alias("pos"))))

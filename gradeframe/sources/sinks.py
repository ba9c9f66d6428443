"""Sinks: append-only response and score tables (K1, K2) and a versioned
overwrite-in-place for labelled question tables (K3).

All three write behind a commit log (``commitlog``): a wave of rows, or a
version of a table, is there as a whole or not at all, and resume (anti-join
on the keys already committed) keeps re-runs from duplicating.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import RESPONSE_COLUMNS, SCORE_COLUMNS
from ..schemas import RESPONSE_TYPES, RESPONSES_SCHEMA, SCORE_TYPES, SCORES_SCHEMA
from .commitlog import COMMITS, ROWS, CommitLog, new_wave
from .files import _fs_path, path_exists, read_any


def _project(df: DataFrame, columns: list[str], types: dict) -> DataFrame:
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c)
                       for c in columns])


def response_rows(df: DataFrame) -> DataFrame:
    """The 9 response columns in order; null texts become ''."""
    return _project(df, RESPONSE_COLUMNS, RESPONSE_TYPES).fillna("", subset=["response_text", "error_message"])


def score_rows(df: DataFrame) -> DataFrame:
    """The 42 score columns in order, typed; absent columns are null."""
    return _project(df, SCORE_COLUMNS, SCORE_TYPES)


def open_table(spark: SparkSession, path: str) -> CommitLog:
    """The commit log of the table at ``path``. A folder of Parquet files without a log (written by other means) becomes
    its first wave."""
    log = CommitLog(spark, path)
    if log.exists() or not path_exists(spark, path):
        return log
    fs, p = _fs_path(spark, path)
    if not fs.getFileStatus(p).isDirectory():
        raise ValueError(f"{path} is a file; outputs are folders (read it as prior output and write to another path)")
    files = sorted(n for s in fs.listStatus(p) if (n := s.getPath().getName()).endswith(".parquet"))
    if files:
        log.commit(ROWS, new_wave(), files, spark.read.parquet(*[f"{log.base}/{f}" for f in files]).count())
    return log


def read_table(spark: SparkSession, path: str, schema=None, fmt: str | None = None) -> DataFrame:
    """The committed rows of a table that the sinks wrote, whatever its name; any other path by its format."""
    if path_exists(spark, f"{path.rstrip('/')}/{COMMITS}"):
        return CommitLog(spark, path).read(schema or RESPONSES_SCHEMA)
    return read_any(spark, path, fmt)


def append_responses(df: DataFrame, path: str, wave: str | None = None) -> None:
    """K1: one wave of responses."""
    open_table(df.sparkSession, path).write(response_rows(df), ROWS, wave or new_wave())


def append_scores(df: DataFrame, path: str, wave: str | None = None) -> None:
    """K2: one wave of scores."""
    open_table(df.sparkSession, path).write(score_rows(df), ROWS, wave or new_wave())


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, RESPONSES_SCHEMA)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, SCORES_SCHEMA)


VERSION = "version"


def current_version(spark: SparkSession, base: str) -> str | None:
    """The last committed version: its wave name, null before the first."""
    entries = CommitLog(spark, base).entries(VERSION)
    return entries[-1]["wave"] if entries else None


def read_versioned(spark: SparkSession, base: str) -> DataFrame:
    log = CommitLog(spark, base)
    entries = log.entries(VERSION)
    if not entries:
        raise FileNotFoundError(f"No version written under {base}")
    return spark.read.parquet(*[f"{log.base}/{f}" for f in entries[-1]["files"]])


def write_versioned(df: DataFrame, base: str) -> str:
    """K3: a table cannot be overwritten while it is being read, so each
    write adds files of its own; the log entry that names them makes them the
    current version, in one step."""
    version = new_wave()
    CommitLog(df.sparkSession, base).write(df, VERSION, version)
    return version


def union_runs(tables: dict[str, DataFrame]) -> DataFrame:
    """Responses or scores of several runs in one table. Ids restart at 1 in
    every run's output, so rows are keyed by (run, id): a ``run`` column is
    added from the dict key (T14)."""
    out = None
    for run, df in tables.items():
        part = df.withColumn("run", F.lit(run))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables given")
    return out

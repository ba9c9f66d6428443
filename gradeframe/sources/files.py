"""File-format dispatch and filesystem checks shared by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def format_of(path: str, fmt: str | None = None) -> str:
    if fmt:
        return fmt
    low = path.lower().rstrip("/")
    for suffix, f in ((".csv", "csv"), (".parquet", "parquet"), (".json", "json"),
                      (".jsonl", "json"), (".xlsx", "xlsx")):
        if low.endswith(suffix):
            return f
    return "parquet"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as string (no inference: ids like ``001`` stay text);
    quoted fields may contain doubled quotes and newlines (multiLine)."""
    return (spark.read.option("header", True).option("multiLine", True)
            .option("escape", '"').option("mode", "PERMISSIVE").csv(path))


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """``path`` by its format. A folder that this library's sinks wrote is Parquet whatever its name."""
    f = format_of(path, fmt)
    if f == "csv":
        return read_csv(spark, path)
    if f == "xlsx":
        from .xlsx import read_xlsx
        return read_xlsx(spark, path)
    return spark.read.format(f).load(path)

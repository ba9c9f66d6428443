"""Helpers shared by the operators: shared scratch tables, private column
names, word splitting as the query contracts define it, text guards."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.session import scratch_path

# the six separator characters of the contracts: space, tab, LF, VT, FF, CR
SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Maximal runs of non-separator characters; null gives no words."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE_CLASS), "")


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text column as a string that is never null."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back:
    cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once for each row, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


@contextmanager
def small_methods(spark):
    """Meanwhile no whole-stage code in methods that HotSpot leaves to its interpreter (over 8,000 bytes of bytecode): operators
    with such expressions run one by one, their expressions split into small compiled methods."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

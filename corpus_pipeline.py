"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet in the shared folder and read again as the next stage's docs. All
but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from gradeframe.llm import decontaminate, near_dedup, packing, pii, quality
from gradeframe.llm.common import documents, written


def _packed(docs, *cols):
    """The whole row as one column beside the columns that a stage reads: no name of a column clashes with the stage's own."""
    return docs.select(F.struct("*").alias("_row"), *cols, "text")


def quality_rules(spark, docs, sf_dir):
    """Documents that the line rules reject go. The removal of lines serves this verdict only: kept texts pass on whole."""
    return quality.judged(_packed(docs)).where("kept").select("_row.*")


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    keep = near_dedup.near_dedup(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_id"]), "left_semi")


def benchmark_leaks(spark, docs, sf_dir):
    """Documents that leak a benchmark item go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_leaks(docs, bench)


def personal_data(spark, docs, sf_dir):
    """Personal data in texts is replaced by its kind."""
    done = pii.redacted(_packed(docs, "doc_id"))
    return done.select(F.col("_row").withField("text", F.col("text")).alias("_row")).select("_row.*")


def packed(spark, docs, sf_dir):
    """Sequences of at most 2048 tokens, one row per piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates),
          ("benchmark decontamination", benchmark_leaks), ("personal data", personal_data), ("packing", packed)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Incremental evaluation with Structured Streaming.

Responses land as files in a directory; ``availableNow`` processes whatever
has arrived in micro-batches and stops. Each micro-batch runs the evaluate job
(``run_evaluate``) through ``foreachBatch``: its scores are committed as a
wave, the anti-join on ``response_id`` against the committed scores makes a
replayed batch (after a failure, before the checkpoint commit) write nothing
twice, and score ids continue from the committed rows. The stream's
checkpoint lives in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.pipelines import run_evaluate
from ..schemas import SCORES_SCHEMA
from ..session import scratch_path
from ..sources.commitlog import CommitLog


def evaluate_stream(spark: SparkSession, questions: DataFrame, models: DataFrame, landing: str,
                    response_schema: T.StructType, output: str, checkpoint: str | None = None,
                    files_per_batch: int | None = None, **evaluate_kw):
    """Start the incremental evaluate job; returns the StreamingQuery
    (``availableNow``: it stops by itself once the landing folder is drained)."""
    reader = spark.readStream.schema(response_schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(landing)

    def score_batch(batch: DataFrame, epoch_id: int) -> None:
        run_evaluate(spark, questions, batch, models, output, **evaluate_kw)

    return (stream.writeStream.foreachBatch(score_batch)
            .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
            .trigger(availableNow=True).start())


def run_evaluate_stream(spark: SparkSession, *args, **kw) -> DataFrame:
    q = evaluate_stream(spark, *args, **kw)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    output = args[4] if len(args) > 4 else kw["output"]
    return CommitLog(spark, output).read(SCORES_SCHEMA)

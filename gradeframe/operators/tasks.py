"""Task grid, resume, runnable models, quota predicate, circuit breaker and
response ids (J3, J4, P6, P7, W1, W4, A5, A8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ID_DIGITS, QUOTA_MARKERS, RESPONSE_ID_PREFIX
from .ids import format_id, global_row_number, narrow_row_number

INLINE_MODELS = 1_000  # up to so many models are written into the plan; more are joined


def inline_rows(df: DataFrame, limit: int = INLINE_MODELS) -> list | None:
    """The rows of a configuration-sized table, or None where it has more
    than ``limit``: reads at most ``limit + 1`` rows."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def active_models(models: DataFrame, available_apis: list[str]) -> DataFrame:
    """Keep models whose backend is available; fail naming the missing
    backends when none is left."""
    out = models.filter(F.col("api").isin(list(available_apis)))
    if not out.limit(1).collect():
        missing = inline_rows(models.select("api").distinct().orderBy("api"))
        raise RuntimeError("No active models available; no backend for: "
                           f"{'any API' if missing is None else [r['api'] for r in missing]}")
    return out


def task_grid(questions: DataFrame, models: DataFrame, question_order: list,
              model_order: str = "model_ord") -> DataFrame:
    """Every question paired with every model, question-major.

    A model dimension of configuration size is inlined as an array literal
    and exploded next to each question: no join, no shuffle, and the question
    side streams. A larger one becomes blocks of models, one array each; every
    question is dealt to every block number and joined to it by equality."""
    cols = models.select("model_name", F.col(model_order).cast("int").alias("model_ord"))
    q = questions.withColumn("_q_order", F.struct(*question_order))
    rows = inline_rows(cols.orderBy("model_ord"))
    if rows is not None:
        arr = F.array(*[F.struct(F.lit(r["model_name"]).alias("model_name"), F.lit(r["model_ord"]).alias("model_ord"))
                        for r in rows]) if rows else F.array().cast("array<struct<model_name:string,model_ord:int>>")
        grid = q.withColumn("_m", F.explode(arr))
    else:
        n = cols.count() // INLINE_MODELS + 1
        block = F.pmod(F.xxhash64("model_name", "model_ord"), F.lit(n))
        blocks = cols.groupBy(block.alias("_b")).agg(F.collect_list(F.struct("model_name", "model_ord")).alias("_ms"))
        dealt = q.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        grid = dealt.join(blocks, "_b").withColumn("_m", F.explode("_ms")).drop("_b", "_ms")
    return (grid.withColumn("model_name", F.col("_m.model_name")).withColumn("model_ord", F.col("_m.model_ord"))
            .withColumn("task_order", F.struct(F.col("_q_order"), F.col("model_ord")))
            .drop("_m", "_q_order"))


def done_pairs(done: DataFrame) -> DataFrame:
    """A5: distinct completed (question_id, model_name)."""
    return done.select("question_id", "model_name").distinct()


def resume_tasks(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks whose (question_id, model_name) is not yet in the output;
    error rows count as done. Hash anti join; the optimizer dedupes the
    right side itself."""
    return tasks.join(done.select("question_id", "model_name"), ["question_id", "model_name"], "left_anti")


def quota_error(error, message) -> Column:
    """An error whose lower-cased message mentions a quota marker."""
    msg = F.lower(F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit("")))
    hit = F.lit(False)
    for m in QUOTA_MARKERS:
        hit = hit | msg.contains(m)
    err = F.col(error) if isinstance(error, str) else error
    return F.coalesce(err, F.lit(False)) & hit


def circuit_breaker(log: DataFrame, model: str, seq: str, error: str = "error",
                    message: str = "error_message") -> DataFrame:
    """Per model keep the rows up to and including its first quota
    error in ``seq`` order; later rows of that model are dropped.

    First quota error per model is an aggregate (partial aggregation keeps a
    hot model cheap), joined back on the model key: the joined side has one
    row per model and adaptive execution broadcasts it from its measured
    size; no per-model window sorts a hot model's rows on one task."""
    first = (log.filter(quota_error(error, message)).groupBy(model)
             .agg(F.min(seq).alias("_first_quota")))
    return (log.join(first, model, "left")
            .filter(F.col("_first_quota").isNull() | (F.col(seq) <= F.col("_first_quota")))
            .drop("_first_quota"))


def with_response_ids(df: DataFrame, order: list, offset: int = 0, key: str | None = None) -> DataFrame:
    """``resp_`` + (offset + n) zero-padded, n counting emitted rows in
    task order (after the breaker). With a unique ``key`` only the order
    columns and the key are sorted, and the numbers joined back."""
    out = (narrow_row_number(df, order, key, "_n", offset + 1) if key
           else global_row_number(df, order, "_n", start=offset + 1))
    return out.withColumn("response_id", format_id(RESPONSE_ID_PREFIX, "_n", ID_DIGITS)).drop("_n")


def run_progress(**tables: DataFrame) -> DataFrame:
    """Run tallies as (metric, value) rows, one count per named table,
    e.g. ``run_progress(tasks_remaining=t, rows_total=out)``."""
    parts = [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

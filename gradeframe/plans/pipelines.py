"""The three jobs as Spark plans: label (L1), query (L2), evaluate (L3), and
the job catalog (L4).

Each job reads what is committed, only does the remaining work (anti-join on
the keys of its own output), and goes through it in waves: the paid calls of a
wave are made once and committed raw, then its rows are derived from them and
committed. A job that is killed loses at most the calls of one wave; started
again, it first derives the rows of calls that were committed without them.
Waves double in size, so there are few of them and the first are small.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (JUDGE_ERROR_CHARS, JUDGE_SUBSCORE_COLUMNS, LABEL_ERROR_CHARS, QUOTA_MARKERS,
                         RESPONSE_FLUSH_ROWS, RETRY_ATTEMPTS, RETRY_DELAY_SEC, SCORE_FLUSH_ROWS, SKIP_LEXICAL_FOR_MCQ)
from ..functions.parsing import parse_judge, parse_label
from ..functions.prompts import PromptConfig, judge_prompt, label_prompt, question_prompt
from ..functions.text import word_count
from ..operators.ids import Ordered, format_id, wave_ranges
from ..operators.inference import NOT_CALLED, Backend, infer
from ..operators.lexical import content_key, lexical_by_content
from ..operators.scoring import (is_error, join_responses, lexical_applies, model_lookup, resume_scores,
                                 score_metadata, skipped_justification, unmatched_responses, with_score_ids)
from ..operators.tasks import (active_models, circuit_breaker, quota_error, resume_tasks, task_grid,
                               with_response_ids)
from ..schemas import RESPONSE_TYPES, RESPONSES_SCHEMA, SCORES_SCHEMA
from ..session import scratch_path
from ..sources.commitlog import ROWS, CommitLog, new_wave
from ..sources.donestate import DoneState
from ..sources.questions import ORDER_COLS, load_questions, null_audit
from ..sources.responses import coerce_bloom, load_responses
from ..sources.sinks import (current_version, open_table, read_versioned, response_rows, score_rows, union_runs,
                             write_versioned)

log_ = logging.getLogger(__name__)
CALLS = "calls"
LARGEST_WAVE = 100_000


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared checkpoint folder and read back: inference
    output is paid for and nondeterministic, so nothing downstream may
    recompute it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class CallOptions:
    """How calls are made: seconds for each attempt, calls open at once in a task, tasks they are dealt over."""
    deadline: float | None = None
    in_flight: int = 1
    partitions: int | None = None
    attempts: int = 1
    delay: float = RETRY_DELAY_SEC


# ----------------------------------------------------------------- query (L2)

def query_tasks(questions: DataFrame, models: DataFrame, done: DataFrame | DoneState, question_order: list,
                available_apis: list[str], prompts: PromptConfig = PromptConfig()) -> DataFrame:
    """P7 -> J3 -> J4 -> F1: the remaining (question, model) tasks with
    their prompts, model attributes attached from the configuration."""
    act = active_models(models, available_apis)
    grid = task_grid(questions, act, question_order)
    todo = done.remaining(grid) if isinstance(done, DoneState) else resume_tasks(grid, done)
    attrs = act.select("model_name", *[c for c in ("api", "model_id", "temperature", "max_tokens")
                                       if c in act.columns])
    todo = todo.join(attrs, "model_name", "left")
    cols = {c: (F.col(c) if c in todo.columns else F.lit(None)) for c in
            ("domain", "question_text", "context", "choices_json", "question_type")}
    return todo.withColumn("prompt", question_prompt(cols["domain"], cols["question_text"], cols["context"],
                                                     cols["choices_json"], cols["question_type"], prompts))


CALL_SCHEMA = T.StructType([
    T.StructField("question_id", T.StringType()), T.StructField("model_name", T.StringType()),
    T.StructField("_task", T.LongType()), T.StructField("text", T.StringType()), T.StructField("elapsed", T.DoubleType()),
    T.StructField("error", T.BooleanType()), T.StructField("error_message", T.StringType()),
    T.StructField("called_at", T.TimestampType())])


def responses_from_calls(calls: DataFrame, offset: int) -> DataFrame:
    """W4 -> F16/F15 -> W1 over a call log (``_task`` order): tasks that were
    not called and rows after a model's first quota error go; ids number the
    others from ``offset``."""
    made = calls.where(~F.startswith("error_message", F.lit(NOT_CALLED)))
    kept = circuit_breaker(made, "model_name", "_task")
    err = F.col("error")
    out = (kept.withColumn("response_text", F.when(err, F.lit("")).otherwise(F.col("text")))
           .withColumn("response_time_sec", F.round("elapsed", 3))
           .withColumn("token_count", F.when(err, F.lit(0)).otherwise(word_count("text")))
           .withColumn("error_message", F.when(err, F.col("error_message")).otherwise(F.lit("")))
           .withColumn("timestamp", F.col("called_at")))
    return with_response_ids(out, ["_task"], offset, key="_task")


def _commit_responses(log: CommitLog, wave: str) -> None:
    calls = log.read(CALL_SCHEMA, CALLS, {wave})
    log.write(response_rows(responses_from_calls(calls, log.count())), ROWS, wave)


def run_query(spark: SparkSession, questions: DataFrame, models: DataFrame, backends: dict[str, Backend],
              output: str, question_order: list, prompts: PromptConfig = PromptConfig(),
              wave_size: int = RESPONSE_FLUSH_ROWS, largest_wave: int = LARGEST_WAVE,
              calls: CallOptions = CallOptions(), retry_errors: bool = False) -> DataFrame:
    """L2: the committed responses after all remaining tasks were called.

    The tasks are written once in task order and called wave by wave (ranges
    of that order that double from ``wave_size`` to ``largest_wave``). A model
    whose calls hit a quota error is not called in later waves, and no task
    calls it again after the error; its later tasks leave no row and are
    retried by the next run. With ``retry_errors`` error rows do not count as
    done."""
    log = open_table(spark, output)
    for wave in log.open_waves(CALLS):
        _commit_responses(log, wave)
    done: DataFrame | DoneState = DoneState(log, RESPONSES_SCHEMA, ("question_id", "model_name"))
    if retry_errors:
        done = log.read(RESPONSES_SCHEMA).where("not coalesce(error, false)")
    tasks = Ordered(query_tasks(questions, models, done, question_order, list(backends), prompts), ["task_order", "question_id"])
    disabled: set[str] = set()
    for start, stop in wave_ranges(tasks.count, wave_size, largest_wave):
        todo = tasks.rows(start, stop, "_task")
        if disabled:
            todo = todo.where(~F.col("model_name").isin(sorted(disabled)))
        need = [c for c in ("question_id", "model_name", "api", "model_id", "temperature", "max_tokens", "_task", "prompt")
                if c in todo.columns]
        todo = _dealt(todo.select(*need), calls).sortWithinPartitions("_task")
        made = infer(todo, backends, attempts=calls.attempts, delay=calls.delay, deadline=calls.deadline,
                     in_flight=calls.in_flight, halt_markers=tuple(QUOTA_MARKERS))
        wave = new_wave()
        made = log.write(made.select(*[F.col(f.name).cast(f.dataType) for f in CALL_SCHEMA]), CALLS, wave)
        _commit_responses(log, wave)
        disabled |= {r[0] for r in made.filter(quota_error("error", "error_message")).select("model_name").distinct().collect()}
    return log.read(RESPONSES_SCHEMA)


def _dealt(df: DataFrame, calls: CallOptions) -> DataFrame:
    """Calls dealt over tasks: as many as asked for, else as the cluster runs at once."""
    return df.repartition(calls.partitions or df.sparkSession.sparkContext.defaultParallelism)


# -------------------------------------------------------------- evaluate (L3)

JUDGE_API = "judge"
JUDGED = JUDGE_SUBSCORE_COLUMNS + ["overall_score", "justification"]
JUDGE_CALL_SCHEMA = T.StructType([
    T.StructField("response_id", T.StringType()), T.StructField("_sha", T.StringType()), T.StructField("_row", T.LongType()),
    T.StructField("_judge_text", T.StringType()), T.StructField("_judge_error", T.BooleanType()),
    T.StructField("_judge_error_message", T.StringType())])


def judge_prompts(rows: DataFrame) -> Column:
    return judge_prompt(F.col("question_text"), F.col("ground_truth_answer"), F.col("response_text"),
                        F.col("bloom_level"), F.col("bloom_name"), F.col("domain"))


def judge_calls(rows: DataFrame, judge: Backend, judge_model: dict | None = None,
                calls: CallOptions = CallOptions(attempts=RETRY_ATTEMPTS)) -> DataFrame:
    """I4: F3 -> I1 with I2 over the rows (``_row`` unique): the raw answers,
    one narrow row each. The judge's factory is given ``api`` and the entries
    of ``judge_model`` by their own names."""
    model = {k: (judge_model or {}).get(k) for k in ("model_name", "model_id", "temperature", *(judge_model or {}))}
    req = rows.select("response_id", "_row", judge_prompts(rows).alias("_prompt"), F.lit(JUDGE_API).alias("api"),
                      *[F.lit(v).alias(f"_m_{k}") for k, v in model.items()])
    req = req.withColumns({c: F.col(c).cast("string") for c, t in req.dtypes if t == "void"})
    made = infer(_dealt(req, calls), {JUDGE_API: judge}, prompt_col="_prompt", model_cols=tuple(f"_m_{k}" for k in model),
                 model_keys={f"_m_{k}": k for k in model}, attempts=calls.attempts, delay=calls.delay,
                 deadline=calls.deadline, in_flight=calls.in_flight, error_chars=JUDGE_ERROR_CHARS,
                 error_prefix="Judge error: ", out_prefix="_judge_")
    made = made.withColumn("_sha", F.sha2("_prompt", 256))
    return made.select(*[F.col(f.name).cast(f.dataType) for f in JUDGE_CALL_SCHEMA])


def judged_columns(calls: DataFrame) -> DataFrame:
    """F5 over raw answers: (_row, the parsed scores). A failed judge call
    leaves the scores null and says so in the justification."""
    failed = F.col("_judge_error")
    parsed = parse_judge(F.col("_judge_text"))
    cols = {c: F.when(~failed, parsed[c]) for c in JUDGED[:-1]}
    cols["justification"] = F.when(failed, F.col("_judge_error_message")).otherwise(parsed["justification"])
    return calls.select("_row", *[v.alias(c) for c, v in cols.items()])


def evaluation_rows(questions: DataFrame, responses: DataFrame, done_scores: DataFrame | None = None) -> DataFrame:
    """J1 -> J5: the responses not yet scored with their questions. Only the
    four required response columns need to be there. ``_pair`` is the key of
    the two texts that are compared."""
    lacking = {c: F.lit(None).cast(RESPONSE_TYPES[c]) for c in RESPONSE_TYPES if c not in responses.columns}
    rows = join_responses(responses.withColumns(lacking) if lacking else responses, questions)
    missing = {c: F.lit(None).cast("int" if c == "bloom_level" else "string")
               for c in ("domain", "bloom_level", "bloom_name", "question_text", "ground_truth_answer",
                         "question_type") if c not in rows.columns}
    if missing:
        rows = rows.withColumns(missing)
    rows = rows.withColumn("_pair", content_key("ground_truth_answer", "response_text"))
    return resume_scores(rows, done_scores) if done_scores is not None else rows


def scored(rows: DataFrame, models: DataFrame, ids: DataFrame, judged: DataFrame | None = None, stem: bool = True,
           skip_mcq: bool = SKIP_LEXICAL_FOR_MCQ) -> DataFrame:
    """(P3 | judged) -> P4 + F8-F14 -> J6 -> P5 over written rows. Everything
    computed is keyed on ``_row``, the identity of a row; ``ids`` (_row,
    score_id) and ``judged`` are narrow. Texts that repeat are compared once.
    Metrics, ids and judge scores meet the wide rows in one join."""
    lex = lexical_by_content(rows.filter(lexical_applies(rows, skip_mcq)).select(
        "_row", "_pair", F.col("ground_truth_answer").alias("reference"), F.col("response_text").alias("candidate")), "_row", stem=stem)
    side = ids.join(lex, "_row", "left")
    if judged is None:
        none = {c: F.lit(None).cast("bigint") for c in JUDGE_SUBSCORE_COLUMNS}
        side = side.withColumns({**none, "overall_score": F.lit(None).cast("double"), "justification": F.lit("")})
    else:
        side = side.join(judged, "_row", "left")
    rows = score_metadata(model_lookup(rows.drop(*JUDGED, "score_id", *[c for c in lex.columns if c != "_row"]), models))
    out = rows.drop("justification").join(side, "_row", "inner")
    out = out.withColumn("justification", F.when(is_error(rows), skipped_justification(F.col("error_message")))
                         .otherwise(F.col("justification")))
    return score_rows(out)


def evaluate_frame(questions: DataFrame, responses: DataFrame, models: DataFrame,
                   done_scores: DataFrame | None = None, judge: Backend | None = None,
                   judge_model: dict | None = None, order: list | None = None, score_offset: int = 0,
                   compat_ids: bool = False, stem: bool = True, skip_mcq: bool = SKIP_LEXICAL_FOR_MCQ,
                   calls: CallOptions = CallOptions(attempts=RETRY_ATTEMPTS)) -> DataFrame:
    """J1 -> J5 -> (P3 | I4) -> P4 + F8-F14 -> J6 -> W2 -> P5: the score
    table (42 columns) for the responses not yet scored.

    The joined rows are written once with an identity of their own, so null
    and repeated response ids give one score row each. Score ids number the
    rows in ``order`` (the input's order if it is known, else response_id).

    Shuffles: the metric job exchanges token arrays once; score ids are
    numbered on a narrow projection; the wide rows are shuffled once, by the
    final join on the row id (adaptive execution broadcasts the narrow side
    when small)."""
    rows = materialize(evaluation_rows(questions, responses, done_scores)
                       .withColumn("_row", F.monotonically_increasing_id()), "evaluate")
    narrow = rows.select("_row", F.col("error"), *[F.col(c) for c in dict.fromkeys(order or score_order(rows))])
    ids = with_score_ids(narrow, [*(order or score_order(rows)), "_row"], score_offset, compat_ids).select("_row", "score_id")
    judged = None
    if judge is not None:
        judged = judged_columns(materialize(judge_calls(rows.filter(~is_error(rows)), judge, judge_model, calls), "judge"))
    return scored(rows, models, ids, judged, stem, skip_mcq)


def score_order(rows: DataFrame) -> list[str]:
    """The order of the responses' input where it was kept, else their ids."""
    return ORDER_COLS if set(ORDER_COLS) <= set(rows.columns) else ["response_id"]


def evaluation_audit(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """J2 + A1: one row with the responses, those without a question, and the
    questions whose text or reference is null."""
    n = responses.agg(F.count(F.lit(1)).alias("responses"))
    lost = unmatched_responses(responses, questions).agg(F.count(F.lit(1)).alias("unmatched"))
    parts = [n, lost, null_audit(questions)]
    rows = [df.select(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for df in parts for c in df.columns]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def run_evaluate(spark: SparkSession, questions: DataFrame, responses: DataFrame, models: DataFrame,
                 output: str, judge: Backend | None = None, judge_model: dict | None = None,
                 order: list | None = None, compat_ids: bool = False, stem: bool = True,
                 skip_mcq: bool = SKIP_LEXICAL_FOR_MCQ, wave_size: int | None = None, largest_wave: int = LARGEST_WAVE,
                 calls: CallOptions = CallOptions(attempts=RETRY_ATTEMPTS)) -> DataFrame:
    """L3 with resume against ``output``: the committed scores after all
    remaining responses were scored.

    The remaining rows are written once in order and scored wave by wave
    (with a judge; without paid calls all are one wave). A wave's judge calls
    are committed before its scores, and calls that an earlier run committed
    without scores are used instead of calling again: for the same response
    id and prompt."""
    log = open_table(spark, output)
    rows = DoneState(log, SCORES_SCHEMA, ("response_id",)).remaining(evaluation_rows(questions, responses))
    for r in evaluation_audit(questions, responses).collect():
        if r["metric"] != "responses" and r["value"]:
            log_.warning("evaluate %s: %s %s", output, r["value"], r["metric"])
    stored = Ordered(rows, [*(order or score_order(rows)), "response_id"])
    open_waves = log.open_waves(CALLS)
    paid = None
    if open_waves and judge is not None:
        paid = log.read(JUDGE_CALL_SCHEMA, CALLS, set(open_waves)).drop("_row").dropDuplicates(["response_id", "_sha"])
    first = wave_size or (SCORE_FLUSH_ROWS if judge is not None else max(1, stored.count))
    for start, stop in wave_ranges(stored.count, first, max(first, largest_wave)):
        wave, part = new_wave(), stored.rows(start, stop, "_row")
        judged = None
        if judge is not None:
            todo, found = part.filter(~is_error(part)), None
            if paid is not None:
                keyed = todo.withColumn("_sha", F.sha2(judge_prompts(todo), 256))
                same = keyed["response_id"].eqNullSafe(paid["response_id"]) & (keyed["_sha"] == paid["_sha"])
                found = keyed.select("_row", "response_id", "_sha").join(paid, same).select(
                    keyed["response_id"], keyed["_sha"], "_row", "_judge_text", "_judge_error", "_judge_error_message")
                todo = keyed.join(paid, same, "left_anti").drop("_sha")
            made = judge_calls(todo, judge, judge_model, calls)
            judged = judged_columns(log.write(made.unionByName(found) if found is not None else made, CALLS, wave))
        narrow = part.select("_row", "error")
        offset = log.count()
        if compat_ids:
            ids = with_score_ids(narrow, ["_row"], offset, True).select("_row", "score_id")
        else:
            ids = narrow.select("_row", format_id("score_", F.col("_row") - F.lit(start - offset - 1)).alias("score_id"))
        log.write(scored(part, models, ids, judged, stem, skip_mcq), ROWS, wave)
    for wave in open_waves:
        log.commit(ROWS, wave, [], 0)
    return log.read(SCORES_SCHEMA)


# ----------------------------------------------------------------- label (L1)

LABEL_API = "labeller"
LABEL_CALL_SCHEMA = T.StructType([
    T.StructField("question_id", T.StringType()), T.StructField("_sha", T.StringType()),
    T.StructField("_call_text", T.StringType()), T.StructField("_call_error", T.BooleanType()),
    T.StructField("_call_error_message", T.StringType())])


def label_requests(q: DataFrame, relabel: bool = False) -> DataFrame:
    """P2 -> F4: (question_id, _prompt, _sha) of the rows that need a label."""
    prompt = label_prompt(F.col("question_text"), F.col("domain") if "domain" in q.columns else F.lit(None))
    return (q.filter(needs_label(q, relabel)).select(F.col("question_id").cast("string").alias("question_id"), prompt.alias("_prompt"))
            .withColumn("_sha", F.sha2("_prompt", 256)))


def label_calls(requests: DataFrame, labeller: Backend, model: dict | None = None,
                calls: CallOptions = CallOptions(attempts=RETRY_ATTEMPTS)) -> DataFrame:
    """I1/I2 over label requests: the raw answers. The labeller's factory is
    given ``api`` and the entries of ``model`` by their own names."""
    model = {k: (model or {}).get(k) for k in ("model_name", "model_id", "temperature", *(model or {}))}
    req = requests.withColumns({"api": F.lit(LABEL_API), **{f"_m_{k}": F.lit(v) for k, v in model.items()}})
    req = req.withColumns({c: F.col(c).cast("string") for c, t in req.dtypes if t == "void"})
    made = infer(_dealt(req, calls), {LABEL_API: labeller}, prompt_col="_prompt", model_cols=tuple(f"_m_{k}" for k in model),
                 model_keys={f"_m_{k}": k for k in model}, attempts=calls.attempts, delay=calls.delay,
                 deadline=calls.deadline, in_flight=calls.in_flight, error_chars=LABEL_ERROR_CHARS,
                 error_prefix="Labeling error: ", out_prefix="_call_")
    return made.select(*[F.col(f.name).cast(f.dataType) for f in LABEL_CALL_SCHEMA])


def labels_from_calls(calls: DataFrame) -> DataFrame:
    """F7 over raw answers, by question_id."""
    parsed = parse_label(F.col("_call_text"))
    return calls.select(
        "question_id", F.col("_call_error").alias("_failed"), F.col("_call_error_message").alias("_msg"),
        parsed["bloom_level"].alias("_lvl"), parsed["bloom_name"].alias("_name"),
        parsed["bloom_confidence"].alias("_conf"), parsed["bloom_justification"].alias("_just"))


def label_frame(questions: DataFrame, labeller: Backend, relabel: bool = False, model: dict | None = None,
                calls: CallOptions = CallOptions(attempts=RETRY_ATTEMPTS), keep_on_failure: bool = True) -> DataFrame:
    """S5 -> P2 -> F4 -> I1/I2 -> F7 -> J9: the question table with bloom
    columns filled for the rows that needed a label. A failed call leaves
    the row's old label (D8; ``keep_on_failure=False`` erases it, as the
    original did) and records the error as the justification."""
    q = coerce_bloom(questions)
    made = materialize(label_calls(label_requests(q, relabel), labeller, model, calls), "labels")
    return label_merge(q, labels_from_calls(made), keep_on_failure)


def needs_label(q: DataFrame, relabel: bool = False):
    """Rows without a bloom level (or all rows when relabelling)."""
    return F.lit(True) if relabel else F.col("bloom_level").isNull()


def label_merge(q: DataFrame, new: DataFrame, keep_on_failure: bool = True) -> DataFrame:
    """Override the four bloom columns of the labelled rows, leave the
    others; keyed by question_id (unique after the first-wins dedupe)."""
    n = new.withColumnRenamed("question_id", "_qid")
    j = q.join(n, F.col("question_id").cast("string").eqNullSafe(F.col("_qid")), "left").drop("_qid")
    labelled = F.col("_failed").isNotNull()
    ok = labelled & ~F.col("_failed")
    failed = labelled & F.col("_failed")
    keep = F.lit(keep_on_failure)

    def pick(old: str, new_c: str, on_fail):
        return (F.when(ok, F.col(new_c)).when(failed & keep, F.col(old)).when(failed, on_fail)
                .otherwise(F.col(old)))
    return (j.withColumn("bloom_level", pick("bloom_level", "_lvl", F.lit(None).cast("int")))
            .withColumn("bloom_name", pick("bloom_name", "_name", F.lit(None).cast("string")))
            .withColumn("bloom_confidence", pick("bloom_confidence", "_conf", F.lit(None).cast("double")))
            .withColumn("bloom_justification", F.when(ok, F.col("_just")).when(failed, F.col("_msg"))
                        .otherwise(F.col("bloom_justification")))
            .drop("_failed", "_msg", "_lvl", "_name", "_conf", "_just"))


def label_coverage(q: DataFrame) -> DataFrame:
    """A2: labelled rows and all rows."""
    return q.agg(F.count("bloom_level").alias("labelled"), F.count(F.lit(1)).alias("total"))


def run_label(spark: SparkSession, base: str, labeller: Backend, relabel: bool = False, model: dict | None = None,
              wave_size: int = RESPONSE_FLUSH_ROWS, largest_wave: int = LARGEST_WAVE,
              calls: CallOptions = CallOptions(attempts=RETRY_ATTEMPTS), keep_on_failure: bool = True) -> DataFrame:
    """L1 over a versioned question table (K3): label the current version
    wave by wave, write a new version, return the coverage row (A2).

    The calls of a wave are committed with the version they label; a run that
    starts from the same version again uses them (same id and prompt)."""
    log, at = CommitLog(spark, base), current_version(spark, base)
    q = coerce_bloom(read_versioned(spark, base))

    def paid() -> DataFrame:
        waves = {e["wave"] for e in log.entries(CALLS) if e["labels"] == at and e["relabel"] == relabel}
        return log.read(LABEL_CALL_SCHEMA, CALLS, waves).dropDuplicates(["question_id", "_sha"])
    known = paid().select(F.col("question_id").alias("_qid"), F.col("_sha").alias("_known"))
    requests = label_requests(q, relabel)
    todo = Ordered(requests.join(known, F.col("question_id").eqNullSafe(F.col("_qid")) & (F.col("_sha") == F.col("_known")),
                                 "left_anti"), ["question_id", "_sha"])
    for start, stop in wave_ranges(todo.count, wave_size, largest_wave):
        log.write(label_calls(todo.rows(start, stop).drop("_n"), labeller, model, calls), CALLS, new_wave(), labels=at, relabel=relabel)
    made = requests.select("question_id", "_sha").distinct().join(paid().withColumnRenamed("question_id", "_qid"), "_sha") \
        .where(F.col("question_id").eqNullSafe(F.col("_qid"))).drop("_qid")
    write_versioned(label_merge(q, labels_from_calls(made), keep_on_failure), base)
    return label_coverage(read_versioned(spark, base))


def run_labels(spark: SparkSession, bases: list[str], labeller: Backend, **kw) -> DataFrame:
    """L1 over several question tables: (base, labelled, total) of each."""
    out = None
    for base in bases:
        row = run_label(spark, base, labeller, **kw).select(F.lit(base).alias("base"), "labelled", "total")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no question tables given")
    return out


# ---------------------------------------------------------- job catalog (L4)

@dataclass(frozen=True)
class QueryRun:
    models: list[str]
    questions: list[str]
    output: str
    skip_datasets: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class EvaluationRun:
    questions: list[str]
    responses: str
    output: str
    judge_model: str
    description: str = ""


def expand(catalog: dict, name: str) -> list[tuple[str, object]]:
    """L4: ``all`` = every entry in catalog order, else the named entry."""
    if name == "all":
        return list(catalog.items())
    if name not in catalog:
        raise KeyError(f"unknown run '{name}'; known: {sorted(catalog)}")
    return [(name, catalog[name])]


def effective_skip(cli_skip: list[str] | None, run: QueryRun) -> list[str]:
    """A skip list given on the command line wins; else the run's own."""
    return list(cli_skip) if cli_skip else list(run.skip_datasets)


def run_study(spark: SparkSession, catalog: dict[str, QueryRun], name: str, models: DataFrame,
              backends: dict[str, Backend], cli_skip: list[str] | None = None, **kw) -> dict[str, DataFrame]:
    """L4: run the named query runs (``all``: every one, in catalog order):
    load each run's questions, query its models, give its responses."""
    out = {}
    for run, spec in expand(catalog, name):
        questions = load_questions(spark, spec.questions, skip=effective_skip(cli_skip, spec), keep_order=True)
        chosen = models.where(F.col("model_name").isin(spec.models))
        out[run] = run_query(spark, questions, chosen, backends, spec.output, ORDER_COLS, **kw)
    return out


def run_evaluations(spark: SparkSession, catalog: dict[str, EvaluationRun], name: str, models: DataFrame,
                    judge: Backend | None = None, **kw) -> dict[str, DataFrame]:
    """L4: run the named evaluation runs; the judge is told the run's judge model."""
    out = {}
    for run, spec in expand(catalog, name):
        out[run] = run_evaluate(spark, load_questions(spark, spec.questions), load_responses(spark, spec.responses, keep_order=True),
                                models, spec.output, judge, {"model_name": spec.judge_model, "model_id": spec.judge_model}, **kw)
    return out


__all__ = ["CALLS", "CallOptions", "EvaluationRun", "QueryRun", "effective_skip", "evaluate_frame", "evaluation_audit",
           "evaluation_rows", "expand", "judge_calls", "judged_columns", "label_calls", "label_coverage", "label_frame",
           "label_merge", "label_requests", "labels_from_calls", "materialize", "needs_label", "query_tasks",
           "responses_from_calls", "run_evaluate", "run_evaluations", "run_label", "run_labels", "run_query", "run_study",
           "scored", "union_runs"]

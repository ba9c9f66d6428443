"""Registered queries: one per operator of the inventory, each a function
(spark, sf_dir) -> DataFrame over the adapter views of the given tables.

Column names and types here match the oracle SQL in ``oracle.py``
(integers as bigint/int as stated, doubles rounded to 6 dp).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SCORE_COLUMNS
from ..functions.parsing import bloom_name, leading_int, mean_of_present, parse_judge, parse_label
from ..functions.prompts import instruction, judge_prompt, label_prompt, question_prompt, render_choices
from ..functions.text import keyword_scores, keywords, py_splitlines, py_strip, truncate, word_count
from ..operators.inference import infer
from ..operators.lexical import lexical_scores, ngram_overlap, stem_token
from ..operators.scoring import (is_error, join_responses, lexical_applies, model_lookup, resume_scores,
                                 skipped_justification, unmatched_responses, with_score_ids)
from ..operators.tasks import (active_models, circuit_breaker, done_pairs, quota_error, resume_tasks,
                               run_progress, task_grid, with_response_ids)
from ..session import scratch_path, spread
from ..sources.files import read_csv
from ..sources.questions import (dedupe_first, load_questions, null_audit, union_inputs,
                                 with_optional_defaults)
from ..sources.responses import coerce_bloom, load_responses
from ..sources.reconcile import RESCUED
from ..sources.sinks import (append_responses, append_scores, read_responses, read_scores, read_versioned, union_runs,
                             write_versioned)
from ..sources.xlsx import workbook_table
from . import stubs
from .pipelines import (CallOptions, QueryRun, evaluate_frame, evaluation_audit, label_coverage, label_frame, materialize,
                        run_evaluate, run_label, run_query, run_study)
from .views import view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).cast("double")


def V(spark, sf, name) -> DataFrame:
    return view(spark, sf, name)


def _stub_models(spark, sf) -> DataFrame:
    return V(spark, sf, "models_v")


# ------------------------------------------------------------------ sources

QCOLS = ["question_id", "domain", "difficulty", "bloom_level", "question_text", "ground_truth_answer",
         "question_type", "context", "choices_json", "dataset_name"]


def _write_csv(df: DataFrame, path: str) -> None:
    (df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def _question_files(spark, sf) -> list[str]:
    """Both question 'files' written as CSV (quoted texts with newlines),
    plus a path that does not exist (skipped, S3)."""
    base = scratch_path(spark, "questions_csv")
    named = {"bloom_name": bloom_name(F.col("bloom_level"))}
    f1 = V(spark, sf, "questions_file1").orderBy("row_ord").drop("conv_id", "turn", "file_ord", "row_ord") \
        .withColumns(named)
    f2 = V(spark, sf, "questions_file2").orderBy("row_ord").drop("conv_id", "turn", "file_ord", "row_ord") \
        .withColumns(named)
    _write_csv(f1, f"{base}/one.csv")
    _write_csv(f2, f"{base}/two.csv")
    return [f"{base}/one.csv", f"{base}/missing.csv", f"{base}/two.csv"]


@query("load_questions")
def q_load_questions(spark, sf):
    return load_questions(spark, _question_files(spark, sf)).select(*QCOLS)


@query("skip_datasets")
def q_skip_datasets(spark, sf):
    return load_questions(spark, _question_files(spark, sf), skip=["ds1", "ds2"]).select(*QCOLS)


@query("load_responses")
def q_load_responses(spark, sf):
    """Responses written as CSV (texts with newlines and quotes, boolean
    error flag as text) and read back with validation and typing (S4)."""
    path = scratch_path(spark, "responses_csv") + "/responses.csv"
    _write_csv(V(spark, sf, "responses_v"), path)
    return load_responses(spark, path).select("response_id", "question_id", "model_name", "response_text",
                                              "error", "error_message")


@query("mixed_types")
def q_mixed_types(spark, sf):
    """One input with typed columns (Parquet), one with text cells, some of
    which have no value in the declared type (CSV): they load together, and
    such a cell is null with its text kept."""
    base = scratch_path(spark, "questions_mixed")
    named = {"bloom_name": bloom_name(F.col("bloom_level"))}
    f1 = V(spark, sf, "questions_file1").where("conv_id % 2 = 1").drop("turn", "file_ord", "row_ord").withColumns(named)
    f1.write.parquet(f"{base}/typed.parquet")
    f2 = V(spark, sf, "questions_file2").drop("turn", "file_ord", "row_ord").withColumns(named)
    level = F.when(F.col("conv_id") % 4 == 0, F.lit("n/a")).otherwise(F.concat(F.col("bloom_level").cast("string"), F.lit(".0")))
    _write_csv(f2.withColumns({"bloom_level": level, "conv_id": F.concat(F.lit("no "), "conv_id")}), f"{base}/text.csv")
    q = load_questions(spark, [f"{base}/typed.parquet", f"{base}/text.csv"], keep_rescued=True)
    return q.select("question_id", "conv_id", "bloom_level", F.element_at(RESCUED, "bloom_level").alias("rescued_level"))


@query("xlsx_ingest")
def q_xlsx_ingest(spark, sf):
    """Workbooks of the questions, written by as many tasks as the view has
    partitions, read back through the workbook source (S2)."""
    q = V(spark, sf, "questions_v").select("question_id", "domain", "question_text", F.col("bloom_level").cast("string")
                                           .alias("bloom_level"), "context", "dataset_name")
    path = scratch_path(spark, "workbooks")
    stubs.workbooks(q).write.parquet(path)
    return workbook_table(spark.read.parquet(path)).select(*q.columns)


@query("union_files")
def q_union_files(spark, sf):
    u = union_inputs([V(spark, sf, "questions_file1"), V(spark, sf, "questions_file2")])
    return u.select("question_id", "question_text", "dataset_name", F.col("file_ord").cast("int"),
                    F.col("row_ord").cast("bigint"))


@query("dedupe_questions")
def q_dedupe_questions(spark, sf):
    u = union_inputs([V(spark, sf, "questions_file1"), V(spark, sf, "questions_file2")])
    d = dedupe_first(u, "question_id", ["file_ord", "row_ord"])
    return d.select("question_id", "question_text", "dataset_name", F.col("file_ord").cast("int"))


@query("optional_columns")
def q_optional_columns(spark, sf):
    q = V(spark, sf, "questions_v").drop("context", "choices_json", "question_type")
    return with_optional_defaults(q).select("question_id", "context", "choices_json", "question_type")


@query("null_audit")
def q_null_audit(spark, sf):
    return null_audit(V(spark, sf, "questions_v"),
                      ("question_text", "ground_truth_answer", "dataset_name", "bloom_level"))


@query("coerce_bloom")
def q_coerce_bloom(spark, sf):
    q = V(spark, sf, "questions_v").select("question_id", "question_text", "domain",
                                           F.col("bloom_level").cast("string").alias("bloom_level"))
    return coerce_bloom(q).select("question_id", "bloom_level", "bloom_name", "bloom_confidence",
                                  "bloom_justification")


@query("needs_label")
def q_needs_label(spark, sf):
    q = coerce_bloom(V(spark, sf, "questions_v"))
    return q.filter(F.col("bloom_level").isNull()).select("question_id", "question_text")


@query("label_coverage")
def q_label_coverage(spark, sf):
    return label_coverage(V(spark, sf, "questions_v"))


# ---------------------------------------------------------- prompts, parsers

@query("instruction_lookup")
def q_instruction_lookup(spark, sf):
    q = V(spark, sf, "questions_v")
    return q.select("question_id", instruction(F.col("domain")).alias("instruction"))


@query("render_choices")
def q_render_choices(spark, sf):
    q = V(spark, sf, "questions_v")
    return q.select("question_id", render_choices(F.col("choices_json")).alias("choices_text"))


@query("build_prompts")
def q_build_prompts(spark, sf):
    q = V(spark, sf, "questions_v")
    return q.select("question_id", question_prompt(F.col("domain"), F.col("question_text"), F.col("context"),
                                                   F.col("choices_json"), F.col("question_type")).alias("prompt"))


def _joined(spark, sf) -> DataFrame:
    return join_responses(V(spark, sf, "responses_v"), V(spark, sf, "questions_v"))


@query("build_judge_prompts")
def q_build_judge_prompts(spark, sf):
    j = _joined(spark, sf)
    return j.select("response_id", judge_prompt(F.col("question_text"), F.col("ground_truth_answer"),
                                                F.col("response_text"), F.col("bloom_level"),
                                                bloom_name(F.col("bloom_level")), F.col("domain")).alias("prompt"))


@query("build_label_prompts")
def q_build_label_prompts(spark, sf):
    q = V(spark, sf, "questions_v")
    return q.select("question_id", label_prompt(F.col("question_text"), F.col("domain")).alias("prompt"))


JUDGE_OUT = ["correctness", "completeness", "clarity", "cognitive_alignment", "overall_score", "justification"]


@query("parse_judge")
def q_parse_judge(spark, sf):
    j = spread(V(spark, sf, "judge_raw_v"))
    p = parse_judge(F.col("raw"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", *[p[c].alias(c) for c in JUDGE_OUT])


@query("parse_score")
def q_parse_score(spark, sf):
    j = spread(V(spark, sf, "judge_raw_v"))
    vals = F.transform(F.filter(py_splitlines(F.col("raw")), lambda ln: F.instr(ln, ":") > 0),
                       lambda ln: py_strip(F.substr(ln, F.instr(ln, ":") + 1)))
    e = j.select("l_orderkey", "l_linenumber", "l_partkey", F.posexplode(vals).alias("pos", "v"))
    return e.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("pos") + 1).cast("bigint").alias("pos"),
                    leading_int(F.col("v")).alias("score"))


@query("overall_fallback")
def q_overall_fallback(spark, sf):
    j = spread(V(spark, sf, "judge_raw_v"))
    p = parse_judge(F.col("raw"))
    subs = [p[c] for c in JUDGE_OUT[:4]]
    return j.select("l_orderkey", "l_linenumber", "l_partkey", mean_of_present(subs).alias("mean_score"))


LABEL_OUT = ["bloom_level", "bloom_name", "bloom_confidence", "bloom_justification"]


@query("parse_label")
def q_parse_label(spark, sf):
    lab = spread(V(spark, sf, "label_raw_v"))
    p = parse_label(F.col("raw"))
    return lab.select("o_orderkey", *[p[c].alias(c) for c in LABEL_OUT])


@query("bloom_lookup")
def q_bloom_lookup(spark, sf):
    q = V(spark, sf, "questions_v")
    return q.select("question_id", "bloom_level", bloom_name(F.col("bloom_level")).alias("bloom_name"))


# -------------------------------------------------------------- text, metrics

@query("extract_keywords")
def q_extract_keywords(spark, sf):
    p = V(spark, sf, "pairs_v")
    kr, kc = keywords(F.col("reference")), keywords(F.col("candidate"))
    return p.select("pair_id", F.array_join(kr, " ").alias("ref_keywords"), F.array_join(kc, " ").alias("cand_keywords"),
                    F.size(kr).cast("bigint").alias("n_ref"), F.size(kc).cast("bigint").alias("n_cand"))


@query("keyword_overlap")
def q_keyword_overlap(spark, sf):
    p = V(spark, sf, "pairs_v")
    kp, kr, kf = keyword_scores(keywords(F.col("reference")), keywords(F.col("candidate")))
    # per-row set arithmetic on at most 20 keywords a side: no shuffle needed
    return p.select("pair_id", r6(kp).alias("keyword_precision"), r6(kr).alias("keyword_recall"),
                    r6(kf).alias("keyword_f1"))


@query("ngram_overlap")
def q_ngram_overlap(spark, sf):
    return ngram_overlap(V(spark, sf, "pairs_v")).select(
        "pair_id", F.col("n").cast("int"), "matches", "cand_ngrams", "ref_ngrams")


def _lex(spark, sf, stem: bool, metrics=None) -> DataFrame:
    kw = {"metrics": metrics} if metrics else {}
    return lexical_scores(V(spark, sf, "pairs_v"), stem=stem, **kw)


@query("bleu")
def q_bleu(spark, sf):
    return _lex(spark, sf, True, ["bleu"]).select("pair_id", r6("bleu").alias("bleu"))


@query("rouge_unstemmed")
def q_rouge_unstemmed(spark, sf):
    return _lex(spark, sf, False, ["rouge1", "rouge2"]).select("pair_id", r6("rouge1").alias("rouge1"),
                                                                r6("rouge2").alias("rouge2"))


@query("rouge1")
def q_rouge1(spark, sf):
    return _lex(spark, sf, True, ["rouge1"]).select("pair_id", r6("rouge1").alias("rouge1"))


@query("rouge2")
def q_rouge2(spark, sf):
    return _lex(spark, sf, True, ["rouge2"]).select("pair_id", r6("rouge2").alias("rouge2"))


@query("rougeL")
def q_rougeL(spark, sf):
    return _lex(spark, sf, True, ["rougeL"]).select("pair_id", r6("rougeL").alias("rougeL"))


@query("stem_tokens")
def q_stem_tokens(spark, sf):
    from ..functions.tokens import rouge_tokens
    p = V(spark, sf, "pairs_v")
    toks = p.select(F.explode(rouge_tokens(F.col("reference"))).alias("token")).distinct()
    # distinct-token dimension: each token is stemmed once
    return toks.select("token", stem_token("token").alias("stem"))


@query("token_counts")
def q_token_counts(spark, sf):
    r = V(spark, sf, "responses_v")
    return r.select("response_id", F.when(is_error(r), F.lit(0)).otherwise(word_count("response_text"))
                    .cast("int").alias("token_count"))


@query("normalise_responses")
def q_normalise_responses(spark, sf):
    r = V(spark, sf, "responses_v")
    err = is_error(r)
    return r.select("response_id",
                    F.when(err, F.lit("")).otherwise(F.col("response_text")).alias("response_text"),
                    F.when(err, F.col("error_message")).otherwise(F.lit("")).alias("error_message"),
                    F.round(F.length("response_text") / F.lit(7.0), 3).cast("double").alias("response_time_sec"))


@query("truncate_errors")
def q_truncate_errors(spark, sf):
    q = V(spark, sf, "questions_v")
    t = F.col("question_text")
    return q.select("question_id", truncate(t, 200).alias("call_error"), truncate(t, 100).alias("judge_error"),
                    truncate(t, 80).alias("label_error"))


# ------------------------------------------------------- tasks, ids, breaker

@query("quota_errors")
def q_quota_errors(spark, sf):
    c = V(spark, sf, "call_log_v")
    return c.filter(quota_error("error", "error_message")).select("model_key", "seq", "error_message")


@query("active_models")
def q_active_models(spark, sf):
    return active_models(V(spark, sf, "model_catalog_v"), ["stub", "alt"]).select("model_name", "api")


@query("circuit_breaker")
def q_circuit_breaker(spark, sf):
    c = V(spark, sf, "call_log_v")
    return circuit_breaker(c, "model_key", "seq").select("model_key", "seq", "error", "error_message")


@query("response_ids")
def q_response_ids(spark, sf):
    kept = circuit_breaker(V(spark, sf, "call_log_v"), "model_key", "seq")
    return with_response_ids(kept, ["seq"], 0).select("seq", "response_id")


def _grid(spark, sf) -> DataFrame:
    act = active_models(_stub_models(spark, sf), ["stub"])
    return task_grid(V(spark, sf, "questions_v"), act, ["conv_id", "turn"])


@query("task_grid")
def q_task_grid(spark, sf):
    return _grid(spark, sf).select("question_id", "model_name", F.col("model_ord").cast("int"))


@query("resume_tasks")
def q_resume_tasks(spark, sf):
    return resume_tasks(_grid(spark, sf), V(spark, sf, "done_v")).select("question_id", "model_name")


@query("done_pairs")
def q_done_pairs(spark, sf):
    return done_pairs(V(spark, sf, "done_v"))


@query("run_progress")
def q_run_progress(spark, sf):
    return run_progress(tasks_remaining=resume_tasks(_grid(spark, sf), V(spark, sf, "done_v")),
                        rows_total=V(spark, sf, "done_v"))


# ------------------------------------------------------------------- scoring

@query("join_responses")
def q_join_responses(spark, sf):
    return _joined(spark, sf).select("response_id", "question_id", "model_name", "domain", "question_type",
                                     "response_text", "ground_truth_answer", "error")


@query("unmatched_responses")
def q_unmatched_responses(spark, sf):
    return unmatched_responses(V(spark, sf, "responses_v"), V(spark, sf, "questions_v")) \
        .select("response_id", "question_id")


@query("resume_scores")
def q_resume_scores(spark, sf):
    return resume_scores(_joined(spark, sf), V(spark, sf, "done_v")).select("response_id")


@query("model_lookup")
def q_model_lookup(spark, sf):
    models = _stub_models(spark, sf).filter(F.col("api") == "stub")
    return model_lookup(V(spark, sf, "responses_v"), models).select("response_id", "model_version", "temperature")


@query("error_rows")
def q_error_rows(spark, sf):
    j = _joined(spark, sf)
    return j.filter(is_error(j)).select("response_id", skipped_justification(F.col("error_message"))
                                        .alias("justification"))


@query("mcq_guard")
def q_mcq_guard(spark, sf):
    j = _joined(spark, sf)
    return j.select("response_id", lexical_applies(j).alias("lexical"))


SCORE_OUT = ["score_id", "response_id", "question_id", "model_name", "dataset_name", "domain", "difficulty",
             "bloom_level", "bloom_name", "question_type", "context", "choices_json", "error", "error_message",
             "model_version", "temperature", "human_validated", "justification"]
METRIC_OUT = ["bleu", "rouge1", "rouge2", "rougeL", "keyword_precision", "keyword_recall", "keyword_f1"]


def _evaluate(spark, sf, **kw) -> DataFrame:
    return evaluate_frame(V(spark, sf, "questions_v"), V(spark, sf, "responses_v"), _stub_models(spark, sf),
                          order=["response_id"], **kw)


def _score_select(df: DataFrame) -> DataFrame:
    """All columns of the score table, metrics rounded."""
    return df.select(*[r6(c).alias(c) if c in METRIC_OUT else F.col(c) for c in SCORE_COLUMNS])


@query("score_metadata")
def q_score_metadata(spark, sf):
    return _evaluate(spark, sf).select(*SCORE_OUT)


@query("score_ids")
def q_score_ids(spark, sf):
    return with_score_ids(_joined(spark, sf), ["response_id"]).select("response_id", "score_id")


@query("score_ids_compat")
def q_score_ids_compat(spark, sf):
    return with_score_ids(_joined(spark, sf), ["response_id"], compat=True).select("response_id", "score_id")


@query("evaluate_job")
def q_evaluate_job(spark, sf):
    """The evaluate job as configured by default: stemmed ROUGE, ROUGE-L, all 42 columns."""
    return _score_select(_evaluate(spark, sf))


@query("evaluate_stemmed")
def evaluate_stemmed_query(spark, sf):
    """The same job, the columns of interest."""
    return _evaluate(spark, sf).select(*SCORE_OUT, *[r6(c).alias(c) for c in METRIC_OUT])


@query("evaluate_minimal")
def q_evaluate_minimal(spark, sf):
    """Responses with the four required columns only."""
    r = V(spark, sf, "responses_v").select("response_id", "question_id", "model_name", "response_text")
    s = evaluate_frame(V(spark, sf, "questions_v"), r, _stub_models(spark, sf), order=["response_id"])
    return s.select("score_id", "response_id", "error", "error_message", "justification", *[r6(c).alias(c) for c in METRIC_OUT])


@query("evaluate_repeated_ids")
def q_evaluate_repeated_ids(spark, sf):
    """Null and repeated response ids: one score row for each response row."""
    s = evaluate_frame(V(spark, sf, "questions_v"), V(spark, sf, "responses_odd_v"), _stub_models(spark, sf))
    return s.select("response_id", "question_id", "model_name", "error", *[r6(c).alias(c) for c in METRIC_OUT])


@query("evaluation_audit")
def q_evaluation_audit(spark, sf):
    return evaluation_audit(V(spark, sf, "questions_v"), V(spark, sf, "responses_v"))


@query("stream_evaluate")
def q_stream_evaluate(spark, sf):
    """Responses arrive in two lots (split by model); the streaming job drains
    the landing folder after each, going on from its checkpoint. Score ids
    depend on the lots, so the compared columns are the rest of the score row."""
    from ..streaming.incremental import run_evaluate_stream
    landing, scores, ckpt = (scratch_path(spark, x) for x in ("landing", "stream-scores", "stream-ckpt"))
    r, out = V(spark, sf, "responses_v"), None
    for lot in (r.filter(F.col("model_name") == "copy"), r.filter(F.col("model_name") != "copy")):
        lot.write.parquet(landing, mode="append")
        out = run_evaluate_stream(spark, V(spark, sf, "questions_v"), _stub_models(spark, sf), landing, r.schema, scores, ckpt)
    return _score_select(out).drop("score_id")


@query("scores_sink")
def q_scores_sink(spark, sf):
    """Two committed waves of scores, read back; files of a wave without a
    commit (a job cut off while it wrote) are not seen."""
    path = scratch_path(spark, "scores")
    s = materialize(_evaluate(spark, sf), "scores-made")
    first = F.col("model_name") == "copy"
    append_scores(s.where(first), path)
    append_scores(s.where(~first), path)
    s.where(first).write.parquet(f"{path}/rows/cut-off")
    return _score_select(read_scores(spark, path))


@query("judge_scores")
def q_judge_scores(spark, sf):
    s = _evaluate(spark, sf, judge=stubs.judge_backend, calls=CallOptions(attempts=3, delay=0.0))
    return s.select("response_id", *JUDGE_OUT)


@query("evaluate_run")
def q_evaluate_run(spark, sf):
    """The evaluate run (L3) with a judge, in waves that double, then run
    again over all responses: the second run finds every score there."""
    path = scratch_path(spark, "evaluate-run")
    for part in (F.col("model_name") == "copy", F.lit(True)):
        out = run_evaluate(spark, V(spark, sf, "questions_v"), V(spark, sf, "responses_v").where(part), _stub_models(spark, sf),
                           path, stubs.judge_backend, wave_size=1000, calls=CallOptions(attempts=3, delay=0.0))
    return out.select("response_id", *JUDGE_OUT, *[r6(c).alias(c) for c in METRIC_OUT])


# ----------------------------------------------------------------- inference

def _all_model_tasks(spark, sf) -> DataFrame:
    models = _stub_models(spark, sf)
    grid = task_grid(V(spark, sf, "questions_v"), models, ["conv_id", "turn"])
    grid = grid.join(models.drop("model_ord"), "model_name")
    return grid.withColumn("prompt", question_prompt(F.col("domain"), F.col("question_text"), F.col("context"),
                                                     F.col("choices_json"), F.col("question_type")))


@query("infer_stub")
def q_infer_stub(spark, sf):
    out = infer(_all_model_tasks(spark, sf), {"stub": stubs.copy_backend})
    return out.select("question_id", "model_name", "text", "error", "error_message")


@query("routing_errors")
def q_routing_errors(spark, sf):
    out = infer(_all_model_tasks(spark, sf), {"stub": stubs.copy_backend})
    return out.filter(F.col("error")).select("question_id", "model_name", "error_message")


RESPONSE_OUT = ["response_id", "question_id", "model_name", "response_text", "token_count", "error", "error_message"]


@query("query_job")
def q_query_job(spark, sf):
    out = run_query(spark, V(spark, sf, "questions_v"), _stub_models(spark, sf), {"stub": stubs.copy_backend},
                    scratch_path(spark, "responses"), ["conv_id", "turn"], wave_size=500)
    return out.select(*RESPONSE_OUT)


@query("catalog_run")
def q_catalog_run(spark, sf):
    """A catalogue of two query runs (L4), all run: each loads its question
    files, skips its datasets and queries its model."""
    files, base = _question_files(spark, sf), scratch_path(spark, "catalog")
    catalog = {"copies": QueryRun(["copy"], files, f"{base}/copies.csv", ["ds1", "ds2"]),
               "prefixes": QueryRun(["prefix", "other"], files[:1], f"{base}/prefixes.csv")}
    runs = run_study(spark, catalog, "all", _stub_models(spark, sf), {"stub": stubs.copy_backend}, wave_size=500)
    return union_runs(runs).select("run", "question_id", "model_name", "response_text", "error", "error_message")


@query("responses_sink")
def q_responses_sink(spark, sf):
    path = scratch_path(spark, "responses_sink")
    append_responses(V(spark, sf, "responses_v"), path)
    return read_responses(spark, path).select("response_id", "question_id", "model_name", "response_text",
                                           "error", "error_message")


def _labelled(spark, sf) -> DataFrame:
    return label_frame(V(spark, sf, "questions_v"), stubs.labeller_backend, calls=CallOptions(attempts=3, delay=0.0))


@query("label_job")
def q_label_job(spark, sf):
    return _labelled(spark, sf).select("question_id", *LABEL_OUT)


@query("label_versions")
def q_label_versions(spark, sf):
    """The label run (L1) over a versioned table (K3): the current version
    after it, calls made in waves."""
    base = scratch_path(spark, "label-versions")
    write_versioned(V(spark, sf, "questions_v"), base)
    run_label(spark, base, stubs.labeller_backend, wave_size=500, calls=CallOptions(attempts=3, delay=0.0))
    return read_versioned(spark, base).select("question_id", *LABEL_OUT)


@query("label_merge")
def q_label_merge(spark, sf):
    return _labelled(spark, sf).select("question_id", "bloom_level", "bloom_justification")


@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    """Quoted multi-line CSV read back as written (T5)."""
    files = _question_files(spark, sf)
    return read_csv(spark, files[0]).select("question_id", "question_text", "context")


__all__ = ["QUERIES"]

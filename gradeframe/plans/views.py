"""Adapter views: question / response / raw-output tables derived from the
driver's tables, so every registered query's work grows with its input.

The SQL text is portable: the same string defines the view in Spark SQL and
in DuckDB (the oracle), so both sides start from identical rows. The one
exception is the response grid, which Spark expands with a generator over
the fixed model literal instead of a cross join (same rows).
Portability rules: ``concat()`` instead of ``||``; ``chr(10)``; ``floor``
before casting a double to int; no ``/`` integer division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]

VIEW_SQL: dict[str, str] = {}
VIEW_DEPS: dict[str, list[str]] = {}


def _view(name: str, deps: list[str], sql: str) -> None:
    VIEW_SQL[name] = sql.strip()
    VIEW_DEPS[name] = deps


_view("questions_v", ["conversations", "benchmark"], """
select concat('c',u.conv_id,'_',u.turn) question_id, u.conv_id, u.turn,
 case u.conv_id%5 when 0 then 'math' when 1 then 'science' when 2 then 'reading' when 3 then 'computer_science' else 'history' end domain,
 case u.conv_id%3 when 0 then 'easy' when 1 then 'medium' else 'hard' end difficulty,
 cast(nullif(u.conv_id%7,0) as int) bloom_level,
 u.text question_text, a.text ground_truth_answer,
 case when u.conv_id%4=0 then 'mcq' else 'open' end question_type,
 case when u.conv_id%2=0 then b.text else '' end context,
 case when u.conv_id%4<>0 then null when u.conv_id%12=0 then 'not json' else concat('{"B":"beta ',u.conv_id,'","A":"alpha ',u.turn,'"}') end choices_json,
 case when u.conv_id%9=0 then null else concat('ds',u.conv_id%9) end dataset_name
from (select *, conv_id%(select max(item_id)+1 from benchmark) item from conversations) u
join conversations a on u.conv_id=a.conv_id and a.turn=u.turn+1 and u.role='user' and a.role='assistant'
left join benchmark b on b.item_id=u.item
union all
select concat('b',i.item_id), i.conv_id, 0,
 case i.item_id%3 when 0 then 'math' when 1 then 'reading' else 'computer_science' end,
 'hard', cast(nullif(i.item_id%7,0) as int), i.text, substr(i.text,cast(floor(length(i.text)/2) as int)+1),
 case when i.item_id%2=0 then 'mcq' else 'open' end, substr(i.text,1,50),
 concat('{"A":"first","B":"second ',i.item_id,'","A":"last"}'), 'bench'
from (select *, item_id+(select max(conv_id)+1 from conversations) conv_id from benchmark) i
""")

# The model dimension of the fixtures: (model_ord, model_name, api, model_id, temperature).
MODELS = [(0, "copy", "stub", "copy-1", 0.0), (1, "prefix", "stub", "prefix-1", 0.0),
          (2, "other", "none", "other-1", 0.0)]
MODEL_COLS = ["model_ord", "model_name", "api", "model_id", "temperature"]

_view("models_v", [], "\nunion all ".join(
    f"select {o} model_ord,'{n}' model_name,'{a}' api,'{i}' model_id,cast({t} as double) temperature"
    for o, n, a, i, t in MODELS))

# A catalogue of models as large as a given table, for the queries that look
# at models themselves.
_view("model_catalog_v", ["supplier"], """
select cast(s_suppkey as int) model_ord, concat('m',s_suppkey) model_name,
 case s_nationkey%3 when 0 then 'stub' when 1 then 'alt' else 'none' end api,
 concat(s_name,'-',s_nationkey) model_id, cast(s_nationkey as double)/8 temperature
from supplier
""")

RESPONSES_BODY = """select concat('r_',question_id,'_',model_name) response_id, question_id, model_name,
 case when err then '' when model_name='copy' then ground_truth_answer when model_name='prefix' then substr(ground_truth_answer,1,cast(floor(length(ground_truth_answer)/2) as int)) else question_text end response_text,
 err error, case when not err then '' when conv_id%22=0 then 'rate_limit exceeded 429' else 'timeout' end error_message
from ({grid}) x
union all select concat('r_orphan_',conv_id), concat('missing_',conv_id),'copy','orphan text',false,'' from questions_v where conv_id%13=0 and turn=0"""

_view("responses_v", ["questions_v", "models_v"], RESPONSES_BODY.format(
    grid="select q.*,m.*,(q.conv_id+m.model_ord)%11=0 err from questions_v q cross join models_v m"))

# Spark builds the same rows without a join: each question row is expanded
# by a generator over the fixed model literal (no nested-loop join).
_MODEL_STRUCTS = ", ".join(
    f"named_struct('model_ord',{o},'model_name','{n}','api','{a}','model_id','{i}','temperature',cast({t} as double))"
    for o, n, a, i, t in MODELS)
SPARK_VIEW_SQL = {
    "responses_v": RESPONSES_BODY.format(
        grid=f"select q.*, m.*, (q.conv_id+m.model_ord)%11=0 err from questions_v q "
             f"lateral view inline(array({_MODEL_STRUCTS})) m as {', '.join(MODEL_COLS)}"),
}

# Responses whose ids are null or shared by many rows.
_view("responses_odd_v", ["responses_v"], """
select case when length(response_text)%5=0 then null when length(response_text)%5=1 then 'same' else response_id end response_id,
 question_id, model_name, response_text, error, error_message from responses_v
""")

_view("pairs_v", ["responses_v", "questions_v"], """
select r.response_id pair_id,q.ground_truth_answer reference,r.response_text candidate
from responses_v r join questions_v q on r.question_id=q.question_id where not r.error
""")

_view("judge_raw_v", ["lineitem"], """
select l_orderkey,l_linenumber,l_partkey,
 concat(case when l_linenumber=3 then 'correctness: ' else 'CORRECTNESS: ' end, cast(floor(l_quantity) as int)%11, case when l_linenumber=2 then '/10' else '' end, chr(10),
 'COMPLETENESS: ', cast(l_partkey%11 as int), chr(10),'CLARITY: ', case when l_linenumber=4 then 'n/a' else cast(l_suppkey%11 as varchar(9)) end, chr(10),
 'COGNITIVE_ALIGNMENT:', cast(l_orderkey%11 as int), chr(10),
 case when l_linenumber in (1,5) then '' else concat('OVERALL_SCORE: ',cast(l_orderkey%10 as int),chr(10)) end,
 'JUSTIFICATION: ratio ', l_linenumber, ':1 ok', case when l_linenumber=6 then concat(chr(10),'CORRECTNESS: 3') else '' end) raw
from lineitem
""")

_view("label_raw_v", ["orders"], """
select o_orderkey, concat(case when o_orderkey%4=0 then ' level: ' else 'LEVEL: ' end, cast(o_orderkey%9 as int), case when o_orderkey%3=0 then ' (x)' else '' end, chr(10),'NAME: whatever',chr(10),
 'CONFIDENCE: ', case when o_orderkey%5=0 then '.9' else concat('0.',cast(o_orderkey%100 as int)) end, chr(10), 'JUSTIFICATION: a: b') raw
from orders
""")

_view("call_log_v", ["events"], """
select user_id model_key,event_id seq,event_type='error' error,
 case when event_type<>'error' then '' when value>30 then 'HTTP 429 Quota' else 'timeout' end error_message
from events
""")

# Two "files" of questions for the union / first-wins dedupe: file 1 is the
# whole question table, file 2 repeats the even conversations with changed
# text and without dataset_name (so the union must fill a missing column).
_view("questions_file1", ["questions_v"], """
select question_id, conv_id, turn, domain, difficulty, bloom_level, question_text, ground_truth_answer,
 question_type, context, choices_json, dataset_name, 1 file_ord, conv_id*100+turn row_ord
from questions_v
""")
_view("questions_file2", ["questions_v"], """
select question_id, conv_id, turn, domain, difficulty, bloom_level, concat('copy: ', question_text) question_text, ground_truth_answer,
 question_type, context, choices_json, 2 file_ord, conv_id*100+turn row_ord
from questions_v where conv_id%2=0
""")

# Prior output for resume: responses whose question's conversation id is a
# multiple of three were already written by an earlier run.
_view("done_v", ["responses_v", "questions_v"], """
select r.* from responses_v r join questions_v q on r.question_id=q.question_id where q.conv_id%3=0
""")

def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out or n in BASE_TABLES:
            return
        for d in VIEW_DEPS[n]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def duck_sql(body: str, views: list[str]) -> str:
    """Prefix ``body`` with the CTEs that define ``views`` (for DuckDB)."""
    order = _closure(views)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS (\n{VIEW_SQL[n]}\n)" for n in order)
    head = body.lstrip()
    if head[:4].upper() == "WITH":
        return f"WITH {ctes},\n{head[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def register_base(spark: SparkSession, sf_dir: str, tables: list[str]) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark DataFrame for an adapter view over the tables in ``sf_dir``."""
    order = _closure([name])
    base = sorted({d for n in order for d in VIEW_DEPS[n] if d in BASE_TABLES})
    register_base(spark, sf_dir, base)
    for n in order:
        spark.sql(SPARK_VIEW_SQL.get(n, VIEW_SQL[n])).createOrReplaceTempView(n)
    return spark.table(name)

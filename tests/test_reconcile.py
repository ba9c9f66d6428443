"""Inputs of different types, cells without a value, wide scores, repeated JSON keys, large model tables, workbooks."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.functions.parsing import parse_judge
from gradeframe.functions.porter import stem
from gradeframe.functions.prompts import render_choices
from gradeframe.operators import tasks
from gradeframe.operators.scoring import model_lookup
from gradeframe.plans import oracle, stubs
from gradeframe.sources.questions import load_questions, union_inputs
from gradeframe.sources.reconcile import RESCUED, common_type
from gradeframe.sources.xlsx import workbook_table

HEAD = "question_id,domain,difficulty,bloom_level,bloom_name,question_text,ground_truth_answer,extra\n"


def test_typed_and_text_inputs_load_together(spark, tmp_dir):
    spark.createDataFrame([("q1", "d", "e", 3, "Apply", "Q1", "A1", 7)], "question_id string, domain string, difficulty string, "
                          "bloom_level int, bloom_name string, question_text string, ground_truth_answer string, extra long") \
        .write.parquet(f"{tmp_dir}/a.parquet")
    with open(f"{tmp_dir}/b.csv", "w") as f:
        f.write(HEAD + "q2,d,e,n/a,x,Q2,A2,8\nq3,d,e,4.0,x,NA,A3,none\nq1,d,e,5,x,COPY,A,9\n")
    q = load_questions(spark, [f"{tmp_dir}/a.parquet", f"{tmp_dir}/b.csv"], keep_rescued=True, na_values=["NA"])
    rows = {r["question_id"]: r for r in q.collect()}
    assert {k: r["bloom_level"] for k, r in rows.items()} == {"q1": 3, "q2": None, "q3": 4}
    assert {k: r[RESCUED] for k, r in rows.items()} == {"q1": {}, "q2": {"bloom_level": "n/a"}, "q3": {}}
    assert rows["q3"]["question_text"] is None and rows["q1"]["extra"] == "7" and rows["q3"]["extra"] == "none"


@pytest.mark.parametrize("a,b,want", [
    (T.IntegerType(), T.LongType(), T.LongType()), (T.IntegerType(), T.DoubleType(), T.DoubleType()),
    (T.DateType(), T.TimestampType(), T.TimestampType()), (T.BooleanType(), T.IntegerType(), T.StringType()),
    (T.NullType(), T.DateType(), T.DateType()), (T.DecimalType(5, 2), T.DecimalType(9, 4), T.DecimalType(9, 4)),
    (T.DecimalType(38, 0), T.DecimalType(38, 10), T.DoubleType()), (T.ArrayType(T.StringType()), T.StringType(), T.StringType())])
def test_common_type(a, b, want):
    assert common_type(a, b) == want == common_type(b, a)


def test_union_of_every_kind(spark):
    a = spark.createDataFrame([(1, dt.date(2024, 1, 2), [1, 2], True)], "x int, d date, l array<int>, f boolean")
    b = spark.createDataFrame([(2.5, dt.datetime(2024, 1, 3, 4), "text", "maybe")], "x double, d timestamp, l string, f string")
    got = [tuple(r) for r in union_inputs([a, b]).orderBy("x").collect()]
    assert got == [(1.0, dt.datetime(2024, 1, 2), "[1,2]", "true"), (2.5, dt.datetime(2024, 1, 3, 4), "text", "maybe")]


def test_scores_beyond_int(spark):
    df = spark.createDataFrame([("CORRECTNESS: 99999999999\nOVERALL_SCORE: 123456789012345678901234",), ("CLARITY: 3000000000",)], "r string")
    a, b = [r[0] for r in df.select(parse_judge("r")).collect()]
    assert a["correctness"] == 99999999999 and a["overall_score"] == 1.2345678901234568e23
    assert b["clarity"] == 3000000000 and b["overall_score"] == 3e9


def test_repeated_json_keys(spark):
    df = spark.createDataFrame([('{"A":"x","A":"y"}',), ('{"B":"1","A":"2","B":null,"C":"3","A":"4"}',)], "c string")
    assert [r[0] for r in df.select(render_choices("c")).collect()] == ["A. y", "A. 4\nB. None\nC. 3"]


def test_model_tables_larger_than_the_plan(spark, monkeypatch):
    q = spark.createDataFrame([(i, f"q{i}") for i in range(4)], "n int, question_id string")
    m = spark.createDataFrame([(i, f"m{i}", f"id{i}", i / 2) for i in range(25)], "model_ord int, model_name string, model_id string, temperature double")
    r = spark.createDataFrame([("m3",), ("zz",), (None,)], "model_name string")
    want = sorted(map(tuple, tasks.task_grid(q, m, ["n"]).select("question_id", "model_name", "model_ord").collect()))
    looked = sorted(map(str, model_lookup(r, m).select("model_name", "model_version", "temperature").collect()))
    monkeypatch.setattr(tasks, "INLINE_MODELS", 10)
    monkeypatch.setattr(tasks.inline_rows, "__defaults__", (10,))
    grid = tasks.task_grid(q, m, ["n"])
    assert sorted(map(tuple, grid.select("question_id", "model_name", "model_ord").collect())) == want and len(want) == 100
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan
    assert sorted(map(str, model_lookup(r, m).select("model_name", "model_version", "temperature").collect())) == looked


def test_workbooks(spark):
    """Several workbooks with other headers, repeated and empty header cells, rows without cells."""
    books = [("a.xlsx", stubs.workbook(["id", "x", "x", None], [["1", "p", "q", "r"], [None] * 4, ["2", None, "s", None]])),
             ("b.xlsx", stubs.workbook(["id", "y"], [["3", "t"]])), ("c.xlsx", stubs.workbook(["id"], []))]
    got = workbook_table(spark.createDataFrame(books, "path string, content binary"))
    assert got.columns == ["id", "x", "x.1", "_c3", "y", "_xlsx_path", "_xlsx_row"]
    rows = sorted(got.collect(), key=lambda r: (r["_xlsx_path"], r["_xlsx_row"]))
    assert [tuple(r)[:5] for r in rows] == [("1", "p", "q", "r", None), (None,) * 5, ("2", None, "s", None, None), ("3", None, None, None, "t")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan                                        # decoded before, once


def test_stemmer_equals_its_sql():
    """The SQL of Porter's steps and the helper agree on words built from the suffixes of the rules."""
    draw = random.Random(11)
    ends = [x for t in (oracle.STEP2_SQL, oracle.STEP3_SQL) for x, _ in oracle.suffix_pairs(t)] + oracle.STEP4_SQL.split()
    ends += ["ed", "ing", "ies", "ied", "eed", "s", "sses", "y", "ll", "e", "logi", "bled", "ating", "izing"]
    words = {"sky", "skies", "dying", "news", "howe", "sayings", "yyy", "by"}
    words |= {"".join(draw.choice("aeiouybcdlstzwxr1") for _ in range(draw.randint(1, 6)))
              + "".join(draw.choice(ends) for _ in range(draw.randint(0, 2))) for _ in range(20_000)}
    con = duckdb.connect()
    con.execute("create table t(token varchar)")
    con.execute(f"insert into t values {', '.join(f'({oracle.q(w)})' for w in sorted(words))}")
    got = dict(con.execute(f"WITH {oracle.stem_ctes('select token from t')} select token, stem from stems").fetchall())
    assert got == {w: stem(w) if len(w) > 3 else w for w in words}


def test_every_benchmark_item_is_a_question(spark):
    from conftest import SF_SMALL
    from gradeframe.plans.views import view
    ids = {r[0] for r in view(spark, SF_SMALL, "questions_v").select("question_id").collect()}
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select(F.concat(F.lit("b"), "item_id")).collect()
    assert {r[0] for r in items} <= ids

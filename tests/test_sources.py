"""Question/response sources: CSV traps, multi-file union, skip list with
null names, first-wins dedupe, optional columns, validation, null audit."""

import os

import pytest

from gradeframe.sources.questions import load_questions, null_audit
from gradeframe.sources.responses import coerce_bloom, load_responses, read_or_empty
from gradeframe.schemas import RESPONSES_SCHEMA

HEADER = "question_id,domain,difficulty,bloom_level,bloom_name,question_text,ground_truth_answer,dataset_name\n"


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_multi_file_dedupe_skip_and_traps(spark, tmp_dir):
    a = write(os.path.join(tmp_dir, "a.csv"), HEADER +
              'q001,science,easy,1,Remember,"What is ""ATP""?\nTwo lines","energy, molecule",ds1\n'
              'q002,math,hard,3,Apply,Q2,A2,\n'
              'q003,math,hard,x,Apply,Q3,A3,ds2\n'
              '007,math,easy,2,Understand,Q7,,ds3\n')
    b = write(os.path.join(tmp_dir, "b.csv"),
              "question_id,domain,difficulty,bloom_level,bloom_name,question_text,ground_truth_answer\n"
              "q002,math,hard,3,Apply,SECOND COPY,A2\nq004,science,easy,2,Understand,Q4,A4\n")
    df = load_questions(spark, [a, os.path.join(tmp_dir, "missing.csv"), b], skip=["ds2"])
    rows = {r["question_id"]: r for r in df.collect()}
    assert set(rows) == {"q001", "q002", "007", "q004"}          # q003 skipped, file 2's q002 loses
    assert rows["q001"]["question_text"] == 'What is "ATP"?\nTwo lines'
    assert rows["q001"]["ground_truth_answer"] == "energy, molecule"
    assert rows["q002"]["question_text"] == "Q2"                  # first copy wins
    assert rows["007"]["bloom_level"] == 2                        # id stays text "007"
    assert rows["q004"]["dataset_name"] is None                   # missing column -> null
    assert rows["q001"]["context"] == "" and rows["q001"]["question_type"] == ""   # optional defaults
    audit = null_audit(df).first()
    assert audit["null_ground_truth_answer"] == 1 and audit["null_question_text"] == 0


def test_null_dataset_names_are_kept(spark, tmp_dir):
    a = write(os.path.join(tmp_dir, "n.csv"), HEADER + "q1,s,e,1,R,Q,A,\nq2,s,e,1,R,Q,A,ds1\n")
    ids = sorted(r[0] for r in load_questions(spark, [a], skip=["ds1"]).select("question_id").collect())
    assert ids == ["q1"]


def test_missing_files_and_columns(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        load_questions(spark, [os.path.join(tmp_dir, "nope.csv")])
    bad = write(os.path.join(tmp_dir, "bad.csv"), "question_id,domain\nq1,x\n")
    with pytest.raises(ValueError, match="bloom_level"):
        load_questions(spark, [bad])


def test_parquet_and_json_sources(spark, tmp_dir):
    df = spark.createDataFrame([("q1", "s", "e", 2, "Understand", "Q", "A")],
                               "question_id string, domain string, difficulty string, bloom_level int, "
                               "bloom_name string, question_text string, ground_truth_answer string")
    df.write.parquet(f"{tmp_dir}/q.parquet")
    df.write.json(f"{tmp_dir}/q.json")
    assert load_questions(spark, [f"{tmp_dir}/q.parquet"]).count() == 1
    assert load_questions(spark, [f"{tmp_dir}/q.json", f"{tmp_dir}/q.parquet"]).count() == 1


def test_responses_and_bloom(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        load_responses(spark, f"{tmp_dir}/none.csv")
    p = write(os.path.join(tmp_dir, "r.csv"),
              "response_id,question_id,model_name,response_text,error,token_count\n"
              "resp_000001,q1,m,hello,False,1\nresp_000002,q2,m,,True,0\n")
    r = load_responses(spark, p).orderBy("response_id").collect()
    assert r[0]["error"] is False and r[1]["error"] is True and r[0]["token_count"] == 1
    assert read_or_empty(spark, f"{tmp_dir}/absent", RESPONSES_SCHEMA).count() == 0
    q = spark.createDataFrame([("q1", "Q", "3"), ("q2", "Q", "zz"), ("q3", "Q", None)],
                              "question_id string, question_text string, bloom_level string")
    c = {x["question_id"]: x for x in coerce_bloom(q).collect()}
    assert c["q1"]["bloom_level"] == 3 and c["q2"]["bloom_level"] is None   # one bad cell only
    assert "bloom_confidence" in c["q1"] and c["q1"]["bloom_name"] is None

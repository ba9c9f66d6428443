"""Workbook ingest and the streaming evaluate job."""

import os
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from conftest import SF_SMALL
from gradeframe.plans.views import view
from gradeframe.sources.questions import load_questions
from gradeframe.sources.xlsx import read_xlsx


def col_name(i):
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def write_xlsx(path, rows):
    """Minimal workbook (inline strings, numbers as numbers)."""
    def cell(r, c, v):
        ref = f"{col_name(c)}{r + 1}"
        if v is None:
            return ""
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    sheet = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>"
                    for r, row in enumerate(rows))
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData>{sheet}</sheetData></worksheet>')


HEAD = ["question_id", "domain", "difficulty", "bloom_level", "bloom_name", "question_text", "ground_truth_answer"]


def test_xlsx_questions(spark, tmp_dir):
    d = os.path.join(tmp_dir, "books")
    os.makedirs(d)
    write_xlsx(os.path.join(d, "a.xlsx"), [HEAD, ["q1", "math", "easy", 3, "Apply", "Two\nlines & <tags>", "A"],
                                            ["q2", "math", "easy", None, None, "Q2", "A2"]])
    raw = read_xlsx(spark, d)
    rows = {r["question_id"]: r for r in raw.collect()}
    assert rows["q1"]["question_text"] == "Two\nlines & <tags>" and rows["q1"]["bloom_level"] == "3"
    assert rows["q2"]["bloom_level"] is None
    q = load_questions(spark, [os.path.join(d, "a.xlsx")])
    assert {r["question_id"]: r["bloom_level"] for r in q.collect()} == {"q1": 3, "q2": None}


def test_stream_scores_idempotent(spark, tmp_dir):
    from gradeframe.streaming.incremental import run_evaluate_stream
    q = view(spark, SF_SMALL, "questions_v")
    m = view(spark, SF_SMALL, "models_v")
    r = view(spark, SF_SMALL, "responses_v")
    landing, out, ckpt = f"{tmp_dir}/landing", f"{tmp_dir}/scores", f"{tmp_dir}/ckpt"
    r.filter(F.col("model_name") == "copy").write.parquet(landing, mode="append")
    s1 = run_evaluate_stream(spark, q, m, landing, r.schema, out, ckpt, files_per_batch=1, stem=False)
    n1 = s1.count()
    r.filter(F.col("model_name") != "copy").write.parquet(landing, mode="append")
    s2 = run_evaluate_stream(spark, q, m, landing, r.schema, out, ckpt, files_per_batch=1, stem=False)
    total = r.join(q, "question_id").count()
    assert s2.count() == total > n1
    assert s2.select("score_id").distinct().count() == total
    # replaying everything from a fresh checkpoint writes nothing new (anti-join on response_id)
    s3 = run_evaluate_stream(spark, q, m, landing, r.schema, out, f"{tmp_dir}/ckpt2", stem=False)
    assert s3.count() == total


def test_xlsx_shared_strings_and_numbers(spark, tmp_dir):
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    path = os.path.join(tmp_dir, "s.xlsx")
    shared = ["question_id", "bloom_level", "flag", "q&amp;1"]
    sheet = ('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row>'
             '<row r="2"><c r="A2" t="s"><v>3</v></c><c r="B2"><v>3.0</v></c><c r="C2" t="b"><v>1</v></c></row>'
             '<row r="3"><c r="A3" t="str"><v>q2</v></c><c r="C3" t="b"><v>0</v></c></row>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="worksheet" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData>{sheet}</sheetData></worksheet>')
    rows = sorted((r["question_id"], r["bloom_level"], r["flag"]) for r in read_xlsx(spark, path).collect())
    assert rows == [("q&1", "3", "TRUE"), ("q2", None, "FALSE")]

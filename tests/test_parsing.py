"""Judge / labeller parsers against a direct Python transcription of the
rules (SURVEY 2.12), on the fixture table and hand-made edge cases."""

import re

from conftest import SF_SMALL, one_col
from gradeframe.constants import BLOOM_LEVELS
from gradeframe.functions.parsing import parse_judge, parse_label
from gradeframe.plans.views import view


def py_score(v):
    if not v:
        return None
    m = re.match(r"([0-9]+)", v.strip())
    return int(m.group(1)) if m else None


def py_judge(text):
    out = {"correctness": None, "completeness": None, "clarity": None, "cognitive_alignment": None,
           "overall_score": None, "justification": ""}
    keys = {"CORRECTNESS": "correctness", "COMPLETENESS": "completeness", "CLARITY": "clarity",
            "COGNITIVE_ALIGNMENT": "cognitive_alignment", "OVERALL_SCORE": "overall_score"}
    for line in (text or "").splitlines():
        if ":" not in line:
            continue
        k, v = line.split(":", 1)
        v = v.strip()
        if k in keys:
            out[keys[k]] = py_score(v)
        elif k == "JUSTIFICATION":
            out["justification"] = v
    if out["overall_score"] is None:
        sub = [out[c] for c in ("correctness", "completeness", "clarity", "cognitive_alignment") if out[c] is not None]
        if sub:
            out["overall_score"] = round(sum(sub) / len(sub), 2)
    elif out["overall_score"] is not None:
        out["overall_score"] = float(out["overall_score"])
    return out


def py_label(text):
    out = {"bloom_level": None, "bloom_name": None, "bloom_confidence": None, "bloom_justification": ""}
    for line in (text or "").strip().splitlines():
        if ":" not in line:
            continue
        k, v = line.split(":", 1)
        k, v = k.strip().upper(), v.strip()
        if k == "LEVEL":
            m = re.match(r"([0-9])", v)
            if m and int(m.group(1)) in BLOOM_LEVELS:
                out["bloom_level"] = int(m.group(1))
                out["bloom_name"] = BLOOM_LEVELS[out["bloom_level"]]
        elif k == "CONFIDENCE":
            m = re.match(r"([0-9]+\.?[0-9]*)", v)
            if m:
                out["bloom_confidence"] = round(float(m.group(1)), 3)
        elif k == "JUSTIFICATION":
            out["bloom_justification"] = v
    return out


JUDGE_CASES = [
    "CORRECTNESS: 8/10\nCOMPLETENESS: 6\nCLARITY: 9\nCOGNITIVE_ALIGNMENT: 7",
    "correctness: 8\nCLARITY: 5",
    "CORRECTNESS: 8.5\nOVERALL_SCORE: 7\nJUSTIFICATION: fine: really",
    "CORRECTNESS: -3\nCOMPLETENESS: [8]\nCLARITY:\nJUSTIFICATION:",
    "", None, "no colon here",
    "CORRECTNESS: 4\r\nCORRECTNESS: n/a\r\nJUSTIFICATION:  a  \x0bCLARITY: 3",
    " CORRECTNESS: 9\nCORRECTNESS : 2\nCOMPLETENESS:\t07 points OVERALL_SCORE: 10",
    "JUSTIFICATION: first\nJUSTIFICATION: second\x85CLARITY: 1\x1cCOMPLETENESS: 2",
]
LABEL_CASES = [
    "LEVEL: 3 (Apply)\nNAME: x\nCONFIDENCE: 0.91666\nJUSTIFICATION: because: yes",
    " level: 3 (x)", "LEVEL: 12", "LEVEL: 7", "LEVEL: 4\nLEVEL: 9", "CONFIDENCE: .9", "CONFIDENCE: 90%",
    "\n\n  Level :  5\r\n confidence: 1\n", "", None, "JUSTIFICATION: a\nJUSTIFICATION:",
    "LEVEL: 2\nLEVEL: x\nCONFIDENCE: 0.5\nCONFIDENCE: none",
]


def _struct_rows(spark, texts, fn):
    out = one_col(spark, texts, fn)
    return [r.asDict() for r in out]


def test_judge_cases(spark):
    got = _struct_rows(spark, JUDGE_CASES, parse_judge)
    assert got == [py_judge(t) for t in JUDGE_CASES]
    assert got[0]["overall_score"] == 7.5 and got[0]["correctness"] == 8
    assert got[1]["correctness"] is None


def test_label_cases(spark):
    got = _struct_rows(spark, LABEL_CASES, parse_label)
    assert got == [py_label(t) for t in LABEL_CASES]
    assert got[1]["bloom_level"] == 3 and got[1]["bloom_name"] == "Apply"
    assert got[2]["bloom_level"] == 1
    assert got[5]["bloom_confidence"] is None and got[6]["bloom_confidence"] == 90.0


def test_fixture_tables(spark):
    j = view(spark, SF_SMALL, "judge_raw_v")
    p = parse_judge(j["raw"])
    rows = j.select("raw", p.alias("p")).collect()
    assert rows and all(r["p"].asDict() == py_judge(r["raw"]) for r in rows)
    lab = view(spark, SF_SMALL, "label_raw_v")
    q = parse_label(lab["raw"])
    rows = lab.select("raw", q.alias("p")).collect()
    assert rows and all(r["p"].asDict() == py_label(r["raw"]) for r in rows)

"""Prompt layouts, choices rendering and instruction fallback."""

from pyspark.sql import functions as F

from gradeframe.functions.prompts import (DEFAULT_FALLBACK, DEFAULT_INSTRUCTIONS, PromptConfig,
                                          judge_prompt, label_prompt, question_prompt, render_choices)

CH = '{"B": "beta", "A": "alpha", "C": "gamma"}'


def prompts(spark, rows, cfg=PromptConfig()):
    df = spark.createDataFrame(rows, "i int, domain string, q string, ctx string, cj string, qt string")
    return [r[0] for r in df.orderBy("i").select(question_prompt("domain", "q", "ctx", "cj", "qt", cfg)).collect()]


def test_layouts(spark):
    T = DEFAULT_INSTRUCTIONS
    got = prompts(spark, [
        (1, " Reading ", "Q?", " passage ", CH, " mcq "),
        (2, "reading", "Q?", "passage", None, "open"),
        (3, "science", " Q? ", "", CH, "mcq"),
        (4, "computer_science", "Q?", "def f(): pass", None, "open"),
        (5, "math", "Q?", "", None, "open"),
        (6, "unknown", None, None, None, None),
        (7, "science", "Q?", "", "not json", "mcq"),
        (8, "science", "Q?", "", "{}", "mcq"),
        (9, "science", "Q?", "", CH, "open"),
        (10, "computer_science", "Q?", "code", CH, "mcq"),
    ])
    choices = "A. alpha\nB. beta\nC. gamma"
    assert got[0] == f"Passage:\npassage\n\nQuestion: Q?\n\nChoices:\n{choices}\n\n{T['reading']}"
    assert got[1] == f"Passage:\npassage\n\nQuestion: Q?\n\n{T['reading']}"
    assert got[2] == f"Q?\n\nChoices:\n{choices}\n\n{T['science']}"
    assert got[3] == f"{T['computer_science']}\n\nProblem:\nQ?\n\nStarter code:\n```python\ndef f(): pass\n```"
    assert got[4] == f"Q?\n\n{T['math']}"
    assert got[5] == f"\n\n{DEFAULT_FALLBACK}"
    assert got[6] == f"Q?\n\n{T['science']}"      # malformed JSON -> plain layout
    assert got[7] == f"Q?\n\n{T['science']}"      # empty object -> no choices
    assert got[8] == f"Q?\n\n{T['science']}"      # not mcq -> choices ignored
    assert got[9].startswith("Q?\n\nChoices:")   # choices win over the code layout


def test_custom_instructions(spark):
    got = prompts(spark, [(1, "Math", "Q", "", None, "open")], PromptConfig({"math": "M!"}, "F!"))
    assert got == ["Q\n\nM!"]


def test_render_choices(spark):
    df = spark.createDataFrame([(CH,), ("[1,2]",), ("null",), ('{"b": null, "a": "x"}',)], "cj string")
    got = [r[0] for r in df.select(render_choices("cj")).collect()]
    assert got[0] == "A. alpha\nB. beta\nC. gamma"
    assert got[1] is None and got[2] is None
    assert got[3] == "a. x\nb. None"


def test_judge_and_label_prompts_carry_fields(spark):
    df = spark.createDataFrame([("Q", "R", "A", 3, "Apply", "math")], "q string, r string, a string, l int, n string, d string")
    jp = df.select(judge_prompt("q", "r", "a", "l", "n", "d")).first()[0]
    for k in ("Q", "R", "A", "math", "3 (Apply)", "CORRECTNESS:", "OVERALL_SCORE:", "JUSTIFICATION:"):
        assert k in jp
    lp = df.select(label_prompt("q", "d")).first()[0]
    for k in ("1 = Remember", "6 = Create", "DOMAIN: math", "QUESTION: Q", "LEVEL:", "CONFIDENCE:"):
        assert k in lp
    nulls = df.select(judge_prompt(F.lit(None), "r", "a", F.lit(None), F.lit(None), F.lit(None))).first()[0]
    assert "unknown (unknown)" in nulls

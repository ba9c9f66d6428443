"""Prompt rendering (F1-F4) and the domain-instruction lookup (J7) as native
column expressions.

Layout is behaviour and fixed; instruction wording is caller data
(``instructions`` / ``fallback`` arguments) with our own defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BLOOM_LEVELS, MCQ_TYPE
from .text import col_, py_strip, text_or_empty

# Default instructions (our own wording; pass your own table to override).
DEFAULT_INSTRUCTIONS = {
    "math": "Work through the problem step by step and state the final answer clearly at the end.",
    "science": "Answer the question and explain the reasoning behind your answer.",
    "reading": "Answer briefly, using only the passage above as evidence.",
    "computer_science": ("Write a correct, readable solution in Python with short comments, "
                         "preferring the most efficient approach."),
}
DEFAULT_FALLBACK = "Give a clear answer and explain your reasoning."

# ---------------------------------------------------------------- fixed values
# Block labels of the question layouts.
PASSAGE_LABEL = "Passage:"
QUESTION_LABEL = "Question:"
CHOICES_LABEL = "Choices:"
PROBLEM_LABEL = "Problem:"
STARTER_LABEL = "Starter code:"
CODE_FENCE_OPEN = "```python"
CODE_FENCE_CLOSE = "```"
READING_DOMAIN = "reading"
CODE_DOMAIN = "computer_science"
# --------------------------------------------------------- end of fixed values

NL = "\n"
BLANK = "\n\n"


@dataclass(frozen=True)
class PromptConfig:
    instructions: dict[str, str] = field(default_factory=lambda: dict(DEFAULT_INSTRUCTIONS))
    fallback: str = DEFAULT_FALLBACK


def _map_literal(d: dict) -> Column:
    if not d:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def instruction(domain, cfg: PromptConfig = PromptConfig()) -> Column:
    """Instruction for the trimmed, lower-cased domain, else the fallback.
    The table is a bounded config literal: no join at all."""
    key = F.lower(py_strip(text_or_empty(domain)))
    return F.coalesce(F.try_element_at(_map_literal(cfg.instructions), key), F.lit(cfg.fallback))


def render_choices(choices_json) -> Column:
    """``key. value`` lines sorted by key from a JSON object; null when the
    JSON is malformed or not an object (F2 + O1). Of a repeated key the last
    value stays."""
    m = F.from_json(col_(choices_json), "map<string,string>")
    keys = F.map_keys(m)  # in the order of the text, repeats included
    last = F.filter(F.map_entries(m), lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    entries = F.array_sort(last, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    lines = F.transform(entries, lambda e: F.concat(e["key"], F.lit(". "),
                                                    F.coalesce(e["value"], F.lit("None"))))
    return F.when(m.isNotNull(), F.array_join(lines, NL))


def question_prompt(domain, question_text, context, choices_json, question_type,
                    cfg: PromptConfig = PromptConfig()) -> Column:
    """The five question layouts, first match wins (F1)."""
    dom = F.lower(py_strip(text_or_empty(domain)))
    q = py_strip(text_or_empty(question_text))
    ctx = py_strip(text_or_empty(context))
    qtype = py_strip(text_or_empty(question_type))
    cj = col_(choices_json)
    choices = F.when((qtype == MCQ_TYPE) & cj.isNotNull() & (cj != ""), render_choices(cj))
    has_choices = F.coalesce(choices != "", F.lit(False))
    has_ctx = ctx != ""
    t = instruction(domain, cfg)
    L = F.lit
    passage = F.concat(L(PASSAGE_LABEL + NL), ctx, L(BLANK + QUESTION_LABEL + " "), q, L(BLANK))
    return (F.when((dom == READING_DOMAIN) & has_ctx & has_choices,
                   F.concat(passage, L(CHOICES_LABEL + NL), choices, L(BLANK), t))
            .when((dom == READING_DOMAIN) & has_ctx, F.concat(passage, t))
            .when(has_choices, F.concat(q, L(BLANK + CHOICES_LABEL + NL), choices, L(BLANK), t))
            .when((dom == CODE_DOMAIN) & has_ctx,
                  F.concat(t, L(BLANK + PROBLEM_LABEL + NL), q, L(BLANK + STARTER_LABEL + NL + CODE_FENCE_OPEN + NL),
                           ctx, L(NL + CODE_FENCE_CLOSE)))
            .otherwise(F.concat(q, L(BLANK), t)))


def _or_unknown(c) -> Column:
    return F.coalesce(col_(c).cast("string"), F.lit("unknown"))


def judge_prompt(question, reference, response, bloom_level, bloom_name, domain) -> Column:
    """Judge prompt: question, reference, response, domain and Bloom level;
    asks for the six labelled lines the judge parser reads (F3)."""
    L = F.lit
    return F.concat(
        L("You are grading an answer written by an AI model against a reference answer." + BLANK),
        L("QUESTION:" + NL), text_or_empty(question), L(BLANK),
        L("REFERENCE ANSWER:" + NL), text_or_empty(reference), L(BLANK),
        L("MODEL ANSWER:" + NL), text_or_empty(response), L(BLANK),
        L("CONTEXT:" + NL + "- Domain: "), _or_unknown(domain), L(NL + "- Bloom level: "),
        _or_unknown(bloom_level), L(" ("), _or_unknown(bloom_name), L(")" + BLANK),
        L("Reply with exactly these six lines, each score an integer from 0 to 10:" + NL
          + "CORRECTNESS: <score>" + NL + "COMPLETENESS: <score>" + NL + "CLARITY: <score>" + NL
          + "COGNITIVE_ALIGNMENT: <score>" + NL + "OVERALL_SCORE: <score>" + NL
          + "JUSTIFICATION: <two or three sentences>" + NL))


def level_list() -> str:
    return NL.join(f"  {k} = {v}" for k, v in BLOOM_LEVELS.items())


def label_prompt(question_text, domain) -> Column:
    """Labelling prompt: the level list, the domain and the question; asks
    for the four labelled lines the label parser reads (F4)."""
    L = F.lit
    return F.concat(
        L("Assign one level of Bloom's revised taxonomy to the question below." + BLANK),
        L("LEVELS:" + NL + level_list() + BLANK),
        L("DOMAIN: "), _or_unknown(domain), L(NL + "QUESTION: "), F.coalesce(col_(question_text), L("")),
        L(BLANK + "Answer with exactly these lines and nothing else:" + NL
          + "LEVEL: <1-6>" + NL + "NAME: <level name>" + NL + "CONFIDENCE: <0.0-1.0>" + NL
          + "JUSTIFICATION: <one sentence>" + NL))

"""Parsers for the judge's and the labeller's ``KEY: value`` replies, as
native column expressions (no UDF).

Semantics (Python ``splitlines``; lines without ':' ignored; key = text
before the first ':'; value stripped; the last line per key wins) are
implemented as one anchored regex scan per key: a line whose key equals K
is exactly a line that starts with ``K:``. Known edge: for the labeller's
case-folded keys, characters whose upper-case form is several letters
(e.g. the 'fi' ligature) are not folded.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (BLOOM_LEVELS, JUDGE_JUSTIFICATION_KEY, JUDGE_OVERALL_KEY,
                         JUDGE_SCORE_KEYS, JUDGE_SUBSCORE_COLUMNS)
from .text import col_, py_strip, text_or_empty


# Line-break characters of str.splitlines() (\r\n is two of them in a row).
BREAKS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}"
# Whitespace that can occur inside a line (str.isspace() minus line breaks).
INLINE_WS = r"[\t\x1f \xa0\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"


def line_values(raw, key: str, fold_key: bool = False, value: str = f"([^{BREAKS}]*)") -> Column:
    """Values of the lines whose key (text before the first ':') is ``key``,
    in order. A line's key equals ``key`` exactly iff the line starts with
    ``key:`` (``key`` has no colon); with ``fold_key`` the key may carry
    surrounding whitespace and any letter case (trim + upper-case compare).
    ``value`` is the pattern after the colon; its group 1 is returned.
    One codegen'd regex scan per key, no per-line lambda."""
    k = re.escape(key)
    head = f"{INLINE_WS}*(?iu:{k}){INLINE_WS}*:" if fold_key else f"{k}:"
    return F.regexp_extract_all(col_(raw), F.lit(f"(?:^|[{BREAKS}]){head}{value}"), 1)


def last_value(raw, key: str, fold_key: bool = False, value: str | None = None) -> Column:
    """Value of the last line with ``key`` (stripped), null if none; with
    ``value``, only lines whose value matches it count (group 1 returned)."""
    vals = line_values(raw, key, fold_key, value) if value else line_values(raw, key, fold_key)
    v = F.try_element_at(vals, F.lit(-1))
    return v if value else py_strip(v)


# Every str.splitlines() boundary character; "\r\n" becomes two breaks,
# and the empty line between them has no ':' so it never matches a key.
_BREAK_CHARS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def normalised_lines(raw) -> Column:
    """The text with every line break turned into '\n' and a leading '\n',
    so "a line starting with K:" is exactly an occurrence of '\nK:'.
    ``translate`` is a per-character map (no regex)."""
    return F.concat(F.lit("\n"), F.translate(text_or_empty(raw), _BREAK_CHARS, "\n" * len(_BREAK_CHARS)))


def last_line_value(norm, key: str) -> Column:
    """Stripped value of the last line whose key is exactly ``key`` (null if
    none), on ``normalised_lines`` output: plain string search for the last
    '\nKEY:' and the rest of that line; no regex per key."""
    n = col_(norm)
    marker = f"\n{key}:"
    rest = F.substring_index(n, marker, -1)
    return F.when(F.instr(n, marker) > 0, py_strip(F.substring_index(rest, "\n", 1)))


def last_line_int(norm, key: str, kind: str = "bigint") -> Column:
    """``leading_int`` of the last ``key`` line's value, in one regex call:
    leading whitespace is skipped by the pattern instead of a strip."""
    n = col_(norm)
    marker = f"\n{key}:"
    line = F.substring_index(F.substring_index(n, marker, -1), "\n", 1)
    digits = F.regexp_extract(line, f"^{INLINE_WS}*([0-9]+)", 1)
    return F.when(F.instr(n, marker) > 0, digits.try_cast(kind))


def leading_int(v) -> Column:
    """Leading digits of a value (``8/10`` -> 8, ``8.5`` -> 8, ``-3``, ``[8]``
    or empty -> null); no range check (F6). Up to
    18 digits; the overall score, a double, may have any number of them."""
    return F.regexp_extract(col_(v), r"^([0-9]+)", 1).try_cast("bigint")


def mean_of_present(cols: list[Column], digits: int = 2) -> Column:
    """Row-wise mean of the non-null values, rounded; null if all are null."""
    n = sum(c.isNotNull().cast("int") for c in cols)
    s = sum(F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols)
    return F.when(n > 0, F.round(s / n, digits))


def parse_judge(raw) -> Column:
    """struct<correctness, completeness, clarity, cognitive_alignment: bigint,
    overall_score: double, justification: string> (F5 + A6)."""
    t = normalised_lines(raw)
    subs = [last_line_int(t, k) for k in JUDGE_SCORE_KEYS]
    overall = last_line_int(t, JUDGE_OVERALL_KEY, "double")
    fields = [s.alias(name) for s, name in zip(subs, JUDGE_SUBSCORE_COLUMNS)]
    return F.struct(*fields,
                    F.coalesce(overall, mean_of_present(subs)).alias("overall_score"),
                    F.coalesce(last_line_value(t, JUDGE_JUSTIFICATION_KEY), F.lit("")).alias("justification"))


def bloom_map() -> Column:
    return F.create_map(*[x for k, v in BLOOM_LEVELS.items() for x in (F.lit(k), F.lit(v))])


def bloom_name(level) -> Column:
    """Canonical level name, null for unknown levels."""
    return F.try_element_at(bloom_map(), col_(level).cast("int"))


def parse_label(raw) -> Column:
    """struct<bloom_level: int, bloom_name, bloom_confidence: double,
    bloom_justification> (F7 + J8). LEVEL: one leading digit, only 1..6,
    an invalid later line keeps the earlier value; the model's NAME is
    ignored; CONFIDENCE: leading ``digits[.digits]``, 3 dp, no clamp."""
    t = text_or_empty(raw)
    levels = "".join(str(k) for k in BLOOM_LEVELS)
    # a LEVEL line counts only if its value starts with a valid level digit
    level = last_value(t, "LEVEL", True, f"{INLINE_WS}*([{levels}])").try_cast("int")
    conf = F.round(last_value(t, "CONFIDENCE", True, f"{INLINE_WS}*([0-9]+\\.?[0-9]*)").try_cast("double"), 3)
    return F.struct(level.alias("bloom_level"), bloom_name(level).alias("bloom_name"),
                    conf.alias("bloom_confidence"),
                    F.coalesce(last_value(t, "JUSTIFICATION", True), F.lit("")).alias("bloom_justification"))

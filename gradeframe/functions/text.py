"""String rules of the original pipeline as native Spark column expressions.

Python's ``str.strip()``/``str.split()``/``str.splitlines()`` treat more
characters as whitespace or line breaks than Spark's ``trim``/``\\s``; the
classes below spell them out so the same pattern works in Java regex (Spark)
and RE2 (the DuckDB oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import KEYWORD_LIMIT, KEYWORD_MIN_CHARS

# Characters Python's str.isspace() accepts.
WS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# The same set as a string of characters (derived from Python itself; all
# of them lie below U+3001), for the character-set functions btrim/rtrim/
# translate, which need no regex.
WS_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
# Line boundaries of Python's str.splitlines().
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
STRIP_PATTERN = f"^{WS}+|{WS}+$"
# A whitespace-delimited token kept as a keyword: only letters/digits
# (str.isalnum()) and at least KEYWORD_MIN_CHARS of them.
KEYWORD_TOKEN = r"^[\p{L}\p{N}]{" + str(KEYWORD_MIN_CHARS) + r",}$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c) -> Column:
    """Null text is treated as the empty string (divergence D2)."""
    return F.coalesce(col_(c).cast("string"), F.lit(""))


def py_strip(c) -> Column:
    """``str.strip()``: character-set trim, no regex."""
    return F.btrim(col_(c), F.lit(WS_CHARS))


def py_rstrip(c) -> Column:
    return F.rtrim(col_(c), F.lit(WS_CHARS))


def split_nonempty(c, sep: str) -> Column:
    """Split on ``sep`` and drop empty pieces (leading/trailing separators,
    empty input). References ``c`` once, so an expensive input expression
    is evaluated once."""
    return F.array_remove(F.split(col_(c), sep), "")


def py_split(c) -> Column:
    """``str.split()``: runs of whitespace, no empty tokens. Every
    whitespace character becomes a space (``translate``), then a plain
    single-space split; empty pieces are dropped."""
    spaced = F.translate(col_(c), WS_CHARS, " " * len(WS_CHARS))
    return split_nonempty(spaced, " ")


def py_splitlines(c) -> Column:
    return F.split(col_(c), LINE_BREAK)


def word_count(c) -> Column:
    """Rough token count = whitespace word count (F15); empty text gives 0."""
    return F.size(py_split(text_or_empty(c)))


def truncate(c, n: int) -> Column:
    return F.substring(col_(c), 1, n)


def keywords(c) -> Column:
    """First ``KEYWORD_LIMIT`` distinct lower-cased whitespace tokens that are
    entirely letters/digits and at least ``KEYWORD_MIN_CHARS`` long, in first
    occurrence order (F13)."""
    toks = F.filter(py_split(F.lower(text_or_empty(c))), lambda t: t.rlike(KEYWORD_TOKEN))
    return F.slice(F.array_distinct(toks), 1, KEYWORD_LIMIT)


def keyword_scores(ref_kw, cand_kw) -> tuple[Column, Column, Column]:
    """Keyword precision / recall / F1 over the two keyword sets."""
    r, c = col_(ref_kw), col_(cand_kw)
    common = F.size(F.array_intersect(r, c)).cast("double")
    empty = (F.size(r) == 0) | (F.size(c) == 0)
    p = F.when(empty, 0.0).otherwise(common / F.size(c))
    rc = F.when(empty, 0.0).otherwise(common / F.size(r))
    f1 = F.when((p + rc) > 0, 2 * p * rc / (p + rc)).otherwise(0.0)
    return p, rc, f1

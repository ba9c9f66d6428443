"""Tokenisers and n-grams as native column expressions.

* ``bleu_tokens``: the public "13a" (mteval-v13a) tokenisation used for
  sentence BLEU, case kept.
* ``rouge_tokens``: lower-case, anything outside ``[a-z0-9]`` becomes a
  separator (stemming, when wanted, is applied afterwards).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, py_rstrip, py_split, split_nonempty, text_or_empty

# ---------------------------------------------------------------- fixed values
# 13a tokeniser: unescaped entities, then the four punctuation rules
# (symbols; period/comma not preceded by a digit; period/comma not followed
# by a digit; dash after a digit).
BLEU_ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
BLEU_SYMBOLS = r"([{-~\[-\x60 -&(-+:-@/])"
BLEU_RULES = [
    (BLEU_SYMBOLS, " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
ROUGE_SEPARATOR = r"[^a-z0-9]+"
# --------------------------------------------------------- end of fixed values

def bleu_tokens(c) -> Column:
    s = py_rstrip(text_or_empty(c))
    s = F.replace(s, F.lit("<skipped>"), F.lit(""))
    s = F.replace(s, F.lit("-\n"), F.lit(""))
    s = F.replace(s, F.lit("\n"), F.lit(" "))
    for ent, ch in BLEU_ENTITIES:
        s = F.replace(s, F.lit(ent), F.lit(ch))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    for pat, rep in BLEU_RULES:
        s = F.regexp_replace(s, pat, rep)
    return py_split(s)


def rouge_tokens(c) -> Column:
    return split_nonempty(F.regexp_replace(F.lower(text_or_empty(c)), ROUGE_SEPARATOR, " "), " ")



def shifted(tokens, n: int) -> Column:
    """``arrays_zip`` of the token array and its copies shifted by 1..n-1:
    element i holds tokens i..i+n-1 (null past the end). Built-in, codegen'd
    array functions only; no lambda per element."""
    t = col_(tokens)
    parts = [t] + [F.slice(t, k + 1, F.greatest(F.size(t) - k, F.lit(0))) for k in range(1, n)]
    return F.arrays_zip(*[p.alias(f"t{k}") for k, p in enumerate(parts)])

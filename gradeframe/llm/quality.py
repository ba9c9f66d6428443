"""Quality rules, line first: punctuation, navigation and boilerplate rules
drop lines; a document that fails the base rules or loses more than half of
its word characters is rejected. DataFrame functions only, no shuffle.

Null or empty text has no words and is rejected; repeated rows are judged
alike; other columns pass through ``judged``, but those of its own names are
replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, words

BOILERPLATE = ("all rights reserved", "licensed under", "privacy policy", "terms of use", "cookie policy",
               "released under the", "this work is licensed", "lorem ipsum", "enable javascript")
MAX_LOSS = 0.5
WINDOW = 5


def good_line(line: Column) -> Column:
    """A line with a word that no rule fails: short lines end in punctuation, few navigation marks and
    symbols, no boilerplate phrase."""
    marks = F.length(line) - F.length(F.translate(line, "|#*$%&<>", ""))
    low = F.lower(line)
    boiler = F.lit(False)
    for p in BOILERPLATE:
        boiler = boiler | F.contains(low, F.lit(p))
    short = (F.length(line) < 40) & ~line.rlike("[.!?:;\"'»”。]\\s*$")
    return line.rlike("[^ \\t\\n\\x0B\\f\\r]") & ~short & (marks * 20 <= F.length(line)) & ~boiler


def _bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once for each row (not for each array element)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _repeat_words(words_of_text: Column) -> Column:
    """Words in 5-word windows found twice or more: sorted (hash, place) neighbours with one hash give the
    places; the union of their windows is the count."""
    def hashes(w):
        last = F.greatest(F.size(w) - (WINDOW - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(w, i, WINDOW), " ")))

    def places(s):
        return F.array_sort(F.array_compact(F.transform(s, lambda x, k: F.when(
            ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))))

    def cover(p):
        gaps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda x, y: x + y)

    def count(h):
        srt = F.array_sort(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            _bind(srt, lambda s: _bind(places(s), cover)))
    return _bind(words_of_text, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(
        _bind(hashes(w), count))).cast("long")


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    ``clean_text`` (the lines that pass)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w = words(F.col("text"))
    d = docs.withColumns({"n_words": F.size(w).cast("long"), "word_chars": F.length(F.array_join(w, "")).cast("long"),
                          "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
                          "n_repeat_words": _repeat_words(w)})
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    clean = F.array_join(F.filter(lines, good_line), "\n")
    d = d.withColumns({"n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
                       "clean_text": clean,
                       "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))})
    left = F.length(F.regexp_replace("clean_text", "[ \\t\\n\\x0B\\f\\r]+", ""))
    return d.withColumn("kept", ~F.col("base_failed") & (left >= (1 - MAX_LOSS) * F.col("word_chars")))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                   "n_repeat_words", "base_failed", "kept")

"""Lexical overlap metrics as one Spark job: BLEU, ROUGE-1/2/L, keywords.

Plan (one shuffle in total), where keys may repeat:

1. Map side, per pair: tokenise both texts for BLEU (13a) and ROUGE, stem
   the ROUGE tokens and measure their LCS in one Arrow UDF over token codes
   (the only Python step), extract keywords.
2. ``repartition(n, key)`` of the token arrays: the only Exchange. (A
   Python operator placed after it would hide the partitioning from the
   planner and cost two more shuffles of n-gram records.)
3. Explode (kind, side, n-gram) records with built-in generators and count
   them per (key, kind, n-gram), then per key. Both aggregates are
   satisfied by the key partitioning, so they run in the same stage as the
   explode; exploded n-grams never cross the network. Token lengths fall
   out of the unigram counts, keywords are one more record kind (set
   semantics), and the LCS length rides along as a kind-0 record, so no
   join is needed.
4. Evaluate the closed-form scores on the one-row-per-key result.

Rows with a key of their own (the evaluate job) need no grouping: their texts
are dealt out by key first, and the same counts come from each row's token
arrays in the Arrow UDF.

A pair's cost is linear in its token count (times a logarithm where n-grams
are sorted) plus the bit-parallel LCS; a huge document is one wide row, never
a hot key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grams, porter
from ..functions.text import keywords, text_or_empty
from ..functions.tokens import bleu_tokens, rouge_tokens, shifted

BLEU_ORDERS = (1, 2, 3, 4)
ROUGE_ORDERS = (1, 2)
ROUGE_KIND = 10          # kind = 10 + n for ROUGE-n, n for BLEU order n
REPEATS_PAY = 0.8        # up to this share of distinct pairs, each is scored once and joined back
STEM_MIN_CHARS = 4       # only tokens longer than 3 characters are stemmed
_STEM_CACHE: dict[str, str] = {}
_STEM_CACHE_MAX = 100_000


def _stem_cached(tok: str) -> str:
    s = _STEM_CACHE.get(tok)
    if s is None:
        if len(_STEM_CACHE) >= _STEM_CACHE_MAX:
            _STEM_CACHE.clear()
        s = porter.stem(tok) if len(tok) >= STEM_MIN_CHARS else tok
        _STEM_CACHE[tok] = s
    return s


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    """Porter-stem every token longer than 3 characters (F12); a null list has none."""
    parts = [pa.array([], pa.list_(pa.string()))]
    for (t,) in grams.runs(tokens):
        codes, words = grams.coded(t, t.slice(0, 0), _stem_cached)
        parts.append(grams.as_lists(codes, grams.lengths(t), words))
    return pa.concat_arrays(parts)


@F.pandas_udf(T.StringType())
def stem_token(tokens: pd.Series) -> pd.Series:
    """Porter stem of one token (tokens of 3 characters or fewer unchanged)."""
    return tokens.map(lambda t: None if t is None else _stem_cached(t))


def rouge_prep(stem: bool, lcs: bool):
    """(ROUGE tokens of both sides, stemmed if asked for; the length of their LCS, 0 if not asked for)."""
    @F.arrow_udf("ref array<string>, cand array<string>, lcs int")
    def prep(ref: pa.Array, cand: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.struct([("ref", pa.list_(pa.string())), ("cand", pa.list_(pa.string())), ("lcs", pa.int32())]))]
        for r, c in grams.runs(ref, cand):
            (codes, words), n, m = grams.coded(r, c, _stem_cached if stem else None), grams.lengths(r), grams.lengths(c)
            split = int(n.sum())
            length = grams.lcs_lengths(codes, n, m) if lcs else np.zeros(len(n), np.int32)
            parts.append(pa.StructArray.from_arrays([grams.as_lists(codes[:split], n, words), grams.as_lists(codes[split:], m, words),
                                                     pa.array(length)], ["ref", "cand", "lcs"]))
        return pa.concat_arrays(parts)
    return prep


def pair_counts(stem: bool, lcs: bool, bleu: bool, rouge: bool):
    """The clipped n-gram counts and the LCS length of each row, from the tokens of its two texts; what is not asked for is 0."""
    names = [*(f"m{n}" for n in BLEU_ORDERS), *(f"r{n}" for n in ROUGE_ORDERS), "lcs"]

    @F.arrow_udf(", ".join(f"{c} int" for c in names))
    def count(rouge_ref: pa.Array, rouge_cand: pa.Array, bleu_ref: pa.Array, bleu_cand: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.struct([(c, pa.int32()) for c in names]))]
        for rr, rc, br, bc in grams.runs(rouge_ref, rouge_cand, bleu_ref, bleu_cand):
            table = np.zeros((len(rr), len(names)), np.int32)
            if bleu:
                table[:, :len(BLEU_ORDERS)] = grams.clipped_matches(grams.coded(br, bc)[0], grams.lengths(br), grams.lengths(bc), max(BLEU_ORDERS))
            codes, n, m = grams.coded(rr, rc, _stem_cached if stem else None)[0], grams.lengths(rr), grams.lengths(rc)
            if rouge:
                table[:, len(BLEU_ORDERS):-1] = grams.clipped_matches(codes, n, m, max(ROUGE_ORDERS))
            if lcs:
                table[:, -1] = grams.lcs_lengths(codes, n, m)
            parts.append(pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(len(names))], names))
        return pa.concat_arrays(parts)
    return count


def text_partitions(df: DataFrame, num_partitions: int | None = None) -> int:
    """Partition count for the text Exchange. The work after it is CPU-bound
    per row (regex tokenising, n-gram aggregation, stemming), so the count
    follows ``spark.sql.shuffle.partitions`` (sized by the user for the
    data) rather than adaptive coalescing by shuffle bytes, which packs many
    compressed texts into a handful of tasks."""
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _f1(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def bleu_from_counts(matches: list[Column], hyp_len: Column, ref_len: Column) -> Column:
    """Sentence BLEU in [0, 1] from clipped n-gram matches (orders 1..4):
    effective order, exponential smoothing of zero-match orders, brevity
    penalty; zero when no unigram matches (F8)."""
    eff = F.least(hyp_len, F.lit(len(matches)))
    nonzero = sum((m > 0).cast("int") for m in matches)
    logs = []
    for n, m in enumerate(matches, start=1):
        total = F.greatest(hyp_len - n + 1, F.lit(0))
        smoothed = -F.log(F.pow(F.lit(2.0), F.lit(n) - nonzero) * total)
        lp = F.when(F.lit(n) > eff, F.lit(0.0)) \
            .when(m > 0, F.log(m.cast("double") / total)) \
            .otherwise(smoothed)
        logs.append(lp)
    bp = F.when(hyp_len >= ref_len, F.lit(1.0)).otherwise(F.exp(1 - ref_len / hyp_len))
    return F.when(matches[0] > 0, bp * F.exp(sum(logs) / eff)).otherwise(F.lit(0.0))


# Token streams of a pair (side = stream id % 2: even = reference).
BLEU_REF, BLEU_CAND, ROUGE_REF, ROUGE_CAND, KW_REF, KW_CAND, CARRIER = range(7)
LCS_KIND = 0
KEYWORD_KIND = 20


def _gram_records(df: DataFrame, key: str, streams: list[tuple[int, Column]], orders: dict[int, int],
                  kind_base: dict[int, int]) -> DataFrame:
    """(key, kind, side, gram) for every n-gram occurrence of every stream.

    ``inline`` turns the fixed list of streams into rows, ``explode`` of an
    ``arrays_zip`` of shifted copies gives one row per position holding the
    next tokens, and a fixed-size ``explode`` emits that position's n-grams
    (null past the end, filtered). Only built-in, codegen'd generators and
    array functions; no per-element lambda."""
    top = max(orders.values())
    rows = df.select(key, F.inline(F.array(*[F.struct(F.lit(sid).alias("s"), toks.cast("array<string>").alias("toks"))
                                             for sid, toks in streams])))
    rows = rows.select(key, "s", F.explode(shifted(F.col("toks"), top)).alias("z"))
    s = F.col("s")
    max_n = F.lit(None).cast("int")
    base = F.lit(None).cast("int")
    for sid, n in orders.items():
        max_n = F.when(s == sid, F.lit(n)).otherwise(max_n)
        base = F.when(s == sid, F.lit(kind_base[sid])).otherwise(base)
    grams = []
    for n in range(1, top + 1):
        g = F.concat_ws(" ", *[F.col(f"z.t{k}") for k in range(n)]) if n > 1 else F.col("z.t0")
        complete = F.col(f"z.t{n - 1}").isNotNull() & (F.lit(n) <= max_n)
        grams.append(F.struct(F.lit(n).alias("n"), F.when(complete, g).alias("gram")))
    out = rows.select(key, base.alias("base"), (s % 2).alias("side"), F.explode(F.array(*grams)).alias("g"))
    return (out.filter(F.col("g.gram").isNotNull())
            .select(key, (F.col("base") + F.col("g.n")).alias("kind"), "side", F.col("g.gram").alias("gram")))


def clipped_counts(records: DataFrame, key: str) -> DataFrame:
    """A7 core: per (key, kind, gram) the occurrence counts on each side.
    When ``records`` is partitioned by ``key`` the aggregate needs no
    Exchange (hash partitioning on key satisfies (key, kind, gram))."""
    return (records.groupBy(key, "kind", "gram")
            .agg(F.sum(1 - F.col("side")).alias("rc"), F.sum("side").alias("cc")))


def _by_kind(kind: int, value: Column) -> Column:
    return F.sum(F.when(F.col("kind") == kind, value).otherwise(F.lit(0)))


ALL_METRICS = ("bleu", "rouge1", "rouge2", "rougeL", "keyword_precision", "keyword_recall", "keyword_f1")


def lexical_scores(pairs: DataFrame, key: str = "pair_id", reference: str = "reference",
                   candidate: str = "candidate", stem: bool = True,
                   num_partitions: int | None = None, metrics=ALL_METRICS, unique: bool = False) -> DataFrame:
    """(key, <metrics>) for every key of ``pairs`` (F8-F14). Null text = empty.
    The n-grams of rows that share a key are counted together; ``unique``
    says that none do, so each row is counted where it is (same scores).
    Only the token streams the requested metrics need are built (BLEU alone
    skips ROUGE tokenising and the Python step)."""
    want = set(metrics)
    need_bleu = "bleu" in want
    need_rn = bool(want & {"rouge1", "rouge2"})
    need_lcs = "rougeL" in want
    need_kw = bool(want & {"keyword_precision", "keyword_recall", "keyword_f1"})
    if not (need_bleu or need_rn or need_lcs or need_kw):
        raise ValueError(f"no known metric in {metrics}")
    if not (need_rn or need_lcs):
        return _lexical_jvm(pairs, key, reference, candidate, num_partitions, need_bleu, need_kw, metrics)
    if unique:
        return _lexical_rows(pairs, key, reference, candidate, stem, num_partitions, need_bleu, need_rn, need_lcs, need_kw, metrics)
    prep = rouge_prep(stem, need_lcs)
    # map side: tokenise and run the Python step where the rows are; the
    # Exchange then carries token arrays and the aggregates after it need no
    # further Exchange (a Python operator after it would hide the partitioning)
    cols = [F.col(key).alias(key), prep(rouge_tokens(reference), rouge_tokens(candidate)).alias("rg")]
    if need_bleu:
        cols += [bleu_tokens(reference).alias("br"), bleu_tokens(candidate).alias("bc")]
    if need_kw:
        cols += [keywords(reference).alias("kr"), keywords(candidate).alias("kc")]
    p = pairs.select(*cols).select("*", F.col("rg.ref").alias("rr"), F.col("rg.cand").alias("rc"),
                                   F.col("rg.lcs").alias("lcs")).drop("rg")
    p = p.repartition(text_partitions(pairs, num_partitions), key)
    rouge_top = max(ROUGE_ORDERS) if need_rn else 1
    streams = [(ROUGE_REF, F.col("rr")), (ROUGE_CAND, F.col("rc")), (CARRIER, F.array(F.col("lcs").cast("string")))]
    orders = {ROUGE_REF: rouge_top, ROUGE_CAND: rouge_top, CARRIER: 1}
    if need_bleu:
        streams += [(BLEU_REF, F.col("br")), (BLEU_CAND, F.col("bc"))]
        orders.update({BLEU_REF: max(BLEU_ORDERS), BLEU_CAND: max(BLEU_ORDERS)})
    if need_kw:
        streams += [(KW_REF, F.col("kr")), (KW_CAND, F.col("kc"))]
        orders.update({KW_REF: 1, KW_CAND: 1})
    counts = clipped_counts(_gram_records(p, key, streams, orders, STREAM_BASE), key)

    agg = counts.groupBy(key).agg(*_count_columns())

    return agg.select(key, *_metric_columns(metrics))


STREAM_BASE = {BLEU_REF: 0, BLEU_CAND: 0, ROUGE_REF: ROUGE_KIND, ROUGE_CAND: ROUGE_KIND,
               KW_REF: KEYWORD_KIND - 1, KW_CAND: KEYWORD_KIND - 1, CARRIER: LCS_KIND - 1}


def _count_columns() -> list[Column]:
    clipped = F.least("rc", "cc")
    return [*[_by_kind(n, clipped).alias(f"m{n}") for n in BLEU_ORDERS],
            *[_by_kind(ROUGE_KIND + n, clipped).alias(f"r{n}") for n in ROUGE_ORDERS],
            _by_kind(1, F.col("rc")).alias("ref_len"), _by_kind(1, F.col("cc")).alias("hyp_len"),
            _by_kind(ROUGE_KIND + 1, F.col("rc")).alias("r_ref"),
            _by_kind(ROUGE_KIND + 1, F.col("cc")).alias("r_cand"),
            F.max(F.when(F.col("kind") == LCS_KIND, F.col("gram").cast("int"))).alias("lcs"),
            _by_kind(KEYWORD_KIND, clipped).alias("k_common"),
            _by_kind(KEYWORD_KIND, F.col("rc")).alias("k_ref"),
            _by_kind(KEYWORD_KIND, F.col("cc")).alias("k_cand")]


def _metric_columns(metrics) -> list[Column]:
    """The requested closed-form scores over the per-key counts (each
    expression is built once; building them is driver-side py4j work)."""
    def rouge_n(n: int) -> Column:
        ov = F.col(f"r{n}").cast("double")
        return _f1(ov / F.greatest(F.col("r_cand") - n + 1, F.lit(1)),
                   ov / F.greatest(F.col("r_ref") - n + 1, F.lit(1)))

    def rouge_l() -> Column:
        lp = _ratio(F.col("lcs"), F.col("r_cand"))
        lr = _ratio(F.col("lcs"), F.col("r_ref"))
        return F.when((F.col("r_ref") > 0) & (F.col("r_cand") > 0), _f1(lp, lr)).otherwise(F.lit(0.0))

    def keyword(part: str) -> Column:
        k_empty = (F.col("k_ref") == 0) | (F.col("k_cand") == 0)
        kp = F.when(k_empty, F.lit(0.0)).otherwise(F.col("k_common") / F.col("k_cand"))
        kr = F.when(k_empty, F.lit(0.0)).otherwise(F.col("k_common") / F.col("k_ref"))
        return {"precision": kp, "recall": kr, "f1": _f1(kp, kr)}[part]

    build = {
        "bleu": lambda: bleu_from_counts([F.col(f"m{n}") for n in BLEU_ORDERS], F.col("hyp_len"), F.col("ref_len")),
        "rouge1": lambda: rouge_n(1), "rouge2": lambda: rouge_n(2), "rougeL": rouge_l,
        "keyword_precision": lambda: keyword("precision"), "keyword_recall": lambda: keyword("recall"),
        "keyword_f1": lambda: keyword("f1"),
    }
    return [build[m]().alias(m) for m in metrics]


def _lexical_jvm(pairs: DataFrame, key: str, reference: str, candidate: str, num_partitions,
                 need_bleu: bool, need_kw: bool, metrics) -> DataFrame:
    """BLEU and/or keywords only: no ROUGE tokens, no Python step."""
    cols = [F.col(key).alias(key)]
    streams, orders = [(CARRIER, F.array(F.lit("0")))], {CARRIER: 1}
    if need_bleu:
        cols += [bleu_tokens(reference).alias("br"), bleu_tokens(candidate).alias("bc")]
        streams += [(BLEU_REF, F.col("br")), (BLEU_CAND, F.col("bc"))]
        orders.update({BLEU_REF: max(BLEU_ORDERS), BLEU_CAND: max(BLEU_ORDERS)})
    if need_kw:
        cols += [keywords(reference).alias("kr"), keywords(candidate).alias("kc")]
        streams += [(KW_REF, F.col("kr")), (KW_CAND, F.col("kc"))]
        orders.update({KW_REF: 1, KW_CAND: 1})
    p = pairs.select(*cols).repartition(text_partitions(pairs, num_partitions), key)
    counts = clipped_counts(_gram_records(p, key, streams, orders, STREAM_BASE), key)
    agg = counts.groupBy(key).agg(*_count_columns())
    return agg.select(key, *_metric_columns(metrics))


def _lexical_rows(pairs: DataFrame, key: str, reference: str, candidate: str, stem: bool, num_partitions,
                  need_bleu: bool, need_rn: bool, need_lcs: bool, need_kw: bool, metrics) -> DataFrame:
    """``lexical_scores`` of rows with a key of their own. The texts are dealt out by key, then each row's counts come
    from its own token arrays, so no n-gram record is made, hashed or sorted by Spark."""
    p = pairs.select(F.col(key).alias(key), F.col(reference).alias("_ref"), F.col(candidate).alias("_cand"))
    p = p.repartition(text_partitions(pairs, num_partitions), key)
    none = F.array().cast("array<string>")
    sides = {"rr": rouge_tokens("_ref"), "rc": rouge_tokens("_cand"),
             "br": bleu_tokens("_ref") if need_bleu else none, "bc": bleu_tokens("_cand") if need_bleu else none,
             "kr": keywords("_ref") if need_kw else none, "kc": keywords("_cand") if need_kw else none}
    count = pair_counts(stem, need_lcs, need_bleu, need_rn)
    p = p.select(key, *[c.alias(n) for n, c in sides.items()]).withColumn("n", count("rr", "rc", "br", "bc"))
    sizes = {"ref_len": "br", "hyp_len": "bc", "r_ref": "rr", "r_cand": "rc", "k_ref": "kr", "k_cand": "kc"}
    p = p.select(key, "n.*", *[F.size(c).alias(n) for n, c in sizes.items()],
                 F.size(F.array_intersect("kr", "kc")).alias("k_common"))
    return p.select(key, *_metric_columns(metrics))


def content_key(reference, candidate) -> Column:
    """What a pair of texts is known by: SHA-256 over both, the length of the first before it."""
    a, b = text_or_empty(reference), text_or_empty(candidate)
    return F.sha2(F.concat(F.length(a).cast("string"), F.lit(":"), a, b), 256)


def lexical_by_content(pairs: DataFrame, key: str, content: str = "_pair", reference: str = "reference",
                       candidate: str = "candidate", stem: bool = True, metrics=ALL_METRICS) -> DataFrame:
    """``lexical_scores`` of ``pairs`` with each pair of texts scored once, however many rows hold it. ``content`` is their
    ``content_key``, stored with the rows.

    (key, content) alone is grouped and counted first. Where pairs repeat, the texts of one row for each content are
    scored and the scores joined back by content, without texts. Where hardly any pair repeats, scoring all rows costs
    less than the extra exchange of texts, and they are scored as they are."""
    narrow = pairs.select(key, content)
    one = narrow.groupBy(content).agg(F.min(key).alias(key))
    n, distinct = narrow.agg(F.count(F.lit(1)), F.count_distinct(content)).first()
    if distinct > REPEATS_PAY * n:
        return lexical_scores(pairs, key, reference, candidate, stem, metrics=metrics, unique=True)
    texts = pairs.join(one.select(key), key, "left_semi")
    scores = lexical_scores(texts, key, reference, candidate, stem, metrics=metrics, unique=True)
    return narrow.join(one.join(scores, key).drop(key), content).drop(content)


def ngram_overlap(pairs: DataFrame, key: str = "pair_id", reference: str = "reference",
                  candidate: str = "candidate", orders=BLEU_ORDERS) -> DataFrame:
    """A7 as a table: (key, n, matches, cand_ngrams, ref_ngrams) per order,
    clipped counts over 13a tokens; one row per key and order."""
    p = pairs.select(F.col(key).alias(key), F.col(reference).alias("_ref"),
                     F.col(candidate).alias("_cand")).repartition(text_partitions(pairs), key)
    p = p.select(key, bleu_tokens("_ref").alias("br"), bleu_tokens("_cand").alias("bc"))
    top = max(orders)
    streams = [(BLEU_REF, F.col("br")), (BLEU_CAND, F.col("bc")), (CARRIER, F.array(F.lit("")))]
    counts = clipped_counts(_gram_records(p, key, streams, {BLEU_REF: top, BLEU_CAND: top, CARRIER: 1},
                                          {BLEU_REF: 0, BLEU_CAND: 0, CARRIER: LCS_KIND - 1}), key)
    agg = counts.groupBy(key).agg(
        *[_by_kind(n, F.least("rc", "cc")).alias(f"m{n}") for n in orders],
        _by_kind(1, F.col("rc")).alias("lr"), _by_kind(1, F.col("cc")).alias("lc"))
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("n"), F.col(f"m{n}").cast("bigint").alias("matches"),
                 F.greatest(F.col("lc") - n + 1, F.lit(0)).cast("bigint").alias("cand_ngrams"),
                 F.greatest(F.col("lr") - n + 1, F.lit(0)).cast("bigint").alias("ref_ngrams"))
        for n in orders]))
    return agg.select(key, rows.alias("o")).select(key, "o.n", "o.matches", "o.cand_ngrams", "o.ref_ngrams")



__all__ = ["lexical_scores", "lexical_by_content", "content_key", "ngram_overlap", "clipped_counts", "bleu_from_counts", "stem_tokens", "stem_token"]

"""Lexical metrics against brute-force Python implementations of the
published definitions (13a tokeniser + sentence BLEU with exponential
smoothing and effective order; ROUGE-1/2/L F1 with Porter stemming)."""

import math
import re
from collections import Counter

import pytest

from gradeframe.functions.lcs import lcs_length_dp
from gradeframe.functions.porter import stem
from gradeframe.operators.lexical import lexical_scores, ngram_overlap
from gradeframe.plans.views import view

REF = "The mitochondria is the powerhouse of the cell and produces ATP energy"
CAND = "Mitochondria produces ATP and acts as the powerhouse of the cell"
UNRELATED = "The stock market fell sharply on Tuesday amid rising inflation fears"


def tok13a(line):
    line = line.rstrip()
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in line:
        line = line.replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    line = f" {line} "
    line = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", line)
    line = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", line)
    line = re.sub(r"([\.,])([^0-9])", r" \1 \2", line)
    line = re.sub(r"([0-9])(-)", r"\1 \2 ", line)
    return line.split()


def grams(toks, n):
    return Counter(tuple(toks[i:i + n]) for i in range(len(toks) - n + 1))


def bleu(ref, hyp):
    if not ref or not hyp:
        return 0.0
    r, h = tok13a(ref), tok13a(hyp)
    correct = [sum((grams(h, n) & grams(r, n)).values()) for n in range(1, 5)]
    total = [max(0, len(h) - n + 1) for n in range(1, 5)]
    if not any(correct):
        return 0.0
    bp = 1.0 if len(h) >= len(r) else math.exp(1 - len(r) / len(h))
    precs, smooth, eff = [], 1.0, 4
    for n in range(4):
        if total[n] == 0:
            break
        eff = n + 1
        if correct[n] == 0:
            smooth *= 2
            precs.append(1.0 / (smooth * total[n]))
        else:
            precs.append(correct[n] / total[n])
    return bp * math.exp(sum(math.log(p) for p in precs[:eff]) / eff)


def rtok(text, use_stem):
    toks = re.split(r"\s+", re.sub(r"[^a-z0-9]+", " ", text.lower()))
    if use_stem:
        toks = [stem(t) if len(t) > 3 else t for t in toks]
    return [t for t in toks if re.match(r"^[a-z0-9]+$", t)]


def f1(p, r):
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def rouge(ref, hyp, use_stem=True):
    if not ref or not hyp:
        return 0.0, 0.0, 0.0
    r, h = rtok(ref, use_stem), rtok(hyp, use_stem)
    out = []
    for n in (1, 2):
        rg, hg = grams(r, n), grams(h, n)
        ov = sum((rg & hg).values())
        out.append(f1(ov / max(sum(hg.values()), 1), ov / max(sum(rg.values()), 1)))
    if not r or not h:
        out.append(0.0)
    else:
        lcs = lcs_length_dp(r, h)
        out.append(f1(lcs / len(h), lcs / len(r)))
    return tuple(out)


def test_goldens(spark):
    df = spark.createDataFrame([("a", REF, CAND), ("b", REF, UNRELATED), ("c", REF, REF), ("d", "", CAND)],
                               "pair_id string, reference string, candidate string")
    got = {r["pair_id"]: r for r in lexical_scores(df).collect()}
    a = got["a"]
    assert round(a["bleu"], 6) == 0.380969
    assert round(a["rouge1"], 6) == round(18 / 23, 6)
    assert round(a["rouge2"], 6) == round(10 / 21, 6)
    assert round(a["rougeL"], 6) == 0.521739
    assert (a["keyword_precision"], a["keyword_recall"], a["keyword_f1"]) == (0.875, 0.875, 0.875)
    assert round(got["b"]["bleu"], 6) == 0.034221 and got["b"]["rouge2"] < 0.1
    assert round(got["b"]["keyword_f1"], 6) == 0.111111
    assert all(got["c"][k] == 1.0 for k in ("bleu", "rouge1", "rouge2", "rougeL", "keyword_f1"))
    assert all(got["d"][k] == 0.0 for k in ("bleu", "rouge1", "rouge2", "rougeL", "keyword_f1"))


@pytest.mark.parametrize("use_stem", [True, False])
def test_against_brute_force_on_table_pairs(spark, use_stem):
    pairs = view(spark, "/root/testdata/sf0.001", "pairs_v")
    rows = {r["pair_id"]: r for r in pairs.collect()}
    got = lexical_scores(pairs, stem=use_stem).collect()
    assert len(got) == len(rows)
    for g in got:
        p = rows[g["pair_id"]]
        ref, cand = p["reference"] or "", p["candidate"] or ""
        assert abs(g["bleu"] - bleu(ref, cand)) < 1e-9
        r1, r2, rl = rouge(ref, cand, use_stem)
        assert abs(g["rouge1"] - r1) < 1e-9 and abs(g["rouge2"] - r2) < 1e-9 and abs(g["rougeL"] - rl) < 1e-9


def test_tricky_texts(spark):
    texts = [("t1", "It's 3.5-4 km, i.e. 1,000 m &amp; more... (approx.)", "It is 3.5 - 4 km, i.e. 1,000m & more"),
             ("t2", "line one-\nline two\n\n", "line oneline two"),
             ("t3", "Running runners ran; generalization generously", "runs running generalizations"),
             ("t4", "x", "x y"), ("t5", "   ", "a b c"), ("t6", "a a a a a", "a a")]
    df = spark.createDataFrame(texts, "pair_id string, reference string, candidate string")
    got = {r["pair_id"]: r for r in lexical_scores(df).collect()}
    for k, ref, cand in texts:
        assert abs(got[k]["bleu"] - bleu(ref, cand)) < 1e-9, k
        assert all(abs(a - b) < 1e-9 for a, b in zip((got[k]["rouge1"], got[k]["rouge2"], got[k]["rougeL"]),
                                                      rouge(ref, cand))), k


def test_ngram_overlap_counts(spark):
    df = spark.createDataFrame([("p", REF, CAND)], "pair_id string, reference string, candidate string")
    got = {r["n"]: r for r in ngram_overlap(df).collect()}
    r, h = tok13a(REF), tok13a(CAND)
    for n in range(1, 5):
        assert got[n]["matches"] == sum((grams(h, n) & grams(r, n)).values())
        assert got[n]["cand_ngrams"] == max(0, len(h) - n + 1)
        assert got[n]["ref_ngrams"] == max(0, len(r) - n + 1)


def test_single_exchange(spark, tmp_dir):
    df = spark.createDataFrame([("a", REF, CAND), ("b", REF, UNRELATED)],
                               "pair_id string, reference string, candidate string")
    df.write.parquet(f"{tmp_dir}/pairs")
    pairs = spark.read.parquet(f"{tmp_dir}/pairs")
    plan = lexical_scores(pairs)._jdf.queryExecution().executedPlan().toString()
    # one Exchange in total: hash on the pair key; both aggregates reuse it
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastExchange" not in plan and "SortMergeJoin" not in plan


def test_stem_tokens_query(spark):
    from gradeframe.functions.porter import stem as py_stem
    from gradeframe.plans.registry import QUERIES
    rows = QUERIES["stem_tokens"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["stem"] == (py_stem(r["token"]) if len(r["token"]) > 3 else r["token"]) for r in rows)
    assert len({r["token"] for r in rows}) == len(rows)

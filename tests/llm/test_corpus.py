"""Near-dedup, packing, PII and decontamination on a small fixture with nulls, empty, repeated and odd texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
R = random.Random(3)
VOCAB = [f"w{i}" for i in range(400)]
BASE = [R.choice(VOCAB) for _ in range(300)]


def near(words, edits):
    w = list(words)
    for _ in range(edits):
        w[R.randrange(len(w))] = R.choice(VOCAB)
    return " ".join(w)


ITEM = "A train leaves the old station with 40 passengers and travels 120 km to reach the town where Anna waits for it"
DOCS = [None, "", "  \n", "one two", "ONE two", "same five words in here now", "same five words in here now",
        *[near(BASE, R.randrange(12)) for _ in range(40)], *[near(BASE[:60], 2) for _ in range(5)],
        "intro words " + ITEM.replace("40", "75").replace("120", "330").replace("Anna", "Bela") + " and more text",
        ITEM, "x" * 30000 + " 1.2.3.4", "mail a.b@c.de, 1.2.3.999 +1 (743) 555-3824 card 4111 1111 1111 1111 end é😀 q@r.st"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(DOCS)], "doc_id long, text string, item_id string").repartition(3)


def brute_components(rows):
    """{doc_id: component} over (doc_id, text) rows: all pairs, rows of one id tied."""
    sets, low = [], [i for i, _ in rows]
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    links = []
    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b]) if sets[a] and sets[b] else 0
            if k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k) or rows[a][0] == rows[b][0] and sets[a] and sets[b]:
                links.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return [(rows[i][0], len(sets[i]), low[i], low[i] == rows[i][0]) for i in range(len(rows))]


def test_near_dedup(docs):
    from gradeframe.llm.near_dedup import near_dedup
    want = brute_components([*enumerate(DOCS)])
    assert sorted(tuple(r) for r in near_dedup(docs).collect()) == sorted(want)


def test_near_dedup_repeated_ids(spark):
    """An id with different texts is one document: what is near to any of its texts is linked with it."""
    from gradeframe.llm.near_dedup import near_dedup
    draw = random.Random(8)
    one, two, three = (" ".join(draw.choices(VOCAB, k=60)) for _ in range(3))
    rows = [(11, one), (11, two), (12, one + " more"), (13, two + " more"), (14, three), (14, three), (15, three), (16, ""), (16, None),
            (17, ""), (17, one + " other"), (18, "alone here")]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = [r for r in brute_components(rows) if r[1]]
    assert sorted(tuple(r) for r in got if r.n_shingles) == sorted(want)
    assert sorted(tuple(r) for r in got if not r.n_shingles)[0][:3] == (16, 0, 16) and len(got) == len(rows)
    null = near_dedup(spark.createDataFrame([(None, one), *rows], "doc_id long, text string")).collect()
    assert [tuple(r) for r in null if r.doc_id is None] == [(None, 56, None, True)] and len(null) == len(rows) + 1


def test_near_dedup_common_passage(spark):
    """One passage in 500 otherwise unlike documents, most of each document in some: the links are those of brute force, and
    the pairs that are compared stay few."""
    from gradeframe.llm import near_dedup as N
    draw = random.Random(9)
    passage = " ".join(draw.choices(VOCAB, k=120))
    rows = []
    for i in range(500):
        own = [f"own{i}x{k}" for k in range(draw.choice([20, 60, 90, 300]))]
        rows.append((i, " ".join(own[:5]) + " " + passage + " " + " ".join(own[5:])))
    rows += [(600 + i, near((passage + " tail").split() + [f"t{i}"], 3)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    compared, before = [], N._confirmed

    def seen(pairs, kept):
        compared.append(pairs.count())
        return before(pairs, kept)
    N._confirmed = seen
    try:
        got = sorted(tuple(r) for r in N.near_dedup(docs).collect())
    finally:
        N._confirmed = before
    assert got == sorted(brute_components(rows))
    assert sum(compared) < 20 * len(rows)


def test_packing(docs):
    from tokenizers import Tokenizer

    from gradeframe.llm.packing import pack, plan
    rows = pack(docs, P.path("byte_bpe_50k.json")).collect()
    tok, seqs = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {}
    for i, t in enumerate(DOCS):
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 2048
    hist = {n: R.randrange(1, 50) for n in range(1, 2049, 7)}
    placed = {}
    for count, made in plan(hist):
        assert sum(n * c for n, c in made) <= 2048
        for n, c in made:
            placed[n] = placed.get(n, 0) + count * c
    assert placed == hist


def test_pii(docs):
    from gradeframe.llm.pii import found, redacted
    rows = {r.doc_id: [(s["kind"], s["value"]) for s in r.pii_base] for r in found(docs).collect()}
    assert rows[len(DOCS) - 1] == [(0, "a.b@c.de"), (3, "+1 (743) 555-3824"), (2, "4111 1111 1111 1111"), (0, "q@r.st")]
    assert rows[len(DOCS) - 2] == [(1, "1.2.3.4")] and rows[0] == []
    out = {r.doc_id: r.text for r in redacted(docs).collect()}
    assert out[len(DOCS) - 1] == "mail <email>, 1.2.3.999 <phone> card <card> end é😀 <email>"
    assert out[0] is None and out[5] == DOCS[5]


def test_pii_learns_contexts(spark):
    from gradeframe.llm.pii import found
    rows = [(i, f"please ring me on +1 (743) 555-38{i:02d} today") for i in range(10, 30)] + [(99, "please ring me on 743-555-3800 today")]
    got = {r.doc_id: r for r in found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99].pii_base == [] and [(s["start"], s["end"], s["kind"]) for s in got[99].pii_all] == [(18, 30, 3)]


def test_pii_context_behind_another_token_with_digits(spark):
    from gradeframe.llm.pii import found
    rows = [(i, f"unit b1234567 ring +1 (743) 555-38{i:02d} today") for i in range(10, 30)]
    rows += [(98, "call a.b@c.de x +1 (743) 555-3800 or +1 (743) 555-3801 é"), (99, "unit b1234567 ring 743-555-3800 today")]
    got = {r.doc_id: r for r in found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99].pii_base == [] and [(s["start"], s["end"], s["kind"]) for s in got[99].pii_all] == [(19, 31, 3)]
    assert [s["before"] for s in got[98].pii_base] == [rows[-2][1][:s["start"]] for s in got[98].pii_base]


def test_pii_spaced_and_bracketed_candidates(spark):
    from gradeframe.llm.pii import found
    rows = [(i, f"please ring me on +1 (743) 555-38{i:02d} today") for i in range(10, 30)]
    rows += [(100 + i, f"you may write to john{chr(97 + i)}@mail.example now") for i in range(20)]
    rows += [(200 + i, f"paid with card 4111 1111 1111 {n} ok") for i, n in enumerate((1111, 1129, 1137, 1145, 1152, 1160, 1178, 1186))]
    forms = [("please ring me on {} today", v, 3) for v in ("555 123 4567", "(555) 123-4567", "555-123-4567", "0171234 5678")]
    forms += [("you may write to {} now", v, 0) for v in ("jane(at)example.com", "jane (at) example (dot) com", "jane@localhost")]
    forms += [("paid with card {} ok", "4111 1111 1111 1112", 2), ("please ring me on {} 12 times", "555-123-4567", 3)]
    rows += [(900 + i, t.format(v)) for i, (t, v, _) in enumerate(forms)]
    got = {r.doc_id: r for r in found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (_, v, kind) in enumerate(forms):
        assert got[900 + i].pii_base == [] and [(s["kind"], s["value"]) for s in got[900 + i].pii_all] == [(kind, v)], v


def test_decontaminate(spark, docs):
    from gradeframe.llm.decontaminate import judged
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "")], "item_id long, text string")
    got = {r.doc_id: r.leaked_items for r in judged(docs, bench).collect() if r.contaminated}
    assert got == {len(DOCS) - 4: [7], len(DOCS) - 3: [7]}


def test_decontaminate_two_variants(spark):
    from gradeframe.llm.decontaminate import judged
    one, two = (ITEM.replace("40", a).replace("120", b).replace("Anna", c) for a, b, c in (("75", "330", "Bela"), ("90", "500", "Clara")))
    docs = spark.createDataFrame([(1, one), (2, f"{one}. Then {two}"), (3, "no leak in here at all, only 7 other words")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert {r.doc_id: r.leaked_items for r in judged(docs, bench).collect()} == {1: [7], 2: [7], 3: None}


def test_decontaminate_dense_short_and_folded(spark):
    from gradeframe.llm.decontaminate import judged
    dense, short = "3 + 5 * 2 = 13, 7 + 8 = 15, 9 * 9 = 81", "Which river crosses Prague?"
    names = "We met Anna, Bela, Clara, Dora, Emil, Franz, Georg and Hanna at noon"
    bench = spark.createDataFrame([(1, dense), (2, short), (3, names)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"solve this: {dense} and so on"), (2, f"Some long text before it. {short} The Vltava, as many know."),
                                  (3, f"the list: {names.lower()} today"), (4, f"THE LIST: {names.upper()} TODAY"),
                                  (5, "4 + 6 * 2 = 16, 8 + 8 = 16, and which river crosses Vienna? nobody said")], "doc_id long, text string")
    assert {r.doc_id: r.leaked_items for r in judged(docs, bench).collect()} == {1: [1], 2: [2], 3: [3], 4: [3], 5: None}


def test_decontaminate_item_ids(spark):
    """Texts that share an item_id are items of their own; a null item_id is found; few words leak as a whole text only."""
    from gradeframe.llm.decontaminate import judged, without_leaks
    long = " ".join(f"lw{i}" for i in range(100))
    short = "the quick brown fox jumps over a very lazy dog near our river"
    bench = spark.createDataFrame([(1, short), (1, long), (None, "which mountain is the highest one of all the Alps today"), (3, "yes"), (3, "yes")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, f"intro {short} outro", "a"), (2, "Which mountain is the highest one of all the alps today?", "b"),
                                  (3, "yes", "c"), (4, "yes and no", "d"), (None, short, "e"), (1, "another text of this id", "f")],
                                 "doc_id long, text string, contaminated string")
    got = {(r.doc_id, r.text[:5]): r.leaked_items for r in judged(docs, bench).collect()}
    assert got == {(1, "intro"): [1], (2, "Which"): [None], (3, "yes"): [3], (4, "yes a"): None, (None, "the q"): [1], (1, "anoth"): None}
    kept = without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.contaminated for r in kept.collect()) == ["d", "f"]


def test_decontaminate_windows_by_brute_force(spark):
    """The matched windows are those of a plain scan, by either plan."""
    from gradeframe.llm import decontaminate as D
    draw = random.Random(12)
    vocab = ["a", "the", "km", "Anna", "Bela", "12", "7.5", "river", "house", "crosses", "of", "42", "green", "Prague"]
    bench = [(i, " ".join(draw.choices(vocab, k=draw.randint(1, 30)))) for i in range(30)]
    docs = [(i, " ".join(draw.choices(vocab, k=draw.randint(0, 60))) + " " + draw.choice(bench)[1]) for i in range(60)]
    b, d = spark.createDataFrame(bench, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    items = b.select("item_id", D._words(b["text"]).alias("words")).withColumn("item", D.F.col("item_id"))
    texts = d.select("doc_id", D.F.lit(0).alias("text_key"), "text")
    iw = {r.item: r.words for r in items.collect()}
    dw = {r.doc_id: r.w for r in d.select("doc_id", D._words(d["text"]).alias("w")).collect()}
    form = {True: lambda w: w[1:] if w < "\x04" else w, False: lambda w: w[0] if w < "\x04" else w}
    want = set()
    for i, ws in iw.items():
        n = min(8, len(ws))
        for ip in range(len(ws) - n + 1 if n >= 4 else 0):
            for lit in (False, True):
                if lit or sum(not w < "\x04" for w in ws[ip:ip + n]) >= min(4, n):
                    key = [form[lit](w) for w in ws[ip:ip + n]]
                    want |= {(k, i, lit, p, ip) for k, x in dw.items() for p in range(len(x) - n + 1) if [form[lit](w) for w in x[p:p + n]] == key}
    for limit in (10**6, 0):
        got = D.common_windows(texts, items, cover=0.0, broadcast_rows=limit).select("doc_id", "item", "lit", D.F.explode("at").alias("m"))
        got = got.select("doc_id", "item", "lit", "m.pos", "m.ipos").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_empty_tables(spark):
    from gradeframe.llm import decontaminate, near_dedup, packing, pii
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert near_dedup.near_dedup(none).count() == pii.found(none).count() == decontaminate.judged(none, bench).count() == 0
    assert packing.pack(none, P.path("byte_bpe_50k.json")).count() == 0


def base_spans(t):
    """The base rules as plain Python: (start, kind number, end)."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii_base_against_brute_force(spark, tmp_path):
    from gradeframe.llm.pii import KINDS, op10_pii
    rnd = random.Random(5)
    bits = ["a.b@c.de", "x@y", "@", "1.2.3.4", "1.2.3.999", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1111", "411111111111111",
            "+1 (743) 555-3824", "+49.30.1234567", "+1", " ", "  ", "\n", "é😀", "word", ".", "-", "+", "(", "00000000000000", "9" * 40, "1..2", "a@b.c.d-e"]
    texts = [None, "", "+1 2", *["".join(rnd.choices(bits, k=rnd.randrange(1, 14))) for _ in range(300)], "4" * 5000 + " a@b.cd"]
    texts += texts[3:6]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op10_pii(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == [*range(len(texts))]
    for r in rows:
        want = base_spans(texts[r.doc_id] or "")
        line = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


def learned(spark, texts):
    from gradeframe.llm.pii import found
    rows = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: [(s["kind"], s["value"]) for s in r.pii_all if s not in r.pii_base] for r in rows}


def test_pii_patterns_of_each_level(spark):
    for form in ("{w} fax {w}\nPhone: {v}", "{w} ring {v} {w}", "{w} ring {v} today", "{w} so {w}{i} dial {v} soon {w}"):
        fill = lambda i, v: form.format(w=f"w{chr(97 + i)}x", i=i, v=v)  # noqa: E731, B023
        got = learned(spark, [fill(i, f"+1 (743) 555-38{i:02d}") for i in range(10, 22)] + [fill(3, "743-555-3800"), "w was 743-555-3801 w"])
        weak = form == "{w} ring {v} {w}"           # one word on one side only is not enough
        assert got[12] == ([] if weak else [(3, "743-555-3800")]) and got[13] == [], form


def test_pii_known_candidates_support_new_patterns(spark):
    numbers = [f"743-555-38{i}" for i in range(10, 20)]
    texts = [f"please ring me on +1 (743) 555-38{i:02d} w{i}" for i in range(30, 60)]
    texts += [f"please ring me on {n} x{i}" for i, n in enumerate(numbers)]               # first round
    texts += [f"y{i} his mobile was {n} z{i}" for i, n in enumerate(numbers)]             # the same numbers elsewhere
    got = learned(spark, [*texts, "q his mobile was 209-555-1111 r", "t an order of 209-555-2222 u"])
    n = len(texts)
    assert got[n] == [(3, "209-555-1111")] and got[n + 1] == []
    assert all(got[i] == [(3, numbers[(i - 30) % 10])] for i in range(30, n))


def test_pii_pattern_without_support_stays_unused(spark):
    texts = [f"a lot no +1 (743) 555-38{i:02d} x" for i in range(10, 14)]                 # four seeds, five are asked
    texts += [f"item code {i}43-555-3800 sold" for i in range(1, 9)]
    assert not any(learned(spark, [*texts, "a lot no 743-555-3800 x"]).values())


def test_pii_goes_over_a_text_once(spark, tmp_path, monkeypatch):
    """Each regex of the spans stands once in the plan, and op10 ships no text."""
    from gradeframe.llm import pii
    from pyspark.sql import functions as F
    spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("n"), *[F.col("id") + 1234567 * i for i in range(60)]).alias("text")) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    plans, write = {}, pii.written
    monkeypatch.setattr(pii, "written", lambda df, label: (plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString()), write(df, label))[1])
    limits = ("spark.sql.maxPlanStringLength", "spark.sql.debug.maxToStringFields")
    try:
        for c in limits:
            spark.conf.set(c, "10000000")
        out = pii.op10_pii(spark, str(tmp_path))
        final = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for c in limits:
            spark.conf.unset(c)
    assert plans["pii-spans"].count("regexp_extract_all(") == len(pii.REGEX) + 1 + len(pii.RUN)
    below = final[final.index("Exchange"):].split("\n")
    assert not [x for x in below if "hashpartitioning" in x and "text#" in x]
    assert out.count() == 40


def test_late_pairs_meet_once(spark, monkeypatch):
    """Members outside a main component meet its members once, not in every list that they share: same pairs as by brute force."""
    from gradeframe.llm import near_dedup as N
    from pyspark.sql import functions as F
    lists = {v: [*range(300), *range(1000, 1008)] for v in range(20)} | {97: [1000, 2000], 98: [5, 3000], 99: [5, 6, 7, 1001, 4000, 4001]}
    group = lambda d: 0 if d < 300 else 4000 if d in (4000, 4001) else d
    n = lambda d: 300 if d == 1007 else 100
    listed = spark.createDataFrame([(v, len(m), d, n(d)) for v, m in lists.items() for d in m], "value long, df long, doc long, n long")
    nodes = sorted({d for m in lists.values() for d in m})
    comps = spark.createDataFrame([(d, group(d)) for d in nodes if d < 300 or group(d) == 4000], "node long, component long")
    kept = spark.createDataFrame([(d, n(d), [0 if d != 1006 else -1] * N.PARITY) for d in nodes], "node long, n_shingles long, parity array<long>")
    sizes, write = {}, N.written

    def seen(df, label):
        sizes[label] = (out := write(df, label)).count()
        return out
    monkeypatch.setattr(N, "written", seen)
    pairs = N._late_pairs(listed, comps, kept)
    got = [tuple(r) for r in pairs.collect()]
    far = {1006, 1007}                                                                     # by signature, by size
    want = {(min(x, y), max(x, y)) for m in lists.values() for x in m for y in m if group(x) != group(y) and not {x, y} & far}
    assert len(got) == len(set(got)) and set(got) == want
    assert sizes["once"] == 8
    assert N._near_parity(listed.withColumns({"nx": listed["n"], "px": F.array(*[F.lit(0)] * N.PARITY), "parity": F.array(*[F.lit(0)] * N.PARITY)}).limit(1)) \
        ._jdf.queryExecution().analyzed().toString().count("bit_count(") <= N.PARITY

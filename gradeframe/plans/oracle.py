"""DuckDB oracle SQL for the registered queries, written independently of
inlined as CTEs (``views.duck_sql``). Helpers below spell the Python string
rules in DuckDB SQL (RE2 regex, ``lambda x:`` list functions)."""

from __future__ import annotations

from ..constants import BLOOM_LEVELS, QUOTA_MARKERS
from ..functions import prompts as P
from ..functions.text import LINE_BREAK, STRIP_PATTERN, WS
from ..functions.tokens import BLEU_ENTITIES, BLEU_RULES, ROUGE_SEPARATOR
from .views import duck_sql

SQL: dict[str, str] = {}


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def nz(x: str) -> str:
    return f"coalesce({x}, '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(STRIP_PATTERN)}, '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(WS + '+')}), lambda t: t <> '')"


def lines(x: str) -> str:
    return f"regexp_split_to_array({x}, {q(LINE_BREAK)})"


def bloom_case(level: str) -> str:
    arms = " ".join(f"when {k} then {q(v)}" for k, v in BLOOM_LEVELS.items())
    return f"(case {level} {arms} end)"


def bleu_tokens(x: str) -> str:
    s = f"regexp_replace({nz(x)}, {q(WS + '+$')}, '')"
    s = f"replace({s}, '<skipped>', '')"
    s = f"replace({s}, concat('-', chr(10)), '')"
    s = f"replace({s}, chr(10), ' ')"
    for ent, ch in BLEU_ENTITIES:
        s = f"replace({s}, {q(ent)}, {q(ch)})"
    s = f"concat(' ', {s}, ' ')"
    for pat, rep in BLEU_RULES:
        s = f"regexp_replace({s}, {q(pat)}, {q(rep.replace('$', chr(92)))}, 'g')"
    return words(s)


def rouge_tokens(x: str) -> str:
    return (f"list_filter(string_split(regexp_replace(lower({nz(x)}), {q(ROUGE_SEPARATOR)}, ' ', 'g'), ' '), "
            f"lambda t: t <> '')")


def kw_tokens(x: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower({nz(x)}), {q(WS + '+')}), "
            f"lambda t: regexp_full_match(t, '[\\p{{L}}\\p{{N}}]+') and length(t) >= 3)")


def first_distinct(lst: str, limit: int = 20) -> str:
    return f"(list_filter({lst}, lambda t, i: list_position({lst}, t) = i))[1:{limit}]"


def f1(p: str, r: str) -> str:
    return f"(case when ({p}) + ({r}) > 0 then 2 * ({p}) * ({r}) / (({p}) + ({r})) else 0.0 end)"


def r6(x: str) -> str:
    return f"cast(round({x}, 6) as double)"


# ---------------------------------------------------------------- metrics

def ngram_ctes(src: str, tok, orders: list[int], prefix: str, tokens: str | None = None) -> str:
    """CTEs <prefix>_tok(pair_id, rt, ct) and <prefix>_m(pair_id, n, matches)
    over ``src`` (pair_id, reference, candidate); ``tokens`` are CTEs that give
    <prefix>_tok in another way."""
    tokens = tokens or f"{prefix}_tok AS (select pair_id, {tok('reference')} rt, {tok('candidate')} ct from ({src}) s)"
    ords = ", ".join(str(n) for n in orders)
    gram = "lambda i: array_to_string({t}[i:i+n-1], ' ')"
    return f"""{tokens},
{prefix}_g AS (
  select pair_id, n, 1 rc, 0 cc, unnest(list_transform(range(1, len(rt) - n + 2), {gram.format(t='rt')})) gram
  from {prefix}_tok cross join (select unnest([{ords}]) n) o
  union all
  select pair_id, n, 0 rc, 1 cc, unnest(list_transform(range(1, len(ct) - n + 2), {gram.format(t='ct')})) gram
  from {prefix}_tok cross join (select unnest([{ords}]) n) o),
{prefix}_c AS (select pair_id, n, gram, sum(rc) rc, sum(cc) cc from {prefix}_g group by pair_id, n, gram),
{prefix}_m AS (select pair_id, n, cast(sum(least(rc, cc)) as bigint) matches from {prefix}_c group by pair_id, n)"""


# ---------------------------------------------------------------- fixed values
# Porter's rules as published (suffix, what replaces it), longest suffix first,
# and the words with a stem of their own; stated here for the SQL alone.
STEP2_SQL = """ational ate, tional tion, enci ence, anci ance, izer ize, bli ble, alli al, entli ent, eli e, ousli ous,
ization ize, ation ate, ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble, fulli ful"""
STEP3_SQL = "icate ic, ative, alize al, iciti ic, ical ic, ful, ness"
STEP4_SQL = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
OWN_STEM_SQL = """sky sky, skies sky, dying die, lying lie, tying tie, news news, innings inning, inning inning, outings outing,
outing outing, cannings canning, canning canning, howe howe, proceed proceed, exceed exceed, succeed succeed"""
# --------------------------------------------------------- end of fixed values


def suffix_pairs(table: str) -> list[tuple[str, str]]:
    return [(x.split() + [""])[:2] for x in table.split(",")]


def stem_ctes(src: str) -> str:
    """CTEs ending in ``stems(token, stem)`` over ``src`` (token). Each step is one CASE over the word ``w`` and ``p``, its
    letters as c (consonant) and v (vowel); the measure of a stem is the number of vc changes in its part of ``p``."""
    letters = """list_reduce(list_concat([''], string_split({w}, '')), lambda a, c: concat(a, case
      when c in ('a', 'e', 'i', 'o', 'u') then 'v'
      when c = 'y' and a <> '' and right(a, 1) = 'c' then 'v' else 'c' end))"""

    def step(name: str, prev: str, case: str, keep: str = "") -> str:
        return f"""{name}_w AS (select token, {case} w{keep} from {prev}),
{name} AS (select *, {letters.format(w='w')} p from {name}_w)"""

    def cut(n: int) -> str:
        return f"left(w, len(w) - {n})"

    def measure(n: int, p: str = "p") -> str:
        return f"len(regexp_extract_all(left({p}, greatest(len({p}) - {n}, 0)), 'v+c+'))"

    def ends(x: str) -> str:
        return f"ends_with(w, {q(x)})"

    def cvc(n: int) -> str:  # of the word without its last n letters
        stem, p = f"left(w, len(w) - {n})", f"left(p, len(p) - {n})"
        return f"((len({stem}) >= 3 and right({p}, 3) = 'cvc' and right({stem}, 1) not in ('w', 'x', 'y')) or {p} = 'vc')"

    def table(rules: str, least: int = 0) -> str:
        return "case " + " ".join(f"when {ends(x)} then case when {measure(len(x))} > {least} then concat({cut(len(x))}, {q(y)}) else w end"
                                  for x, y in suffix_pairs(rules)) + "{more} else w end"
    s1a = f"""case when {ends('ies')} and len(w) = 4 then concat({cut(3)}, 'ie') when {ends('sses')} or {ends('ies')} then {cut(2)}
      when {ends('ss')} then w when {ends('s')} then {cut(1)} else w end"""
    verb = [(x, f"{ends(x)} and contains(left(p, greatest(len(p) - {len(x)}, 0)), 'v')") for x in ("ed", "ing")]
    s1b = f"""case when {ends('ied')} then concat({cut(3)}, case when len(w) = 4 then 'ie' else 'i' end)
      when {ends('eed')} then case when {measure(3)} > 0 then {cut(1)} else w end
      {' '.join(f"when {c} then {cut(len(x))}" for x, c in verb)} else w end"""
    is_cut = f", not {ends('ied')} and not {ends('eed')} and ({' or '.join(f'({c})' for _, c in verb)}) cut"
    tidy = f"""case when not cut then w when {ends('at')} or {ends('bl')} or {ends('iz')} then concat(w, 'e')
      when len(w) >= 2 and w[-1] = w[-2] and right(p, 1) = 'c' then case when right(w, 1) in ('l', 's', 'z') then w else {cut(1)} end
      when {measure(0)} = 1 and {cvc(0)} then concat(w, 'e') else w end"""
    s1c = f"case when {ends('y')} and len(w) > 2 and p[len(w) - 1] = 'c' then concat({cut(1)}, 'i') else w end"
    s2a = f"case when {ends('alli')} and {measure(4)} > 0 then {cut(2)} else w end"
    s2b = table(STEP2_SQL).format(more=f" when {ends('logi')} then case when {measure(3)} > 0 then {cut(1)} else w end")
    s4 = "case " + " ".join(
        f"when {ends(x)} then case when {measure(len(x))} > 1" + (f" and right({cut(len(x))}, 1) in ('s', 't')" if x == "ion" else "")
        + f" then {cut(len(x))} else w end" for x in STEP4_SQL.split()) + " else w end"
    s5a = f"case when {ends('e')} and ({measure(1)} > 1 or ({measure(1)} = 1 and not {cvc(1)})) then {cut(1)} else w end"
    s5b = f"case when {ends('ll')} and {measure(1)} > 1 then {cut(1)} else w end"
    own = " ".join(f"when {q(x)} then {q(y)}" for x, y in suffix_pairs(OWN_STEM_SQL))
    return ",\n".join([
        f"st0_w AS (select distinct token, token w from ({src}) s)", f"st0 AS (select *, {letters.format(w='w')} p from st0_w)",
        step("st1a", "st0", s1a), step("st1b", "st1a", s1b, is_cut), step("st1d", "st1b", tidy), step("st1c", "st1d", s1c),
        step("st2a", "st1c", s2a), step("st2b", "st2a", s2b), step("st3", "st2b", table(STEP3_SQL).format(more="")),
        step("st4", "st3", s4), step("st5a", "st4", s5a), step("st5b", "st5a", s5b),
        f"stems AS (select token, case when len(token) <= 3 then token else case token {own} else w end end stem from st5b)"])


def rouge_token_ctes(src: str, stem: bool) -> str:
    """CTEs ending in ``r_tok(pair_id, rt, ct)``: the ROUGE tokens of both sides, stemmed or as they are."""
    raw = f"r_raw AS (select pair_id, {rouge_tokens('reference')} rt, {rouge_tokens('candidate')} ct from ({src}) s)"
    if not stem:
        return f"{raw},\nr_tok AS (select * from r_raw)"

    def side(c: str) -> str:
        return f"""r_{c} AS (select pair_id, list(stem order by i) x from (select pair_id, unnest({c}) token,
  unnest(range(1, len({c}) + 1)) i from r_raw) t join stems using (token) group by pair_id)"""
    return f"""{raw},
{stem_ctes('select unnest(list_concat(rt, ct)) token from r_raw')},
{side('rt')},
{side('ct')},
r_tok AS (select r.pair_id, coalesce(a.x, []) rt, coalesce(b.x, []) ct from r_raw r left join r_rt a using (pair_id)
  left join r_ct b using (pair_id))"""


# Longest common subsequence of r_tok's sides: the places where tokens agree, by reference place and from the last candidate
# place to the first, replace the smallest end that is not below them; the ends kept are as many as the subsequence is long.
LCS_CTES = """l_hit AS (select pair_id, list([j] order by i, j desc) hits from
  (select pair_id, unnest(rt) t, unnest(range(1, len(rt) + 1)) i from r_tok) a
  join (select pair_id, unnest(ct) t, unnest(range(1, len(ct) + 1)) j from r_tok) b using (pair_id, t) group by pair_id),
l_out AS (select pair_id, len(list_reduce(hits, lambda s, h: list_concat(list_concat(s[1:len(list_filter(s, lambda x: x < h[1]))], h),
  s[len(list_filter(s, lambda x: x < h[1])) + 2:]), cast([] as bigint[]))) lcs from l_hit)"""


def metric_ctes(src: str, stem: bool = True) -> str:
    """CTE ``met(pair_id, bleu, rouge1, rouge2, rougeL, keyword_precision, keyword_recall, keyword_f1)``."""
    def m(prefix, n):
        return f"coalesce((select matches from {prefix}_m x where x.pair_id = t.pair_id and x.n = {n}), 0)"
    b = ngram_ctes(src, bleu_tokens, [1, 2, 3, 4], "b")
    r = ngram_ctes(src, None, [1, 2], "r", rouge_token_ctes(src, stem))
    return f"""{b},
{r},
{LCS_CTES},
b_cnt AS (select t.pair_id, len(t.ct) hyp, len(t.rt) ref,
   {m('b', 1)} m1, {m('b', 2)} m2, {m('b', 3)} m3, {m('b', 4)} m4 from b_tok t),
b_lp AS (select *, least(hyp, 4) eff,
   (case when m1 > 0 then 1 else 0 end) + (case when m2 > 0 then 1 else 0 end)
   + (case when m3 > 0 then 1 else 0 end) + (case when m4 > 0 then 1 else 0 end) nzc from b_cnt),
b_out AS (select pair_id, case when m1 = 0 then 0.0 else
   (case when hyp >= ref then 1.0 else exp(1 - cast(ref as double) / hyp) end) * exp((
   {' + '.join(f"(case when {n} > eff then 0.0 when m{n} > 0 then ln(cast(m{n} as double) / greatest(hyp - {n} + 1, 1)) else -ln(pow(2.0, {n} - nzc) * greatest(hyp - {n} + 1, 1)) end)" for n in (1, 2, 3, 4))}
   ) / eff) end bleu from b_lp),
r_cnt AS (select t.pair_id, len(t.ct) lc, len(t.rt) lr, {m('r', 1)} o1, {m('r', 2)} o2,
   cast(coalesce((select lcs from l_out x where x.pair_id = t.pair_id), 0) as double) lcs from r_tok t),
r_out AS (select pair_id,
   {f1('cast(o1 as double) / greatest(lc, 1)', 'cast(o1 as double) / greatest(lr, 1)')} rouge1,
   {f1('cast(o2 as double) / greatest(lc - 1, 1)', 'cast(o2 as double) / greatest(lr - 1, 1)')} rouge2,
   {f1('lcs / greatest(lc, 1)', 'lcs / greatest(lr, 1)')} rougeL from r_cnt),
k_tok AS (select pair_id, {kw_tokens('reference')} rt, {kw_tokens('candidate')} ct from ({src}) s),
k_set AS (select pair_id, {first_distinct('rt')} rk, {first_distinct('ct')} ck from k_tok),
k_out AS (select pair_id, case when len(rk) = 0 or len(ck) = 0 then 0.0
   else cast(len(list_intersect(rk, ck)) as double) / len(ck) end kp,
   case when len(rk) = 0 or len(ck) = 0 then 0.0
   else cast(len(list_intersect(rk, ck)) as double) / len(rk) end kr from k_set),
met AS (select b.pair_id, b.bleu, r.rouge1, r.rouge2, r.rougeL, k.kp keyword_precision, k.kr keyword_recall,
   {f1('k.kp', 'k.kr')} keyword_f1
   from b_out b join r_out r on b.pair_id = r.pair_id join k_out k on b.pair_id = k.pair_id)"""


PAIRS = "select pair_id, reference, candidate from pairs_v"

SQL["ngram_overlap"] = duck_sql(f"""WITH {ngram_ctes(PAIRS, bleu_tokens, [1, 2, 3, 4], 'b')}
select t.pair_id, o.n, coalesce(m.matches, 0) matches,
  cast(greatest(len(t.ct) - o.n + 1, 0) as bigint) cand_ngrams, cast(greatest(len(t.rt) - o.n + 1, 0) as bigint) ref_ngrams
from b_tok t cross join (select unnest([1, 2, 3, 4]) n) o left join b_m m on m.pair_id = t.pair_id and m.n = o.n""",
                              ["pairs_v"])

SQL["bleu"] = duck_sql(f"WITH {metric_ctes(PAIRS)}\nselect pair_id, {r6('bleu')} bleu from met", ["pairs_v"])
SQL["rouge_unstemmed"] = duck_sql(
    f"WITH {metric_ctes(PAIRS, stem=False)}\nselect pair_id, {r6('rouge1')} rouge1, {r6('rouge2')} rouge2 from met", ["pairs_v"])
for _m in ("rouge1", "rouge2", "rougeL"):
    SQL[_m] = duck_sql(f"WITH {metric_ctes(PAIRS)}\nselect pair_id, {r6(_m)} {_m} from met", ["pairs_v"])
SQL["stem_tokens"] = duck_sql(f"WITH {stem_ctes('select unnest(' + rouge_tokens('reference') + ') token from pairs_v')}\n"
                              "select token, stem from stems", ["pairs_v"])
SQL["keyword_overlap"] = duck_sql(
    f"WITH {metric_ctes(PAIRS)}\nselect pair_id, {r6('keyword_precision')} keyword_precision, "
    f"{r6('keyword_recall')} keyword_recall, {r6('keyword_f1')} keyword_f1 from met", ["pairs_v"])
SQL["extract_keywords"] = duck_sql(f"""WITH k AS (select pair_id, {kw_tokens('reference')} rt, {kw_tokens('candidate')} ct from pairs_v),
s AS (select pair_id, {first_distinct('rt')} rk, {first_distinct('ct')} ck from k)
select pair_id, array_to_string(rk, ' ') ref_keywords, array_to_string(ck, ' ') cand_keywords,
  cast(len(rk) as bigint) n_ref, cast(len(ck) as bigint) n_cand from s""", ["pairs_v"])

# ---------------------------------------------------------------- sources

QCOLS = ("question_id, domain, difficulty, bloom_level, question_text, ground_truth_answer, question_type, "
         "context, choices_json, dataset_name")
# CSV reads an empty field (quoted or not) back as null, as pandas does.
QCOLS_CSV = ("question_id, nullif(domain, '') domain, nullif(difficulty, '') difficulty, bloom_level, "
             "nullif(question_text, '') question_text, nullif(ground_truth_answer, '') ground_truth_answer, "
             "nullif(question_type, '') question_type, nullif(context, '') context, "
             "nullif(choices_json, '') choices_json, nullif(dataset_name, '') dataset_name")
SQL["load_questions"] = duck_sql(f"select {QCOLS_CSV} from questions_v", ["questions_v"])
SQL["skip_datasets"] = duck_sql(f"""WITH f AS (
  select {QCOLS}, file_ord, row_ord from questions_file1 where dataset_name is null or dataset_name not in ('ds1', 'ds2')
  union all
  select question_id, domain, difficulty, bloom_level, question_text, ground_truth_answer, question_type, context,
    choices_json, null dataset_name, file_ord, row_ord from questions_file2)
select {QCOLS_CSV} from f qualify row_number() over (partition by question_id order by file_ord, row_ord) = 1""",
                                ["questions_file1", "questions_file2"])
UNION = """select question_id, question_text, dataset_name, file_ord, row_ord from questions_file1
  union all select question_id, question_text, null, file_ord, row_ord from questions_file2"""
SQL["union_files"] = duck_sql(f"""select question_id, question_text, dataset_name, cast(file_ord as int) file_ord,
  cast(row_ord as bigint) row_ord from ({UNION}) u""", ["questions_file1", "questions_file2"])
SQL["dedupe_questions"] = duck_sql(f"""select question_id, question_text, dataset_name, cast(file_ord as int) file_ord
from ({UNION}) u qualify row_number() over (partition by question_id order by file_ord, row_ord) = 1""",
                                   ["questions_file1", "questions_file2"])
SQL["optional_columns"] = duck_sql("select question_id, '' context, '' choices_json, '' question_type from questions_v",
                                   ["questions_v"])
SQL["null_audit"] = duck_sql("""select count(*) filter (where question_text is null) null_question_text,
  count(*) filter (where ground_truth_answer is null) null_ground_truth_answer,
  count(*) filter (where dataset_name is null) null_dataset_name,
  count(*) filter (where bloom_level is null) null_bloom_level from questions_v""", ["questions_v"])
SQL["coerce_bloom"] = duck_sql("""select question_id, bloom_level, cast(null as varchar) bloom_name,
  cast(null as double) bloom_confidence, cast(null as varchar) bloom_justification from questions_v""", ["questions_v"])
SQL["needs_label"] = duck_sql("select question_id, question_text from questions_v where bloom_level is null",
                              ["questions_v"])
SQL["label_coverage"] = duck_sql("select count(bloom_level) labelled, count(*) total from questions_v", ["questions_v"])
SQL["load_responses"] = duck_sql("""select response_id, question_id, model_name, nullif(response_text, '') response_text,
  error, nullif(error_message, '') error_message from responses_v""", ["responses_v"])
SQL["csv_roundtrip"] = duck_sql("select question_id, nullif(question_text, '') question_text, nullif(context, '') context "
                                "from questions_v", ["questions_v"])

SQL["mixed_types"] = duck_sql("""WITH f AS (
  select question_id, cast(conv_id as varchar) conv_id, bloom_level, cast(null as varchar) rescued_level, 1 ord from questions_file1
  where conv_id % 2 = 1
  union all
  select question_id, concat('no ', conv_id), case when conv_id % 4 = 0 then null else bloom_level end,
    case when conv_id % 4 = 0 then 'n/a' end, 2 from questions_file2)
select question_id, conv_id, bloom_level, rescued_level from f qualify row_number() over (partition by question_id order by ord) = 1""",
                              ["questions_file1", "questions_file2"])
SQL["xlsx_ingest"] = duck_sql("""select question_id, domain, question_text, cast(bloom_level as varchar) bloom_level, context,
  dataset_name from questions_v""", ["questions_v"])

# ---------------------------------------------------------- prompts, parsers


def instruction_sql(domain: str) -> str:
    arms = " ".join(f"when {q(k)} then {q(v)}" for k, v in P.DEFAULT_INSTRUCTIONS.items())
    return f"(case lower({strip(nz(domain))}) {arms} else {q(P.DEFAULT_FALLBACK)} end)"


def choices_sql(cj: str) -> str:
    """Keys in order with their values; of a repeated key the last value (flat objects of text, as the views have them)."""
    pair = '"([^"]*)"\\s*:\\s*"([^"]*)"'
    keys, values = (f"regexp_extract_all({cj}, {q(pair)}, {g})" for g in (1, 2))
    return (f"(case when json_valid({cj}) and json_type({cj}) = 'OBJECT' then array_to_string(list_transform("
            f"list_sort(list_distinct({keys})), lambda k: concat(k, '. ', ({values})[len({keys}) + 1 - "
            f"list_position(list_reverse({keys}), k)])), chr(10)) end)")


NL2 = "concat(chr(10), chr(10))"


def question_prompt_sql(src: str) -> str:
    """``src`` has question_id, domain, question_text, context, choices_json,
    question_type; returns (question_id, prompt) plus the src columns."""
    return f"""select *, case
  when dom = 'reading' and ctx <> '' and coalesce(ch <> '', false) then concat({q(P.PASSAGE_LABEL)}, chr(10), ctx, {NL2},
       {q(P.QUESTION_LABEL + ' ')}, qt_, {NL2}, {q(P.CHOICES_LABEL)}, chr(10), ch, {NL2}, ins)
  when dom = 'reading' and ctx <> '' then concat({q(P.PASSAGE_LABEL)}, chr(10), ctx, {NL2}, {q(P.QUESTION_LABEL + ' ')}, qt_, {NL2}, ins)
  when coalesce(ch <> '', false) then concat(qt_, {NL2}, {q(P.CHOICES_LABEL)}, chr(10), ch, {NL2}, ins)
  when dom = 'computer_science' and ctx <> '' then concat(ins, {NL2}, {q(P.PROBLEM_LABEL)}, chr(10), qt_, {NL2},
       {q(P.STARTER_LABEL)}, chr(10), {q(P.CODE_FENCE_OPEN)}, chr(10), ctx, chr(10), {q(P.CODE_FENCE_CLOSE)})
  else concat(qt_, {NL2}, ins) end prompt
from (select *, case when typ = 'mcq' and choices_json is not null and choices_json <> '' then {choices_sql('choices_json')} end ch
  from (select *, lower({strip(nz('domain'))}) dom, {strip(nz('question_text'))} qt_, {strip(nz('context'))} ctx,
        {strip(nz('question_type'))} typ, {instruction_sql('domain')} ins from ({src}) s0) s1) s2"""


SQL["instruction_lookup"] = duck_sql(f"select question_id, {instruction_sql('domain')} instruction from questions_v",
                                     ["questions_v"])
SQL["render_choices"] = duck_sql(f"select question_id, {choices_sql('choices_json')} choices_text from questions_v",
                                 ["questions_v"])
SQL["build_prompts"] = duck_sql(f"select question_id, prompt from ({question_prompt_sql('select * from questions_v')}) p",
                                ["questions_v"])


def unknown(x: str) -> str:
    return f"coalesce(cast({x} as varchar), 'unknown')"


def judge_prompt_sql(qt: str, ref: str, resp: str, level: str, name: str, dom: str) -> str:
    return f"""concat({q('You are grading an answer written by an AI model against a reference answer.' + chr(10) * 2)},
 {q('QUESTION:' + chr(10))}, {nz(qt)}, {NL2}, {q('REFERENCE ANSWER:' + chr(10))}, {nz(ref)}, {NL2},
 {q('MODEL ANSWER:' + chr(10))}, {nz(resp)}, {NL2}, {q('CONTEXT:' + chr(10) + '- Domain: ')}, {unknown(dom)},
 {q(chr(10) + '- Bloom level: ')}, {unknown(level)}, ' (', {unknown(name)}, {q(')' + chr(10) * 2)},
 {q('Reply with exactly these six lines, each score an integer from 0 to 10:' + chr(10) + 'CORRECTNESS: <score>' + chr(10) + 'COMPLETENESS: <score>' + chr(10) + 'CLARITY: <score>' + chr(10) + 'COGNITIVE_ALIGNMENT: <score>' + chr(10) + 'OVERALL_SCORE: <score>' + chr(10) + 'JUSTIFICATION: <two or three sentences>' + chr(10))})"""


def label_prompt_sql(qt: str, dom: str) -> str:
    return f"""concat({q("Assign one level of Bloom's revised taxonomy to the question below." + chr(10) * 2)},
 {q('LEVELS:' + chr(10) + P.level_list() + chr(10) * 2)}, 'DOMAIN: ', {unknown(dom)}, {q(chr(10) + 'QUESTION: ')},
 {nz(qt)}, {q(chr(10) * 2 + 'Answer with exactly these lines and nothing else:' + chr(10) + 'LEVEL: <1-6>' + chr(10) + 'NAME: <level name>' + chr(10) + 'CONFIDENCE: <0.0-1.0>' + chr(10) + 'JUSTIFICATION: <one sentence>' + chr(10))})"""


JOINED = """select r.response_id, r.question_id, r.model_name, r.response_text, r.error, r.error_message,
  q.conv_id, q.turn, q.domain, q.difficulty, q.bloom_level, q.question_text, q.ground_truth_answer, q.question_type,
  q.context, q.choices_json, q.dataset_name
from responses_v r join questions_v q on r.question_id is not distinct from q.question_id"""
JV = ["responses_v", "questions_v"]

SQL["build_judge_prompts"] = duck_sql(f"""select response_id, {judge_prompt_sql('question_text', 'ground_truth_answer',
  'response_text', 'bloom_level', bloom_case('bloom_level'), 'domain')} prompt from ({JOINED}) j""", JV)
SQL["build_label_prompts"] = duck_sql(f"select question_id, {label_prompt_sql('question_text', 'domain')} prompt "
                                      f"from questions_v", ["questions_v"])


def kv_sql(raw: str, fold: bool) -> str:
    key = f"upper({strip('split_part(l, chr(58), 1)')})" if fold else "split_part(l, chr(58), 1)"
    return (f"list_transform(list_filter({lines(raw)}, lambda l: strpos(l, ':') > 0), "
            f"lambda l: {{'k': {key}, 'v': {strip('substr(l, strpos(l, chr(58)) + 1)')}}})")


def last_v(kvs: str, key: str, pattern: str | None = None) -> str:
    cond = f"x.k = {q(key)}" + (f" and regexp_matches(x.v, {q(pattern)})" if pattern else "")
    return f"struct_extract((list_filter({kvs}, lambda x: {cond}))[-1], 'v')"


def lead_int(v: str) -> str:
    return f"try_cast(regexp_extract({v}, '^([0-9]+)', 1) as bigint)"


JUDGE_KEYS = ["CORRECTNESS", "COMPLETENESS", "CLARITY", "COGNITIVE_ALIGNMENT"]
JUDGE_COLS = ["correctness", "completeness", "clarity", "cognitive_alignment"]


def mean_sql(cols: list[str]) -> str:
    n = " + ".join(f"(case when {c} is null then 0 else 1 end)" for c in cols)
    s = " + ".join(f"coalesce({c}, 0)" for c in cols)
    return f"(case when ({n}) > 0 then round(cast({s} as double) / ({n}), 2) end)"


JUDGE_PARSED = f"""select l_orderkey, l_linenumber, l_partkey,
  {', '.join(f"{lead_int(last_v('kvs', k))} {c}" for k, c in zip(JUDGE_KEYS, JUDGE_COLS))},
  cast({lead_int(last_v('kvs', 'OVERALL_SCORE'))} as double) parsed_overall,
  coalesce({last_v('kvs', 'JUSTIFICATION')}, '') justification
from (select l_orderkey, l_linenumber, l_partkey, {kv_sql(nz('raw'), False)} kvs from judge_raw_v) k"""

SQL["parse_judge"] = duck_sql(f"""select l_orderkey, l_linenumber, l_partkey, {', '.join(JUDGE_COLS)},
  coalesce(parsed_overall, {mean_sql(JUDGE_COLS)}) overall_score, justification from ({JUDGE_PARSED}) p""",
                              ["judge_raw_v"])
SQL["overall_fallback"] = duck_sql(f"select l_orderkey, l_linenumber, l_partkey, {mean_sql(JUDGE_COLS)} mean_score "
                                   f"from ({JUDGE_PARSED}) p", ["judge_raw_v"])
SQL["parse_score"] = duck_sql(f"""select l_orderkey, l_linenumber, l_partkey, cast(pos as bigint) pos, {lead_int('v')} score
from (select l_orderkey, l_linenumber, l_partkey, unnest(range(1, len(vs) + 1)) pos, unnest(vs) v
  from (select l_orderkey, l_linenumber, l_partkey,
    list_transform(list_filter({lines('raw')}, lambda l: strpos(l, ':') > 0),
      lambda l: {strip('substr(l, strpos(l, chr(58)) + 1)')}) vs from judge_raw_v) a) b""", ["judge_raw_v"])

LEVEL_DIGITS = "".join(str(k) for k in BLOOM_LEVELS)
LABEL_PARSED = f"""select o_orderkey,
  try_cast(substr({last_v('kvs', 'LEVEL', '^[' + LEVEL_DIGITS + ']')}, 1, 1) as integer) bloom_level,
  round(try_cast(regexp_extract({last_v('kvs', 'CONFIDENCE', '^[0-9]')}, '^([0-9]+\\.?[0-9]*)', 1) as double), 3) bloom_confidence,
  coalesce({last_v('kvs', 'JUSTIFICATION')}, '') bloom_justification
from (select o_orderkey, {kv_sql(strip(nz('raw')), True)} kvs from label_raw_v) k"""
SQL["parse_label"] = duck_sql(f"""select o_orderkey, bloom_level, {bloom_case('bloom_level')} bloom_name, bloom_confidence,
  bloom_justification from ({LABEL_PARSED}) p""", ["label_raw_v"])
SQL["bloom_lookup"] = duck_sql(f"select question_id, bloom_level, {bloom_case('bloom_level')} bloom_name from questions_v",
                               ["questions_v"])

# ------------------------------------------------------------------- text

SQL["token_counts"] = duck_sql(f"""select response_id, cast(case when coalesce(error, false) then 0
  else len({words(nz('response_text'))}) end as int) token_count from responses_v""", ["responses_v"])
SQL["normalise_responses"] = duck_sql("""select response_id,
  case when coalesce(error, false) then '' else response_text end response_text,
  case when coalesce(error, false) then error_message else '' end error_message,
  cast(round(length(response_text) / 7.0, 3) as double) response_time_sec from responses_v""", ["responses_v"])
SQL["truncate_errors"] = duck_sql("""select question_id, substr(question_text, 1, 200) call_error,
  substr(question_text, 1, 100) judge_error, substr(question_text, 1, 80) label_error from questions_v""",
                                  ["questions_v"])

# ------------------------------------------------------- tasks, breaker, ids


def quota_sql(err: str, msg: str) -> str:
    hits = " or ".join(f"strpos(lower({nz(msg)}), {q(m)}) > 0" for m in QUOTA_MARKERS)
    return f"(coalesce({err}, false) and ({hits}))"


SQL["quota_errors"] = duck_sql(f"select model_key, seq, error_message from call_log_v "
                               f"where {quota_sql('error', 'error_message')}", ["call_log_v"])
SQL["active_models"] = duck_sql("select model_name, api from model_catalog_v where api in ('stub', 'alt')", ["model_catalog_v"])
BREAKER = f"""select model_key, seq, error, error_message from (
  select *, max(case when {quota_sql('error', 'error_message')} then 1 else 0 end)
    over (partition by model_key order by seq rows between unbounded preceding and 1 preceding) prior
  from call_log_v) x where coalesce(prior, 0) = 0"""
SQL["circuit_breaker"] = duck_sql(BREAKER, ["call_log_v"])
SQL["response_ids"] = duck_sql(f"select seq, printf('resp_%06d', row_number() over (order by seq)) response_id "
                               f"from ({BREAKER}) b", ["call_log_v"])
GRID = """select q.question_id, q.conv_id, q.turn, m.model_name, m.model_ord, m.model_id, m.api
from questions_v q cross join models_v m where m.api in ('stub')"""
SQL["task_grid"] = duck_sql(f"select question_id, model_name, cast(model_ord as int) model_ord from ({GRID}) g",
                            ["questions_v", "models_v"])
REMAINING = f"""select question_id, model_name from ({GRID}) g
where not exists (select 1 from done_v d where d.question_id = g.question_id and d.model_name = g.model_name)"""
SQL["resume_tasks"] = duck_sql(REMAINING, ["questions_v", "models_v", "done_v"])
SQL["done_pairs"] = duck_sql("select distinct question_id, model_name from done_v", ["done_v"])
SQL["run_progress"] = duck_sql(f"""select 'tasks_remaining' metric, count(*) value from ({REMAINING}) r
union all select 'rows_total', count(*) from done_v""", ["questions_v", "models_v", "done_v"])

# ------------------------------------------------------------------ scoring

SQL["join_responses"] = duck_sql(f"""select response_id, question_id, model_name, domain, question_type, response_text,
  ground_truth_answer, error from ({JOINED}) j""", JV)
SQL["unmatched_responses"] = duck_sql("""select response_id, question_id from responses_v r
where not exists (select 1 from questions_v q where q.question_id is not distinct from r.question_id)""", JV)
SQL["resume_scores"] = duck_sql(f"""select response_id from ({JOINED}) j
where not exists (select 1 from done_v d where d.response_id is not distinct from j.response_id)""", JV + ["done_v"])
SQL["model_lookup"] = duck_sql("""select r.response_id, m.model_id model_version, m.temperature
from responses_v r left join (select * from models_v where api = 'stub') m on r.model_name = m.model_name""",
                               ["responses_v", "models_v"])
SKIPPED = "concat('Skipped: model error: ', coalesce(error_message, ''))"
SQL["error_rows"] = duck_sql(f"select response_id, {SKIPPED} justification from ({JOINED}) j where coalesce(error, false)",
                             JV)
APPLIES = f"(not coalesce(error, false) and not coalesce({strip('question_type')} = 'mcq', false))"
SQL["mcq_guard"] = duck_sql(f"select response_id, {APPLIES} lexical from ({JOINED}) j", JV)
SQL["score_ids"] = duck_sql(f"select response_id, printf('score_%06d', row_number() over (order by response_id)) "
                            f"score_id from ({JOINED}) j", JV)
SQL["score_ids_compat"] = duck_sql(f"""select response_id, printf('score_%06d', 1 + coalesce(sum(case when coalesce(error, false)
  then 0 else 1 end) over (order by response_id rows between unbounded preceding and 1 preceding), 0)) score_id
from ({JOINED}) j""", JV)

METRICS = ["bleu", "rouge1", "rouge2", "rougeL", "keyword_precision", "keyword_recall", "keyword_f1"]
EMPTY = {"varchar": "dataset_subset bloom_name human_agreement bloom_justification validation_agreement",
         "double": "bloom_confidence response_time_sec overall_score human_score", "integer": "token_count",
         "bigint": "correctness completeness clarity cognitive_alignment", "timestamp": "timestamp"}
SCORE_BASE = f"""select printf('score_%06d', row_number() over (order by j.response_id)) score_id, j.response_id,
  j.question_id, j.model_name, j.dataset_name, j.domain, j.difficulty, j.bloom_level, j.question_type, j.question_text,
  j.ground_truth_answer, j.context, j.choices_json, j.response_text, j.error, j.error_message, m.model_id model_version,
  m.temperature, false human_validated,
  case when coalesce(j.error, false) then {SKIPPED.replace('error_message', 'j.error_message')} else '' end justification,
  {', '.join(f"cast(null as {t}) {c}" for t, cs in EMPTY.items() for c in cs.split())},
  {', '.join(f"{r6('met.' + c)} {c}" for c in METRICS)}
from ({JOINED}) j left join models_v m on j.model_name = m.model_name
left join met on met.pair_id = j.response_id"""
LEX_SRC = f"select response_id pair_id, ground_truth_answer reference, response_text candidate from ({JOINED}) j where {APPLIES}"
EVAL = f"WITH {metric_ctes(LEX_SRC)}\n{SCORE_BASE}"
SCORE_META = ("score_id, response_id, question_id, model_name, dataset_name, domain, difficulty, bloom_level, bloom_name, "
              "question_type, context, choices_json, error, error_message, model_version, temperature, human_validated, "
              "justification")
SQL["score_metadata"] = duck_sql(f"select {SCORE_META} from ({EVAL}) e", JV + ["models_v"])
SQL["evaluate_job"] = duck_sql(f"select * from ({EVAL}) e", JV + ["models_v"])
SQL["evaluate_stemmed"] = duck_sql(f"select {SCORE_META}, {', '.join(METRICS)} from ({EVAL}) e", JV + ["models_v"])
SQL["scores_sink"] = SQL["evaluate_job"]
SQL["stream_evaluate"] = duck_sql(f"select * exclude (score_id) from ({EVAL}) e", JV + ["models_v"])
PLAIN = f"({strip('question_type')} is distinct from 'mcq')"
MINIMAL_SRC = f"select response_id pair_id, ground_truth_answer reference, response_text candidate from ({JOINED}) j where {PLAIN}"
SQL["evaluate_minimal"] = duck_sql(f"""WITH {metric_ctes(MINIMAL_SRC)}
select printf('score_%06d', row_number() over (order by j.response_id)) score_id, j.response_id, cast(null as boolean) error,
  cast(null as varchar) error_message, '' justification, {', '.join(f"{r6('met.' + c)} {c}" for c in METRICS)}
from ({JOINED}) j left join met on met.pair_id = j.response_id""", JV)
ODD = f"""select row_number() over (order by r.question_id, r.model_name) pair_id, r.*, q.question_type, q.ground_truth_answer
from responses_odd_v r join questions_v q on r.question_id is not distinct from q.question_id"""
ODD_SRC = f"select pair_id, ground_truth_answer reference, response_text candidate from ({ODD}) j where {APPLIES}"
SQL["evaluate_repeated_ids"] = duck_sql(f"""WITH {metric_ctes(ODD_SRC)}
select j.response_id, j.question_id, j.model_name, j.error, {', '.join(f"{r6('met.' + c)} {c}" for c in METRICS)}
from ({ODD}) j left join met on met.pair_id = j.pair_id""", ["responses_odd_v", "questions_v"])
SQL["evaluation_audit"] = duck_sql("""select 'responses' metric, count(*) as value from responses_v
union all select 'unmatched', count(*) from responses_v r where not exists (select 1 from questions_v q where q.question_id is not distinct from r.question_id)
union all select 'null_question_text', count(*) from questions_v where question_text is null
union all select 'null_ground_truth_answer', count(*) from questions_v where ground_truth_answer is null""", JV)

JUDGE_N = f"""select j.*, length({judge_prompt_sql('question_text', 'ground_truth_answer', 'response_text', 'bloom_level',
  'cast(null as varchar)', 'domain')}) n from ({JOINED}) j"""
JUDGE_SUBS = """n % 11 c1, cast(floor(n / 3) as bigint) % 11 c2, cast(floor(n / 7) as bigint) % 11 c3,
  cast(floor(n / 11) as bigint) % 11 c4"""
SQL_JUDGED = f"""select response_id,
  case when err then null else cast(c1 as bigint) end correctness, case when err then null else cast(c2 as bigint) end completeness,
  case when err then null else cast(c3 as bigint) end clarity, case when err then null else cast(c4 as bigint) end cognitive_alignment,
  case when err then null else round(cast(c1 + c2 + c3 + c4 as double) / 4, 2) end overall_score,
  case when err then {SKIPPED} else concat('length ', n) end justification
from (select *, coalesce(error, false) err, {JUDGE_SUBS} from ({JUDGE_N}) a) b"""
SQL["judge_scores"] = duck_sql(SQL_JUDGED, JV)

SQL["evaluate_run"] = duck_sql(f"""WITH {metric_ctes(LEX_SRC)}
select x.*, {', '.join(f"{r6('met.' + c)} {c}" for c in METRICS)}
from ({SQL_JUDGED}) x left join met on met.pair_id = x.response_id""", JV)

# ---------------------------------------------------------------- inference

TASKS_ALL = f"""select * from ({question_prompt_sql('''select g.*, q.domain, q.question_text, q.context, q.choices_json,
  q.question_type from (select q.question_id, q.conv_id, q.turn, m.model_name, m.model_ord, m.model_id, m.api
  from questions_v q cross join models_v m) g join questions_v q on g.question_id = q.question_id''')}) t"""
CALLS = f"""select question_id, conv_id, turn, model_name, model_ord, length(prompt) n,
  case when api <> 'stub' then true when model_name = 'prefix' and length(prompt) % 53 = 0 then true
       when model_name = 'copy' and length(prompt) % 31 = 0 then true else false end error,
  case when api <> 'stub' then concat('no backend for api ', chr(39), api, chr(39))
       when model_name = 'prefix' and length(prompt) % 53 = 0 then '429 quota exceeded'
       when model_name = 'copy' and length(prompt) % 31 = 0 then 'timeout' else '' end error_message,
  case when api <> 'stub' or (model_name = 'prefix' and length(prompt) % 53 = 0)
       or (model_name = 'copy' and length(prompt) % 31 = 0) then ''
       else concat(model_id, ' saw ', length(prompt), ' chars') end text
from ({TASKS_ALL}) t"""
TV = ["questions_v", "models_v"]
SQL["infer_stub"] = duck_sql(f"select question_id, model_name, text, error, error_message from ({CALLS}) c", TV)
SQL["routing_errors"] = duck_sql(f"select question_id, model_name, error_message from ({CALLS}) c where error", TV)
SQL["query_job"] = duck_sql(f"""select printf('resp_%06d', row_number() over (order by conv_id, turn, model_ord)) response_id,
  question_id, model_name, case when error then '' else text end response_text,
  cast(case when error then 0 else len({words('text')}) end as int) token_count, error,
  case when error then error_message else '' end error_message
from (select *, max(case when {quota_sql('error', 'error_message')} then 1 else 0 end) over (partition by model_name
  order by conv_id, turn, model_ord rows between unbounded preceding and 1 preceding) prior
  from ({CALLS}) c where model_name in (select model_name from models_v where api = 'stub')) x
where coalesce(prior, 0) = 0""", TV)
RUN = f"""select question_id, model_name, case when error then '' else text end response_text, error,
  case when error then error_message else '' end error_message
from (select *, max(case when {quota_sql('error', 'error_message')} then 1 else 0 end) over (partition by model_name
  order by conv_id, turn rows between unbounded preceding and 1 preceding) prior from ({CALLS.replace('questions_v', '{src}')}) c) x
where coalesce(prior, 0) = 0"""
# copies: file 1 without two datasets, then what only file 2 has of the rest; prefixes: file 1
SQL["catalog_run"] = duck_sql(f"""WITH two AS (
  select * exclude (file_ord, row_ord, dataset_name), dataset_name, 1 o from questions_file1 where dataset_name is null or dataset_name not in ('ds1', 'ds2')
  union all by name select * exclude (file_ord, row_ord), 2 o from questions_file2),
both_files AS (select * from two qualify row_number() over (partition by question_id order by o) = 1)
select 'copies' run, * from ({RUN.replace('{src}', 'both_files')}) a where model_name = 'copy'
union all select 'prefixes', * from ({RUN.replace('{src}', 'questions_file1')}) b where model_name = 'prefix'""",
                              ["questions_file1", "questions_file2", "models_v"])
SQL["responses_sink"] = duck_sql("""select response_id, question_id, model_name, coalesce(response_text, '') response_text,
  error, coalesce(error_message, '') error_message from responses_v""", ["responses_v"])

LABELLED = f"""select question_id, bloom_level old_level, n,
  case when n % 9 between 1 and 6 then cast(n % 9 as int) end new_level
from (select question_id, bloom_level, length({label_prompt_sql('question_text', 'domain')}) n from questions_v) a"""
SQL["label_job"] = duck_sql(f"""select question_id,
  case when old_level is null then new_level else old_level end bloom_level,
  case when old_level is null then {bloom_case('new_level')} end bloom_name,
  case when old_level is null then round(cast(concat('0.', n % 100) as double), 3) end bloom_confidence,
  case when old_level is null then concat('length ', n) end bloom_justification
from ({LABELLED}) l""", ["questions_v"])
SQL["label_versions"] = SQL["label_job"]
SQL["label_merge"] = duck_sql(f"""select question_id, case when old_level is null then new_level else old_level end bloom_level,
  case when old_level is null then concat('length ', n) end bloom_justification from ({LABELLED}) l""", ["questions_v"])

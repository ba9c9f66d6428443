"""DuckDB SQL of the operators whose whole result SQL expresses, written from
their contracts: quality rules, near-duplicates, importance resampling and the
Merkle manifest."""

from __future__ import annotations

from .quality import BOILERPLATE
from .resampling import N_BUCKETS
from .shards import tree

LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = "'[^\\x20\\x09-\\x0D]+'"


def _crc_ctes() -> str:
    """CTE ``crc_table(crc_t)``: the 256 values of the CRC-32 of one byte."""
    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    return f"crc_table AS (select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: {step})) crc_t)"


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of ``text``, beside the one row of crc_table."""
    code = f"hex(encode({text}))"
    digit = "(strpos('0123456789ABCDEF', {c}) - 1)"
    pair = f"16 * {digit.format(c=f'substr({code}, i, 1)')} + {digit.format(c=f'substr({code}, i + 1, 1)')}"
    data = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: {pair})"
    return (f"xor(4294967295, list_reduce(list_concat([4294967295], {data}), "
            f"lambda c, b: xor(c >> 8, crc_t[1 + (xor(c, b) & 255)])))")


SQL: dict[str, str] = {}

_MARKS = "length(l) - length(translate(l, '|#*$%&<>', ''))"
_GOOD = " and ".join([
    "regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]')",
    "not (length(l) < 40 and not regexp_matches(l, '[.!?:;\"''»”。][ \\t\\n\\x0B\\f\\r]*$'))",
    f"({_MARKS}) * 20 <= length(l)", *[f"not contains(lower(l), '{p}')" for p in BOILERPLATE]])
SQL["op6_quality"] = f"""WITH d AS (select doc_id, coalesce(text, '') t, row_number() over () r from documents),
w AS (select *, regexp_extract_all(t, {WORD}) w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {WORD})) lines from d),
win AS (select r, i, array_to_string(w[i:i + 4], ' ') g from (select r, w, unnest(range(1, len(w) - 3)) i from w) x),
twice AS (select r, i from win qualify count(*) over (partition by r, g) > 1),
covered AS (select r, cast(count(distinct p) as bigint) n from (select r, unnest(range(i, i + 5)) p from twice) x group by r),
c AS (select w.*, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars, coalesce(n, 0) n_repeat_words,
  array_to_string(list_filter(lines, lambda l: {_GOOD}), chr(10)) clean from w left join covered using (r)),
b AS (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from c)
select doc_id, n_words, word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) n_dup_lines, n_repeat_words, base_failed,
  not base_failed and length(array_to_string(regexp_extract_all(clean, {WORD}), '')) >= 0.5 * word_chars kept
from b"""

SQL["op9_near_dedup"] = f"""WITH RECURSIVE w AS (select doc_id, regexp_extract_all({LOWER_AZ}, {WORD}) w from documents),
s AS (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) g from w),
n AS (select doc_id, count(*) n from s group by doc_id),
shared AS (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
link AS (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
edge AS (select a, b from link union all select b, a from link),
reach AS (select a, b from edge union select r.a, e.b from reach r join edge e on e.a = r.b),
low AS (select a doc_id, least(a, min(b)) m from reach group by a)
select doc_id, coalesce(n.n, 0) n_shingles, coalesce(low.m, doc_id) component_id, coalesce(low.m, doc_id) = doc_id kept
from w left join n using (doc_id) left join low using (doc_id)"""


def _grams(table: str, key: str) -> str:
    """(key, g) of every run of 1 to 3 words."""
    words = f"select {key} k, regexp_extract_all({LOWER_AZ}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from {table}"
    return " union all ".join(f"select k, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) g "
                              f"from ({words}) x{n} where len(w) >= {n}" for n in (1, 2, 3))


_HEX = "list_reduce(list_concat([cast(0 as bigint)], list_transform(string_split(h, ''), lambda c: cast(strpos('0123456789abcdef', c) - 1 as bigint))), lambda a, b: a * 16 + b)"
SQL["op11_importance_resampling"] = f"""WITH {_crc_ctes()},
d AS (select *, row_number() over () r from documents),
f AS ({_grams('d', 'r')}),
t AS ({_grams('benchmark', 'item_id')}),
bucket AS (select g, {_crc32('g')} % {N_BUCKETS} b from (select distinct g from (select g from f union all select g from t) x) y cross join crc_table),
fs AS (select b, count(*) s from f join bucket using (g) group by b),
ts AS (select b, count(*) t from t join bucket using (g) group by b),
total AS (select cast((select count(*) from f) as double) s, cast((select count(*) from t) as double) t),
gain AS (select bucket.b, floor(1000 * ln((coalesce(ts.t, 0) + 1.0) * (total.s + {N_BUCKETS}) / ((coalesce(fs.s, 0) + 1.0) * (total.t + {N_BUCKETS})))) gain
  from (select distinct b from bucket) bucket left join fs using (b) left join ts using (b) cross join total),
weight AS (select k r, count(*) n, sum(gain) weight from f join bucket using (g) join gain using (b) group by k),
scored AS (select d.doc_id, coalesce(n, 0) n_features, cast(coalesce(weight, 0) as bigint) weight,
  len(regexp_extract_all({LOWER_AZ}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) n_words, substr(sha256(concat('42:', doc_id)), 1, 8) h
  from d left join weight using (r)),
drawn AS (select *, weight + cast(floor(-1000 * ln(-ln(({_HEX} + 0.5) / 4294967296.0))) as bigint) score from scored),
ranked AS (select *, case when n_words >= 20 then row_number() over (partition by n_words >= 20 order by score desc, doc_id) end k,
  count(*) filter (where n_words >= 20) over () n_fit from drawn)
select doc_id, n_features, weight, score, case when k <= 5 * n_fit // 100 then k end rank from ranked"""


def _field(c: str) -> str:
    return f"case when {c} is null then '-' else concat(strlen(cast({c} as varchar)), ':', {c}) end"


def _tree(name: str, leaves: str, part: str) -> str:
    """CTEs of a binary Merkle tree over ``leaves`` (part, pos, d, n): all nodes, and the path of every leaf to its root."""
    return f"""{name} AS (select {part} p, 0 lvl, pos, d, n from {leaves}
  union all select p, lvl + 1, pos // 2, sha256(string_agg(d, '' order by pos)), (n + 1) // 2 from {name} where n > 1 group by p, lvl, pos // 2, n),
{name}_at AS (select p, pos leaf, unnest(range(0, h)) lvl, pos from (select p, pos, (select max(lvl) from {name} x where x.p = y.p) h from {name} y where lvl = 0) z),
{name}_path AS (select a.p, a.leaf, list(coalesce(case when (a.leaf >> a.lvl) & 1 = 1 then concat('<', s.d) else concat('>', s.d) end, '') order by a.lvl) path
  from {name}_at a left join (select *, concat('=', d) found from {name}) s on s.p = a.p and s.lvl = a.lvl and s.pos = xor(a.leaf >> a.lvl, 1) group by a.p, a.leaf)"""


_BAD = f"n_chars is not null and doc_id is not null and {_crc32('cast(doc_id as varchar)')} % 7 = 0"
SQL["op12_merkle"] = f"""WITH RECURSIVE {_crc_ctes()},
leaf AS (select *, row_number() over (partition by g order by doc_id, d) - 1 pos, count(*) over (partition by g) n from (
  select doc_id, case when lang is null then '' else concat('=', lang) end g, sha256(concat({', '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', 'text')))})) d,
    case when {_BAD} then sha256(concat({', '.join(map(_field, ('doc_id', 'source', 'lang', '(n_chars + 1)', 'text')))})) end claimed from documents cross join crc_table) x),
{_tree('node', 'leaf', 'g')},
sub AS (select p, d, row_number() over (order by encode(p)) - 1 pos, count(*) over () n, 0 one from node where n = 1),
{_tree('top', 'sub', 'one')},
done AS (select leaf.*, sub.d subroot, (select d from top where n = 1) root, list_concat(coalesce(a.path, []), coalesce(b.path, [])) path
  from leaf join sub on sub.p = leaf.g left join node_path a on a.p = leaf.g and a.leaf = leaf.pos left join top_path b on b.leaf = sub.pos),
folded AS (select *, list_reduce(list_concat([coalesce(claimed, d)], path), lambda a, s: sha256(
  case when s = '' then a when s[1] = '<' then concat(s[2:], a) else concat(a, s[2:]) end)) f from done)
select doc_id, d leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) proof_sha256, f folded_root, f = root verified from folded"""


def _shard_of(node: dict, path: str = "t") -> str:
    """The shard that the key ``k`` reaches: at each level the least draw of the children."""
    def weight(x):
        return x if isinstance(x, float) else sum(map(weight, x.values()))

    def draw(kid, w):
        digits = ["strpos('0123456789abcdef', {c}) - 1".format(c=f"substr(md5(concat(k, ':{path}/{kid}')), {i}, 1)") for i in range(1, 13)]
        value = " + ".join(f"({d}) * {16 ** (12 - i)}.0" for i, d in enumerate(digits, 1))
        return f"-ln((({value}) + 1.0) / {(1 << 48) + 1}.0) / {w}"
    kids = list(node.items())
    pick = [_shard_of(v, f"{path}/{k}") if isinstance(v, dict) else str(k) for k, v in kids]
    if len(kids) == 1:
        return pick[0]
    draws = ", ".join(draw(k, weight(v)) for k, v in kids)
    return f"list_extract([{', '.join(pick)}], list_position([{draws}], list_min([{draws}])))"


SQL["op5_shards"] = f"""WITH {_crc_ctes()},
d AS (select doc_id, coalesce(text, '') x, coalesce(cast(doc_id as varchar), '') k, crc_t from documents cross join crc_table),
s AS (select doc_id, cast(strlen(x) + 1 as bigint) size, {_crc32('x')} text_crc32, {_crc32('k')} % 256 block,
  {_shard_of(tree(16))} shard, {_shard_of(tree(17, 16))} grown_shard from d)
select doc_id, size, text_crc32, 'key' law, shard, row_number() over (partition by shard order by block, doc_id, size, text_crc32) - 1 slot,
  grown_shard from s"""

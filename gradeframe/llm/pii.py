"""PII by bootstrapped contextual extraction; DataFrame functions only.

The base rules give seed entities (email, ip, card, phone). What no base rule
covers, but has the shape of a kind, is a candidate instance: tokens with a
digit, runs of digit groups with spaces or brackets between them, and mail
addresses with "@" or a bracketed "at" (no digit asked). The places of both
induce lexical patterns of their kind: the last two words before, the last word
before with the first after, the label that begins the line ("Phone:"), and,
weaker, the last word before alone and the first after alone.

The graph of distinct (pattern, instance) edges is scored in rounds: a pattern
by the mean score of its instances (plus one unknown), an instance by the mean
of its patterns, known instances stay at 1. A pattern is good with ``SEEDS``
distinct known instances and a score of ``SURE``. A candidate with a good
pattern, or with two good weak ones, is known from then on and supports
patterns as the seeds do. Rounds go on until one finds no new instance; known
ones never leave, so they end. Every place of a known candidate is a span.

Null or empty text has no spans. Repeated rows get the same spans. The graph is
aggregated before every join, so a frequent pattern is one row for each
distinct instance. Other columns pass through ``found`` and ``redacted``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bind, documents, written

KINDS = ("email", "ip", "card", "phone")
# possessive forms of the base patterns: same matches, no backtracking over long runs; classes that go over whole texts list
# their characters one by one, which java.util.regex keeps as one bit set (a range beside them is a chain of calls a character)
_DIGIT = "0123456789"
_LOCAL = LOWER + UPPER + _DIGIT + "._%+-"
REGEX = {"email": f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
         "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
         "card": "[0-9]++(?:[ -][0-9]++)*+",
         "phone": "\\+[0-9][ ().0-9-]+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPACE = " \\t\\n\\x0B\\f\\r"
TOKEN = f"(?<![^{_SPACE}])(?=[^{_SPACE}{_DIGIT}]*+[{_DIGIT}])[^{_SPACE}]++"
#: what a candidate that no base rule takes must look like
SHAPE = {"email": "^[^@]+(?:@|[(\\[]at[)\\]])[^@]+$", "ip": "^[0-9a-fA-F]{1,4}(?:[:.][0-9a-fA-F]{0,4}){3,7}$",
         "card": "^[0-9](?:[-./_]?[0-9]){11,18}$", "phone": "^[(]?[0-9](?:[-./() ]*[0-9]){6,14}$"}
_AT, _DOT = " ?[(\\[] ?(?i:at) ?[)\\]] ?", " ?[(\\[] ?(?i:dot) ?[)\\]] ?"
#: candidates that are not one token with a digit
RUN = {"email": f"(?<![^{_SPACE}])[^{_SPACE}@(\\[]++(?:@|{_AT})[^{_SPACE}@(\\[]++(?:{_DOT}[^{_SPACE}@(\\[]++)*+(?!@)",
       "card": "(?<![0-9A-Za-z])[0-9](?:[-./_ ]{0,2}[0-9]){11,18}(?![0-9A-Za-z])",
       "phone": "(?:(?<![0-9A-Za-z])[0-9]|(?<![0-9A-Za-z(])[(][0-9])(?:[-./() ]{0,3}[0-9]){6,14}(?![0-9A-Za-z])"}
#: digits of a token that is a whole identifier, so that a run from the same place on takes in something else
WHOLE = {"email": 99, "card": 12, "phone": 9}
SEEDS, SURE = 5, 0.5
SPAN = "array<struct<start:int,kind:int,end:int,value:string,before:string,after:string>>"


def _spans(text: Column, regex: str, kind: int, ok) -> Column:
    """Matches of ``regex`` that pass ``ok``, as SPAN: the pieces between the matches give their places.
    ``before`` is the end of the whole text before the match, whatever was matched there; ``after`` what follows it up to
    the end of the next match."""
    found = F.array(F.struct(F.split(text, regex).alias("p"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m")))
    both = F.element_at(F.transform(found, lambda f: F.transform(f["p"], lambda p, i: F.struct(
        p.alias("p"), F.get(f["m"], i).alias("m"),
        F.left(F.concat(F.coalesce(F.get(f["p"], i + 1), F.lit("")), F.coalesce(F.get(f["m"], i + 1), F.lit(""))), F.lit(40)).alias("after")))), 1)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(SPAN).alias("out"))

    def add(acc, x):
        lo = acc["at"] + F.length(x["p"])
        hi = lo + F.length(x["m"])
        before = F.right(F.concat(acc["tail"], x["p"]), F.lit(80))
        span = F.struct(lo.alias("start"), F.lit(kind).alias("kind"), hi.alias("end"), x["m"].alias("value"), before.alias("before"),
                        x["after"].alias("after"))
        return F.struct(F.coalesce(hi, lo).alias("at"), F.right(F.concat(before, F.coalesce(x["m"], F.lit(""))), F.lit(80)).alias("tail"),
                        F.when(x["m"].isNotNull() & ok(x["m"]), F.array_append(acc["out"], span))
                        .otherwise(acc["out"]).cast(SPAN).alias("out"))
    return F.aggregate(both, start, add, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    n = F.transform(F.split(F.reverse(_digits(m)), ""), lambda d: d.cast("int"))
    n = F.transform(n, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(n, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


CHECK = {"email": lambda m: F.lit(True), "ip": lambda m: m.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$"),
         "card": lambda m: F.length(_digits(m)).between(12, 19) & _luhn(m), "phone": lambda m: F.length(_digits(m)).between(9, 15)}


def _base(text: Column) -> Column:
    cases = [F.when(text.rlike(hint), _spans(text, REGEX[k], i, CHECK[k])).otherwise(F.array().cast(SPAN))
             for i, (k, hint) in enumerate((("email", "@"), ("ip", "[0-9]\\.[0-9]"), ("card", "[0-9]"), ("phone", "\\+")))]
    return F.array_sort(F.concat(*cases))


def _patterns(before: Column, after: Column) -> Column:
    """(pattern, weight) of a place, in lower case; weight 2 is enough alone, weight 1 not."""
    low = F.lower(before)
    two = F.regexp_extract(low, f"([^{_SPACE}]+)[{_SPACE}]+([^{_SPACE}]+)[{_SPACE}]*$", 0)
    two = F.array_join(F.array_remove(F.split(two, f"[{_SPACE}]+"), ""), " ")
    left = F.regexp_extract(low, f"([^{_SPACE}]+)[{_SPACE}]*$", 1)
    right = F.regexp_extract(F.lower(after), f"^[{_SPACE}]*([^{_SPACE}]+)", 1)
    label = F.regexp_extract(low, "(?:^|\n)[ \t]*([^\n:=]{1,40})[:=][ \t]*$", 1)

    def one(name, c, weight):
        return F.when(F.length(c) > 0, F.struct(F.concat(F.lit(name + " "), c).alias("pattern"), F.lit(weight).alias("weight")))
    both = F.when((F.length(left) > 0) & (F.length(right) > 0), F.concat_ws(" ", left, right))
    return F.array_compact(F.array(one("before:", two, 2), one("around:", both, 2), one("label:", label, 2),
                                   one("last:", left, 1), one("next:", right, 1)))


def _candidates(text: Column, base: Column) -> Column:
    """Spans outside the base spans that have a kind's shape: tokens with a digit, and ``RUN``; a run hides the token it starts with."""
    def free(spans):
        trim = F.transform(spans, lambda s: s.withField("value", F.regexp_replace(s["value"], "[.,;:!?)\"']+$", "")))
        trim = F.transform(trim, lambda s: s.withField("end", (s["start"] + F.length(s["value"])).cast("int")))
        return F.filter(trim, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def of_kind(tokens, i, k):
        mine = F.transform(F.filter(tokens, lambda s: s["value"].rlike(SHAPE[k])), lambda s: s.withField("kind", F.lit(i)))
        if k not in RUN:
            return mine
        runs = F.when(text.rlike(RUN[k]), free(_spans(text, RUN[k], i, lambda m: F.lit(True)))).otherwise(F.array().cast(SPAN))

        def merged(b):
            own = F.filter(b["runs"], lambda s: ~F.exists(b["mine"], lambda t: (t["start"] == s["start"]) & (
                F.length(_digits(t["value"])) >= WHOLE[k])))
            return bind(own, lambda r: F.concat(r, F.filter(b["mine"], lambda t: ~F.exists(r, lambda s: s["start"] == t["start"]))))
        return bind(F.struct(mine.alias("mine"), runs.alias("runs")), merged)
    return bind(free(_spans(text, TOKEN, 0, lambda m: F.length(m) > 6)), lambda tokens: F.concat(
        *[of_kind(tokens, i, k) for i, k in enumerate(KINDS)]))


def _known(edges: DataFrame) -> DataFrame:
    """The candidates (kind, value) that become known; ``edges`` are distinct (kind, pattern, weight, value, seed)."""
    edges = written(edges, "pii-edges")
    state = edges.groupBy("kind", "value").agg(F.max("seed").alias("seed"))
    state = state.select("kind", "value", "seed", F.col("seed").alias("known"), F.col("seed").cast("double").alias("s"))
    count, before = None, -1
    while count != before:
        before = count
        pat = edges.join(state.select("kind", "value", "known", "s"), ["kind", "value"]).groupBy("kind", "pattern").agg(
            (F.sum("s") / (F.count("*") + 1)).alias("conf"), F.count_if("known").alias("support"))
        good = (F.col("support") >= SEEDS) & (F.col("conf") >= SURE)
        scored = edges.where("not seed").join(pat.select("kind", "pattern", "conf", good.alias("good")), ["kind", "pattern"]).groupBy(
            "kind", "value").agg(F.avg("conf").alias("mean"), F.sum(F.when(F.col("good"), F.col("weight")).otherwise(0)).alias("weight"))
        known = F.col("known") | F.coalesce(F.col("weight") >= 2, F.lit(False))
        state = written(state.join(scored, ["kind", "value"], "left").select(
            "kind", "value", "seed", known.alias("known"), F.when(known, 1.0).otherwise(F.coalesce("mean", F.lit(0.0))).alias("s")), "pii-state")
        count = state.where("known").count()
    return state.where("known and not seed").select("kind", "value")


def found(docs: DataFrame) -> DataFrame:
    """``docs`` with pii_base and pii_all: arrays of SPAN sorted by start and kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mine = docs.select("doc_id", F.xxhash64("text").alias("_key"), text.alias("_text")).where(
        F.col("_text").rlike("[0-9@]") | (F.col("_text").rlike("[(\\[]") & F.col("_text").rlike(_AT)))
    # each regex goes over a text once: spans are bound before they are used, and the rows without any are dropped behind a
    # generator, since a filter on the spans themselves would be evaluated beside them, with all of their regexes
    spans = bind(F.col("_text"), lambda t: bind(_base(t), lambda b: F.struct(b.alias("pii_base"), _candidates(t, b).alias("cand"))))
    some = F.filter(F.array(spans), lambda s: (F.size(s["pii_base"]) > 0) | (F.size(s["cand"]) > 0))
    mine = mine.select("doc_id", "_key", F.explode_outer(some).alias("s")).where("s is not null").select("doc_id", "_key", "s.pii_base", "s.cand")
    mine = written(mine.dropDuplicates(["doc_id", "_key"]), "pii-spans")

    def listed(col):
        return mine.select("doc_id", "_key", F.explode(col).alias("s")).select("doc_id", "_key", "s", "s.kind", "s.value")

    def edges(spans, seed):
        return spans.select("kind", "value", F.explode(_patterns(F.col("s.before"), F.col("s.after"))).alias("p"), F.lit(seed).alias("seed"))
    cand = listed("cand")
    graph = edges(listed("pii_base"), True).unionByName(edges(cand, False)).groupBy(
        "kind", "value", F.col("p.pattern").alias("pattern"), F.col("p.weight").alias("weight")).agg(F.max("seed").alias("seed"))
    new = cand.join(_known(graph), ["kind", "value"]).groupBy("doc_id", "_key").agg(F.collect_set("s").alias("new"))
    new = new.withColumnsRenamed({"doc_id": "_d", "_key": "_k"})
    spans = mine.join(new, mine["doc_id"].eqNullSafe(new["_d"]) & (mine["_key"] == new["_k"]), "left").select(
        F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), F.col("pii_base").alias("_base"),
        F.array_sort(F.concat("pii_base", F.coalesce("new", F.array().cast(SPAN)))).alias("_all"))
    # the key is a column of its own before the join, so that a caller who needs no text shuffles none
    docs = docs.select("*", F.xxhash64("text").alias("_of"))
    out = docs.join(spans, docs["doc_id"].eqNullSafe(spans["_d"]) & (docs["_of"] == spans["_k"]), "left")
    none = F.array().cast(SPAN)
    return out.select(*[docs[c] for c in docs.columns if c not in ("pii_base", "pii_all", "_of")],
                      F.coalesce("_base", none).alias("pii_base"), F.coalesce("_all", none).alias("pii_all"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; overlapping spans are one."""
    d = found(docs)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def put(acc, s):
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]),
                                                       F.get(names, s["kind"]))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(acc["out"], gap).alias("out"))
    done = F.aggregate("pii_all", start, put, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(
        F.col("text"), a["at"] + 1, F.length(F.col("text")))))
    new = F.when(F.size("pii_all") > 0, done).otherwise(F.col("text"))
    return d.withColumn("text", new).drop("pii_base", "pii_all")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    d = found(documents(spark, sf_dir).select("doc_id", "text"))
    kinds = F.transform("pii_base", lambda s: s["kind"])
    counts = {f"n_{k}": (F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long") for i, k in enumerate(KINDS)}
    return d.withColumns(counts).select("doc_id", *counts, F.sha2(_joined(F.col("pii_base")).cast("binary"), 256).alias("base_sha256"),
                                        _joined(F.col("pii_all")).alias("spans"))

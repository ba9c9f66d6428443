"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Numbers, names (capitalised words inside a sentence) and units become typed
placeholders. Windows of ``WINDOW`` template words of a document that the
benchmark has too are found by hash: each benchmark window is known by its
longest pair of neighbouring words, the pairs of every text are probed against
these, and where one is found the whole window is compared. A document leaks an
item when matched windows cover at least ``COVER`` of the item's and either the
words are the same in as many windows, or the slots agree: one value in the
item stands for one value in the document over the matched windows (a
re-parameterised question). Both are asked of each occurrence by itself: the
matches whose shift (place in the document less place in the item) lies in one
of ``BANDS``, or all matches together. Windows with fewer than ``PLAIN`` plain
words say too little and are not matched as templates. Windows of the words
themselves in lower case, slots or not, are matched beside them; they need no
slot check.

Null or blank texts leak nothing. An item shorter than a window is one window of
all its words; one of fewer than ``FEW`` words says too little inside a text and
is leaked by a document that consists of just these words. Blank items match
nothing. Rows of one item_id with different texts are items of their own, so is
a null item_id; repeated rows are judged alike; empty tables give no leaks.
``docs`` may have other columns, whatever their names: they are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, written

WINDOW, PLAIN, COVER, FEW = 8, 4, 0.3, 4
#: (width, offset) of the bands of shifts; a band of width 1 is a copy without insertions
BANDS = ((1, 0), (8, 0), (8, 4), (32, 0), (32, 16))
BROADCAST_ROWS = 1_000_000        # windows, 60 bytes each; those of a larger benchmark are joined by shuffle
UNITS = ("mm|cm|km|kg|mg|ml|oz|lbs?|ft|mph|kmh|hz|khz|mhz|ghz|kw|usd|eur|gbp|dollars?|euros?|pounds?|cents?|met(?:er|re)s?|"
         "kilomet(?:er|re)s?|miles?|feet|inch(?:es)?|grams?|kilograms?|lit(?:er|re)s?|seconds?|minutes?|hours?|days?|weeks?|"
         "months?|years?|percent|degrees?")
# marks of the typed slots: control characters, taken out of the text first
NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"
_WORD = "\\p{L}\\p{N}"


def _marked(text: Column) -> Column:
    """The text in lower case with a mark before each slot word."""
    t = F.translate(F.coalesce(text, F.lit("")), NUMBER + NAME + UNIT, "   ")
    t = F.regexp_replace(t, "(?<=[0-9])[.,](?=[0-9])", "")
    t = F.regexp_replace(t, "(?<=[\\p{Ll}\\p{N},;] )(?=\\p{Lu})", NAME)
    t = F.lower(F.regexp_replace(t, f"(?<![{_WORD}{NAME}])(?=[0-9])", NUMBER))
    return F.regexp_replace(t, f"(?<=[0-9] )(?=(?:{UNITS})(?![{_WORD}]))", UNIT)


def _split(marked: Column) -> Column:
    return F.array_remove(F.split(marked, f"[^{_WORD}\x01-\x03]+"), "")


def _words(text: Column) -> Column:
    """The words in lower case, slot words behind their mark."""
    return _split(_marked(text))


def _is_slot(w: Column) -> Column:
    return w < F.lit("\x04")


def _literal(w: Column) -> Column:
    return F.when(_is_slot(w), F.substring(w, 2, 1 << 30)).otherwise(w)


def _template(w: Column) -> Column:
    return F.when(_is_slot(w), F.substring(w, 1, 1)).otherwise(w)


def _window_hash(words: Column, lit: Column) -> Column:
    return F.xxhash64(F.transform(words, lambda w: F.when(lit, _literal(w)).otherwise(_template(w))))


def _pair_hashes(a: Column, b: Column) -> Column:
    """The hashes of two neighbouring words: as they are, and as templates where that differs."""
    lit, tmpl = F.xxhash64(_literal(a), _literal(b)), F.xxhash64(_template(a), _template(b))
    return F.when(lit == tmpl, F.array(lit)).otherwise(F.array(lit, tmpl))


def _benchmark_windows(items: DataFrame) -> DataFrame:
    """(item, lit, ipos, n, wh, h, off): every window of the items with the hash and place of its longest pair."""
    n = F.least(F.lit(WINDOW), F.size("words"))
    w = items.where(F.size("words") >= FEW).select("item", "words", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("ipos"))
    w = w.select("item", "n", "ipos", F.slice("words", F.col("ipos") + 1, F.col("n")).alias("ws"), F.explode(F.array(F.lit(False), F.lit(True))).alias("lit"))
    plain = F.size(F.filter("ws", lambda x: ~_is_slot(x)))
    w = w.where(F.col("lit") | (plain >= F.least(F.lit(PLAIN), F.col("n"))))
    w = w.withColumn("wh", _window_hash(F.col("ws"), F.col("lit"))).withColumn(
        "seq", F.transform("ws", lambda x: F.when(F.col("lit"), _literal(x)).otherwise(_template(x))))
    best = F.array_min(F.transform(F.sequence(F.lit(0), F.col("n") - 2), lambda i: F.struct(
        (-F.length(F.get("seq", i)) - F.length(F.get("seq", i + 1))).alias("k"), F.xxhash64(F.get("seq", i), F.get("seq", i + 1)).alias("h"), i.alias("off"))))
    return w.withColumn("best", best).select("item", "lit", "ipos", "n", "wh", "best.h", "best.off")


def _probed(rows: DataFrame, wins: DataFrame, small: bool) -> DataFrame:
    """(doc_id, text_key, item, lit, pos, ipos) of every window that a row (doc_id, text_key, w) has in common with ``wins``;
    where the windows are few enough to be broadcast, of every window whose longest pair it has."""
    if not small:  # windows of all texts, by hash, against those of a large benchmark
        lengths = [r[0] for r in wins.select("n").distinct().orderBy("n").collect()]  # at most WINDOW - FEW + 1
        each = rows.select("doc_id", "text_key", "w", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(lit).alias("lit")) for n in lengths for lit in (False, True)])).alias("s"))
        hashes = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("s.n")), lambda i: _window_hash(F.slice("w", i + 1, F.col("s.n")), F.col("s.lit")))
        each = each.where(F.size("w") >= F.col("s.n")).select("doc_id", "text_key", "s.lit", F.posexplode(hashes).alias("pos", "wh"))
        return each.join(wins, ["wh", "lit"]).select("doc_id", "text_key", "item", "lit", "pos", "ipos")
    pairs = F.posexplode(F.arrays_zip("w", F.slice("w", 2, 1 << 30).alias("v")))
    at = rows.select("doc_id", "text_key", pairs.alias("at", "pair"))
    at = at.select("doc_id", "text_key", "at", F.explode(_pair_hashes(F.col("pair.w"), F.col("pair.v"))).alias("h"))
    at = at.join(F.broadcast(wins), "h").withColumn("pos", F.col("at") - F.col("off")).where("pos >= 0")
    return at.select("doc_id", "text_key", "item", "lit", "pos", "ipos")


def common_windows(texts: DataFrame, items: DataFrame, cover: float = COVER, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_key, item, lit, total, at, w, words) of every text and item with at least ``cover`` of the item's windows
    in common: ``at`` lists the places (pos, ipos), ``w`` and ``words`` are the words of both."""
    wins = written(_benchmark_windows(items), "windows")
    total = wins.groupBy("item", "lit").agg(F.countDistinct("ipos").alias("total"))
    rows = texts.select("doc_id", "text_key", _words(F.col("text")).alias("w"))
    by = _probed(rows, wins, wins.count() <= broadcast_rows).groupBy("doc_id", "text_key", "item", "lit").agg(
        F.collect_set(F.struct("pos", "ipos")).alias("at"), F.countDistinct("ipos").alias("n"))
    by = written(by.join(total, ["item", "lit"]).where(F.col("n") >= cover * F.col("total")).drop("n"), "probed")
    # the words of these texts; their keys are written first, so few of them shuffle no text
    keys = written(by.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct(), "matched")
    same_row = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
    matched = texts.join(keys, same_row, "left_semi").dropDuplicates(["doc_id", "text_key"])
    matched = matched.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), _words(F.col("text")).alias("w"))
    forms = [F.transform("w", f).alias(c) for f, c in ((_literal, "w_lit"), (_template, "w_tmpl"))]
    own = [F.transform("words", f).alias(c) for f, c in ((_literal, "i_lit"), (_template, "i_tmpl"))]
    full = by.join(written(matched.select("*", *forms), "texts"), same_row).join(written(items.select("item", "words", *own), "item-words"), "item")
    n = F.least(F.lit(WINDOW), F.size("words"))

    def equal(form):
        return F.filter("at", lambda m: F.slice(f"w_{form}", m["pos"] + 1, n) == F.slice(f"i_{form}", m["ipos"] + 1, n))
    full = full.withColumn("at", F.when(F.col("lit"), equal("lit")).otherwise(equal("tmpl")))
    full = full.select("doc_id", "text_key", "item", "lit", "total", "at", "w", "words")
    covered = F.size(F.array_distinct(F.transform("at", lambda m: m["ipos"])))
    return written(full, "common").where((covered > 0) & (covered >= cover * F.col("total")))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id) for every leaked item of a document."""
    items = benchmark.select("item_id", _words(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    items = written(items.dropDuplicates(["item_id", "words"]).withColumn("item", F.xxhash64("item_id", "words")), "items")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    by = common_windows(texts, items)
    who = ["doc_id", "text_key", "item"]
    leaked, by = by.where("lit").select(*who), by.where("not lit").select(*who, "total", "at", "w", "words")
    few = items.where(F.size("words") < FEW).select("item", F.xxhash64(F.transform("words", _literal)).alias("h"))
    if not few.isEmpty():
        whole = texts.select("doc_id", "text_key", _words(F.col("text")).alias("w")).where(F.size("w").between(1, FEW - 1))
        whole = whole.select("doc_id", "text_key", F.xxhash64(F.transform("w", _literal)).alias("h"))
        leaked = leaked.unionByName(whole.join(few, "h").select(*who))
    shift = F.col("m.pos") - F.col("m.ipos")
    bands = [F.struct(F.lit(w).cast("long").alias("width"), F.lit(o).cast("long").alias("offset"), F.floor((shift + o) / w).alias("n")) for w, o in ((1 << 40, 1 << 39), *BANDS)]
    many = by.select(*who, "total", F.explode("at").alias("m")).select(*who, "total", "m", F.explode(F.array(*bands)).alias("band"))
    many = many.groupBy(*who, "total", "band").agg(F.collect_list("m").alias("at"), F.countDistinct("m.ipos").alias("cover"))
    many = many.where(F.col("cover") >= COVER * F.col("total")).withColumnsRenamed({"doc_id": "d", "text_key": "k", "item": "i"})
    full = many.join(by.drop("at", "total"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")) & (F.col("item") == F.col("i")))
    n = F.least(F.lit(WINDOW), F.size("words"))
    same = F.size(F.array_distinct(F.transform(F.filter("at", lambda m: F.slice("w", m["pos"] + 1, n) == F.slice("words", m["ipos"] + 1, n)), lambda m: m["ipos"])))
    pairs = F.array_distinct(F.filter(F.flatten(F.transform("at", lambda m: F.arrays_zip(
        F.slice("words", m["ipos"] + 1, n).alias("i"), F.slice("w", m["pos"] + 1, n).alias("w")))), lambda p: _is_slot(p["i"])))
    full = full.withColumns({"same": same, "pairs": pairs})
    agree = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    leaked = leaked.unionByName(full.where((F.col("same") >= COVER * F.col("total")) | agree).select(*who))
    return leaked.join(items.select("item", "item_id"), "item").select("doc_id", "text_key", "item_id").distinct()


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(_leak_doc, _leak_key, leaked_items) of the documents that leak; written, so few of them shuffle no document. Leaked
    items are sorted; a null item_id counts, as null, at the front."""
    listed = F.sort_array(F.collect_list(F.struct("item_id")))["item_id"]
    found = leaks(docs, benchmark).groupBy("doc_id", "text_key").agg(listed.alias("leaked_items"))
    return written(found.withColumnsRenamed({"doc_id": "_leak_doc", "text_key": "_leak_key"}), "leaks")


def _same(docs: DataFrame, found: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(found["_leak_doc"]) & (F.xxhash64(docs["text"]) == found["_leak_key"])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak nothing, with all their columns as they are."""
    found = _found(docs, benchmark)
    return docs.join(found, _same(docs, found), "left_anti")


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with leaked_items (sorted ids) and contaminated (columns of these names are replaced)."""
    found = _found(docs, benchmark)
    out = docs.join(found, _same(docs, found), "left")
    return out.select(*[docs[c] for c in docs.columns if c not in ("leaked_items", "contaminated")], found["leaked_items"],
                      found["leaked_items"].isNotNull().alias("contaminated"))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = judged(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", F.coalesce(F.size("leaked_items"), F.lit(0)).cast("long").alias("n_items"),
                      F.concat_ws(",", F.col("leaked_items").cast("array<string>")).alias("items"), "contaminated")

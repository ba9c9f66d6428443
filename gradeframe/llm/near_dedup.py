"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Every document keeps the ``K`` smallest hashes of its shingle set. Copies
   (equal sets) form one class; its smallest id stands for it.
2. Inverted lists of retained values give candidates. Two sets with Jaccard
   0.75 share all but a bounded number of retained values, so it is enough to
   list each document under its rarest ones (``_places``): a common passage
   makes no list unless the document is mostly made of common text.
   A sketch that is the whole set gives an exact bound; for others the shared
   count is hypergeometric with mean 0.75 K, and ``_least`` lies ``SIGMAS``
   deviations below it.
3. Lists are linked by stars over blocks of at most about ``BLOCK`` members,
   then stars of leaders. A pair is estimated on the union sketch, then
   confirmed by exact Jaccard on full sets. Members outside their list's main
   component are then held against more of its leaders.
4. All pairs of a list that are still in different components are then
   tested (members outside the list's main component against all members), so
   the components equal those of the full link graph. The join itself leaves
   out pairs whose parity signatures differ in too many places: each differing
   place stands for at least one shingle (of sets over ``FULL``: one retained
   value) that only one of the two has, so no pair that could pass is lost,
   and of sets up to ``FULL`` few others are left.

Null or blank texts have an empty set and link with nothing. Rows that repeat
an id are one document: their different sets are nodes of their own, tied to
each other. Other columns are left alone; an empty table gives none."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, small_methods, written
from .components import components
from .shingles import fingerprint, overlap, shingle_set
from .vocab_cache import forget

K = 192
SIGMAS = 7          # deviations below the mean that a pair's shared retained values are let to lie
BLOCK = 256
LEADERS = (16, 64)  # leaders of each list in the rounds after the stars
PARITY = 24         # longs of the parity signature
FULL = 1536         # sets up to this size have the parity of all their shingles, larger ones that of the retained values
SKETCH = "doc_id long, h long, n_shingles long, f1 long, f2 long, sketch array<long>, parity array<long>"


def _parity(values: np.ndarray) -> np.ndarray:
    """For each of the 64 * PARITY places, whether an odd number of the values falls on it."""
    odd = np.bincount(values.view(np.uint64) % np.uint64(64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    def run(batches):
        forget()  # workers are used again: what an encoding operator held in one is not needed here
        for b in batches:
            sets = [shingle_set(t) for t in b.column(2).to_pylist()]
            f = [fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0), "h": b.column(1), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "f1": pa.array([x[0] for x in f], pa.int64()), "f2": pa.array([x[1] for x in f], pa.int64()),
                "sketch": pa.array([s[:K] for s in sets], pa.list_(pa.int64())),
                "parity": pa.array([_parity(s if len(s) <= FULL else s[:K]) for s in sets], pa.list_(pa.int64()))})
    return _keyed(docs).mapInArrow(run, SKETCH)


def _keyed(docs: DataFrame) -> DataFrame:
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))


def _noded(rows: DataFrame, odd: DataFrame | None) -> DataFrame:
    """``rows`` (doc_id, h) with ``node``: the id, or a number for the text where an id has different sets (``odd``)."""
    if odd is None:
        return rows.withColumn("node", F.col("doc_id"))
    own = F.when(F.col("odd"), F.xxhash64("doc_id", "h")).otherwise(F.col("doc_id"))
    return rows.join(odd.withColumn("odd", F.lit(True)), "doc_id", "left").withColumn("node", own).drop("odd")


def _least(n: Column) -> Column:
    """Retained values that a pair at 0.75 shares at least, when the smaller set has ``n``: three quarters of
    a union that lies in the sketch, else of K draws from a union of at most n / 0.75."""
    union = F.greatest(n / 0.75, F.lit(K + 1.0))
    drawn = F.floor(0.75 * K - SIGMAS * F.sqrt(0.1875 * K * (union - K) / (union - 1)))
    return F.least(drawn, F.floor(0.75 * n)).cast("long")


def _places(n: Column) -> Column:
    """How many of its rarest retained values a document of ``n`` shingles must be listed under."""
    whole = F.floor(n / 4) + 1
    return F.when(4 * n <= 3 * K, whole).otherwise(F.least(n, F.lit(K)) - _least(n) + 1)


def _listed(reps: DataFrame) -> DataFrame:
    """(value, df, doc, n): every document under those of its rarest retained values that others hold too."""
    post = reps.select(F.col("node").alias("doc"), F.col("n_shingles").alias("n"), F.explode("sketch").alias("value"))
    df = post.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    common = post.join(df, "value")
    w = Window.partitionBy("doc").orderBy("df", "value")
    d = common.withColumns({"at": F.row_number().over(w), "held": F.count("*").over(Window.partitionBy("doc"))})
    alone = F.least(F.col("n"), F.lit(K)) - F.col("held")
    return d.where(F.col("at") <= _places(F.col("n")) - alone).select("value", "df", "doc", "n")


def _star_pairs(listed: DataFrame) -> DataFrame:
    """Each member of a block with the block's leader, then leaders with theirs, until one block is left."""
    cur, level, out = listed, 0, None
    top = listed.agg(F.max("df")).first()[0] or 0
    while True:
        blocks = F.ceil(F.col("df") / BLOCK)
        cur = cur.withColumn("block", F.pmod(F.xxhash64("doc", F.lit(level)), blocks))
        w = Window.partitionBy("value", "block")
        cur = cur.withColumn("lead", F.min(F.struct("doc", "n")).over(w))
        pairs = cur.where(F.col("doc") != F.col("lead.doc")).select(
            F.col("lead.doc").alias("a"), F.col("doc").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb"))
        out = pairs if out is None else out.unionByName(pairs)
        top, level = -(-top // BLOCK), level + 1
        if top <= 1:
            return _near_sizes(out).distinct()
        cur = cur.where(F.col("doc") == F.col("lead.doc")).select("value", blocks.alias("df"), "doc", "n")


def _near_sizes(pairs: DataFrame) -> DataFrame:
    return pairs.where(4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")).select("a", "b")


def _near_parity(pairs: DataFrame) -> DataFrame:
    """Pairs (n, parity, nx, px) whose signatures allow a Jaccard of 0.75."""
    apart = sum((F.bit_count(F.col("px")[i].bitwiseXOR(F.col("parity")[i])) for i in range(PARITY)), F.lit(0))
    most = F.when(F.greatest("nx", "n") <= FULL, F.floor((F.col("nx") + F.col("n")) / 7)).when(
        F.least("nx", "n") > FULL, 2 * K - 2 * _least(F.least("nx", "n"))).otherwise(F.lit(64 * PARITY))
    return pairs.where(apart <= most)


def _confirmed(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """The pairs (a, b) of Jaccard 0.75 or more: union-sketch estimate, then exact sets."""
    side = lambda c, *cols: kept.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in cols])
    p = pairs.join(side("a", "sketch", "n_shingles"), "a").join(side("b", "sketch", "n_shingles"), "b")
    union = F.array_sort(F.array_union("sketch_a", "sketch_b"))
    shared = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), F.slice(union, 1, K)))
    whole = (F.greatest("n_shingles_a", "n_shingles_b") <= K)
    fits = F.when(whole & (F.size(union) <= K), 4 * shared >= 3 * F.size(union)).otherwise(
        shared >= _least(F.least("n_shingles_a", "n_shingles_b")))
    p = p.where(fits).select("a", "b").join(side("a", "text"), "a").join(side("b", "text"), "b")

    def exact(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True):
                s, t = shingle_set(x), shingle_set(y)
                both = overlap(s, t)
                keep.append(100 * both >= 75 * (len(s) + len(t) - both))
            yield b.select(["a", "b"]).filter(pa.array(np.array(keep, bool)))
    return p.select("a", "b", "text_a", "text_b").mapInArrow(exact, "a long, b long")


def _apart(listed: DataFrame, comps: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (value, doc, n, c, parity, main) of the lists with more than one component: those outside the list's
    main component, and all."""
    m = listed.join(comps.withColumnRenamed("node", "doc"), "doc", "left")
    m = m.select("value", "doc", "n", F.coalesce("component", "doc").alias("c"))
    main = m.groupBy("value", "c").agg(F.count("*").alias("k")).groupBy("value").agg(
        F.max(F.struct("k", "c"))["c"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    m = m.join(main.select("value", "main"), "value").join(kept.select(F.col("node").alias("doc"), "parity"), "doc")
    m = written(m, "apart")
    few = m.where("c <> main").select("value", F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"),
                                      F.col("parity").alias("px"), "main")
    return few, m


def _pairs(joined: DataFrame) -> DataFrame:
    return _near_sizes(_near_parity(joined).select(F.least("x", "doc").alias("a"), F.greatest("x", "doc").alias("b"),
                                     F.col("nx").alias("na"), F.col("n").alias("nb"))).distinct()


def _leader_pairs(listed: DataFrame, comps: DataFrame, kept: DataFrame, leaders: int) -> DataFrame:
    """Members outside the main component with up to ``leaders`` members of it, spread by hash."""
    few, m = _apart(listed, comps, kept)
    draw = F.xxhash64("doc", F.lit(leaders))
    lead = m.where("c = main").groupBy("value", F.pmod(draw, F.lit(leaders)).alias("part")).agg(
        F.min(F.struct(draw.alias("h"), "doc", "n", "parity")).alias("l")).select("value", "l.doc", "l.n", "l.parity")
    return _pairs(few.join(lead, "value"))


def _late_pairs(listed: DataFrame, comps: DataFrame, kept: DataFrame) -> DataFrame:
    """All pairs that share a list but no component yet. A member outside meets a main component list by list, or each of its
    members once, in blocks, where the lists that they share would take more pairs than that (copies of one passage share many)."""
    few, m = _apart(listed, comps, kept)
    inner = m.where("c = main")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    size = written(inner.groupBy("main").agg(F.countDistinct("doc").alias("size")).withColumn("blocks", blocks), "sizes")
    cost = few.join(inner.groupBy("value").agg(F.count("*").alias("k")), "value").groupBy("x", "main").agg(F.sum("k").alias("cost"))
    once = written(cost.join(size, "main").where("cost > size").select("x", "main", "blocks"), "once")
    side = lambda c, *cols: kept.select(F.col("node").alias(c), *cols)
    block = F.pmod(F.xxhash64("doc", F.lit(BLOCK)), F.col("blocks")).cast("int").alias("block")
    to = inner.select("main", "doc").distinct().join(once.select("main").distinct(), "main", "left_semi").join(size, "main")
    to = to.select("main", "doc", block).join(side("doc", F.col("n_shingles").alias("n"), "parity"), "doc")
    by = once.join(side("x", F.col("n_shingles").alias("nx"), F.col("parity").alias("px")), "x")
    by = by.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cols = ("x", "nx", "px", "doc", "n", "parity")
    whole = by.join(to, ["main", "block"]).select(*cols)
    lists = few.join(once.select("x", "main"), ["x", "main"], "left_anti").join(inner.drop("main"), "value").select(*cols)
    both = few.join(m.where("c <> main").drop("main"), "value").where("cx <> c and x < doc").select(*cols)
    return _pairs(whole.unionByName(lists).unionByName(both))


def near_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    sk = written(sketches(docs), "sketches")
    sets = ["f1", "f2", "n_shingles"]
    some = "n_shingles > 0 and doc_id is not null"
    one = F.struct(*sets)
    odd = written(sk.where("doc_id is not null").groupBy("doc_id").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo <> hi")
                  .select("doc_id"), "odd-ids")
    odd = None if odd.isEmpty() else odd
    sk = _noded(sk, odd)
    full = sk.where(some)
    first = full.groupBy(*sets).agg(F.min("node").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    # narrow tables are written before they are joined: their size is known then, and where it is small neither sketches nor
    # texts are shuffled for it
    others = written(full.select("node", *sets).join(first.select(*sets, "rep"), sets).where("rep <> node").select("node"), "copies")
    reps = full.join(others, "node", "left_anti")
    listed = written(_listed(reps.dropDuplicates(["node"]) if odd is not None else reps), "lists")
    ids = written(listed.select(F.col("doc").alias("node")).distinct(), "listed-ids")
    kept = sk.join(ids, "node", "left_semi").select("node", "n_shingles", "sketch", "parity")
    texts = _noded(_keyed(docs), odd).join(ids, "node", "left_semi").select("node", "text")
    kept = written(kept.dropDuplicates(["node"]).join(texts.dropDuplicates(["node"]), "node"), "candidates")
    ties = None
    if odd is not None:  # the sets of one id belong together
        held = full.join(odd, "doc_id", "left_semi").join(first.select(*sets, "rep"), sets, "left")
        held = held.select("doc_id", F.coalesce("rep", "node").alias("u"))
        ties = held.join(held.groupBy("doc_id").agg(F.min("u").alias("v")), "doc_id").select("u", "v")
    comps = tried = None
    for round_ in ("stars", *LEADERS, "all"):
        if round_ == "stars":
            pairs = _star_pairs(listed)
        else:
            pairs = _late_pairs(listed, comps, kept) if round_ == "all" else _leader_pairs(listed, comps, kept, round_)
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        with small_methods(docs.sparkSession):  # the test of signatures is long
            pairs = written(pairs, "pairs")
        links = written(_confirmed(pairs, kept), "links").select(F.col("a").alias("u"), F.col("b").alias("v"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        if comps is None:
            comps = written(components(links.unionByName(ties) if ties is not None else links), "components")
        elif not links.isEmpty():
            # each earlier component is one star by now
            earlier = comps.select(F.col("node").alias("u"), F.col("component").alias("v"))
            comps = written(components(earlier.unionByName(links)), "components")
    out = sk.select("doc_id", "node", *sets).join(first.select(*sets, "rep"), sets, "left")
    out = out.withColumn("node", F.coalesce("rep", "node")).join(comps, "node", "left")
    out = out.withColumn("component", F.coalesce("component", "node"))
    if odd is not None:  # nodes are not all ids: the smallest id of each component names it
        named = out.groupBy("component").agg(F.min("doc_id").alias("named"))
        out = out.join(named, "component", "left").withColumn("component", F.col("named"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"),
                      F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))

"""Merkle dataset manifest by checkpoint and recompute.

Rows become leaves, numbered by key within their group (a language); pairs of
neighbours are hashed level by level into a subroot for each group, and the
subroots, in order of their groups, likewise into the root. Only every
``STEP``-th level is written: the leaves, then one node for each aligned
subtree of 2**STEP of them, and so on. A proof needs the levels in between:
each stored subtree is rebuilt in memory from its at most 2**STEP stored
nodes, the siblings of its nodes are emitted, and the subtree is discarded.
Paths are handed down from the root, one row for each stored node.

A group may hold any share of the rows: numbering is a range sort with prefix
sums over (partition, group) counts, subtrees are dealt by (group, block).

Null fields are marked, null groups are a group of their own that comes first;
empty and very long texts are hashed whole by Spark; repeated rows are leaves
of their own, next to each other; null keys come first; rows of one key are
ordered by their leaf; other columns are ignored whatever their names; an
empty table has no root and no rows."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, written

STEP = 10  # levels from one stored level to the next
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "path array<string>"


def field(c: Column) -> Column:
    """``-`` for null, else the value behind its UTF-8 byte count and a colon."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _up(level: list[str]) -> list[str]:
    """The parents of a level: the hash of each pair, of the last node alone if it has no neighbour."""
    return [sha256("".join(level[i:i + 2]).encode()).hexdigest() for i in range(0, len(level), 2)]


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` (string column g, not null) with ``pos``, the place within g in the given order, and ``height``,
    the levels above the nodes of g. The sorted table is written once."""
    s = nodes.sort("g", *order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    s = written(s, "merkle-sorted")
    every, before = Window.partitionBy("g"), Window.partitionBy("g").orderBy("_part")
    per = s.groupBy("_part", "g").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    base = per.select("_part", "g", (F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                                     - F.col("_first")).alias("_base"), F.sum("_n").over(every).alias("_total"))
    height = F.when(F.col("_total") > 1, F.length(F.bin(F.col("_total") - 1))).otherwise(0)
    return s.join(written(base, "merkle-counts"), ["_part", "g"]).withColumns(
        {"pos": F.col("_at") + F.col("_base"), "height": height}).drop("_part", "_at", "_base", "_total")


def _subtree_root(block: pa.Table, step: int) -> pa.Table:
    block = block.sort_by("pos")
    level, height = block["digest"].to_pylist(), block["height"][0].as_py()
    for _ in range(min(step, height)):
        level = _up(level)
    return pa.table({"g": block["g"][:1], "pos": pa.array([block["pos"][0].as_py() >> step], pa.int64()),
                     "height": pa.array([max(0, height - step)], pa.int32()), "digest": pa.array(level, pa.string())})


def stored_levels(leaves: DataFrame, step: int) -> list[DataFrame]:
    """The leaves (g, pos, height, digest, others) and each stored level above them; the last has one node for each g."""
    tiers = [leaves]
    highest = leaves.agg(F.max("height")).first()[0] or 0
    for _ in range(-(-highest // step)):
        nodes = tiers[-1].select("g", "pos", "height", "digest")
        up = nodes.groupBy("g", F.shiftright("pos", step).alias("block")).applyInArrow(
            lambda block: _subtree_root(block, step), "g string, pos long, height int, digest string")
        tiers.append(written(up, "merkle-level"))
    return tiers


def _handed_down(nodes: DataFrame, above: DataFrame, step: int) -> DataFrame:
    """``nodes`` of one stored level with the path of each one to the root. ``above`` has (g, pos, path, others) of the
    stored level over it, one row for each subtree; its other columns are handed down as well."""
    own, more = nodes.columns, [c for c in above.columns if c not in ("g", "pos", "path")]

    def expand(block: pa.Table, over: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        level = block["digest"].to_pylist()
        n, tail, paths = len(level), over["path"][0].as_py(), [[] for _ in level]
        for k in range(min(step, block["height"][0].as_py())):
            for i, path in enumerate(paths):
                at = i >> k
                path.append("" if at ^ 1 >= len(level) else ("<" if at & 1 else ">") + level[at ^ 1])
            level = _up(level)
        out = {c: block[c] for c in own} | {c: pa.array([over[c][0].as_py()] * n, pa.string()) for c in more}
        return pa.table(out | {"path": pa.array([p + tail for p in paths], pa.list_(pa.string()))})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema] + [f"`{c}` string" for c in more] + [PATH])
    left = nodes.groupBy("g", F.shiftright("pos", step).alias("block"))
    return left.cogroup(above.groupBy("g", "pos")).applyInArrow(expand, schema)


def _descend(tiers: list[DataFrame], top: DataFrame, step: int) -> DataFrame:
    """The leaves of ``tiers`` with path; ``top`` has (g, pos 0, path, others) of each g's own root."""
    for k, tier in reversed([*enumerate(tiers[:-1])]):
        down = _handed_down(tier, top, step)
        top = written(down.drop("height", "digest"), "merkle-paths") if k else down
    return top if len(tiers) > 1 else tiers[0].join(top.drop("pos"), "g")


@dataclass
class Manifest:
    leaves: list[DataFrame]   # stored levels of the groups' trees; the first are the leaves
    groups: list[DataFrame]   # stored levels of the tree over the groups' subroots
    root: str | None
    step: int                 # levels from one stored level to the next


def manifest(leaves: DataFrame, step: int = STEP) -> Manifest:
    """Build and store the trees over ``leaves``: g (string), key, digest and any other columns."""
    tiers = stored_levels(numbered(leaves, "key", "digest"), step)
    subroots = tiers[-1].select(F.lit("").alias("g"), F.col("g").alias("key"), "digest")
    over = stored_levels(numbered(subroots, "key"), step)
    root = over[-1].select("digest").first()  # one row: the root
    return Manifest(tiers, over, root and root[0], step)


def proofs(m: Manifest, spark) -> DataFrame:
    """Every leaf with subroot, root and ``path``: one entry for each level up to the root, the sibling's digest behind
    ``<`` (it stands left) or ``>``, or the empty string where the node has none."""
    empty = F.expr("cast(array() as array<string>)")
    top = spark.range(1).select(F.lit("").alias("g"), F.lit(0).cast("long").alias("pos"), empty.alias("path"),
                                F.lit(m.root).cast("string").alias("root"))
    top = _descend(m.groups, top, m.step).select(F.col("key").alias("g"), F.lit(0).cast("long").alias("pos"), "path", "root",
                                         F.col("digest").alias("subroot"))
    return _descend(m.leaves, written(top, "merkle-paths"), m.step)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    def step(at, s):
        other = F.substr(s, F.lit(2))
        return F.sha2(F.when(F.startswith(s, F.lit("<")), F.concat(other, at)).otherwise(F.concat(at, other)), 256)
    return F.aggregate(path, leaf, step)


def document_leaves(docs: DataFrame, **changed: Column) -> DataFrame:
    """(g, key, digest) of documents, and ``claimed``: the leaf with some fields changed, null where that is the same."""
    fields = [F.col(c) for c in FIELDS]
    other = leaf_of(*[changed.get(c, F.col(c)) for c in FIELDS])
    differs = F.lit(False)
    for c, v in changed.items():
        differs = differs | ~v.eqNullSafe(F.col(c))
    return docs.select(F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string"))).alias("g"),
                       F.col("doc_id").alias("key"), leaf_of(*fields).alias("digest"), F.when(differs, other).alias("claimed"))


def op12_merkle(spark, sf_dir: str, step: int = STEP) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    leaves = document_leaves(docs, n_chars=F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    m = manifest(written(leaves, "merkle-leaves"), step)
    p = proofs(m, spark)
    siblings = F.array_join(F.transform("path", lambda s: F.substr(s, F.lit(2))), "")
    return p.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
                    F.sha2(siblings, 256).alias("proof_sha256"),
                    folded(F.coalesce("claimed", "digest"), F.col("path")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root").eqNullSafe(F.col("root")))

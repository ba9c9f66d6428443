"""Sharding: hierarchical weighted hash tree. A key descends region, rack and
shard; at each level every child draws -ln(u)/weight from hash(key, child) and
the smallest draw wins, so a key moves only when a weight on its path changes.
A shard added after the tree was created is a region of its own, whatever the
count, so no weight of another subtree changes and keys move only into it.

Slots are prefix sums over (shard, block) counts plus the row number in the
block: no shard is gathered in one task. Null ids hash as the empty string,
null text has size 1; ties and repeated rows are ordered by size and crc."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents


def tree(n_shards: int, created: int | None = None, rack: int = 2, region: int = 4) -> dict:
    """{region: {rack: {shard: weight}}} with equal weights: ``created`` shards (all, if not given) in racks and regions, and
    a region for each one added since."""
    created = n_shards if created is None else created
    out: dict = {}
    for s in range(created):
        out.setdefault(s // region, {}).setdefault(s % region // rack, {})[s] = 1.0
    first = len(out)
    for s in range(created, n_shards):
        out[first + s - created] = {0: {s: 1.0}}
    return out


def _weight(node) -> float:
    return node if isinstance(node, float) else sum(map(_weight, node.values()))


def _draw(key: Column, path: str, weight: float) -> Column:
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(":" + path))), 1, 12), 16, 10).cast("double")
    return -F.log((h + 1) / F.lit(float(1 << 48) + 1)) / F.lit(weight)


def shard_of(key: Column, node: dict, path: str = "t") -> Column:
    """The shard that ``key`` (a string) reaches."""
    kids = list(node.items())
    pick = [(shard_of(key, v, f"{path}/{k}") if isinstance(v, dict) else F.lit(int(k))) for k, v in kids]
    if len(kids) == 1:
        return pick[0]
    draws = [_draw(key, f"{path}/{k}", _weight(v)) for k, v in kids]
    least = F.least(*draws)
    out = pick[-1]
    for d, p in reversed(list(zip(draws[:-1], pick[:-1], strict=True))):
        out = F.when(d == least, p).otherwise(out)
    return out


def op5_shards(spark, sf_dir: str, n_shards: int = 16, blocks: int = 256) -> DataFrame:
    d = documents(spark, sf_dir)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = d.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                    F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
                    shard_of(key, tree(n_shards)).alias("shard"), shard_of(key, tree(n_shards + 1, n_shards)).alias("grown_shard"),
                    (F.crc32(key.cast("binary")) % blocks).alias("block"))
    count = rows.groupBy("shard", "block").count()
    w = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = count.select("shard", "block", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    out = rows.withColumn("at", F.row_number().over(inner)).join(base, ["shard", "block"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard",
                      (F.col("base") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard")

"""Packing: shortest-pack-first over the length histogram.

Texts are encoded once and cut into pieces of at most ``limit`` ids. Only the
histogram (at most ``limit`` rows) reaches the driver. Lengths are placed
longest first, each into the emptiest packs that hold it; packs of one make-up
are one pattern with a count, so the work does not grow with the documents.
A piece's rank among those of its length then picks its pattern, sequence and
offset. Ranks are prefix sums over hashed blocks, so that a length held by a
third of all pieces is not one task. Null text is the end id alone; repeated
rows are packed each; an empty table gives no rows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, text_of, written
from .vocab_cache import encoder

LIMIT = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of sequences, [(length, copies), ...])] that hold every piece of ``histogram`` once."""
    space: dict[int, list] = {}           # free ids -> patterns (count, make-up)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and (free := max(space, default=0)) >= length:      # the emptiest packs first
            for count, made in space.pop(free):
                take = min(count, left)
                left -= take
                if take:
                    more = made[:-1] + [(length, made[-1][1] + 1)] if made[-1][0] == length else made + [(length, 1)]
                    space.setdefault(free - length, []).append((take, more))
                if count > take:
                    space.setdefault(free, []).append((count - take, made))
        each = limit // length
        for count, copies in ((left // each, each), (1, left % each)):
            if count and copies:
                space.setdefault(limit - copies * length, []).append((count, [(length, copies)]))
    return [(c, m) for packs in space.values() for c, m in packs]


def slots(patterns, limit: int = LIMIT) -> list[tuple]:
    """(length, first rank, end rank, copies, first sequence, offset) rows: which ranks of a length go where."""
    out, used, seq = [], {}, 0
    for count, made in patterns:
        at = 0
        for length, copies in made:
            lo = used.get(length, 0)
            used[length] = lo + count * copies
            out.append((length, lo, used[length], copies, seq, at))
            at += length * copies
        seq += count
    return out


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    def cut(batches):
        enc = encoder(tokenizer_path, True)
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, raw in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(raw, enc.dtype).astype("<u4")
                for at in range(0, len(ids), limit):
                    part = ids[at:at + limit]
                    for col, v in zip(rows, (doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, blocks: int = 256) -> DataFrame:
    """One row per piece: PIECES, sequence_id, offset."""
    spark = docs.sparkSession
    p = pieces(docs, tokenizer_path, limit).withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)))
    p = written(p, "pieces")
    count = written(p.groupBy("length", "block").agg(F.count("*").alias("n")), "lengths")
    hist = {r["length"]: r["n"] for r in count.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # the tables of slots and block counts are bounded by the limit, not by the documents
    table = spark.createDataFrame(slots(plan(hist, limit), limit),
                                  "length long, lo long, hi long, copies long, seq long, at long")
    w = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = count.select("length", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    inner = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    r = p.withColumn("k", F.row_number().over(inner)).join(base, ["length", "block"])
    r = r.withColumn("rank", F.col("base") + F.col("k") - 1)
    r = r.join(F.broadcast(table), "length").where("rank >= lo and rank < hi")
    at = F.col("rank") - F.col("lo")
    return r.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                    (F.col("seq") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
                    (F.col("at") + at % F.col("copies") * F.col("length")).cast("long").alias("offset"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))

"""Importance resampling towards a target: documents are drawn with weights
from hashed n-gram counts of the raw and the target texts, by the Gumbel rule.

Features are runs of 1 to 3 words; a feature's bucket is the CRC of its bytes.
The buckets of a lot of texts are found by length-bucketed CRC matrices: words
get numbers, runs get the pair of numbers of their parts, and each distinct
run is hashed once: distinct runs of equal byte length are rows of one uint8
matrix, all CRCs move on column by column, and the results are scattered back
to the places of the runs. Texts are read once; each document's buckets are
kept as sorted, differenced 16-bit numbers, from which the corpus counts and
then the weights are summed.

Null and empty texts have no features, weight 0 and are not drawn unless
``min_words`` is 0; texts of any length are cut at words into lots that
overlap by two words, so no run is lost or counted twice; repeated rows are
rows of their own; rows of one score are ranked by id (null first), then by
their counts; other columns are ignored; without a target or documents all
counts are 0 and the rules hold as they are."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.operators.ids import global_row_number
from gradeframe.session import scratch_path

from .common import documents, written

N_BUCKETS = 10_000   # at most 65,536
ORDER = 3
LOT = 1 << 20        # bytes of text hashed at once
LONG = 4096          # runs of more bytes are too few of a length for a matrix: hashed one by one
_SMALL = {c: c for c in (*range(48, 58), *range(97, 123), *range(128, 256))} | {c: c + 32 for c in range(65, 91)}
_WORD_BYTES = bytes(_SMALL.get(c, 32) for c in range(256))  # A-Z lower-cased, separators to spaces


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table()


def crc_matrix(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a two-dimensional uint8 array, all rows at once, column by column."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = _TABLE[(crc ^ column) & 0xFF] ^ crc >> 8
    return ~crc


def crcs_of(text: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of ``text``, by matrices of slices of equal length."""
    out = np.empty(len(start), np.uint32)
    raw = np.frombuffer(text, np.uint8)
    order = np.argsort(length, kind="stable")
    sizes, at = np.unique(length[order], return_index=True)
    for size, lot in zip(sizes.tolist(), np.split(order, at[1:]), strict=True):
        if size > LONG:
            out[lot] = [zlib.crc32(text[s:s + size]) for s in start[lot].tolist()]
        else:
            out[lot] = crc_matrix(np.lib.stride_tricks.sliding_window_view(raw, size)[start[lot]])
    return out


def pieces(text: str):
    """(words, number of words that the piece before had too): the text's words as bytes, in pieces of about LOT bytes."""
    raw, at, carry = text.encode().translate(_WORD_BYTES), 0, []
    while at < len(raw):
        end = at + LOT if at + LOT < len(raw) else len(raw)
        while end < len(raw) and raw[end] != 32:
            end = stop if (stop := raw.find(b" ", end)) >= 0 else len(raw)
        words = carry + raw[at:end].split()
        yield words, len(carry)
        at, carry = end, words[-(ORDER - 1):]


def bucket_lot(lot: list[tuple[list[bytes], int]], n_buckets: int) -> list[np.ndarray]:
    """The buckets of all runs of 1 to ORDER words of each piece (runs within the words carried over are left out)."""
    number: dict[bytes, int] = {}
    words = [w for ws, _ in lot for w in ws]
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    text = b" ".join(words)
    size = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(size + 1) - size - 1
    piece = np.repeat(np.arange(len(lot)), [len(ws) for ws, _ in lot])
    first = np.cumsum([0, *(len(ws) for ws, _ in lot)])[:-1]
    fresh = first + np.array([c for _, c in lot], np.int64)  # first place whose word is new
    out, run = [[] for _ in lot], ids  # run: number of the run of n words that starts at each place
    for n in range(1, ORDER + 1):
        if n > 1:
            run = run[:len(words) - n + 1] * (len(number) + 1) + ids[n - 1:]
        places = np.arange(len(words) - n + 1)
        if not len(places):
            break
        last = places + n - 1
        whole = (piece[places] == piece[last]) & (last >= fresh[piece[last]])
        _, one, back = np.unique(run, return_index=True, return_inverse=True)
        bucket = crcs_of(text, start[one], start[one + n - 1] + size[one + n - 1] - start[one]) % n_buckets
        found, owner = bucket[back][whole], piece[places][whole]
        for i, b in enumerate(np.split(found, np.searchsorted(owner, np.arange(1, len(lot))))):
            out[i].append(b)
        run = back
    return [np.concatenate(b) if b else np.empty(0, np.uint32) for b in out]


def _buckets_of(texts: list[str], n_buckets: int):
    """(n_words, sorted buckets of all runs) of each text, hashed in lots of about LOT bytes."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    n_words, lot, owner, held = [0] * len(texts), [], [], 0
    for i, t in enumerate(texts):
        for words, carried in pieces(t):
            n_words[i] += len(words) - carried
            lot.append((words, carried))
            owner.append(i)
            held += sum(map(len, words))
            if held >= LOT:
                for k, b in zip(owner, bucket_lot(lot, n_buckets), strict=True):
                    parts[k].append(b.astype(np.uint16))
                lot, owner, held = [], [], 0
    if lot:
        for k, b in zip(owner, bucket_lot(lot, n_buckets), strict=True):
            parts[k].append(b.astype(np.uint16))
    for n, p in zip(n_words, parts, strict=True):
        yield n, np.sort(np.concatenate(p)) if p else np.empty(0, np.uint16)


def features(docs: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(id, n_words, n_features, buckets) of every row; written once. ``buckets``: sorted 16-bit numbers, differenced."""

    def hashed(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = [*_buckets_of([t or "" for t in part.column(1).to_pylist()], n_buckets)]
                yield pa.RecordBatch.from_pydict({
                    "id": part.column(0), "n_words": pa.array([n for n, _ in got], pa.int64()),
                    "n_features": pa.array([len(x) for _, x in got], pa.int64()),
                    "buckets": pa.array([np.diff(x, prepend=np.uint16(0)).tobytes() for _, x in got], pa.binary())})

    rows = docs.mapInArrow(hashed, "id long, n_words long, n_features long, buckets binary")
    path = scratch_path(docs.sparkSession, "resample-features")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def _read(value: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(value, np.uint16), dtype=np.uint16)


def bucket_counts(feats: DataFrame, n_buckets: int) -> np.ndarray:
    """Features in each bucket over all rows: summed in the tasks, then by bucket; ``n_buckets`` numbers reach the driver."""

    def count(batches):
        n = np.zeros(n_buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                n += np.bincount(_read(x.as_py()), minlength=n_buckets)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "n": pa.array(n[full], pa.int64())})

    out = np.zeros(n_buckets, np.int64)
    for bucket, n in feats.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray, scale: float = 1000.0) -> np.ndarray:
    """floor(scale * ln(target share / raw share)) of each bucket, one added to every count."""
    k, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k))))
                     for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(feats: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the sum of the gains of the row's features."""

    def weigh(batches):
        for b in batches:
            w = [int(gain[_read(x.as_py())].sum()) for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(w, pa.int64())], ["id", "n_words", "n_features", "weight"])

    return feats.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")


def gumbel(id_: Column, seed: int, scale: float = 1000.0) -> Column:
    """floor(-scale * ln(-ln(u))), u from the first 32 bits of sha256(``seed:id``)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-scale) * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42,
             n_buckets: int = N_BUCKETS) -> DataFrame:
    """Every row of ``docs`` (id, text) with n_features, weight, score and rank: 1, 2, 3, ... for the ``percent`` of the
    rows with ``min_words`` words or more that score highest against the texts of ``target`` (text), else null."""
    feats = features(docs, n_buckets)
    aim = features(target.select(F.lit(None).cast("long").alias("id"), "text"), n_buckets)
    rows = weighted(feats, gains(bucket_counts(feats, n_buckets), bucket_counts(aim, n_buckets)))
    rows = written(rows.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "resample-scores")
    fit = F.col("n_words") >= min_words
    drawn = rows.where(fit).count() * percent // 100
    ranked = global_row_number(rows.where(fit), [F.desc("score"), "id", "n_features", "weight"], "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long")
    return ranked.withColumn("rank", rank).unionByName(rows.where(~fit).withColumn("rank", F.lit(None).cast("long"))) \
        .select("id", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    d, b = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = resample(d.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")),
                   b.select(F.col("text").cast("string").alias("text")))
    return out.withColumnRenamed("id", "doc_id")

"""Token-ID / binary output: flat unsigned integer files plus 64-bit document
offsets, memory-mapped; partition bases are prefix sums over the manifest.

Rows are range-partitioned and sorted by ``doc_id`` (null ids first, repeated
ids ordered by text hash). Each task writes ``ids-*.bin`` and ``offsets-*.bin``
(int64, n+1 values) under attempt-unique names; the manifest, committed by
Spark, names the files of the winning attempts. Null text is empty: the end id
alone. An empty table gives an empty manifest."""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.session import scratch_path

from .common import text_of, written
from .vocab_cache import encoder

MANIFEST = "ids_file string, offsets_file string, doc_ids array<long>, dtype string, part int, n_tokens long"


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, spaced: bool = False) -> DataFrame:
    """Encode every text and write the files; returns the manifest with ``base`` (tokens before the file)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def write(batches):
        enc, store, part = None, None, 0
        for b in batches:
            if enc is None:
                enc = encoder(tokenizer_path, spaced)
                store, root = fs.FileSystem.from_uri(out)
                store.create_dir(root, recursive=True)
                from pyspark import TaskContext
                part = TaskContext.get().partitionId()
            # one pair of files for each Arrow batch: bounded memory
            for at in range(0, b.num_rows, 2048):
                s = b.slice(at, 2048)
                lens, name = [0], uuid.uuid4().hex
                with store.open_output_stream(f"{root}/ids-{name}.bin") as f:
                    for raw in enc.encode_all(s.column(1).to_pylist()):
                        f.write(raw)
                        lens.append(len(raw) // np.dtype(enc.dtype).itemsize)
                off = np.cumsum(np.array(lens, "<i8"))
                with store.open_output_stream(f"{root}/offsets-{name}.bin") as f:
                    f.write(off.tobytes())
                yield pa.RecordBatch.from_pydict(
                    {"ids_file": [f"ids-{name}.bin"], "offsets_file": [f"offsets-{name}.bin"],
                     "doc_ids": pa.array([s.column(0).to_pylist()], pa.list_(pa.int64())), "dtype": [enc.dtype],
                     "part": pa.array([part], pa.int32()), "n_tokens": pa.array([int(off[-1])], pa.int64())})

    # the order of files: by partition, then first written first
    man = rows.mapInArrow(write, MANIFEST).withColumn("seq", F.monotonically_increasing_id())
    man = written(man, "token-files")
    w = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)   # one row for each file
    base = man.select("seq", "n_tokens").withColumn("base", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    return man.join(base.select("seq", "base"), "seq")


def read_token_files(manifest: DataFrame, out: str) -> DataFrame:
    """(doc_id, start, ids): ``ids`` are the document's ids as bytes of the file's type, read by memory map."""

    def read(batches):
        for b in batches:
            store, root = fs.FileSystem.from_uri(out)
            for r in b.to_pylist():
                if isinstance(store, fs.LocalFileSystem):
                    ids = np.memmap(os.path.join(root, r["ids_file"]), r["dtype"], "r")
                    off = np.memmap(os.path.join(root, r["offsets_file"]), "<i8", "r")
                else:
                    ids = np.frombuffer(store.open_input_file(f"{root}/{r['ids_file']}").readall(), r["dtype"])
                    off = np.frombuffer(store.open_input_file(f"{root}/{r['offsets_file']}").readall(), "<i8")
                docs, n = r["doc_ids"], 64
                for i in range(0, len(docs), n):
                    d = docs[i:i + n]
                    raw = [ids[off[i + k]:off[i + k + 1]].astype("<u4") for k in range(len(d))]
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array(d, pa.int64()),
                         "start": pa.array([r["base"] + int(off[i + k]) for k in range(len(d))], pa.int64()),
                         "n_tokens": pa.array([len(x) for x in raw], pa.int64()),
                         "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in raw], pa.int64())})

    files = manifest.select("ids_file", "offsets_file", "doc_ids", "dtype", "base")
    # the manifest is small and would be read in one task: its files are dealt out again
    return files.repartition(manifest.sparkSession.sparkContext.defaultParallelism, "ids_file").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import documents
    out = scratch_path(spark, "ids")
    man = write_token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), out)
    return read_token_files(man, out)

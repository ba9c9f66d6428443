"""Keys that an output already has, kept bucketed beside it.

A resumed job drops the tasks whose key is done. The keys of committed waves
are kept as a table bucketed by the key, so the anti join shuffles the new
tasks only; what was done before is read bucket by bucket where it lies. Keys
are added wave by wave, after the wave's commit: a wave whose keys are missing
(the job was cut off) is caught up from its rows when the next job starts, and
keys added twice do no harm.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commitlog import ROWS, CommitLog

KEYS = "keys"


def done_key(*cols: str) -> Column:
    """One text for a row's key columns, never null: null is unlike every value, and equals null."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
             for c in (F.col(c).cast("string") for c in cols)]
    return F.concat(*parts)


class DoneState:
    """The done keys (``columns``) of the rows behind ``log``."""

    def __init__(self, log: CommitLog, schema: T.StructType, columns: tuple[str, ...], buckets: int | None = None):
        self.log, self.schema, self.columns = log, schema, columns
        entries = log.entries(KEYS)
        self.buckets = (entries[0]["buckets"] if entries
                        else buckets or int(log.spark.conf.get("spark.sql.shuffle.partitions")))
        self.path = f"{log.base}/{KEYS}"
        self.table = "done_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]
        log.spark.sql(f"create table if not exists {self.table} (k string) using parquet "
                      f"clustered by (k) into {self.buckets} buckets location '{self.path}'")

    def catch_up(self) -> None:
        """Add the keys of committed waves that are not there yet."""
        have = {w for e in self.log.entries(KEYS) for w in e["waves"]}
        waves = [e["wave"] for e in self.log.entries(ROWS) if e["files"] and e["wave"] not in have]
        if not waves:
            return
        rows = self.log.read(self.schema, ROWS, set(waves))
        rows.select(done_key(*self.columns).alias("k")).distinct().write.insertInto(self.table)
        self.log.spark.catalog.refreshTable(self.table)
        self.log.commit(KEYS, waves[-1], [], 0, waves=waves, buckets=self.buckets)

    def remaining(self, tasks: DataFrame) -> DataFrame:
        """The rows of ``tasks`` whose key is not done."""
        self.catch_up()
        keyed = tasks.withColumn("_done_key", done_key(*self.columns))
        done = self.log.spark.table(self.table)
        return keyed.join(done, keyed["_done_key"] == done["k"], "left_anti").drop("_done_key")


__all__ = ["DoneState", "done_key"]

"""Tables written wave by wave behind a log of commits.

A table is a folder of Parquet files and a folder ``_commits`` of numbered
entries. A wave first writes its files, then one entry that names them with
their row count; readers take the files that entries name, so a wave that was
cut off leaves nothing to be read, and a wave that was committed is there
whole. Entries are created, never replaced: of two writers that want one
number, the second takes the next. An entry that was cut off while it was
written is no whole JSON line and does not count.

Entries are of a ``kind``: rows of the table (``rows``), and what a job wants
to find again after a crash, such as the paid calls of a wave (``calls``).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .files import _fs_path, path_exists

COMMITS = "_commits"
ROWS = "rows"


def _entry(line: str) -> dict | None:
    try:
        return json.loads(line)
    except ValueError:
        return None


class CommitLog:
    """The log in front of the table at ``base`` (any folder that Spark's file systems reach)."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.folder = f"{self.base}/{COMMITS}"

    def exists(self) -> bool:
        return path_exists(self.spark, self.folder)

    def entries(self, kind: str | None = None) -> list[dict]:
        """Committed entries in order; their number is the number of waves, and files are named, not read."""
        if not self.exists():
            return []
        rows = self.spark.read.text(self.folder).selectExpr("_metadata.file_name as name", "value").orderBy("name").collect()
        found = [e for r in rows if (e := _entry(r["value"]))]
        return [e for e in found if kind is None or e["kind"] == kind]

    def _numbers(self) -> list[int]:
        if not self.exists():
            return []
        fs, path = _fs_path(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return [int(n.split(".")[0]) for n in names if n.split(".")[0].isdigit()]

    def commit(self, kind: str, wave: str, files: list[str], rows: int, **also) -> None:
        """Add an entry. Whoever creates the numbered file first has the number."""
        text = json.dumps({"kind": kind, "wave": wave, "files": files, "rows": rows, **also}) + "\n"
        n = max(self._numbers(), default=-1) + 1
        while True:
            fs, path = _fs_path(self.spark, f"{self.folder}/{n:012d}.json")
            try:
                out = fs.create(path, False)
                break
            except Exception:  # noqa: BLE001 - the JVM's FileAlreadyExistsException
                if not fs.exists(path):
                    raise
                n += 1
        out.write(bytearray(text.encode()))
        out.close()

    def write(self, df: DataFrame, kind: str, wave: str, **also) -> DataFrame:
        """Write ``df`` as one wave and commit it; gives the rows as written."""
        folder = f"{self.base}/{kind}/{uuid.uuid4().hex[:16]}"
        df.write.parquet(folder)
        fs, path = _fs_path(self.spark, folder)
        names = sorted(s.getPath().getName() for s in fs.listStatus(path))
        files = [f"{kind}/{path.getName()}/{n}" for n in names if n.endswith(".parquet")]
        written = self.spark.read.schema(df.schema).parquet(folder)
        self.commit(kind, wave, files, written.count(), **also)
        return written

    def read(self, schema: T.StructType, kind: str = ROWS, waves: set[str] | None = None) -> DataFrame:
        """The committed rows of ``kind`` (of some waves only, if named)."""
        files = [f"{self.base}/{f}" for e in self.entries(kind) if waves is None or e["wave"] in waves for f in e["files"]]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files)

    def count(self, kind: str = ROWS) -> int:
        """Committed rows, from the entries alone."""
        return sum(e["rows"] for e in self.entries(kind))

    def open_waves(self, kind: str, closed_by: str = ROWS) -> list[str]:
        """Waves that have an entry of ``kind`` and none of ``closed_by``, in order."""
        closed = {e["wave"] for e in self.entries(closed_by)}
        return list(dict.fromkeys(e["wave"] for e in self.entries(kind) if e["wave"] not in closed))


def new_wave() -> str:
    return uuid.uuid4().hex


__all__ = ["CommitLog", "ROWS", "new_wave"]

"""Sequential ids in a global order without a single-partition window.

Two passes: sort (range-partitioned) and record each row's partition id
and in-partition position as columns, cut lineage by writing that table to
the shared checkpoint folder (one pass; a lost executor only re-reads
files), count rows per partition (one row per partition), turn the counts
into offsets, and add each row's position inside its partition. The offsets
table is bounded by the number of partitions, so broadcasting it is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

_P, _M, _W = "_gf_part", "_gf_mono", "_gf_weight"
POS_BITS = 33  # monotonically_increasing_id = (partition << 33) + position


def _sorted_with_position(df: DataFrame, order: list) -> DataFrame:
    s = df.sort(*order)
    s = s.withColumn(_P, F.spark_partition_id()).withColumn(_M, F.monotonically_increasing_id())
    path = scratch_path(df.sparkSession, "ordered")
    s.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _offsets(counts: DataFrame, value: str) -> DataFrame:
    w = Window.orderBy(_P).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(_P, F.coalesce(F.sum(value).over(w), F.lit(0)).alias("_off"))


def global_row_number(df: DataFrame, order: list, name: str = "row_number",
                      start: int | Column = 1) -> DataFrame:
    """``name`` = start + 0-based rank of the row in ``order`` (order must be
    total, e.g. end with a unique key)."""
    s = _sorted_with_position(df, order)
    offs = _offsets(s.groupBy(_P).agg(F.count(F.lit(1)).alias("_n")), "_n")
    local = F.col(_M) - F.shiftleft(F.col(_P).cast("long"), POS_BITS)
    out = s.join(F.broadcast(offs), _P).withColumn(name, F.lit(start) + F.col("_off") + local)
    return out.drop(_P, _M, "_off")


def global_exclusive_sum(df: DataFrame, order: list, weight: Column, name: str) -> DataFrame:
    """``name`` = sum of ``weight`` over the rows strictly before this row in
    ``order``. Within a partition the running sum is a window on the
    partition id (one extra shuffle; used only by the compatibility mode)."""
    s = _sorted_with_position(df.withColumn(_W, weight.cast("long")), order)
    offs = _offsets(s.groupBy(_P).agg(F.sum(_W).alias("_s")), "_s")
    w = Window.partitionBy(_P).orderBy(_M).rowsBetween(Window.unboundedPreceding, -1)
    out = (s.join(F.broadcast(offs), _P)
           .withColumn(name, F.col("_off") + F.coalesce(F.sum(_W).over(w), F.lit(0))))
    return out.drop(_P, _M, _W, "_off")


def format_id(prefix: str, n, digits: int = 6) -> Column:
    """``prefix`` + zero-padded number; wider numbers are not truncated
    (``lpad`` would cut them)."""
    return F.format_string(f"{prefix}%0{digits}d", F.col(n) if isinstance(n, str) else n)


class Ordered:
    """A table written once in global order. Rows are numbered from 0 and read back by ranges of numbers: only the files
    that hold a range are read, because the stored partition id is pushed to the scan. One row for each partition (its
    row count) reaches the driver."""

    def __init__(self, df: DataFrame, order: list):
        self.stored = _sorted_with_position(df, order)
        counts = self.stored.groupBy(_P).agg(F.count(F.lit(1)).alias("_n")).orderBy(_P).collect()
        self.first, self.count = [], 0  # (partition, number of its first row)
        for p, n in counts:
            self.first.append((p, self.count))
            self.count += n

    def rows(self, start: int, stop: int, name: str = "_n") -> DataFrame:
        """The rows numbered ``start`` up to ``stop`` (exclusive), with their number."""
        ends = [f for _, f in self.first[1:]] + [self.count]
        held = [(p, f) for (p, f), e in zip(self.first, ends) if f < stop and e > start] or [(0, 0)]
        low, high, known = held[0][0], held[-1][0], dict(held)
        offs = ", ".join(f"{known.get(p, 0)}L" for p in range(low, high + 1))  # an array literal: no job of its own
        part = self.stored.where((F.col(_P) >= low) & (F.col(_P) <= high))
        local = F.col(_M) - F.shiftleft(F.col(_P).cast("long"), POS_BITS)
        out = part.withColumn(name, F.expr(f"element_at(array({offs}), {_P} - {low - 1})") + local)
        return out.where((F.col(name) >= start) & (F.col(name) < stop)).drop(_P, _M)


def wave_ranges(total: int, first: int, largest: int) -> list[tuple[int, int]]:
    """Ranges of numbers that double from ``first`` rows to ``largest``: few waves, of which the early ones are small."""
    out, at, size = [], 0, max(1, first)
    while at < total:
        out.append((at, min(total, at + size)))
        at, size = at + size, min(2 * size, max(first, largest))
    return out


def narrow_row_number(df: DataFrame, order: list, key: str, name: str = "row_number", start: int = 1) -> DataFrame:
    """``df`` with ``name``, its number in ``order``. Only the order columns and ``key`` (unique) are sorted and written; the
    numbers are joined back to the rows by ``key``."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    narrow = df.select(F.col(key), *[c.alias(f"_o{i}") for i, c in enumerate(cols)])
    numbered = global_row_number(narrow, [f"_o{i}" for i in range(len(cols))] + [key], name, start)
    return df.join(numbered.select(key, name), key)

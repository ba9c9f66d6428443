"""Types of a column over several inputs: a lattice for the common type, and
casts that lose no row.

Each input is cast on its own, before the union. A column with a declared type
gets that type; any other gets the least type that holds the values of all
inputs (whole numbers widen, mixed numbers become doubles, dates become
timestamps, everything else becomes text). A cell that has no value in the new
type becomes null by itself, and its text is kept in a map on the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESCUED = "_rescued"
_WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
_NESTED = (T.StructType, T.ArrayType, T.MapType)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds every value of both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if a in _WHOLE and b in _WHOLE:
        return max(a, b, key=_WHOLE.index)
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
            scale = max(a.scale, b.scale)
            whole = max(a.precision - a.scale, b.precision - b.scale)
            if whole + scale <= 38:
                return T.DecimalType(whole + scale, scale)
        return T.DoubleType()
    if {type(a), type(b)} <= {T.DateType, T.TimestampType}:
        return T.TimestampType()
    return T.StringType()


def safe_cast(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """``c`` as ``want``; null where a value has none. Text of a whole number may be written as ``3.0``."""
    if have == want:
        return c
    if isinstance(want, T.StringType):
        return F.to_json(c) if isinstance(have, _NESTED) else c.cast("string")
    if want in _WHOLE:
        if have in _WHOLE:
            return c.try_cast(want)
        text = c.cast("string")
        d = text.try_cast("double")
        return F.coalesce(text.try_cast(want), F.when(d == F.floor(d), d.try_cast(want)))
    if isinstance(have, T.StringType) or isinstance(have, _NESTED):
        return (F.to_json(c) if isinstance(have, _NESTED) else c).try_cast(want)
    return c.cast("string").try_cast(want)


def reconcile(frames: list[DataFrame], declared: dict[str, T.DataType], keep_rescued: bool = False) -> list[DataFrame]:
    """The inputs with one type for each column name; with ``keep_rescued`` each row has ``_rescued``, a map from column to
    the text of a cell that has no value in its type (empty if there is none)."""
    seen: dict[str, list[T.DataType]] = {}
    for df in frames:
        for f in df.schema.fields:
            seen.setdefault(f.name, []).append(f.dataType)
    wanted = {c: declared.get(c) or reduce(common_type, ts) for c, ts in seen.items()}
    out = []
    for df in frames:
        cols, lost = [], []
        for f in df.schema.fields:
            old = F.col(f"`{f.name}`")
            new = safe_cast(old, f.dataType, wanted[f.name])
            cols.append(new.alias(f.name))
            if new is not old:
                text = F.to_json(old) if isinstance(f.dataType, _NESTED) else old.cast("string")
                lost += [F.lit(f.name), F.when(new.isNull(), text)]
        if keep_rescued:
            empty = F.create_map().cast("map<string,string>")
            cols.append((F.map_filter(F.create_map(*lost), lambda _, v: v.isNotNull()) if lost else empty).alias(RESCUED))
        out.append(df.select(*cols))
    return out

"""Directory-of-workbooks ingest (S2): ``.xlsx`` files read with the
``binaryFile`` source and decoded once, each in one task, into cells as rows
(standard library zip + XML; no spreadsheet package is required). The cells
are written; header names, their order and the rows of the table are then
plain DataFrame work over them. The first worksheet's first row is the header
(a name that repeats in one workbook gets ``.1``, ``.2``, ...); every cell is
text (as for CSV).

Output columns: the union of all headers, in first-seen order, plus the
file path and row number used for first-copy-wins ordering.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
      "p": "http://schemas.openxmlformats.org/package/2006/relationships"}
_CELL = re.compile(r"([A-Z]+)([0-9]+)")


def _col_index(ref: str) -> int:
    letters = _CELL.match(ref).group(1)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = wb.find("m:sheets/m:sheet", NS)
    rid = sheet.get(f"{{{NS['r']}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for rel in rels.findall("p:Relationship", NS):
        if rel.get("Id") == rid:
            target = rel.get("Target").lstrip("/")
            return target if target.startswith("xl/") else f"xl/{target}"
    return "xl/worksheets/sheet1.xml"


def _text(el) -> str:
    return "".join(t.text or "" for t in el.iter(f"{{{NS['m']}}}t"))


def workbook_rows(content: bytes) -> list[list[str | None]]:
    """Rows of the first worksheet as lists of cell texts (None = empty)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_text(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", NS)]
        sheet = ET.fromstring(z.read(_first_sheet(z)))
    rows = []
    for row in sheet.iter(f"{{{NS['m']}}}row"):
        cells: dict[int, str | None] = {}
        for c in row.findall("m:c", NS):
            t = c.get("t")
            v = c.find("m:v", NS)
            if t == "s" and v is not None:
                val = shared[int(v.text)]
            elif t == "inlineStr":
                is_ = c.find("m:is", NS)
                val = _text(is_) if is_ is not None else ""
            elif t == "b" and v is not None:
                val = "TRUE" if v.text == "1" else "FALSE"
            else:
                val = v.text if v is not None else None
                if val is not None and re.fullmatch(r"-?[0-9]+\.0", val):
                    val = val[:-2]
            cells[_col_index(c.get("r"))] = val
        width = max(cells) + 1 if cells else 0
        rows.append([cells.get(i) for i in range(width)])
    return rows


_CELLS = "path string, row long, col int, value string"
_ROW = -1  # the column of the entry that every row has, cells or not


def _decode(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            found = [(n, k, v) for n, cells in enumerate(workbook_rows(content.as_py()))
                     for k, v in [(_ROW, None), *enumerate(cells)]]
            for at in range(0, len(found), 10_000):
                n, k, v = zip(*found[at:at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(n), pa.string()), pa.array(n, pa.int64()),
                                                  pa.array(k, pa.int32()), pa.array(v, pa.string())],
                                                 names=["path", "row", "col", "value"])


def workbook_table(files: DataFrame) -> DataFrame:
    """The rows of all workbooks in ``files`` (path, content) as one table."""
    spark = files.sparkSession
    path = scratch_path(spark, "xlsx-cells")
    files.select("path", "content").mapInArrow(_decode, _CELLS).write.parquet(path)
    cells = spark.read.parquet(path)
    same = Window.partitionBy("path", "name").orderBy("col")
    head = (cells.where(f"col <> {_ROW}").groupBy("path", "col").agg(F.max(F.when(F.col("row") == 0, F.col("value"))).alias("value"))
            .select("path", "col", F.coalesce("value", F.concat(F.lit("_c"), F.col("col").cast("string"))).alias("name"))
            .withColumn("n", F.row_number().over(same) - 1)
            .select("path", "col", F.when(F.col("n") > 0, F.concat_ws(".", "name", F.col("n").cast("string")))
                    .otherwise(F.col("name")).alias("name")))
    first = head.groupBy("name").agg(F.min(F.struct("path", "col")).alias("first"))
    names = [r[0] for r in first.orderBy("first").select("name").collect()]  # the columns of the result
    entry = F.when(F.col("name").isNotNull(), F.struct("name", "value"))
    rows = (cells.where("row > 0").join(head, ["path", "col"], "left").groupBy("path", "row")
            .agg(F.map_from_entries(F.collect_list(entry)).alias("cells")))
    return rows.select(*[F.try_element_at("cells", F.lit(n)).alias(n) for n in names], F.col("path").alias("_xlsx_path"),
                       F.col("row").alias("_xlsx_row"))


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """All ``*.xlsx`` under ``path`` (a file or a folder) as one table."""
    return workbook_table(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path))

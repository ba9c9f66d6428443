"""Deterministic stand-in backends used by the registered queries and the
tests: they derive their answer from the prompt only, so the same result
can be written in SQL for the oracle."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa


def copy_backend(model: dict):
    """Answers ``<model_id> saw <n> chars``; raises a quota error for model
    ``prefix`` when n % 53 == 0 and a timeout for model ``copy`` when
    n % 31 == 0."""
    name = model.get("model_name")
    mid = model.get("model_id")

    def call(prompt: str) -> str:
        n = len(prompt)
        if name == "prefix" and n % 53 == 0:
            raise RuntimeError("429 quota exceeded")
        if name == "copy" and n % 31 == 0:
            raise TimeoutError("timeout")
        return f"{mid} saw {n} chars"
    return call


def judge_backend(model: dict):
    """Four sub-scores from the prompt length, no overall line (so the
    parser's mean fallback is used); the clarity value carries '/10'."""
    def call(prompt: str) -> str:
        n = len(prompt)
        return (f"CORRECTNESS: {n % 11}\nCOMPLETENESS: {(n // 3) % 11}\n"
                f"CLARITY: {(n // 7) % 11}/10\nCOGNITIVE_ALIGNMENT: {(n // 11) % 11}\n"
                f"JUSTIFICATION: length {n}")
    return call


def labeller_backend(model: dict):
    """LEVEL from the prompt length (0, 7 and 8 are invalid levels)."""
    def call(prompt: str) -> str:
        n = len(prompt)
        return f"LEVEL: {n % 9} (x)\nNAME: ignored\nCONFIDENCE: 0.{n % 100}\nJUSTIFICATION: length {n}"
    return call


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006/relationships"


def workbook(header: list[str], rows) -> bytes:
    """A minimal workbook of text cells; a null has no cell."""
    def row(n, cells):
        inner = "".join(f'<c r="{chr(65 + k)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
                        for k, v in enumerate(cells) if v is not None)
        return f'<row r="{n}">{inner}</row>'
    sheet = "".join(row(n, cells) for n, cells in enumerate([header, *rows], 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PKG}"><Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(df):
    """(path, content): the rows of a table of text columns as workbooks, one for each batch of a partition."""
    names = df.columns

    def write(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            rows = zip(*[c.to_pylist() for c in b.columns])
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"book-{part:05d}-{k:05d}.xlsx"]),
                                              "content": pa.array([workbook(names, rows)], pa.binary())})
    return df.mapInArrow(write, "path string, content binary")

"""Workbooks (xlsx) as DataFrames: whole files by Spark's binary reader, one sheet each by the standard library.

A sheet of a workbook is a relation of texts: its first row names the columns, shorter rows are filled with nulls.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(reference: str) -> int:
    """A1 is 0, B7 is 1, AA3 is 26."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """The cells of the named sheet, or else of the first."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{MAIN}t"))
        shared = [text(n) for n in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(LINK)]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
        target = next((t for n, t in sheets if n == sheet), sheets[0][1])
        rows = []
        for row in ElementTree.fromstring(z.read(f"xl/{target.removeprefix('/xl/')}")).iter(f"{MAIN}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{MAIN}c"):
                at = column_number(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value = c.find(f"{MAIN}v")
                if c.get("t") == "inlineStr":
                    cells[at] = text(c)
                elif value is not None:
                    cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
            rows.append(cells)
        return rows


def workbook_bytes(rows: list[list], sheet: str = "Sheet1") -> bytes:
    """A workbook with one sheet of texts."""
    out = io.BytesIO()
    body = "".join("<row>" + "".join("<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for v in row) + "</row>" for row in rows)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINK[1:-3]}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def parsed(files: DataFrame, columns: list[str], sheet: str | None = None) -> DataFrame:
    """(path, pos, columns...) of files (path, content); a column that a workbook lacks is null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                head, *rows = sheet_rows(content, sheet) or [[]]
                at = {str(h).strip().upper(): i for i, h in enumerate(head) if h is not None}
                where = [at.get(c.upper()) for c in columns]
                out += [(path, n, *(r[i] if i is not None and i < len(r) else None for i in where)) for n, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["path", "pos", *columns])

    return files.select("path", "content").mapInPandas(run, "path string, pos long, " + ", ".join(f"`{c}` string" for c in columns))


def read_workbooks(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None) -> DataFrame:
    return parsed(spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("content")), columns, sheet)


def as_workbooks(rows: DataFrame, key: str, columns: list[str], sheet: str = "Sheet1") -> DataFrame:
    """(path, content): a workbook for each value of ``key``, which bounds a workbook's size."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = pdf.sort_values(columns)[columns].astype(object).where(lambda x: x.notna(), None)
        return pd.DataFrame({"path": [f"{pdf[key].iloc[0]}.xlsx"], "content": [workbook_bytes([columns, *cells.values.tolist()], sheet)]})

    return rows.groupBy(key).applyInPandas(build, "path string, content binary")

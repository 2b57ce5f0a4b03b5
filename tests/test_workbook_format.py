"""The workbook data source: partitions, inference, push-down, commit and abort."""

from __future__ import annotations

import os
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import workbook_format
from loomgraph.sources.workbooks import LINK, MAIN, workbook_bytes


@pytest.fixture(scope="module")
def source(spark):
    workbook_format.register(spark)
    return spark


def two_sheets(first: list[list], second: list[list]) -> bytes:
    """A workbook with sheets One and Two, out of two with one each."""
    out = BytesIO()
    with zipfile.ZipFile(BytesIO(workbook_bytes(first, "One"))) as a, zipfile.ZipFile(BytesIO(workbook_bytes(second))) as b, zipfile.ZipFile(out, "w") as z:
        for n in a.namelist():
            if n not in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels"):
                z.writestr(n, a.read(n))
        z.writestr("xl/worksheets/sheet2.xml", b.read("xl/worksheets/sheet1.xml"))
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINK[1:-3]}"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.xlsx").write_bytes(two_sheets([[" Name", "N", "name"], ["x", "1", "later"], ["y"]], [["n", "other"], ["7", "o"]]))
    (tmp_path / "in/sub/b.xlsx").write_bytes(workbook_bytes([["NAME", None, "N"], [None, "skip", "3"], ["é <&>", None, "4", "more"]], "Two"))
    (tmp_path / "in/c.xlsx").write_bytes(workbook_bytes([]))
    (tmp_path / "in/notes.txt").write_text("no workbook")
    (tmp_path / "in/_temporary-1").mkdir()
    (tmp_path / "in/_temporary-1/d.xlsx").write_bytes(workbook_bytes([["Name"], ["unfinished"]]))
    return str(tmp_path / "in")


def test_reads_by_sheet(source, folder):
    found = source.read.format("workbooks").load(folder)
    assert found.columns == ["_path", "_sheet", "_row", "Name", "N"]
    rows = {(os.path.basename(r._path), r._sheet, r._row, r.Name, r.N) for r in found.collect()}
    assert rows == {("a.xlsx", "One", 0, "x", "1"), ("a.xlsx", "One", 1, "y", None), ("b.xlsx", "Two", 0, None, "3"), ("b.xlsx", "Two", 1, "é <&>", "4")}
    named = source.read.format("workbooks").option("sheet", "Two").schema("n string, none string").load(folder)
    assert sorted((r.n, r.none) for r in named.collect()) == [("3", None), ("4", None), ("7", None)]
    assert source.read.format("workbooks").option("sheet", "*").load(f"{folder}/*.xlsx").rdd.getNumPartitions() == 3


def test_pushes_filters_down(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = workbook_format.WorkbookReader(folder, "*", workbook_format.PLACE)
    rest = list(reader.pushFilters([EqualTo(("_sheet",), "Two"), GreaterThan(("_row",), 1), In(("_path",), (f"{folder}/a.xlsx", "x"))]))
    assert rest == [GreaterThan(("_row",), 1)]
    assert [(os.path.basename(p.path), p.sheet) for p in reader.partitions()] == [("a.xlsx", "Two")]


def test_filters_through_spark(source, folder):
    found = source.read.format("workbooks").option("sheet", "*").schema("_path string, _sheet string, n string").load(folder).where("_sheet = 'Two' and n > '3'")
    assert sorted(r.n for r in found.collect()) == ["4", "7"] and found.rdd.getNumPartitions() == 2


def test_writes_all_or_nothing(source, tmp_path):
    rows = source.range(0, 1000, 1, 4).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("n<"), F.col("id"))).alias("name"))
    path = str(tmp_path / "out")
    rows.write.format("workbooks").option("rowsPerFile", 100).mode("append").save(path)
    assert len([f for f in os.listdir(path) if f.endswith(".xlsx")]) == 12 and "_SUCCESS" in os.listdir(path)
    read = source.read.format("workbooks").load(path).select(F.col("id").cast("long"), "name")
    assert sorted(map(tuple, read.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    before = sorted(os.listdir(path))
    failing = rows.select("id", F.when(F.col("id") == 999, F.raise_error(F.lit("stop"))).otherwise("x").cast("string").alias("name"))
    with pytest.raises(Exception, match="stop"):
        failing.write.format("workbooks").mode("append").save(path)
    assert sorted(os.listdir(path)) == before
    rows.limit(3).write.format("workbooks").mode("overwrite").save(path)
    assert source.read.format("workbooks").load(path).count() == 3


def test_empty_folder_needs_a_schema(source, tmp_path):
    with pytest.raises(Exception, match="name a schema"):
        source.read.format("workbooks").load(str(tmp_path)).collect()
    assert source.read.format("workbooks").schema("a string").load(str(tmp_path)).count() == 0

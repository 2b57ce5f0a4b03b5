"""Workbooks (xlsx) as a data source of Spark: ``spark.read.format("workbooks")`` and ``df.write.format("workbooks")``.

Reading. A partition is one sheet of one file. All columns are texts named by the sheet's first row; ``_path``, ``_sheet`` and
``_row`` say where a row stands. Without a schema the columns are those of the first file's sheet. Option ``sheet`` names the sheet;
a file without it gives its first one; ``sheet=*`` means all sheets. Comparisons of ``_path`` and ``_sheet`` with values are pushed
down where ``spark.sql.python.filterPushdown.enabled`` is set, so that files and sheets they exclude aren't opened.
A sheet is parsed as a stream: a task holds one row of it, beside the file's shared strings.

Writing. A task writes its rows to files of at most ``rowsPerFile`` rows in a folder of the job's own; the driver's commit moves
them to their place and an abort, after any task's failure, deletes the folder, so readers see all of a job or nothing.

Files are opened by pyarrow's file systems (local paths and the URIs that it knows). For stores that only Spark's readers
reach there is ``workbooks.read_workbooks``.

Defined results: headers are trimmed, their case doesn't matter; of equal headers the first counts; columns that a sheet lacks and
the missing cells of short rows are null; an empty sheet, or one with a header only, has no rows; an empty folder needs a schema.
"""

from __future__ import annotations

import fnmatch
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .workbooks import LINK, MAIN, column_number, workbook_bytes

PLACE = StructType([StructField("_path", StringType()), StructField("_sheet", StringType()), StructField("_row", LongType())])
ROWS_PER_FILE = 100_000


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The workbooks of a file, a folder with its sub-folders, or a pattern; hidden ones and those of unfinished jobs are left out."""
    from pyarrow import fs

    system, at = opened(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    if "*" in at or "?" in at:
        base = at.split("*", 1)[0].split("?", 1)[0].rpartition("/")[0] or "/"
        parts = at.split("/")
        fits = lambda p: len(p) == len(parts) and all(map(fnmatch.fnmatchcase, p, parts))
        found = [f.path for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if fits(f.path.split("/"))]
    elif system.get_file_info(at).type == fs.FileType.Directory:
        found = [f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File]
        found = [f for f in found if not any(p.startswith(("_", ".")) for p in f[len(at) :].split("/"))]
    else:
        found = [at]
    return sorted(prefix + f for f in found if f.lower().endswith(".xlsx"))


class Book:
    """An open workbook: its sheets by name, and the rows of one of them as a stream."""

    def __init__(self, path: str):
        system, at = opened(path)
        self.zip = zipfile.ZipFile(system.open_input_file(at))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = {s.get("name"): targets[s.get(LINK)] for s in ElementTree.fromstring(self.zip.read("xl/workbook.xml")).iter(f"{MAIN}sheet")}

    def __enter__(self) -> Book:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()

    def named(self, sheet: str | None) -> list[str]:
        if sheet == "*":
            return list(self.sheets)
        return [sheet if sheet in self.sheets else next(iter(self.sheets))]

    def rows(self, sheet: str) -> Iterator[list[str | None]]:
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{MAIN}t"))
        has = "xl/sharedStrings.xml" in self.zip.namelist()
        shared = [text(n) for n in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml"))] if has else []
        with self.zip.open(f"xl/{self.sheets[sheet].removeprefix('/xl/')}") as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag != f"{MAIN}row":
                    continue
                cells: list[str | None] = []
                for c in node.iter(f"{MAIN}c"):
                    at = column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value = c.find(f"{MAIN}v")
                    if c.get("t") == "inlineStr":
                        cells[at] = text(c)
                    elif value is not None:
                        cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
                yield cells
                node.clear()


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str

    def __post_init__(self) -> None:
        super().__init__((self.path, self.sheet))


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, schema: StructType):
        self.path, self.sheet, self.schema = path, sheet, schema
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in ("_path", "_sheet"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[column] = self.only.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[Sheet]:
        found, paths, sheets = [], self.only.get("_path"), self.only.get("_sheet")
        for path in files_of(self.path):
            if paths is None or path in paths:
                with Book(path) as book:
                    found += [Sheet(path, s) for s in book.named(self.sheet) if sheets is None or s in sheets]
        return found

    def read(self, partition: Sheet) -> Iterator[tuple]:
        if partition is None:  # there are no files
            return
        with Book(partition.path) as book:
            rows = book.rows(partition.sheet)
            at: dict[str, int] = {}
            for i, h in enumerate(next(rows, [])):
                if h is not None:
                    at.setdefault(h.strip().upper(), i)
            where = [f.name if f.name in PLACE.names else at.get(f.name.strip().upper()) for f in self.schema]
            for n, cells in enumerate(rows):
                place = {"_path": partition.path, "_sheet": partition.sheet, "_row": n}
                yield tuple(place[i] if isinstance(i, str) else cells[i] if i is not None and i < len(cells) else None for i in where)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]] = field(default_factory=list)


class WorkbookWriter(DataSourceWriter):
    def __init__(self, path: str, sheet: str, rows_per_file: int, columns: list[str], overwrite: bool):
        self.path, self.sheet, self.rows_per_file, self.columns, self.overwrite = path.rstrip("/"), sheet, rows_per_file, columns, overwrite
        self.job = uuid.uuid4().hex
        self.own = f"{self.path}/_temporary-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        context, done, held = TaskContext.get(), Written(), []
        system, own = opened(self.own)
        system.create_dir(own, recursive=True)

        def flush() -> None:
            name = f"part-{context.partitionId():05d}-{len(done.files):03d}-{self.job[:8]}-{context.attemptNumber()}.xlsx"
            with system.open_output_stream(f"{own}/{name}") as out:
                out.write(workbook_bytes([self.columns, *held], self.sheet))
            done.files.append((name, len(held)))
            held.clear()

        for row in iterator:
            held.append(list(row))
            if len(held) >= self.rows_per_file:
                flush()
        if held:
            flush()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, at = opened(self.path)
        system.create_dir(at, recursive=True)
        before = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".xlsx")] if self.overwrite else []
        for message in messages:
            for name, _ in message.files if message else []:
                system.move(f"{at}/_temporary-{self.job}/{name}", f"{at}/{name}")
        for old in before:
            system.delete_file(old)
        self._drop()
        with system.open_output_stream(f"{at}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        from pyarrow import fs

        system, own = opened(self.own)
        if system.get_file_info(own).type == fs.FileType.Directory:
            system.delete_dir(own)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> StructType:
        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"no workbooks in {self.options['path']}: name a schema")
        with Book(files[0]) as book:
            header = next(book.rows(book.named(self.options.get("sheet"))[0]), [])
        names = list(dict.fromkeys(h.strip() for h in header if h and h.strip()))
        known: set[str] = set()
        names = [n for n in names if not (n.upper() in known or known.add(n.upper()))]
        return StructType([*PLACE.fields, *(StructField(n, StringType()) for n in names)])

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options["path"], self.options.get("sheet"), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        rows = int(self.options.get("rowsperfile", ROWS_PER_FILE))
        return WorkbookWriter(self.options["path"], self.options.get("sheet", "Sheet1"), rows, schema.names, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session; filters are pushed down to Python sources from here on."""
    spark.dataSource.register(WorkbookSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

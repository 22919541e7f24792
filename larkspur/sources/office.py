"""Word documents in, spreadsheets out: both are zip containers of XML, read and written as streams inside tasks."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from larkspur.operators.profiles import MOST_BYTES, file_format

# Where a Word document's text is, why a file can't be read, and the names in the XML.
BODY = "word/document.xml"
NO_FORMAT, BROKEN, NO_WORD, TOO_LARGE = "That file is not a PDF or a Word document.", "That Word document could not be opened.", "That file is a zip archive, but not a Word document.", "That Word document is too large once unpacked."
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS, _PACKAGE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
#: Rows of a sheet, its head included.
MOST_ROWS = 1_048_576


class _Limited:
    """A stream that ends in an error after so many bytes, whatever its container says of its size."""

    def __init__(self, stream, most: int) -> None:
        self.stream, self.left = stream, most

    def read(self, n: int = -1) -> bytes:
        got = self.stream.read(n)
        self.left -= len(got)
        if self.left < 0:
            raise OverflowError
        return got


def _text(p: ElementTree.Element) -> str:
    """A paragraph's text with its tabs and breaks; what tables and boxes inside it say is theirs."""
    out = []
    for e in p.iter():
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr", f"{_W}noBreakHyphen"):
            out.append({"tab": "\t", "noBreakHyphen": "-"}.get(e.tag[len(_W) :], "\n"))
    return "".join(out)


def word_text(content: bytes, most: int = MOST_BYTES) -> tuple[str | None, str | None]:
    """(text, error) of a Word document: its paragraphs, then the cells of its tables, without blank ones. Elements are dropped as soon as they are read."""
    try:
        with zipfile.ZipFile(BytesIO(content)) as z:
            names = z.namelist()
            if BODY not in names:
                return None, NO_WORD
            if sum(i.file_size for i in z.infolist()) > most:
                return None, TOO_LARGE
            paragraphs, cells, tables, cell, level = [], [], 0, [], 0
            with z.open(BODY) as f:
                for event, e in ElementTree.iterparse(_Limited(f, most), events=("start", "end")):
                    if e.tag == f"{_W}tbl":
                        tables += 1 if event == "start" else -1
                    elif e.tag == f"{_W}p":
                        level += 1 if event == "start" else -1
                        if event == "end" and level == 0:
                            if tables == 0:
                                paragraphs.append(_text(e))
                            elif tables == 1:
                                cell.append(_text(e))
                            e.clear()
                    elif e.tag == f"{_W}tc" and tables == 1 and event == "end":
                        cells.append("\n".join(cell))
                        cell = []
                        e.clear()
            return "\n".join(x for x in paragraphs + cells if x.strip()), None
    except OverflowError:
        return None, TOO_LARGE
    except (zipfile.BadZipFile, ElementTree.ParseError, RuntimeError, NotImplementedError, EOFError, OSError, ValueError):
        return None, BROKEN


def cv_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: (path, content) of uploaded files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def cv_text(content: Column) -> Column:
    """SRC-12: struct of a Word document's text, or of the error that keeps it from being read; both null for a PDF, whose text nothing here reads.

    Files are handed over a few at a time, without Arrow: ten thousand of them in a batch would all be held at once.
    """

    @F.udf("text string, error string", useArrow=False)
    def read(file: bytes | None) -> tuple[str | None, str | None]:
        return (None, None) if file is None else word_text(bytes(file))

    kind = file_format(content)
    return F.when(kind == "docx", read(content)).when(kind == "pdf", F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("error"))).otherwise(F.struct(F.lit(None).cast("string").alias("text"), F.lit(NO_FORMAT).alias("error")))


def _clean(value) -> str:
    return escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", "" if value is None else str(value)))


def _line(values: list, at: int, bold: bool) -> str:
    style = ' s="1"' if bold else ""
    return f'<row r="{at}">' + "".join(f'<c{style} t="inlineStr"><is><t xml:space="preserve">{_clean(v)}</t></is></c>' for v in values) + "</row>"


def write_workbook(stream, sheet: str, labels: list[str], rows: Iterator[list]) -> int:
    """One sheet with a bold head that stays in view, all cells text; rows are written as they come. The number of rows."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    part = lambda name, kind: f'<Override PartName="{name}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{kind}+xml"/>'
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + part("/xl/workbook.xml", "sheet.main") + part("/xl/worksheets/sheet1.xml", "worksheet") + part("/xl/styles.xml", "styles") + "</Types>")
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_SHEET}" xmlns:r="{_LINKS}"><sheets><sheet name="{_clean(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_LINKS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_LINKS}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{_SHEET}"><fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts><fills count="1"><fill><patternFill patternType="none"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        n = 0
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(f'{head}<worksheet xmlns="{_SHEET}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>{_line(labels, 1, True)}'.encode())
            for n, values in enumerate(rows, 1):
                if n >= MOST_ROWS:
                    raise ValueError(f"a sheet holds {MOST_ROWS} rows")
                f.write(_line(values, n + 1, False).encode())
            f.write(b"</sheetData></worksheet>")
    return n


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


class _WorkbookWriter(DataSourceArrowWriter):
    """A workbook a task, written under a name of its own and renamed when all have ended well."""

    def __init__(self, path: str, sheet: str, labels: list[str]) -> None:
        self.path, self.sheet, self.labels = path, sheet, labels

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        files, path = self._files()
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.xlsx"
        files.create_dir(path, recursive=True)
        rows = (values for b in iterator for values in zip(*(c.to_pylist() for c in b.columns)))
        with files.open_output_stream(f"{path}/_{context.taskAttemptId()}-{name}") as out:
            n = write_workbook(out, self.sheet, self.labels, rows)
        return _Written(f"_{context.taskAttemptId()}-{name}", n)

    def commit(self, messages) -> None:
        files, path = self._files()
        for m in messages:
            if m is not None:
                files.move(f"{path}/{m.name}", f"{path}/{m.name.split('-', 1)[1]}")

    def abort(self, messages) -> None:
        files, path = self._files()
        for m in messages:
            if m is not None:
                files.delete_file(f"{path}/{m.name}")


class Workbooks(DataSource):
    """Format xlsx, for writing: option sheet names the sheet, columns are its head."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _WorkbookWriter(self.options["path"], self.options.get("sheet", "Sheet1"), schema.names)


def export_xlsx(rows: DataFrame, path: str, *order: str | Column, sheet: str = "Jobs", most: int = MOST_ROWS - 1) -> None:
    """SNK-02: rows as workbooks in a folder, a new one: one workbook as long as its rows fit a sheet, else as many as it takes, in order.

    Columns are the labels of the head, see files.export_rows(). Nothing is gathered: a task writes its workbook row by row
    to the folder, which all executors must be able to write to. No rows give one workbook with the head alone.
    """
    spark = rows.sparkSession
    spark.dataSource.register(Workbooks)
    n = max(1, -(-rows.count() // most))
    if n == 1:
        dealt = rows.repartition(1)
    else:  # ranges differ in size: as many that the largest fits is left to more, smaller ones
        dealt = rows.repartitionByRange(2 * n, *(order or [F.col(f"`{rows.columns[0]}`")]))
    (dealt.sortWithinPartitions(*order) if order else dealt).write.format("xlsx").mode("append").option("sheet", sheet).save(path)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, at, bold, cells) of each row of the workbooks in a folder, and whether the head stays in view: frozen."""

    def rows(batches):
        import pyarrow as pa

        tag = lambda x: f"{{{_SHEET}}}{x}"
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                with zipfile.ZipFile(BytesIO(content)) as z:
                    sheet = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f".//{tag('sheet')}").get("name")
                    styles = ElementTree.fromstring(z.read("xl/styles.xml"))
                    fonts = [f.find(tag("b")) is not None for f in styles.find(tag("fonts"))]
                    bold = [fonts[int(x.get("fontId"))] for x in styles.find(tag("cellXfs"))]
                    frozen, out = False, []
                    with z.open("xl/worksheets/sheet1.xml") as f:
                        for _, e in ElementTree.iterparse(f):
                            if e.tag == tag("pane"):
                                frozen = e.get("state") == "frozen" and e.get("topLeftCell") == "A2"
                            elif e.tag == tag("row"):
                                out.append((name, sheet, int(e.get("r")), all(bold[int(c.get("s", "0"))] for c in e) if len(e) else False, ["".join(c.itertext()) for c in e], frozen))
                                e.clear()
                                if len(out) == 1000:
                                    yield _batch(pa, out)
                                    out = []
                    yield _batch(pa, out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInArrow(rows, "file string, sheet string, at int, bold boolean, cells array<string>, frozen boolean")


def _batch(pa, rows: list[tuple]):
    kinds = (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "sheet", "at", "bold", "cells", "frozen"])

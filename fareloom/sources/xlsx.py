"""Workbooks (XLSX) as rows: a Python table function over the bytes of each file, files dealt to tasks by Spark."""

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS = "sheet string, row long, cells map<string,string>"


def _column(reference: str) -> int:
    """The place of a cell such as AB12 in its row, from 1."""
    place = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        place = place * 26 + ord(letter) - ord("A") + 1
    return place


def _text(element) -> str:
    """All text runs of a string, without phonetic hints."""
    hints = {id(t) for hint in element.iter(f"{_MAIN}rPh") for t in hint.iter(f"{_MAIN}t")}
    return "".join(t.text or "" for t in element.iter(f"{_MAIN}t") if id(t) not in hints)


def _sheets(book: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """Name and part of each sheet, in the workbook's order."""
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {link.get("Id"): posixpath.normpath(posixpath.join("/xl", link.get("Target"))).lstrip("/") for link in links}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        yield sheet.get("name"), targets[sheet.get(_LINK)]


def _rows(part, shared: list[str]) -> Iterator[tuple[int, dict[int, str]]]:
    """Number and filled cells of each row of a sheet, read as a stream."""
    number = 0
    for _, row in ElementTree.iterparse(part):
        if row.tag != f"{_MAIN}row":
            continue
        number, place, cells = int(row.get("r") or number + 1), 0, {}
        for cell in row.iter(f"{_MAIN}c"):
            place = _column(cell.get("r") or "") or place + 1
            kind, value, inline = cell.get("t"), cell.find(f"{_MAIN}v"), cell.find(f"{_MAIN}is")
            if kind == "inlineStr" and inline is not None:
                said = _text(inline)
            elif value is None or value.text is None:
                continue
            else:
                said = shared[int(value.text)] if kind == "s" else {"1": "true", "0": "false"}.get(value.text) if kind == "b" else value.text
            if said:
                cells[place] = said
        row.clear()
        if cells:
            yield number, cells


@F.udtf(returnType=ROWS)
class WorkbookRows:
    """``ROWS`` of a workbook: the first filled row of a sheet names the columns (trimmed, lower case; the first of equal names counts)."""

    def eval(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            names = set(book.namelist())
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = [_text(item) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
            for sheet, part in _sheets(book):
                if part not in names:
                    continue
                header = None
                with book.open(part) as opened:
                    for number, cells in _rows(opened, shared):
                        if header is None:
                            header = {}
                            for place, said in cells.items():
                                if said.strip().lower() not in header.values():
                                    header[place] = said.strip().lower()
                            continue
                        yield sheet, number, {header[place]: said for place, said in cells.items() if place in header}


def read_xlsx(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None) -> DataFrame:
    """file, sheet, row and ``columns`` (texts, by the names in each sheet's first filled row) of all workbooks below ``path``.

    Cells that are empty and columns that a sheet lacks are null; numbers are the texts that the file has, formulas their stored values, rows without
    a filled cell are left out. A workbook is read whole by one task, which the format bounds at about a million rows a sheet; a file that is no
    workbook fails the job with its path's task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "content")
    found = files.lateralJoin(WorkbookRows(F.col("content").outer())).drop("content")
    if sheet is not None:
        found = found.where(F.col("sheet") == sheet)
    return found.select("file", "sheet", "row", *(F.try_element_at("cells", F.lit(c.strip().lower())).alias(c) for c in columns))

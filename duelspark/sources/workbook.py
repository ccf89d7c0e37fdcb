"""First sheet of OOXML workbooks as strings, as a Python data source (``format("workbook")``).

Reads with the standard library's zip and XML modules, row by row. The old binary format is refused.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")) for x in root.iter(f"{_MAIN}numFmt") if re.search("[dy]", re.sub(r'"[^"]*"', "", x.get("formatCode", "").lower()))}
    cells = root.find(f"{_MAIN}cellXfs")
    return {k for k, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


def read_rows(file) -> Iterator[list[str]]:
    """Rows of the first sheet; cells that hold dates come as ISO text, empty ones as ''."""
    with zipfile.ZipFile(file) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in x.iter(f"{_MAIN}t")) for x in root.iter(f"{_MAIN}si")]
        dates = _date_styles(book)
        sheets = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))
        with book.open(sheets[0]) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: dict[int, str] = {}
                for cell in row.iter(f"{_MAIN}c"):
                    value = cell.find(f"{_MAIN}v")
                    text = (value.text or "") if value is not None else "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    if cell.get("t") == "s" and text:
                        text = shared[int(text)]
                    elif text and cell.get("t") in (None, "n"):
                        number = float(text)
                        if int(cell.get("s", -1)) in dates:
                            text = (datetime(1899, 12, 30) + timedelta(days=number)).strftime("%Y-%m-%d")
                        elif number == int(number):
                            text = str(int(number))
                    cells[_column(cell.get("r"))] = text
                row.clear()
                yield [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]  # a workbook is one archive

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = read_rows(partition.value)
        next(rows, None)
        for row in rows:
            yield tuple((row + [""] * self.width)[: self.width])


class Workbook(DataSource):
    """``spark.read.format("workbook").load(path)``; the header row names the columns."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _header(self) -> list[str]:
        path = self.options["path"]
        if path.lower().endswith(".xls"):
            raise ValueError("the binary workbook format isn't supported; save it as .xlsx")
        return next(read_rows(path), [])

    def schema(self) -> StructType:
        return StructType([StructField(n or f"_c{k}", StringType()) for k, n in enumerate(self._header())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self.options["path"], len(schema))

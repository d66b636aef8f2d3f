"""Workbook files (xlsx): first sheet, header row.

A workbook is a zip that one reader must open whole, so the unit of work is the
file: Spark spreads a folder of workbooks over tasks. A sheet holds at most
1,048,576 rows by the format itself.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.schemas import WORKBOOK_ROW

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DOC_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_BATCH = 5_000


def _text(node) -> str:
    """Text of a string item: its own, or its runs'; phonetic runs are no part of it."""
    runs = node.iterfind(f"{MAIN}r/{MAIN}t")
    return "".join(t.text or "" for t in [*node.iterfind(f"{MAIN}t"), *runs])


def column_name(index: int) -> str:
    name = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        name = chr(65 + rest) + name
    return name


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, str]:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets")[0]
    wanted = sheet.get(f"{DOC_REL}id")
    for relation in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if relation.get("Id") == wanted:
            target = relation.get("Target").lstrip("/")
            return sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"
    raise ValueError("workbook without a first sheet")


def _sheet_rows(content: bytes) -> Iterator[tuple[str, dict[str, str | None]]]:
    """Sheet name and cells by header name, for each row below the header."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        name, part = _first_sheet(book)
        header: dict[str, str] | None = None
        with book.open(part) as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag != f"{MAIN}row":
                    continue
                cells: dict[str, str | None] = {}
                for at, cell in enumerate(node):
                    value = cell.find(f"{MAIN}v")
                    kind = cell.get("t")
                    if kind == "inlineStr":
                        found = "".join(_text(s) for s in cell.iterfind(f"{MAIN}is"))
                    elif value is None:
                        found = None
                    elif kind == "s":
                        found = shared[int(value.text)]
                    else:
                        found = value.text
                    place = cell.get("r")
                    cells[place.rstrip("0123456789") if place else column_name(at)] = found
                node.clear()
                if header is None:
                    header = {k: v for k, v in cells.items() if v is not None}
                    if len(set(header.values())) < len(header):
                        raise ValueError(f"sheet {name} has a column name twice")
                else:
                    yield name, {h: cells.get(k) for k, h in header.items()}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows: list[tuple] = []
            for number, (sheet, cells) in enumerate(_sheet_rows(bytes(content)), 1):
                rows.append((path, sheet, number, cells))
                if len(rows) == _BATCH:
                    yield pd.DataFrame(rows, columns=WORKBOOK_ROW.names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=WORKBOOK_ROW.names)


def workbook_rows(files: DataFrame) -> DataFrame:
    """Rows of the first sheet of each workbook in (path, content)."""
    return files.select("path", "content").mapInPandas(_parse, WORKBOOK_ROW)


def sheet_columns(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed columns from the cells; what does not fit its type becomes null."""
    return rows.select(
        "path", F.col("row").alias("src_row"),
        *[
            F.element_at("cells", F.lit(f.name)).try_cast(f.dataType).alias(f.name)
            for f in schema.fields
        ],
    )


def read_workbooks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All workbooks at ``path`` (a file, folder or pattern) as one table."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return sheet_columns(workbook_rows(files), schema)

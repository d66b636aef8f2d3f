"""Tables written as workbook files, for the query that reads workbooks and for tests of the reader."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockledger.sources.workbooks import DOC_REL, MAIN, column_name

_TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns='
    '"http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType='
    '"application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType='
    '"application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType='
    '"application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
)
_RELS = (
    '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns='
    '"http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
    'relationships/{kind}" Target="{target}"/></Relationships>'
)


def _workbook_bytes(table: pd.DataFrame) -> bytes:
    names = [column_name(i) for i in range(len(table.columns))]
    rows = []
    for number, values in enumerate([tuple(table.columns), *table.itertuples(index=False)], 1):
        cells = [
            f'<c r="{column}{number}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}'
            "</t></is></c>"
            for column, value in zip(names, values)
            if isinstance(value, str)
        ]
        rows.append(f'<row r="{number}">{"".join(cells)}</row>')
    sheet = f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{"".join(rows)}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", _TYPES)
        book.writestr("_rels/.rels", _RELS.format(kind="officeDocument", target="xl/workbook.xml"))
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{DOC_REL[1:-1]}"><sheets>'
            '<sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            _RELS.format(kind="worksheet", target="worksheets/sheet1.xml"),
        )
        book.writestr("xl/worksheets/sheet1.xml", sheet.encode())
    return out.getvalue()


def to_workbooks(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """A table as workbook files: (path, content), one per Arrow batch of rows.

    ``tasks`` spreads the rows before the Python work; leave it out when the input
    already has enough partitions.

    Values are written as text. A batch is bounded by
    ``spark.sql.execution.arrow.maxRecordsPerBatch``, far below the row limit of a
    sheet. There is no index column.
    """
    spread = df if tasks is None else df.repartition(tasks)
    texts = spread.select([F.col(c).cast("string").alias(c) for c in df.columns])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, table in enumerate(batches):
            yield pd.DataFrame(
                {"path": [f"part-{task:05d}-{number:05d}.xlsx"], "content": [_workbook_bytes(table)]}
            )

    return texts.mapInPandas(build, "path string, content binary")

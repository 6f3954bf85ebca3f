"""Workbooks (zipped XML): a reader of all sheets, and a writer of one file for each partition."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from crewspark.shipping import ship
from crewspark.sources.delimited import read_rows

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(reference: str) -> int:
    """3 for C7."""
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def column_name(number: int) -> str:
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def sheets_of(raw: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of every row; cells that aren't there are empty texts."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
            at = f"xl/{targets[sheet.get(RELATION)]}"
            for k, row in enumerate(ElementTree.fromstring(z.read(at)).iter(f"{SHEET}row"), 1):
                cells: dict[int, str] = {}
                for c in row.iter(f"{SHEET}c"):
                    place = column_number(c.get("r", "")) or len(cells) + 1
                    value = c.find(f"{SHEET}v")
                    if c.get("t") == "inlineStr":
                        cells[place] = "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
                    elif value is not None and c.get("t") == "s":
                        cells[place] = shared[int(value.text)]
                    else:
                        cells[place] = (value.text or "") if value is not None else ""
                out.append((sheet.get("name"), int(row.get("r", k)), [cells.get(i, "") for i in range(1, max(cells, default=0) + 1)]))
    return out


def read_workbooks(spark: SparkSession, path: str, memory: int | None = None) -> DataFrame:
    """file, sheet, row_no, cells, error: all rows of all sheets of the workbooks below a path; files that
    aren't workbooks (by their first two bytes) are passed over, those that are refused or damaged have
    one row with an error."""
    return read_rows(spark, path, memory, lambda raw: sheets_of(raw) if raw[:2] == b"PK" else None)


def workbook_bytes(sheet: str, header: list[str], rows: list[list]) -> bytes:
    """A workbook of one sheet; numbers stay numbers, all else is text."""

    def cell(value, row: int, col: int) -> str:
        at = f"{column_name(col)}{row}"
        if value is None:
            return ""
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f'<c r="{at}"><v>{value}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    lines = [f'<row r="{i}">{"".join(cell(v, i, j) for j, v in enumerate(r, 1))}</row>' for i, r in enumerate([header, *rows], 1)]
    head, main = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', SHEET.strip("{}")
    office = RELATION.split("}")[0].strip("{")
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


#: Rows of one workbook; a sheet format has room for about a million.
SHEET_ROWS = 500_000


def workbooks(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part, content: a workbook for each key and each SHEET_ROWS rows of it, as bytes.

    Write the result with any sink; rows of a key are ordered by all columns.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ship(df.sparkSession)
    names = [c for c in df.columns if c not in keys]
    numbered = df.withColumn("__part", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*names)) - 1) / SHEET_ROWS).cast("int"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        rows = pdf[names].sort_values(names, kind="stable").astype(object)
        raw = workbook_bytes("Sheet", names, rows.where(rows.notna(), None).values.tolist())
        return pd.DataFrame([[*(first[k] for k in keys), first["__part"], raw]], columns=[*keys, "part", "content"])

    kinds = dict(df.dtypes)
    return numbered.groupBy(*keys, "__part").applyInPandas(make, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "part int", "content binary"]))

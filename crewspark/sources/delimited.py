"""Delimited text of unknown dialect.

Each file's encoding and delimiter are found from the file itself; files are read as wholes because
both can differ from file to file, and rows leave as arrays of cells.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewspark.shipping import ship

#: The largest file that is read; what a file grows to when it is read, and the part of a task's memory it may take.
MAX_BYTES = 80 * 1024 * 1024
GROWS, HEADROOM = 8.0, 0.90
DELIMITERS = ";,\t"
ROWS = "file string, sheet string, row_no int, cells array<string>, error string"


def decoded(raw: bytes) -> str:
    """UTF-8 (a mark at the start is dropped) or else Windows-1252."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def delimiter_of(first_line: str) -> str:
    """The delimiter that the first line has most of; the earlier one in the list among equals."""
    return max(DELIMITERS, key=first_line.count)


def cells_of(raw: bytes) -> list[list[str]]:
    text = decoded(raw).replace("\r\n", "\n").replace("\r", "\n")
    return list(csv.reader(io.StringIO(text), delimiter=delimiter_of(text.split("\n", 1)[0])))


def refusal(length: Column, memory: int | None = None) -> Column:
    """Why a file of a length isn't read, or null: too large, or larger than a task's memory once read."""
    grown = F.lit(False) if memory is None else F.round(length * GROWS) > round(memory * HEADROOM)
    return F.when(length > MAX_BYTES, F.format_string("%d bytes, more than %d", length, F.lit(MAX_BYTES))).when(grown, F.format_string("%d bytes, too many for the memory", length))


def files(spark: SparkSession, path: str, memory: int | None = None) -> DataFrame:
    """path, length, content and error of all files below a path; files that are refused have no content
    (which isn't read then) but an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    why = refusal(F.col("length"), memory)
    return found.select("path", "length", F.when(why.isNull(), F.col("content")).alias("content"), why.alias("error"))


def read_rows(spark: SparkSession, path: str, memory: int | None, rows_of: Callable[[bytes], list[tuple] | None]) -> DataFrame:
    """file, sheet, row_no, cells and error (null) of all files; one row with an error for a file that isn't read
    or can't be.  rows_of: sheet, row_no and cells of a file's rows; None for files to pass over."""
    ship(spark)
    columns = [c.split(" ")[0] for c in ROWS.split(", ")]

    def read(batches):
        for pdf in batches:
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = [(file, *r, None) for r in rows_of(bytes(raw)) or ()]
                except (ValueError, KeyError, SyntaxError, csv.Error, zipfile.BadZipFile) as e:  # what damaged files raise
                    rows = [(file, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=columns).astype({"row_no": "Int32"})

    found = files(spark, path, memory)
    refused = found.where("error IS NOT NULL").select(F.col("path").alias("file"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in ROWS.split(", ")[1:-1])], "error")
    return found.where("content IS NOT NULL").select("path", "content").mapInPandas(read, ROWS).unionByName(refused)


def read_delimited(spark: SparkSession, path: str, memory: int | None = None) -> DataFrame:
    """file, sheet (null), row_no from 1, cells, error: all rows of all files, empty rows too; files that
    are refused or damaged have one row with an error.  memory: bytes that a task has, if that counts."""
    return read_rows(spark, path, memory, lambda raw: [(None, n, cells) for n, cells in enumerate(cells_of(raw), 1)])


def long_cells(rows: DataFrame) -> DataFrame:
    """One row a cell: file, sheet, row_no, col_no from 1, value (blank ones are left out)."""
    each = rows.select("file", "sheet", "row_no", F.posexplode("cells").alias("at", "value"))
    return each.select("file", "sheet", "row_no", (F.col("at") + 1).alias("col_no"), F.trim("value").alias("value")).where("value <> ''")


def header_rows(cells: DataFrame, roles: dict[str, list[str]], first: int = 20) -> DataFrame:
    """file, sheet, row_no, found: of the first rows of each sheet the one in which the most roles
    are named (the earliest among equals); sheets without any are left out."""
    v = F.lower("value")
    named = F.array_compact(F.array(*[F.when(v.isin(*words), F.lit(role)) for role, words in roles.items()]))
    scored = cells.where(F.col("row_no") <= first).select("file", "sheet", "row_no", F.explode(named).alias("role"))
    each = scored.groupBy("file", "sheet", "row_no").agg(F.countDistinct("role").alias("n"))
    best = each.groupBy("file", "sheet").agg(F.max_by(F.struct("row_no", "n"), F.struct("n", -F.col("row_no"))).alias("x"))
    return best.select("file", "sheet", "x.row_no", F.col("x.n").alias("found"))


def column_roles(cells: DataFrame, headers: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """file, sheet, col_no, role: columns by their header's words; each role goes to its leftmost
    column and each column has one role, the earlier in the list."""
    v = F.lower("value")
    order = list(roles)
    rank = None
    for i, role in enumerate(order):
        hit = v.isin(*roles[role])
        rank = F.when(hit, i) if rank is None else rank.when(hit, i)
    heads = headers.select(F.col("file").alias("__file"), F.col("sheet").alias("__sheet"), F.col("row_no").alias("__row"))
    same = F.col("file").eqNullSafe(F.col("__file")) & F.col("sheet").eqNullSafe(F.col("__sheet")) & (F.col("row_no") == F.col("__row"))
    own = cells.join(heads, same).select("file", "sheet", "col_no", rank.alias("rank")).where("rank IS NOT NULL")
    left = own.groupBy("file", "sheet", "rank").agg(F.min("col_no").alias("col_no"))
    return left.select("file", "sheet", "col_no", F.get(F.array(*[F.lit(r) for r in order]), F.col("rank")).alias("role"))

"""Loads: kinds of files, contents that are new, upserts by key, revisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_kind(name: Column, start: Column) -> Column:
    """sheet, drawing, web page or text: by the name's ending, else by the first characters."""
    n, head = F.lower(name), F.lower(F.ltrim(start))
    return (
        F.when(n.rlike(r"\.(xlsx|xls|csv)($|[?#])"), "sheet")
        .when(n.rlike(r"\.pdf($|[?#])"), "drawing")
        .when(head.startswith("<!doctype") | head.startswith("<html"), "web page")
        .otherwise("text")
    )


def not_yet_loaded(new: DataFrame, loaded: DataFrame, content: str, out: str = "sha256") -> DataFrame:
    """Rows whose content's digest isn't among the loaded ones; only digests are compared."""
    known = loaded.select(F.sha2(content, 256).alias(out)).distinct()
    return new.withColumn(out, F.sha2(content, 256)).join(known, out, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows without the keys that are written anew, and the new rows."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def revisions(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """revision (1, 2, ...) and current flag of each key's rows."""
    key = Window.partitionBy(*keys)
    ranked = df.withColumns({"revision": F.row_number().over(key.orderBy(*order)), "__n": F.count("*").over(key)})
    return ranked.withColumn("current", F.col("revision") == F.col("__n")).drop("__n")

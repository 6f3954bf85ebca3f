"""Rows of cost sheets: which materials a labour row is about; roll-ups over time and people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claimed_materials(rows: DataFrame, keys: Sequence[str], order: Sequence[str], labour: Column, usable: Column, quantity: str) -> DataFrame:
    """keys, the order of each labour row, materials and quantity: the usable materials that follow it up to
    the next one; a key's first labour row takes those before it if none follow.

    Each labour row claims what follows it, so that materials before one are free only where no labour
    row stands before them.  Islands (a labour row and what follows) are summed first; only sums of the
    first two islands meet again.
    """
    island = F.count_if(labour).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    own = rows.withColumns({"__labour": labour, "__usable": ~labour & F.coalesce(usable, F.lit(False)), "__island": island})
    at = [F.min(F.when(F.col("__labour"), F.col(o))).alias(o) for o in order]
    zero = F.lit(0).cast(rows.schema[quantity].dataType)
    sums = own.groupBy(*keys, "__island").agg(*at, F.count_if("__usable").alias("materials"), F.sum(F.when(F.col("__usable"), F.col(quantity)).otherwise(zero)).alias(quantity))
    lead = sums.where("__island = 0").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("materials").alias("__m"), F.col(quantity).alias("__q"), F.lit(1).alias("__one"))
    same = (F.col("__island") == F.col("__one")) & (F.col("materials") == 0)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = sums.where("__island > 0").join(lead, same, "left")
    return joined.select(*keys, *order, F.coalesce("__m", "materials").alias("materials"), F.coalesce("__q", quantity).alias(quantity))


def rolled_up(rows: DataFrame, down: Sequence[str], across: Sequence[str], **aggregates: Column) -> DataFrame:
    """Totals of every level of rows (work, then team, then person) at every level of time (year, then week, then
    day): one pass with grouping sets.  level and span say how many columns of either are set; the
    others are null.  Totals of a sheet's rows and columns are rows of their own."""
    sets = [[*down[:i], *across[:j]] for i in range(len(down) + 1) for j in range(len(across) + 1)]
    bits = len(down) + len(across)
    used = lambda names, first: sum((1 - F.shiftright(F.grouping_id(), bits - 1 - (first + i)).bitwiseAND(F.lit(1)) for i in range(len(names))), F.lit(0))
    every = [*down, *across]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *every)
    return out.agg(used(down, 0).cast("int").alias("level"), used(across, len(down)).cast("int").alias("span"), *[c.alias(n) for n, c in aggregates.items()])


def week_sheet(rows: DataFrame, down: Sequence[str], week: str, value: str, weeks: Sequence[int]) -> DataFrame:
    """A sheet of a year: rows (with their sub-totals) by week, w1 to w53 as stated, and their total."""
    sums = [F.sum(F.when(F.col(week) == w, F.col(value))).alias(f"w{w}") for w in weeks]
    return rows.rollup(*down).agg(*sums, F.sum(value).alias("total"))

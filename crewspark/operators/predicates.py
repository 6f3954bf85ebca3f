"""Filters with optional and tagged parameters, unions, distinct values, and shifts of dates."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def archived(df: DataFrame, at: str, want: bool = False) -> DataFrame:
    """Rows that aren't archived, or those that are."""
    return df.where(F.col(at).isNotNull() if want else F.col(at).isNull())


def by_state(df: DataFrame, finished: Column, state: str) -> DataFrame:
    """Rows of a state: "open", "finished" or "all"; without a flag a row is open."""
    if state == "all":
        return df
    done = F.coalesce(finished, F.lit(False))
    return df.where(done if state == "finished" else ~done)


def when_given(df: DataFrame, value: object, condition: Callable[[object], Column]) -> DataFrame:
    """The condition for a parameter that is given; all rows without one (None or empty)."""
    return df if value is None or value == "" else df.where(condition(value))


def by_person(df: DataFrame, person: str, member: str, worker: str) -> DataFrame:
    """Rows of "member-7", or of "worker-3" without a member; any other text filters nothing."""
    found = re.fullmatch(r"(member|worker)-([0-9]+)", person)
    if not found:
        return df
    own = F.col(member if found[1] == "member" else worker) == int(found[2])
    return df.where(own if found[1] == "member" else own & F.col(member).isNull())


def on_weekday(df: DataFrame, day: str, iso: int) -> DataFrame:
    """Rows on a day of the week, 1 for Monday."""
    return df.where(F.weekday(day) + 1 == iso)


def not_of(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows whose value is another one or missing."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def same_mail(df: DataFrame, column: str, address: str) -> DataFrame:
    return df.where(F.lower(column) == F.lower(F.lit(address)))


def union_by_id(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both; of an id in both that of the first only."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"), allowMissingColumns=True)


def occupancy(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Rows of all sources with the source's name; columns that one lacks are null."""
    out = None
    for name, df in sources:
        own = df.withColumn("source", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def with_unassigned(df: DataFrame, key: str, *sums: Column) -> DataFrame:
    """Sums by key; rows without one are in the bucket 0."""
    return df.groupBy(F.coalesce(F.col(key), F.lit(0)).alias(key)).agg(*sums)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The values that occur and aren't empty."""
    return df.where(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) != "").select(column).distinct()


def code_sets(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """What two arrays share, what the first has alone, and whether they share any; in its order."""
    return F.array_intersect(a, b), F.array_except(a, b), F.arrays_overlap(a, b)


def shifted(df: DataFrame, days: int, *dates: str) -> DataFrame:
    """Dates moved by a number of days; missing ones stay missing."""
    return df.withColumns({d: F.date_add(F.col(d), days) for d in dates})


def rebalanced(df: DataFrame, keys: Sequence[str], id: str, hours: str, target: str, wanted: str, budget: Column) -> DataFrame:
    """Hours of a day's activities after the target gets what is wanted (rounded to a tenth) and the
    first of the others gives or takes the difference.

    Days with one activity, or whose target changes by less than 0.05, stay.  A day with an activity
    below -0.01, or in all more than the budget + 0.01, is refused: it keeps its hours.
    """
    own = F.col(id) == F.col(target)
    day = df.groupBy(*keys).agg(
        F.count("*").alias("__n"),
        F.max(F.when(own, F.col(hours))).alias("__held"),
        F.first(wanted).alias("__wanted"),
        F.min(F.when(~own, F.col(id))).alias("__other"),
        F.first(budget).alias("__budget"),
    )
    delta = F.round(F.col("__wanted") - F.col("__held"), 2)
    moves = (F.col("__n") > 1) & (F.abs(delta) >= 0.05)
    new = F.when(own, F.round("__wanted", 1)).when(F.col(id) == F.col("__other"), F.round(F.col(hours) - delta, 1)).otherwise(F.col(hours))
    each = df.join(day, list(keys)).withColumn("__new", F.when(moves, new).otherwise(F.col(hours)))
    sums = each.groupBy(*keys).agg(F.min("__new").alias("__least"), F.round(F.sum("__new"), 2).alias("__sum"))
    fits = (F.col("__least") >= -0.01) & (F.col("__sum") <= F.col("__budget") + 0.01)
    out = each.join(sums, list(keys)).withColumns({"refused": ~fits, "hours_after": F.when(fits, F.col("__new")).otherwise(F.col(hours))})
    return out.select(*df.columns, "hours_after", "refused")

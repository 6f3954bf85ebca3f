"""Differences between snapshots and between sources; rules that gate an import."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewspark.functions.numbers import near
from crewspark.operators.sequences import ordered_fold

#: Numbers of a diff are equal within this.
EQUAL = 0.005


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], numbers: Sequence[str], texts: Sequence[str] = (), tolerance: float = EQUAL) -> DataFrame:
    """keys, state (new, removed, changed, unchanged), changed fields, old_* and new_* values."""
    values = [*numbers, *texts]
    a = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in values], F.lit(True).alias("__old"))
    b = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in values], F.lit(True).alias("__new"))
    joined = a.join(b, list(keys), "full_outer")
    same = {c: near(F.col(f"old_{c}"), F.col(f"new_{c}"), tolerance) for c in numbers}
    same |= {c: F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in texts}
    fields = F.array_compact(F.array(*[F.when(~s, F.lit(c)) for c, s in same.items()]))
    state = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "removed").when(F.size(fields) > 0, "changed").otherwise("unchanged")
    return joined.select(*keys, state.alias("state"), F.when(state == "changed", fields).otherwise(F.array().cast("array<string>")).alias("fields"), *[f"old_{c}" for c in values], *[f"new_{c}" for c in values])


def three_sources(df: DataFrame, first: str, second: str, third: str, tolerance: float = 0.05) -> DataFrame:
    """leading value (the first source given), its source, spread of the sources, differ and status."""
    each = F.array_compact(F.array(first, second, third))
    leading = F.coalesce(first, second, third)
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in (first, second, third)])
    spread = F.array_max(each) - F.array_min(each)
    status = F.when(F.size(each) == 0, "missing").when(F.size(each) == 1, "single").when(spread > tolerance, "differs").otherwise("confirmed")
    return df.withColumns({"leading": leading, "leading_source": source, "spread": spread, "differ": F.coalesce(spread > tolerance, F.lit(False)), "status": status})


def total_status(declared: Column, calculated: Column) -> Column:
    off = F.abs(declared - calculated)
    return F.when(declared.isNull() | calculated.isNull(), "unknown").when(off <= 0.10, "ok").when(off <= 2.0, "warning").otherwise("check")


def gate(df: DataFrame, keys: Sequence[str], rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """Issues of each key and the decision: an error stops it, a warning marks it.  rules: name to
    (severity "error" or "warning", condition)."""
    issues = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, (_, c) in rules.items()]))
    bad = {s: [c for level, c in rules.values() if level == s] for s in ("error", "warning")}
    either = lambda cs: F.coalesce(F.greatest(*[F.coalesce(c, F.lit(False)) for c in cs], F.lit(False), F.lit(False)), F.lit(False))
    each = df.select(*keys, issues.alias("issues"), either(bad["error"]).alias("e"), either(bad["warning"]).alias("w"))
    total = each.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("issues")))).alias("issues"), F.max("e").alias("e"), F.max("w").alias("w"))
    return total.select(*keys, "issues", F.when(F.col("e"), "TECHNICAL_ERROR").when(F.col("w"), "READY_WITH_WARNINGS").otherwise("READY").alias("decision"))


def collapse_near(df: DataFrame, keys: Sequence[str], order: str, value: str, tolerance: float = 0.05) -> DataFrame:
    """Sum of the values of each key in order, where one that equals the running value (within the
    tolerance) is a repetition and not added."""
    step = lambda s, v: v if s is None else s if v is None or abs(s - v) <= tolerance else s + v
    return ordered_fold(df, keys, [order], value, step).select(*keys, value)

"""Search terms over columns and related rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the shortest term that names a kind by its badge.
BADGE_LEAST = 3


def holds(term: str, columns: Sequence[str]) -> Column:
    """Whether a column holds the term, in any case; the term's signs (%, _, \\) mean themselves."""
    own = F.lit(term.strip().lower())
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), own), F.lit(False)) for c in columns], F.lit(False))


def matching_search(df: DataFrame, term: str, columns: Sequence[str], related: Sequence[tuple[DataFrame, str]] = (), kind: str | None = None, badges: dict[str, str] | None = None) -> DataFrame:
    """Rows of which a column holds the term, or a related row does, or whose kind's badge does (from three
    letters on).  related: rows that hold the term, and their column with df's column of that name.  A
    blank term finds all."""
    own = term.strip().lower()
    if not own:
        return df
    hit = holds(own, columns)
    if kind and len(own) >= BADGE_LEAST:
        kinds = [k for k, badge in (badges or {}).items() if own in badge.lower()]
        hit = hit | F.coalesce(F.col(kind).isin(kinds), F.lit(False)) if kinds else hit
    flagged, flags = df, []
    for i, (rows, key) in enumerate(related):
        found = rows.select(F.col(key).alias(f"__k{i}")).where(F.col(f"__k{i}").isNotNull()).distinct()
        flagged = flagged.join(found, F.col(key) == F.col(f"__k{i}"), "left")
        flags.append(F.col(f"__k{i}").isNotNull())
    return flagged.where(reduce(lambda a, b: a | b, flags, hit)).select(df.columns)

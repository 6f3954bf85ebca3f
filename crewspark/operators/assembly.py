"""Rooms and tasks from several sources: pairing by place, filling gaps, merging tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewspark.operators.products import name_key
from crewspark.operators.ranking import with_place
from crewspark.operators.sequences import ordered_fold
from crewspark.storage import rewritten


def positional_pairs(left: DataFrame, right: DataFrame, levels: Sequence[Sequence[str]], confidence: Sequence[float], order: str) -> DataFrame:
    """id, other, confidence: the k-th left row of a key with the k-th right one, for each level of
    keys in turn; what a level has paired takes no part in the next.  left, right: id, order, keys.

    A level's pairs are written to the shared folder, as the next levels read them several times.
    """
    out, a, b = None, left, right
    for keys, sure in zip(levels, confidence, strict=True):
        x = with_place(a, keys, [order, "id"], "__k").select(*keys, "id", "__k")
        y = with_place(b, keys, [order, "id"], "__k").select(*keys, F.col("id").alias("other"), "__k")
        met = rewritten(x.join(y, [*keys, "__k"]).select("id", "other", F.lit(sure).alias("confidence")))
        out = met if out is None else out.unionByName(met)
        a = a.join(met.select("id"), "id", "left_anti")
        b = b.join(met.select(F.col("other").alias("id")), "id", "left_anti")
    return out


def enriched(rows: DataFrame, hints: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """rows whose empty columns are filled from the first hint of their key; no rows are added.
    ``filled`` names the columns that a hint has given."""
    first = hints.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__{c}") for c in columns])
    joined = rows.join(first, list(keys), "left")
    filled = F.array_compact(F.array(*[F.when(F.col(c).isNull() & F.col(f"__{c}").isNotNull(), F.lit(c)) for c in columns]))
    return joined.select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in rows.columns], filled.alias("filled"))


def merged_tasks(df: DataFrame, keys: Sequence[str], order: Sequence[str], quantity: str, tolerance: float) -> DataFrame:
    """One quantity a key, from its parts in order: an equal one counts once, a smaller one of the
    same task is part of what is there, a larger one takes its place."""
    step = lambda s, v: v if s is None else s if v is None or v <= s + tolerance else v
    return ordered_fold(df, keys, order, quantity, step)


def summed_tasks(df: DataFrame, keys: Sequence[str], order: Sequence[str], tolerance: float = 0.05) -> DataFrame:
    """keys, unit, name, quantity, parts: a room's tasks (keys, name, unit, quantity) of one name and unit as one, in order.

    A quantity that equals what is there counts once, a smaller one is a part of it, a larger one is
    another surface and added.  Names are one by their letters and digits; the longest is kept.
    Tasks without a name are left out; a quantity that isn't given is nothing.
    """
    named = df.where(F.trim(F.coalesce("name", F.lit(""))) != "").withColumns({"__key": name_key(F.col("name")), "unit": F.coalesce("unit", F.lit("m2")), "quantity": F.coalesce("quantity", F.lit(0)).cast(df.schema["quantity"].dataType)})
    own = [*keys, "unit", "__key"]
    step = lambda s, v: v if s is None else s if v <= s + tolerance else s + v
    sums = ordered_fold(named, own, order, "quantity", step)
    names = named.groupBy(*[F.col(k).alias(f"__{i}") for i, k in enumerate(own)]).agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("name"))
    same = F.lit(True)
    for i, k in enumerate(own):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    return sums.join(names, same).select(*keys, "unit", "name", "quantity", "parts")


def first_positive(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The first value above nothing of each key, and how many rows the key has."""
    given = F.when(F.col(value) > 0.0001, F.struct(*order))
    return df.groupBy(*keys).agg(F.min_by(value, given).alias(value), F.count("*").alias("n"))


def absences(windows: DataFrame, keys: Sequence[str], rank: dict[str, int]) -> DataFrame:
    """keys, day, kind, start_min, end_min: one absence for each day of windows (keys, first_day,
    last_day, kind, slot); the kind of least rank wins, then the longer one.  Slots: morning ends and
    afternoon begins at noon; any other is the day."""
    days = windows.select(*keys, "kind", "slot", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    order = F.lit(len(rank))
    for kind, r in rank.items():
        order = F.when(F.col("kind") == kind, r).otherwise(order)
    whole = ~F.coalesce(F.col("slot").isin("morning", "afternoon"), F.lit(False))
    best = days.groupBy(*keys, "day").agg(F.min_by(F.struct("kind", "slot"), F.struct(order.alias("r"), (~whole).alias("h"), "kind", "slot")).alias("x"))
    noon = 12 * 60
    start = F.when(F.col("x.slot") == "afternoon", noon).otherwise(0)
    end = F.when(F.col("x.slot") == "morning", noon).otherwise(24 * 60)
    return best.select(*keys, "day", "x.kind", start.alias("start_min"), end.alias("end_min"))


def initials(df: DataFrame, name: str, order: str) -> DataFrame:
    """df with initials that no other row has: a repeated one gets its number."""
    own = F.upper(F.array_join(F.transform(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""), lambda w: F.left(w, F.lit(1))), ""))
    placed = with_place(df.withColumn("__own", own), ["__own"], [order], "__k")
    return placed.withColumn("initials", F.when(F.col("__k") == 1, F.col("__own")).otherwise(F.concat("__own", "__k"))).drop("__own", "__k")


def label_score(number: Column, name: Column, text: Column) -> Column:
    """1 where a text holds the number, 0.82 where it holds the name only, else null."""
    t = F.lower(text)
    has = lambda x: (F.coalesce(F.trim(x), F.lit("")) != "") & F.contains(t, F.lower(F.trim(x)))
    return F.when(has(number), 1.0).when(has(name), 0.82)

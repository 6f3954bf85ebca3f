"""Rules of planning: proposals against what is planned, clocks of members, calendars of people."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from crewspark.operators import intervals
from crewspark.shipping import map_in_arrow
from crewspark.storage import rewritten


def proposal_conflicts(planned: DataFrame, proposals: DataFrame, keys: Sequence[str], capacity: Column, bucket: int | None = None) -> DataFrame:
    """id, first_at, most of the proposals (keys, id, s, e, people) during which more people than the
    capacity (an expression of the keys) would be present with those planned (keys, id, s, e, people).

    What is planned is swept once a key.  A proposal looks up the most people in that profile, and the place
    where too many begin, for each number of people that is proposed in its key; proposals and entries are
    never paired, and equal places and ends are looked up once (so that a bucket no longer matters).
    """
    room = [*keys, "people"]
    own = proposals.where("e > s").select(*keys, "id", "s", "e", "people")
    profile = rewritten(intervals.profile(planned.dropna(subset=list(keys)), keys, "s", "e", F.col("people")))
    peaks = intervals.profile_peaks(profile, own.select(*keys, "s", "e").distinct(), keys)
    too_many = F.coalesce(F.col("present") + F.col("people") > capacity, F.lit(False))
    over = profile.join(own.select(*room).distinct(), list(keys)).select(*room, "at", too_many.alias("over"), F.lit(False).alias("asked"))
    asked = own.select(*room, F.col("s").alias("at"), F.lit(None).cast("boolean").alias("over"), F.lit(True).alias("asked")).distinct()
    order = Window.partitionBy(*room).orderBy("at", "asked")
    here = F.coalesce(F.last("over", ignorenulls=True).over(order), F.lit(False))
    later = F.min(F.when(F.col("over"), F.col("at"))).over(Window.partitionBy(*room).orderBy(F.desc("at"), F.desc("asked")).rowsBetween(Window.unboundedPreceding, 0))
    firsts = over.union(asked).select(*room, F.col("at").alias("s"), "asked", F.when(here, F.col("at")).otherwise(later).alias("first")).where("asked").drop("asked")
    met = intervals.same_keys(intervals.same_keys(own, firsts, [*room, "s"]), peaks, [*keys, "s", "e"])
    most = F.col("people") + F.coalesce("peak", F.lit(0))
    first = F.when(F.col("people") > capacity, F.col("s")).otherwise(F.col("first"))
    return met.where(most > capacity).select(*keys, "id", first.alias("first_at"), most.alias("most"))


def budget_conflicts(planned: DataFrame, proposals: DataFrame, budget: Column, bucket: int) -> DataFrame:
    """id, person, day, used, met, internal: proposals (id, person, day, s, e, hours) that one person can't
    take: what they overlap (planned: id, person, day, s, e, hours, internal) is internal work, or the
    hours of both are more than the day's budget (an expression of person and day)."""
    keys = ["person", "day"]
    met = intervals.overlap_pairs(proposals, planned, keys, bucket).select(*keys, F.col("id_a").alias("id"), "id_b")
    other = planned.select(*keys, F.col("id").alias("id_b"), F.col("hours").alias("h"), "internal")
    load = met.join(other, [*keys, "id_b"]).groupBy(*keys, "id").agg(F.sum("h").alias("h"), F.count("*").alias("met"), F.max(F.coalesce("internal", F.lit(False))).alias("internal"))
    own = proposals.select(*keys, "id", "hours").join(load, [*keys, "id"], "left")
    used = F.col("hours") + F.coalesce("h", F.lit(0))
    out = own.select("id", *keys, used.alias("used"), F.coalesce("met", F.lit(0)).alias("met"), F.coalesce("internal", F.lit(False)).alias("internal"))
    return out.where(F.col("internal") | (F.col("used") > budget + 0.01))


def away(people: DataFrame, windows: DataFrame, first: Column, last: Column) -> DataFrame:
    """person, day, reason, whole: days from first to last on which people (person, unavailable,
    free_weekday: 1 is Monday) are away: structurally, by the first of their windows (person, first_day,
    last_day, kind, whole, place), or on their free weekday."""
    days = people.withColumn("day", F.explode(F.sequence(first, last)))
    covered = windows.where((F.col("first_day") <= last) & (F.col("last_day") >= first)).withColumn("day", F.explode(F.sequence(F.greatest("first_day", first), F.least("last_day", last))))
    best = covered.groupBy("person", "day").agg(F.min_by(F.struct("kind", "whole"), F.struct("place", "kind")).alias("w"))
    gone, free = F.coalesce("unavailable", F.lit(False)), F.weekday("day") + 1 == F.col("free_weekday")
    reason = F.when(gone, "unavailable").when(F.col("w").isNotNull(), F.col("w.kind")).when(free, "weekday")
    whole = F.when(gone | F.col("w").isNull(), True).otherwise(F.coalesce("w.whole", F.lit(True)))
    return days.join(best, ["person", "day"], "left").select("person", "day", reason.alias("reason"), whole.alias("whole")).where("reason IS NOT NULL")


def teams_away(members: DataFrame, away_days: DataFrame) -> DataFrame:
    """team, day, members, absent, away: a team (members: team, person) is away on a day only if all of
    its people are, the whole day."""
    size = members.groupBy("team").agg(F.countDistinct("person").alias("members"))
    gone = members.distinct().join(away_days.where("whole"), "person").groupBy("team", "day").agg(F.count("*").alias("absent"))
    return gone.join(size, "team").select("team", "day", "members", "absent", (F.col("absent") == F.col("members")).alias("away"))


def clamped(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """A member's clocks inside those of the assignment; the assignment's where nothing is left."""
    a, b = F.greatest(F.coalesce(start, low), low), F.least(F.coalesce(end, high), high)
    return F.when(a < b, a).otherwise(low), F.when(a < b, b).otherwise(high)


def agenda(entries: DataFrame, keys: Sequence[str], day: str, first: Column, last: Column, columns: dict[str, Column]) -> DataFrame:
    """One row for each key and day from first to last, with the aggregates of the day's entries
    (null on days without any)."""
    days = entries.select(*keys).distinct().withColumn(day, F.explode(F.sequence(first, last)))
    sums = entries.groupBy(*keys, day).agg(*[c.alias(n) for n, c in columns.items()])
    return days.join(sums, [*keys, day], "left")


def reliable_quantity(df: DataFrame, keys: Sequence[str], product: str, quantity: str) -> DataFrame:
    """keys, quantity, articles: the sum where a key's articles are one product, else null."""
    same = F.min(F.lower(F.trim(product))) == F.max(F.lower(F.trim(product)))
    return df.groupBy(*keys).agg(F.when((F.count("*") == 1) | same, F.sum(quantity)).alias(quantity), F.count("*").alias("articles"))


def resolved_fields(df: DataFrame, keys: Sequence[str], rank: str, fields: Sequence[str]) -> DataFrame:
    """Of several sources of one key (rank: least first) the first value of each field, and the
    fields in which sources differ."""
    first = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col(rank))).alias(f) for f in fields]
    differ = F.array_compact(F.array(*[F.when(F.min(F.lower(F.trim(f))) != F.max(F.lower(F.trim(f))), F.lit(f)) for f in fields]))
    return df.groupBy(*keys).agg(*first, differ.alias("mismatches"))


def renumbered(df: DataFrame, keep: DataFrame, id: str, keys: Sequence[str], lane: str) -> DataFrame:
    """Rows whose id is kept, with the lanes that are left numbered without gaps."""
    own = df.join(keep.select(id), id, "left_semi")
    return own.withColumn(lane, F.dense_rank().over(Window.partitionBy(*keys).orderBy(lane)) - 1)


def double_factor(declared: Column, calculated: Column, off: float = 0.05) -> Column:
    """Whether one total is twice the other."""
    ratio = F.greatest(declared, calculated) / F.nullif(F.least(declared, calculated), F.lit(0))
    return F.coalesce(F.abs(ratio - 2) <= off, F.lit(False))


def clustered_lines(items: DataFrame, keys: Sequence[str], gap: float = 0.028, baseline: float = 0.004) -> DataFrame:
    """keys, line, text, x, y, w: texts (keys, text, x, y, w) on one baseline joined from left to
    right while the next begins within the gap of the line so far.

    The line so far grows as it goes, so that a page is taken in order; a task reads its pages one after
    the other and keeps one of them.
    """
    own = items.repartition(*keys).sortWithinPartitions(*keys, "y", "x", "text").select(*keys, "text", F.col("x").cast("double"), F.col("y").cast("double"), F.col("w").cast("double"))
    schema = StructType([*own.schema.fields[: len(keys)], StructField("line", IntegerType()), *own.schema.fields[len(keys) :]])
    types = to_arrow_schema(schema)

    def rows(page, lines):
        return [(*page, i, *line) for i, line in enumerate(lines)]

    def join(batches):
        page, lines = None, []
        for batch in batches:
            out = []
            for *key, text, x, y, w in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != page:
                    out += rows(page, lines)
                    page, lines = key, []
                near = (q for q in reversed(lines) if abs(q[2] - y) <= baseline and 0 <= x - q[1] and x - (q[1] + q[3]) <= gap)
                last = next(near, None)
                if last:
                    last[0], last[3] = f"{last[0]} {text}", max(last[3], x + w - last[1])
                else:
                    lines.append([text, x, y, w])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows(page, lines), strict=True), types, strict=True)], schema=types)

    return map_in_arrow(own, join, schema)

"""Algebra of half-open intervals [start, end) that belong to keys (such as person and day)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewspark.storage import rewritten


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Half-open intervals overlap; touching ones do not."""
    return (a0 < b1) & (b0 < a1)


def claimed(df: DataFrame, keys: Sequence[str], start: str, end: str, tie: str, out: str = "claimed") -> DataFrame:
    """Length that each interval claims: time that an earlier one holds counts for that one only.

    Ties break on the text form of the id.
    """
    w = Window.partitionBy(*keys).orderBy(start, end, F.col(tie).cast("string")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(end).over(w)
    return df.withColumn(out, F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start)))))


def merged(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """The union of the intervals of each key as disjoint ones (touching ones are joined)."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) > before, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__island", island).groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def profile(df: DataFrame, keys: Sequence[str], start: str, end: str, weight: Column | None = None) -> DataFrame:
    """keys, at and the weight that is present from there on, at each boundary of a key.

    One pass over the boundaries with a running sum; boundaries at one place are summed before.
    """
    w = weight if weight is not None else F.lit(1)
    ends = F.explode(F.array(F.struct(F.col(start).alias("at"), w.alias("d")), F.struct(F.col(end).alias("at"), (-w).alias("d"))))
    moves = df.where(F.col(end) > F.col(start)).select(*keys, ends.alias("__m")).groupBy(*keys, F.col("__m.at").alias("at")).agg(F.sum("__m.d").alias("d"))
    return moves.select(*keys, "at", F.sum("d").over(Window.partitionBy(*keys).orderBy("at")).alias("present"))


def sweep(df: DataFrame, keys: Sequence[str], start: str, end: str, weight: Column | None = None) -> DataFrame:
    """Segments [at, until) between boundaries of each key, and the weight that is present in each."""
    until = F.lead("at").over(Window.partitionBy(*keys).orderBy("at"))
    return profile(df, keys, start, end, weight).select(*keys, "at", until.alias("until"), "present").where("until IS NOT NULL")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left with the other columns of right's row of its keys, if any; null keys are equal."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(other, same, "left").drop(*[f"__{k}" for k in keys])


def profile_peaks(steps: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """bounds (keys, s, e, s < e) with peak, the most that is present in steps (keys, at, present: a
    profile, written somewhere) between s and e; null: no step before e.

    Each step knows the most of the 1, 2, 4, ... steps from it on; a range of steps is two such runs.
    """
    order = Window.partitionBy(*keys).orderBy("at")
    numbered = steps.select(*keys, "at", F.col("present").alias("__m0"), F.row_number().over(order).cast("long").alias("__n"))
    most = steps.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    levels = most.bit_length()
    for j in range(1, levels):
        numbered = numbered.withColumn(f"__m{j}", F.greatest(f"__m{j - 1}", F.lead(f"__m{j - 1}", 2 ** (j - 1)).over(order)))
    runs = rewritten(numbered.select(*keys, "__n", F.array(*[f"__m{j}" for j in range(levels)]).alias("__m")))
    # at one place: an end, a step, a start
    places = steps.select(*keys, "at", F.lit(1).alias("__kind")).union(bounds.select(*keys, "s", F.lit(2)).distinct()).union(bounds.select(*keys, "e", F.lit(0)).distinct())
    placed = places.withColumn("__n", F.count_if(F.col("__kind") == 1).over(Window.partitionBy(*keys).orderBy("at", "__kind")))
    of = lambda kind, at, n: placed.where(F.col("__kind") == kind).select(*keys, F.col("at").alias(at), F.col("__n").alias(n))
    ranged = same_keys(same_keys(bounds, of(2, "s", "__lo"), [*keys, "s"]), of(0, "e", "__hi"), [*keys, "e"])
    ranged = ranged.withColumn("__lo", F.greatest("__lo", F.lit(1).cast("long"))).withColumn("__j", F.length(F.bin(F.greatest(F.col("__hi") - F.col("__lo") + 1, F.lit(1)))) - 1)
    ranged = ranged.withColumn("__k2", F.col("__hi") + 1 - F.pow(F.lit(2), F.col("__j")).cast("long"))
    a, b = runs.withColumnsRenamed({"__n": "__lo", "__m": "__ma"}), runs.withColumnsRenamed({"__n": "__k2", "__m": "__mb"})
    both = same_keys(same_keys(ranged.where("__hi >= __lo"), a, [*keys, "__lo"]), b, [*keys, "__k2"])
    return both.select(*keys, "s", "e", F.greatest(F.get("__ma", F.col("__j")), F.get("__mb", F.col("__j"))).alias("peak"))


def peak(df: DataFrame, keys: Sequence[str], start: str, end: str, weight: Column | None = None) -> DataFrame:
    return sweep(df, keys, start, end, weight).groupBy(*keys).agg(F.max("present").alias("peak"))


def over_capacity(df: DataFrame, keys: Sequence[str], start: str, end: str, capacity: int) -> DataFrame:
    """Keys, total length and number of segments in which more than the capacity is present."""
    over = sweep(df, keys, start, end).where(F.col("present") > capacity)
    return over.groupBy(*keys).agg(F.sum(F.col("until") - F.col("at")).alias("over_length"), F.count("*").alias("segments"), F.max("present").alias("peak"))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: int) -> DataFrame:
    """Pairs of overlapping rows of two tables (keys, id, s, e), equal keys.

    Both sides are cut into buckets of a fixed width, so that the join is on equality; a pair is
    made in the bucket where the later of the two begins, and nowhere else.
    """

    def cut(df: DataFrame, tag: str) -> DataFrame:
        last = F.greatest(F.col("e") - 1, F.col("s"))
        buckets = F.sequence(F.floor(F.col("s") / bucket), F.floor(last / bucket))
        return df.select(*keys, F.col("id").alias(f"id_{tag}"), F.col("s").alias(f"s_{tag}"), F.col("e").alias(f"e_{tag}"), F.explode(buckets).alias("__bucket"))

    joined = cut(left, "a").join(cut(right, "b"), [*keys, "__bucket"])
    first = F.col("__bucket") == F.floor(F.greatest("s_a", "s_b") / bucket)
    return joined.where(overlap(F.col("s_a"), F.col("e_a"), F.col("s_b"), F.col("e_b")) & first).drop("__bucket")


def self_overlaps(df: DataFrame, keys: Sequence[str], bucket: int) -> DataFrame:
    """Each pair of overlapping rows of one table once, the lesser id first."""
    return overlap_pairs(df, df, keys, bucket).where("id_a < id_b")


def overlap_totals(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, overlaps (pairs of a left and a right row that overlap) and length (of all their common
    parts), without making the pairs.

    Both sides are summed to how many begin and end at each place of a key.  A pair begins where the
    later of the two does, while the other is there; the common length is the sum, over stretches
    between places, of their length x left present x right present.
    """

    def moves(df: DataFrame, side: str) -> DataFrame:
        ends = F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("begun"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(0).alias("begun"), F.lit(-1).alias("d"))))
        each = df.where("e > s").select(*keys, ends.alias("m")).groupBy(*keys, F.col("m.at").alias("at")).agg(F.sum("m.begun").alias("begun"), F.sum("m.d").alias("d"))
        own = lambda c, x: (F.col(c) if x == side else F.lit(0).cast("long")).alias(f"{c}_{x}")
        return each.select(*keys, "at", *[own(c, x) for x in "ab" for c in ("begun", "d")])

    both = moves(left, "a").union(moves(right, "b")).groupBy(*keys, "at").agg(*[F.sum(f"{c}_{x}").alias(f"{c}_{x}") for x in "ab" for c in ("begun", "d")])
    order = Window.partitionBy(*keys).orderBy("at")
    a, b, until = F.sum("d_a").over(order), F.sum("d_b").over(order), F.lead("at").over(order)
    swept = both.select(*keys, "at", "begun_a", "begun_b", a.alias("a"), b.alias("b"), until.alias("until"))
    pairs = F.col("begun_a") * F.col("b") + F.col("begun_b") * F.col("a") - F.col("begun_a") * F.col("begun_b")
    out = swept.groupBy(*keys).agg(F.sum(pairs).alias("overlaps"), F.coalesce(F.sum((F.col("until") - F.col("at")) * F.col("a") * F.col("b")), F.lit(0)).alias("length"))
    return out.where("overlaps > 0")

"""Rooms of two sources as one: scores of candidates, rejections, and the matches that stand out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewspark.functions.text import folded, loose_name, repaired_room_number
from crewspark.operators.matching import EXACT, EXACT_LEAD, LEAD, LEAST, best_two
from crewspark.storage import rewritten

#: The parts of a score, and what areas and places count as near.
FLOOR, UNKNOWN_FLOOR, NUMBER, NAME, LIKE, CONFLICT = 20, 8, 100, 50, 18, -30
SAME_AREA, NEAR_AREA, SOFT_AREA, PLACE = 40, 30, 12, 15
AREA_SAME, AREA_NEAR, AREA_SOFT, AREA_OFF, PLACE_NEAR, UNSURE_MOST = 0.05, 0.15, 1.0, 2.0, 120.0, 60
#: Fixed value: rooms of a key that each room of the other side may be held against as they are.
FEW_ROOMS = 64
GENERIC = r"^(ruimte|[0-3][.\-]\d{1,3}[a-z]?)?$"


def name_letters(name: Column) -> Column:
    """A name's letters (folded), runs of a letter as one."""
    return F.regexp_replace(F.regexp_replace(name, "[^a-z]", ""), r"(.)\1+", "$1")


def names_alike(a: Column, b: Column) -> Column:
    """Whether two names (folded) can be one: equal, one within the other, equal but for runs of a letter,
    or off by a letter; five letters or more where they differ.  Labels that name nothing never are."""
    return ~a.rlike(GENERIC) & ~b.rlike(GENERIC) & named_alike(a, b, name_letters(a), name_letters(b))


def named_alike(a: Column, b: Column, letters_a: Column, letters_b: Column) -> Column:
    """``names_alike`` of names that name something, whose letters are known."""
    short = F.least(F.length(a), F.length(b)) >= 5
    like = (short & (a.contains(b) | b.contains(a) | (F.levenshtein(a, b, 1) >= 0))) | ((letters_a != "") & (letters_a == letters_b))
    return (a == b) | like


def alike_keys(name: Column, within: bool) -> Column:
    """Keys of a name (folded); two names that are alike share one of the one's with within and of the
    other's without, or the other way round: the first five letters of the shorter are in the longer one,
    names that are off by a letter are equal without one, and equal but for runs of a letter."""
    at = F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))
    five = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 4, F.lit(1))), lambda i: F.concat(F.lit("5"), F.substr(name, i, F.lit(5))))
    without = F.transform(at, lambda i: F.concat(F.lit("-"), F.left(name, i - 1), F.substr(name, i + 1)))
    same = F.array(F.concat(F.lit("-"), name), F.concat(F.lit("="), loose_name(F.regexp_replace(name, "[^a-z]", ""))))
    return F.array_distinct(F.concat(same, without, five if within else F.slice(five, 1, 1)))


def scored(pairs: DataFrame) -> DataFrame:
    """pairs (a, b: struct<floor, number, name, area, page, x, y>) with score, reject (the reason, null if
    none), exact (equal numbers), and by_name and by_area (what else agrees)."""
    side = {s: {c: F.col(f"{s}.{c}") for c in ("area", "page", "x", "y")} for s in "ab"}
    parts = {}
    for s in "ab":
        parts[f"__floor_{s}"] = folded(F.coalesce(F.col(f"{s}.floor"), F.lit("")))
        parts[f"__number_{s}"] = repaired_room_number(F.coalesce(F.col(f"{s}.number"), F.lit("")))
        parts[f"__name_{s}"] = folded(F.coalesce(F.col(f"{s}.name"), F.lit("")))
    own = pairs.withColumns(parts)
    fa, fb, na, nb, ma, mb = (F.col(c) for c in ("__floor_a", "__floor_b", "__number_a", "__number_b", "__name_a", "__name_b"))
    blank = lambda f: f.isin("", "onbekend")
    off = F.abs(side["a"]["area"].cast("double") - side["b"]["area"].cast("double"))
    dx, dy = (side["a"][c] - side["b"][c] for c in "xy")
    both_pages = (F.coalesce(side["a"]["page"], F.lit(0)) > 0) & (F.coalesce(side["b"]["page"], F.lit(0)) > 0)
    own = own.withColumns({
        "__floor": blank(fa) | blank(fb) | (fa == fb), "__known": ~blank(fa) & ~blank(fb), "exact": (na != "") & (na == nb), "__numbers": (na != "") & (nb != ""),
        "__same": (ma != "") & (ma == mb), "__alike": names_alike(ma, mb), "__off": F.round(off, 6), "__page": ~both_pages | (side["a"]["page"] == side["b"]["page"]),
        "__near": F.coalesce(F.sqrt(dx * dx + dy * dy) <= PLACE_NEAR, F.lit(False)),
    })
    exact, numbers, same, alike, apart = (F.col(c) for c in ("exact", "__numbers", "__same", "__alike", "__off"))
    within = lambda x: F.coalesce(apart <= x, F.lit(False))
    conflict = ~ma.rlike(GENERIC) & ~mb.rlike(GENERIC) & ~alike
    far, near_area, place = F.coalesce(apart > AREA_OFF, F.lit(False)), within(AREA_NEAR), F.col("__near") & F.col("__page")
    reject = (
        F.when(~F.col("__floor"), "floor")
        .when(~F.col("__page"), "page")
        .when(exact & conflict & far, "number against name and area")
        .when(~exact & far, "area")
        .when(~exact & numbers & conflict, "number and name")
        .when(~exact & numbers & ~alike & ~near_area, "number")
    )
    total = (
        F.when(F.col("__floor"), F.when(F.col("__known"), FLOOR).otherwise(UNKNOWN_FLOOR)).otherwise(0)
        + F.when(exact, NUMBER).otherwise(0)
        + F.when(same, NAME).when(alike, LIKE).when(conflict, CONFLICT).otherwise(0)
        + F.when(within(AREA_SAME), SAME_AREA).when(near_area, NEAR_AREA).when(within(AREA_SOFT) & (exact | same), SOFT_AREA).otherwise(0)
        + F.when(place, PLACE).otherwise(0)
    )
    no_number = (
        F.when(alike & near_area, total + F.when(same, 20).otherwise(10))
        .when(same & place, total + 10)
        .otherwise(F.least(total, F.lit(UNSURE_MOST)))
    )
    score = F.when(~exact & ~numbers, no_number).when(~exact & alike & near_area, total + F.when(same, 20).otherwise(8)).otherwise(total)
    by_area = near_area | (within(AREA_SOFT) & (exact | same))
    out = own.withColumns({"score": score.cast("double"), "reject": reject, "by_name": same | alike, "by_area": by_area})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def matched(candidates: DataFrame, keys: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """The best candidate (score, reject, exact, by_name, by_area) of each key where it stands out: equal
    numbers need a short lead or a weak next one, name and area together a long lead, others a score too."""
    best = best_two(candidates.where("reject IS NULL"), keys, "score", tie)
    next_score = F.coalesce("runner_up", F.lit(0.0))
    lead = F.col("score") - next_score
    sure = F.col("exact") & (F.col("score") >= EXACT)
    clear = F.when(sure, (lead >= EXACT_LEAD) | (next_score < LEAST)).when(~F.col("exact") & F.col("by_name") & F.col("by_area"), lead >= LEAD).otherwise((F.col("score") >= LEAST) & (lead >= LEAD))
    return best.where((F.col("score") >= LEAST) & clear)


def candidates(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, id, other: all pairs of rooms (keys, id, room) that score above LEAST - LEAD, and few others: those
    below are neither a match nor a next best that undoes one.

    Such a score needs equal numbers, areas as good as equal, names alike and near each other in place, or
    equal names whose areas don't rule them out.  Each of these is a join on equality: numbers; cells of
    area, or of place, with the storey; names with wider cells of area, or with the storey where an area
    isn't known.  Cells are joined with their neighbours.
    """

    def known(side: DataFrame, name: str) -> DataFrame:
        r = F.col("room")
        return side.select(
            *keys, F.col("id").alias(name), repaired_room_number(F.coalesce(r["number"], F.lit(""))).alias("number"), folded(F.coalesce(r["name"], F.lit(""))).alias("name"),
            folded(F.coalesce(r["floor"], F.lit(""))).alias("floor"), r["area"].cast("double").alias("area"), r["x"].cast("double").alias("x"), r["y"].cast("double").alias("y"),
        )

    a, b = known(left, "id"), known(right, "other")
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])

    def cells(side: DataFrame, column: str, width: float, spread: bool) -> DataFrame:
        at = F.floor(F.col(column) / width)
        return side.where(F.col(column).isNotNull()).withColumn(f"c_{column}", F.explode(F.transform(around, lambda d: at + d)) if spread else at)

    blank = F.col("floor").isin("", "onbekend")
    # a known storey meets its like and unknown ones, an unknown one meets all
    ours = a.withColumn("level", F.explode(F.when(blank, F.array(F.lit("*"))).otherwise(F.array("floor", F.lit("?")))))
    theirs = b.withColumn("level", F.explode(F.when(blank, F.array(F.lit("?"), F.lit("*"))).otherwise(F.array("floor", F.lit("*")))))
    named = "name <> ''"
    near = lambda side, spread: cells(cells(side.where(named), "x", PLACE_NEAR, spread), "y", PLACE_NEAR, spread)
    ways = [
        (a.where("number <> ''"), b.where("number <> ''"), ["number"]),
        (cells(ours, "area", AREA_NEAR + 0.01, True), cells(theirs, "area", AREA_NEAR + 0.01, False), ["level", "c_area"]),
        (near(ours, True), near(theirs, False), ["level", "c_x", "c_y"]),
        (cells(a.where(named), "area", AREA_OFF + 0.01, True), cells(b.where(named), "area", AREA_OFF + 0.01, False), ["name", "c_area"]),
        (ours.where(named).where("area IS NULL"), theirs.where(named), ["name", "level"]),
        (ours.where(named).where("area IS NOT NULL"), theirs.where(named).where("area IS NULL"), ["name", "level"]),
    ]
    out = None
    for x, y, on in ways:
        met = x.select(*keys, *on, "id").join(y.select(*keys, *on, "other"), [*keys, *on]).select(*keys, "id", "other")
        out = met if out is None else out.union(met)
    return out.distinct()


def identified(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, id, other, score, exact: the rooms (keys, id, room) of the left side that are one of the right's.

    Where a key has few rooms on a side these are paired as they are; candidates are only found for the other keys.
    """
    left, right, on = rewritten(left.select(*keys, "id", "room")), rewritten(right.select(*keys, "id", "room")), list(keys)
    one, two = left.withColumnRenamed("room", "a"), right.select(*keys, F.col("id").alias("other"), F.col("room").alias("b"))
    count = lambda side, n: side.groupBy(*keys).agg(F.count("*").alias(n))
    large = rewritten(count(left, "__n").join(count(right, "__m"), on).where(F.least("__n", "__m") > FEW_ROOMS).select(*keys))
    if large.isEmpty():
        pairs = one.join(two, on)
    else:
        found = candidates(left.join(large, on, "left_semi"), right.join(large, on, "left_semi"), keys)
        pairs = one.join(large, on, "left_anti").join(two, on).unionByName(found.join(one, [*keys, "id"]).join(two, [*keys, "other"]))
    return matched(scored(pairs), [*keys, "id"], ["other"]).select(*keys, "id", "other", "score", "exact")

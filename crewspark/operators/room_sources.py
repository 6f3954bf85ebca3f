"""Rooms of several sources as one list, and storeys of drawn rooms put right by their pages.

merged_sources: sources are merged in order.  A row claims the one room that has its keys and hasn't been
claimed by its source; what a level of keys leaves over goes on to the next level, and what no room fits
becomes a room itself, which later sources can claim.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewspark.functions.text import floor_base, folded, repaired_room_number
from crewspark.operators.rooms import FEW_ROOMS, GENERIC, alike_keys, name_letters, named_alike
from crewspark.storage import rewritten

#: Areas that differ by no more are one, and by how much two sources may differ.
SAME_AREA, AREA_APART = 0.05, 1.0
#: Rooms of a project and side that are held together.
ROOMS_HELD = 4_096


def merged_sources(sources: Sequence[tuple[str, DataFrame]], levels: Sequence[Sequence[str]], fields: Sequence[str]) -> DataFrame:
    """room (id of the first row), the keys, and for each source its id and fields as a struct (null: none),
    with ``how``, the level at which it was claimed (0: it made the room).

    sources: name and rows (id, unique over all sources; keys; fields).  A level's keys are as those
    of the first level, some of them left out; rows that differ in a key that both have never meet.
    """
    columns = ["id", *dict.fromkeys(k for level in levels for k in level), *fields]
    rows = None
    for name, df in sources:
        own = df.select(F.lit(name).alias("source"), *columns)
        rows = own if rows is None else rows.unionByName(own)
    return merged_rows(rows, [n for n, _ in sources], levels, fields)


def merged_rows(rows: DataFrame, names: Sequence[str], levels: Sequence[Sequence[str]], fields: Sequence[str]) -> DataFrame:
    """``merged_sources`` of rows (source, one of names; id; keys; fields) of all sources.

    Rows that can meet share the keys of all levels, and are brought together by these once; each source's
    claims are then counts over rows of equal keys, so that nothing is written or shuffled between sources.
    """
    keys = list(dict.fromkeys(k for level in levels for k in level))
    common = [k for k in keys if all(k in level for level in levels)]
    given = lambda on: reduce(lambda a, k: a & F.col(k).isNotNull() & (F.col(k).cast("string") != ""), on, F.lit(True))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("source")).cast("int") - 1
    # what lacks a common key meets nothing, and is on its own rather than with all its like
    pool = rows.where(place >= 0).select(
        F.col("id").alias("room"), *keys, place.alias("__k"), F.when(~given(common), F.col("id")).alias("__alone"),
        *[F.when(F.col("source") == n, F.struct("id", *fields)).alias(n) for n in names], *[F.when(F.col("source") == n, 0).alias(f"how_{n}") for n in names],
    )
    for k, name in enumerate(names[1:], 1):
        how, held, new = f"how_{name}", F.col("__k") < k, F.col("__k") == k
        # __level tells the source's rows that were claimed; they go when its levels are done
        for level, on in enumerate(levels, 1):
            open_, others = given(on) & F.when(held, F.col(how).isNull()).otherwise(F.col("__level").isNull() if level > 1 else F.lit(True)), [k for k in keys if k not in on]
            w = Window.partitionBy(*common, "__alone", *[k for k in on if k not in common])
            of = lambda side, *c: F.first(F.when(side & open_, F.struct(*c)), ignorenulls=True).over(w)
            pool = pool.withColumns({"__held": F.count_if(held & open_).over(w), "__new": F.count_if(new & open_).over(w), "__row": of(new, name, *others), **({"__room": of(held, *others)} if others else {})})
            met = open_ & (F.col("__held") == 1) & (F.col("__new") == 1)
            for c in others:  # a key that both sides have and don't share keeps them apart
                met = met & F.coalesce(F.col("__room")[c] == F.col("__row")[c], F.lit(True))
            pool = pool.withColumn("__met", met)
            took, gone = F.col("__met") & held, F.when(F.col("__met") & new, level)
            pool = pool.withColumns({
                **{c: F.when(took, F.coalesce(c, F.col("__row")[c])).otherwise(F.col(c)) for c in others},
                name: F.when(took, F.col("__row")[name]).otherwise(F.col(name)), how: F.when(took, level).otherwise(F.col(how)),
                "__level": F.coalesce("__level", gone) if level > 1 else gone,
            }).drop("__held", "__new", "__row", "__room", "__met")
        pool = pool.where("__level IS NULL").drop("__level")
    return pool.drop("__k", "__alone")


def chosen(field: str, order: Sequence[str]) -> Column:
    """A field of the first source that has it."""
    return F.coalesce(*[F.col(n)[field] for n in order])


def judged(pool: DataFrame, names: Sequence[str], area: Sequence[str], product: Sequence[str]) -> DataFrame:
    """pool with sources, area, product, confidence and reasons.

    The area is of the first source of ``area`` that has one, the product likewise.  Sources that name
    different products need a check; two sources, or a product, with an area make a room sure.
    """
    given = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names]))
    areas, products = (F.array_compact(F.array(*[F.col(n)[f] for n in names])) for f in ("area", "product"))
    apart = (F.size(areas) > 1) & (F.array_max(areas) - F.array_min(areas) > AREA_APART)
    conflict = F.size(F.array_distinct(F.transform(products, folded))) > 1
    by_name = F.greatest(*[F.coalesce(F.col(f"how_{n}"), F.lit(0)) for n in names]) > 1
    out = pool.withColumns({"sources": given, "area": chosen("area", area), "product": chosen("product", product), "__conflict": conflict})
    sure = (F.size("sources") > 1) | F.col("product").isNotNull()
    confidence = F.when(F.col("__conflict"), "controleren").when(sure & F.col("area").isNotNull(), "hoog").otherwise("midden")
    reasons = {"materials differ": F.col("__conflict"), "areas differ": apart, "no area": F.col("area").isNull(), "matched by name": by_name, "one source": F.size("sources") == 1}
    return out.withColumns({"confidence": confidence, "reasons": F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()]))}).drop("__conflict")


#: What is known of a drawn room, and of a room of the other source, where they meet.
DRAWN = ["id", "floor", "page", "number", "na", "ma", "aa", "generic_a", "letters_a", "skip"]
ROOM = ["other", "target", "base", "nb", "mb", "ab", "generic_b", "letters_b"]


def _alike_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of drawn rooms and rooms of one project that share a number, a cell of area or a key of a name; b has a
    row for each of a room's storeys (``floor``).  A pair comes once for all that is shared in one way."""
    cell = lambda c: F.floor(F.col(c) / (2 * SAME_AREA))
    near_a, near_b = a.withColumn("k", F.explode(F.array(*[cell("aa") + d for d in (-1, 0, 1)]))), b.withColumn("k", cell("ab"))
    keyed = lambda side, name, within: side.where(f"{name} <> ''").withColumn("k", F.explode(alike_keys(F.col(name), within)))
    ways = [(a.where("na <> ''").withColumn("k", F.col("na")), b.withColumn("k", F.col("nb"))), (near_a, near_b)]
    ways += [(keyed(a, "ma", within), keyed(b, "mb", not within)) for within in (True, False)]
    pairs = None
    for x, y in ways:
        met = x.join(y, ["project", "floor", "k"]).select("project", *DRAWN, *ROOM)
        pairs = met if pairs is None else pairs.union(met)
    return pairs.distinct()


def _sides(rows: DataFrame) -> DataFrame:
    """project, a (drawn room) and b (room of the other source; both may be null), with what is compared: each text is
    brought into its form once for a room, not for each pair."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = rows.select(
        "project", F.col("drawn").isNotNull().alias("is_a"), F.col("room").isNotNull().alias("is_b"), F.col("drawn.id").alias("id"), folded(text("drawn.floor")).alias("floor"), F.coalesce("drawn.page", F.lit(0)).alias("page"),
        F.col("drawn.number").alias("number"), repaired_room_number(text("drawn.number")).alias("na"), folded(text("drawn.name")).alias("ma"), F.col("drawn.area").alias("aa"), F.col("room.id").alias("other"), folded("room.floor").alias("target"),
        floor_base(F.col("room.floor")).alias("base"), repaired_room_number(text("room.number")).alias("nb"), folded(text("room.name")).alias("mb"), F.col("room.area").alias("ab"),
    )
    skip = F.col("ma").rlike(r"^(ruimte(\s*\d+)?|toilet|toiletruimte)?$") | (F.col("floor") == "")
    own = own.withColumns({f"{p}_{x}": f(F.col(f"m{x}")) for x in "ab" for p, f in (("generic", lambda m: m.rlike(GENERIC)), ("letters", name_letters))}).withColumn("skip", skip)
    return own.select("project", F.when(F.col("is_a"), F.struct(*DRAWN)).alias("a"), F.when(F.col("is_b"), F.struct(*ROOM)).alias("b"))


def _few_pairs(sides: DataFrame) -> DataFrame:
    """All pairs of each project's drawn rooms and rooms of their storey, and each drawn room by itself (target null)."""
    both = sides.groupBy("project").agg(F.array_distinct(F.collect_list("a")).alias("a"), F.collect_list("b").alias("b"))
    none = F.array(F.lit(None).cast(sides.schema["b"].dataType))
    each = both.select("project", F.concat(none, "b").alias("b"), F.inline("a"))
    met = each.select("project", *DRAWN, F.explode(F.when(F.col("skip"), none).otherwise(F.col("b"))).alias("b"))
    # a room has a base even without a storey (""), a drawn room by itself has none
    return met.select("project", *DRAWN, "b.*").where("base IS NULL OR floor = base OR floor = target")


def _many_pairs(sides: DataFrame) -> DataFrame:
    """The same for projects with many rooms: of their pairs, those that can have a score."""
    a, b = (sides.where(f"{x} IS NOT NULL").select("project", f"{x}.*").distinct() for x in "ab")
    storeys = rewritten(b.withColumn("floor", F.col("base")).unionByName(b.withColumn("floor", F.col("target")).where("target <> base")))
    alone = a.select("project", *DRAWN, *[F.lit(None).cast(b.schema[c].dataType).alias(c) for c in ROOM])
    return alone.union(_alike_pairs(a.where("NOT skip"), storeys))


def _best(pairs: DataFrame) -> DataFrame:
    """pairs with a score, one for each drawn room and storey, with raw, score, triple, ...; rooms by themselves as they are."""
    generic = F.col("generic_a") | F.col("generic_b")
    off = F.round(F.abs(F.col("aa") - F.col("ab")).cast("double"), 6)
    pairs = pairs.withColumns({"off": off, "named": (F.col("ma") != "") & (F.col("mb") != "")})
    alike = F.col("named") & ~generic & named_alike(F.col("ma"), F.col("mb"), F.col("letters_a"), F.col("letters_b"))
    pairs = pairs.withColumns({"by_number": (F.col("na") != "") & (F.col("na") == F.col("nb")), "by_name": alike, "by_area": F.coalesce(F.col("off") <= SAME_AREA, F.lit(False))})
    by_number, by_name, by_area, off = (F.col(c) for c in ("by_number", "by_name", "by_area", "off"))
    conflict = F.col("named") & ~generic & ~by_name
    raw = (
        F.when(by_number & ~by_name & ~by_area, 10.0)
        .when(by_number & by_name & by_area, 100.0)
        .when(by_number & by_name, 85.0)
        .when(by_name & by_area & (F.col("na") != ""), 80.0)
        .when(by_number & by_area & ~conflict, 70.0)
        .when(by_number & conflict, 15.0)
        .when(by_name, 40.0)
        .when(by_area, 25.0)
    )
    bonus = F.coalesce(F.greatest(F.lit(0.0), 5.0 - F.least(F.lit(5.0), off * 20)), F.lit(0.0))
    # what agrees in nothing has no score
    scored = pairs.where(F.col("target").isNull() | by_number | by_area | by_name).withColumns({"raw": raw, "conflict": conflict})
    scored = scored.select("project", "id", "floor", "page", "number", "na", "target", "other", "nb", "by_number", "by_name", "by_area", "conflict", "off", "raw", (F.col("raw") + bonus).alias("score"))
    rank = F.row_number().over(Window.partitionBy("project", "id", "target").orderBy(F.desc("score"), F.coalesce("off", F.lit(999.0)), "other"))
    return scored.withColumn("rank", rank).where("target IS NULL OR rank = 1").withColumns({"strong": F.col("raw") >= 70, "triple": by_number & by_name & by_area})


def storeys_by_section(drawn: DataFrame, rooms: DataFrame) -> DataFrame:
    """project, id, floor, moved_from, number, by_page of drawn rooms (project, id, floor, number, name,
    area, page), where those of a storey that the other source (same columns) divides into sections go to
    the section whose rooms they are.

    A page votes for the section on which its rooms' best strong matches with equal areas lie (a match of
    number, name and area counts twice; two votes make it the page's).  A room goes to its best strong
    section if it fits better than where it is: with the page, or by number, name and area, or where a
    room of its number has another name.  Its number is put right if name and area prove the other.
    Equal rows are one room.
    """
    as_one = lambda side, name, *more: side.select("project", F.struct("id", "floor", "number", "name", "area", *more).alias(name))
    rows = as_one(drawn, "drawn", "page").unionByName(as_one(rooms, "room"), allowMissingColumns=True)
    counts = rows.groupBy("project").agg(F.count("drawn").alias("n"), F.count("room").alias("m"))
    return storeys_of_rows(rows, counts.where((F.least("n", "m") > FEW_ROOMS) | (F.greatest("n", "m") > ROOMS_HELD)).select("project"))


def storeys_of_rows(rows: DataFrame, large: DataFrame) -> DataFrame:
    """``storeys_by_section`` of rows (project; drawn and room, structs of these columns, either may be null).  large: the
    projects with more than FEW_ROOMS of both, or ROOMS_HELD of one; keys of names are only made for these, others are
    paired as they are.

    All that is joined is of one project, so that rows dealt by project meet, are ranked and vote where they are.
    """
    large = rewritten(large)
    if large.isEmpty():
        pairs = _few_pairs(_sides(rows))
    else:
        pairs = _few_pairs(_sides(rows.join(large, "project", "left_anti"))).unionByName(_many_pairs(_sides(rows.join(large, "project", "left_semi"))))
    found = _best(pairs)
    # the best section of a room, and how well it fits where it is
    own, no = Window.partitionBy("project", "id"), F.lit(False)
    section = (F.col("target") != F.col("floor")) & F.col("strong")
    best = F.min(F.when(section, F.struct((-F.col("score")).alias("less"), "target", "triple", "nb", "by_name", "by_area", "by_number", "off"))).over(own)
    now = F.max(F.when(F.col("target") == F.col("floor"), F.struct("strong", "score", "conflict"))).over(own)
    vote = F.when(section & F.col("by_area") & (F.col("page") > 0), F.when(F.col("triple"), 2).otherwise(1))
    voters = found.withColumns({"best": best, "now": now, "vote": vote}).where("target IS NULL OR vote IS NOT NULL").select("project", "id", "floor", "page", "number", "na", "target", "best", "now", "vote")
    # the section that a page votes for
    votes = voters.withColumn("votes", F.sum("vote").over(Window.partitionBy("project", "page", "target")))
    first = F.min(F.when(F.col("votes") >= 2, F.struct((-F.col("votes")).alias("less"), "target"))).over(Window.partitionBy("project", "page"))
    all_ = votes.withColumn("section", first).where("target IS NULL").select("project", "id", "floor", "number", "na", "now", F.col("section.target").alias("section"), "best.*")
    now_score, conflict, strong = F.coalesce("now.score", F.lit(0.0)), F.coalesce("now.conflict", no), F.coalesce("now.strong", no)
    at_page = F.col("section").eqNullSafe(F.col("target"))
    stays = (
        F.col("target").isNull()
        | (strong & (now_score >= -F.col("less")))
        | (strong & ~conflict & ~at_page)
        | (F.col("section").isNotNull() & ~at_page & ~F.col("triple"))
        | (F.col("section").isNull() & ~F.col("triple") & ~conflict)
    )
    all_ = all_.withColumns({"moved": ~F.coalesce(stays, F.lit(True)), "at_page": at_page})
    moved, better = F.col("moved"), (F.col("nb") != "") & ((F.col("na") == "") | ~F.col("by_number")) & F.col("by_name") & F.col("by_area") & (F.col("off") <= SAME_AREA)
    return all_.select(
        "project", "id", F.when(moved, F.col("target")).otherwise(F.col("floor")).alias("floor"), F.when(moved, F.col("floor")).alias("moved_from"),
        F.when(moved & F.coalesce(better, no), F.col("nb")).otherwise(F.col("number")).alias("number"), (moved & F.col("at_page")).alias("by_page"),
    )


def storeys_from_page(rooms: DataFrame) -> DataFrame:
    """rooms whose unknown storey is that of the only one that their page names; others as they are."""
    unknown = F.lower(F.trim(F.coalesce("floor", F.lit("")))).isin("", "onbekend")
    known = rooms.where(~unknown & (F.coalesce("page", F.lit(0)) > 0)).groupBy("project", "page").agg(F.min(folded("floor")).alias("a"), F.max(folded("floor")).alias("b"), F.min("floor").alias("only"))
    joined = rooms.join(known.where("a = b").select("project", "page", "only"), ["project", "page"], "left")
    return joined.withColumn("floor", F.when(unknown & F.col("only").isNotNull(), F.col("only")).otherwise(F.col("floor"))).drop("only").select(rooms.columns)

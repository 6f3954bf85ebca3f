"""Days of assignments with their clock times, double bookings, and who fits a job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewspark.functions import calendar as cal
from crewspark.operators import intervals

#: A work day's first and last minute, its hours, and what counts as equal.
DAY_START, DAY_END, DAY_HOURS, HOURS_NEAR = 8 * 60, 16 * 60, 8, 0.01


def day_intervals(ranges: DataFrame, keys: Sequence[str], saturday: Column | bool = False, sunday: Column | bool = False) -> DataFrame:
    """keys, day, start_min, end_min: a range's work days (first_day, last_day, start_min, end_min).  The first
    work day begins at the range's time, the last one ends at its; all others are whole.  Days without
    a minute are left out; a time that isn't given is the day's."""
    days = ranges.withColumn("__days", cal.workdays(F.col("first_day"), F.col("last_day"), saturday, sunday))
    each = days.select(*keys, F.coalesce("start_min", F.lit(DAY_START)).alias("__a"), F.coalesce("end_min", F.lit(DAY_END)).alias("__b"), F.array_min("__days").alias("__first"), F.array_max("__days").alias("__last"), F.explode("__days").alias("day"))
    start = F.when(F.col("day") == F.col("__first"), F.col("__a")).otherwise(DAY_START)
    end = F.when(F.col("day") == F.col("__last"), F.col("__b")).otherwise(DAY_END)
    return each.select(*keys, "day", start.alias("start_min"), end.alias("end_min")).where("end_min > start_min")


def double_bookings(rows: DataFrame, keys: Sequence[str], start: str, end: str, seconds_an_hour: int = 3600) -> DataFrame:
    """keys, peak, capacity, hours of the keys (a worker's day) with more at once than there are people.

    rows: keys, start, end, capacity (people), budget (hours of a day).  One person is only booked twice
    when the day's hours are beyond the budget: times may overlap while the hours fit.
    """
    facts = rows.groupBy(*keys).agg(F.max("capacity").alias("capacity"), F.max("budget").alias("budget"), F.round(F.sum(F.col(end) - F.col(start)) / seconds_an_hour, 2).alias("hours"))
    peaks = intervals.peak(rows, keys, start, end)
    joined = facts.join(peaks, list(keys))
    fits = (F.col("capacity") == 1) & (F.col("hours") <= F.col("budget") + HOURS_NEAR)
    return joined.where(~fits & (F.col("peak") > F.col("capacity"))).select(*keys, "peak", "capacity", "hours")


def crew_conflicts(proposals: DataFrame, existing: DataFrame, budget: float = DAY_HOURS) -> DataFrame:
    """proposal, day, person, used: the first day of each proposal (proposal, person, day, start_min, end_min, hours)
    on which a named person is over the day's hours with what stands in the way.

    existing: id, person, day, start_min, end_min, hours.  Assignments count with their hours once, whoever
    of the proposal's people they have; a day without overlap is no conflict.  The last name is told.
    """
    p, e = proposals.alias("p"), existing.alias("e")
    same = (F.col("p.person") == F.col("e.person")) & (F.col("p.day") == F.col("e.day")) & (F.col("p.start_min") < F.col("e.end_min")) & (F.col("e.start_min") < F.col("p.end_min"))
    met = p.join(e, same).select("p.proposal", "p.day", F.col("p.hours").alias("adding"), "e.id", "e.person", "e.hours")
    once = met.groupBy("proposal", "day", "id").agg(F.max("adding").alias("adding"), F.max("hours").alias("hours"), F.max("person").alias("person"))
    days = once.groupBy("proposal", "day").agg(F.round(F.sum("hours") + F.max("adding"), 2).alias("used"), F.max("person").alias("person"))
    over = days.where(F.col("used") > budget + HOURS_NEAR)
    return over.groupBy("proposal").agg(F.min(F.struct("day", "person", "used")).alias("x")).select("proposal", "x.day", "x.person", "x.used")


def person_status(skilled: Column, busy: Column, away: Column) -> Column:
    """no_skill, busy (or away) or available."""
    return F.when(~F.coalesce(skilled, F.lit(False)), "no_skill").when(F.coalesce(busy, F.lit(False)) | F.coalesce(away, F.lit(False)), "busy").otherwise("available")


def fitting_teams(people: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, selectable, status, suitable, total of teams of people (keys, skilled, busy, away): a team of two or
    more is partly there if one fits; a single one has a person's status."""
    status = person_status(F.col("skilled"), F.col("busy"), F.col("away"))
    each = people.withColumn("__status", status).groupBy(*keys).agg(F.count_if(F.col("__status") == "available").alias("suitable"), F.count("*").alias("total"), F.max("__status").alias("__one"))
    team = F.when(F.col("suitable") > 0, "partial").otherwise("unavailable")
    return each.select(*keys, (F.col("suitable") > 0).alias("selectable"), F.when(F.col("total") > 1, team).otherwise(F.col("__one")).alias("status"), "suitable", "total")


def person_weeks(days: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """keys, worked, absence, absence by kind, days away and summary of days (keys, planned, away: hours of absence, kind,
    structural).  Worked are the planned hours that the absence leaves of a day; structural absence
    isn't counted as such."""
    away = F.coalesce("away", F.lit(0))
    worked = F.greatest(F.lit(0), F.least(F.col("planned"), F.lit(DAY_HOURS) - away))
    told = F.when(F.col("kind").isNotNull() & ~F.coalesce("structural", F.lit(False)), away).otherwise(0)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, told)), F.lit(0)).alias(f"away_{k}")
    sums = days.groupBy(*keys).agg(F.sum(worked).alias("worked"), F.sum(told).alias("absence"), *[of(k) for k in kinds], F.count_if((told > 0) & (worked < HOURS_NEAR)).alias("days_away"))
    most = F.array_max(F.array(*[F.struct(F.col(f"away_{k}").alias("h"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(kinds)]))
    summary = F.when(F.col("absence") <= HOURS_NEAR, "present").when(F.col("worked") > HOURS_NEAR, F.concat(F.lit("partly "), most["k"])).otherwise(most["k"])
    return sums.withColumn("summary", summary)


def week_reviews(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, state and reviewed_at of entries (keys, status, reviewed_at): approved if all are, submitted if any
    is open, else rejected; reviewed at the last review of those that the state rests on."""
    st = F.col("status")
    state = F.when(F.bool_and(st == "approved"), "approved").when(F.bool_or(~st.isin("approved", "rejected")), "submitted").otherwise("rejected")
    at = lambda s: F.max(F.when(st == s, F.col("reviewed_at")))
    each = rows.groupBy(*keys).agg(state.alias("state"), at("approved").alias("__a"), at("rejected").alias("__r"))
    return each.select(*keys, "state", F.when(F.col("state") == "approved", F.col("__a")).when(F.col("state") == "rejected", F.col("__r")).alias("reviewed_at"))


#: States of a room's row, and those that stop a sheet.
ROW_STATES, BLOCKING = ("certain", "generous", "estimated", "review", "missing", "not_applicable"), ("review", "missing")


def room_counters(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, rooms, a counter for each state, blocking, linked (floor and skirting), skirtings by their length's
    state, without length, and ready (nothing blocks and something is there) of rows (keys, state; confirmed
    counts as certain; floor_linked, plinth: none, net, generous, estimated or no length)."""
    st = F.when(F.col("state") == "confirmed", "certain").otherwise(F.col("state"))
    own = rows.withColumn("__s", st)
    counts = [F.count_if(F.col("__s") == s).alias(s) for s in ROW_STATES]
    plinths = [F.count_if(F.col("plinth") == p).alias(f"plinth_{p}") for p in ("net", "generous", "estimated")]
    out = own.groupBy(*keys).agg(F.count("*").alias("rooms"), *counts, F.count_if("floor_linked").alias("floors"), *plinths, F.count_if(F.col("plinth") == "no length").alias("plinth_missing"))
    blocking = sum((F.col(b) for b in BLOCKING), F.lit(0))
    some = F.col("certain") + F.col("generous") + F.col("estimated") > 0
    return out.withColumns({"blocking": blocking, "plinths": F.col("plinth_net") + F.col("plinth_generous") + F.col("plinth_estimated"), "ready": (blocking == 0) & some})


def booking_warnings(rows: DataFrame, team: str, person: str, day: str, start: str, end: str) -> DataFrame:
    """team, people (those booked twice at once, in order), first_day, days: one warning for each team that has any.
    rows: team, person, day, start, end.  What a team's people add up to is found by person and day first."""
    peaks = intervals.peak(rows, [team, person, day], start, end).where("peak > 1")
    each = peaks.groupBy(team, person).agg(F.min(day).alias("first_day"))
    days = peaks.select(team, day).distinct().groupBy(team).agg(F.count("*").alias("days"))
    people = each.groupBy(team).agg(F.array_sort(F.collect_list(person)).alias("people"), F.min("first_day").alias("first_day"))
    return people.join(days, team)


#: Units of surfaces and lengths.
METRES = ("m2", "m²", "m1", "m¹", "lm")


def metre_quantity(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, quantity: the labour lines' (keys, unit, quantity, labour) metres of each key, null up to 0.0001."""
    unit = F.rtrim(F.lower(F.trim("unit")), F.lit("."))
    metres = F.col("labour") & unit.isin(*METRES)
    total = F.round(F.sum(F.when(metres, F.col("quantity"))), 2)
    return lines.groupBy(*keys).agg(F.when(total > 0.0001, total).alias("quantity"))

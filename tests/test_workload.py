"""Workload, search, money and name rules on stated cases."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from crewspark.functions import labor, text
from crewspark.operators import search, workload


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_day_intervals(spark):
    rows = [(1, date(2026, 9, 4), date(2026, 9, 8), 600, 720), (2, date(2026, 9, 5), date(2026, 9, 6), 600, 720), (3, date(2026, 9, 7), date(2026, 9, 7), 720, 600), (4, date(2026, 9, 7), date(2026, 9, 7), None, None)]
    df = spark.createDataFrame(rows, "k int, first_day date, last_day date, start_min int, end_min int")
    got = sorted((r.k, r.day.day, r.start_min, r.end_min) for r in workload.day_intervals(df, ["k"]).collect())
    assert got == [(1, 4, 600, 960), (1, 7, 480, 960), (1, 8, 480, 720), (4, 7, 480, 960)]
    assert workload.day_intervals(df, ["k"], saturday=True).where("k = 2").count() == 1


def test_double_bookings(spark):
    """One person may have overlaps while the hours fit; a team may have as many as its people."""
    rows = [("fits", 0, 3600, 1, 2), ("fits", 0, 3600, 1, 2), ("over", 0, 3600, 1, 2), ("over", 0, 3700, 1, 2), ("later", 0, 9000, 1, 2), ("later", 9000, 18000, 1, 2), ("team", 0, 9, 2, 2), ("team", 0, 9, 2, 2), ("crowd", 0, 9, 2, 2), ("crowd", 0, 9, 2, 2), ("crowd", 8, 9, 2, 2)]
    df = spark.createDataFrame(rows, "k string, s long, e long, capacity int, budget int")
    assert {(r.k, r.peak) for r in workload.double_bookings(df, ["k"], "s", "e").collect()} == {("over", 2), ("crowd", 3)}


def test_crew_conflicts(spark):
    schema = "{} long, person string, day date, start_min int, end_min int, hours decimal(12,2)"
    d = date(2026, 9, 7)
    e = spark.createDataFrame([(1, "a", d, 480, 720, Decimal(4)), (1, "b", d, 480, 720, Decimal(4)), (2, "a", d, 900, 960, Decimal(9)), (3, "c", d, 480, 960, Decimal(8))], schema.format("id"))
    p = spark.createDataFrame([(10, "a", d, 600, 780, Decimal(3)), (10, "b", d, 600, 780, Decimal(3)), (11, "a", d, 600, 900, Decimal(5)), (12, "c", d, 0, 480, Decimal(8))], schema.format("proposal"))
    assert [(r.proposal, r.person, float(r.used)) for r in workload.crew_conflicts(p, e).collect()] == [(11, "a", 9.0)]


def test_fitting_teams(spark):
    rows = [("t", True, False, False), ("t", True, True, False), ("t", False, False, False), ("u", True, False, True), ("u", None, None, None), ("v", True, None, False), ("w", False, True, False)]
    got = {r.team: tuple(r)[1:] for r in workload.fitting_teams(spark.createDataFrame(rows, "team string, skilled boolean, busy boolean, away boolean"), ["team"]).collect()}
    assert got == {"t": (True, "partial", 1, 3), "u": (False, "unavailable", 0, 2), "v": (True, "available", 1, 1), "w": (False, "no_skill", 0, 1)}


def test_search_takes_signs_as_they_are(spark):
    df = spark.createDataFrame([(1, "10% off", "x", "a"), (2, "100 off", None, "b"), (3, "a_b", "y", "c"), (4, "axb", "y", "c"), (5, None, None, None)], "id int, name string, notes string, kind string")
    ids = lambda *a, **k: sorted(r.id for r in search.matching_search(df, *a, **k).collect())
    assert ids("10%", ["name", "notes"]) == [1] and ids(" A_B ", ["name"]) == [3] and ids("  ", ["name"]) == [1, 2, 3, 4, 5]
    assert ids("shop", ["name"], kind="kind", badges={"b": "Workshop"}) == [2] and ids("sh", ["name"], kind="kind", badges={"b": "Workshop"}) == []
    related = df.where("name = 'axb'").select("notes")
    assert ids("100", ["name"], [(related, "notes")]) == [2, 3, 4]


def test_labour_status_and_finance(spark):
    d = lambda x: F.lit(x).cast("decimal(12,2)")
    own = lambda *a: one(spark, labor.status(*map(d, a)).alias("x"))[0]
    assert own(10, 7, 0, 7, None, None).asDict() == {"remaining": 3, "overrun": 0, "percent": 70, "tone": "ok", "warnings": []}
    assert own(10, 8, 0, 8, None, None)[2:] == (80, "warn", ["hours nearly used up"]) and own(10, 11, 0, 0, None, None)[2:] == (110, "over", ["hours used up"])
    assert own(10, 4, 11, 12, 5, 6)[3:] == ("over", ["actual above budget", "planned above budget", "price above budget"])
    assert own(0, 4, 0, 4, None, None)[2:] == (None, "none", []) and own(None, 4, 0, 4, 1, 2)[2:] == (None, "over", ["price above budget"])
    f = lambda *a: tuple(one(spark, labor.finance(*[F.lit(x).cast("long") for x in a]).alias("x"))[0])
    assert f(100_000, 40_000, 60_050) == (60_000, 39_950, 40.0, 20_050, 50.1, "ok", "over")
    assert f(None, 0, 5) == (None, None, None, 5, None, "none", "over") and f(0, 10, 5)[2] is None and f(10, 10, 25)[2:] == (-150.0, 15, 150.0, "over", "over")
    hours = lambda s, a, b: tuple(one(spark, labor.accounted(F.lit(s), d(a), d(b)).alias("x"))[0])
    assert hours("approved", 8, 7) == (7, True) and hours("approved", 8, None) == (0, False) and hours("submitted", 8, 7) == (8, False) and hours("approved", 8, 8) == (8, False)
    late = lambda end, rest: one(spark, labor.behind(F.lit(end).cast("date"), F.lit(rest), F.lit("2026-01-10").cast("date")))[0]
    assert late("2026-01-12", 1) and not late("2026-01-13", 1) and not late("2026-01-01", 0) and not late(None, 1)


def test_names_in_texts_and_storeys(spark):
    found = lambda a, b: one(spark, text.name_in_text(F.lit(a), F.lit(b)))[0]
    assert found("Hal", "0.01 HAL 12 m2") and found("kantoor", "kkaannttoooorr") and found("berging", "bbberrrging") and found("keuken", "kxexuxkxexn")
    assert not found("hal", "h a x l") and not found("keuken", "kxxxexxxuxxxkxxxexxxn") and not found("", "hal") and not found("hal", None) and not found("keuken", "neukek")
    assert one(spark, *[text.floor_from_number(F.lit(n)) for n in ("0.03", " 2-14a", "12.1", "A-01", "7", None)]) == ("begane grond", "verdieping 2", "verdieping 12", None, None, None)


def test_person_weeks_and_reviews(spark):
    rows = [("a", 8, 3, "ill", False), ("a", 8, None, None, None), ("b", 8, 8, "leave", False), ("c", 8, 4, "leave", True), ("d", 4, 4, "ill", False), ("d", 0, 8, "leave", False)]
    got = {r.k: tuple(r)[1:] for r in workload.person_weeks(spark.createDataFrame(rows, "k string, planned int, away int, kind string, structural boolean"), ["k"], ["ill", "leave"]).collect()}
    assert got == {"a": (13, 3, 3, 0, 0, "partly ill"), "b": (0, 8, 0, 8, 1, "leave"), "c": (4, 0, 0, 0, 0, "present"), "d": (4, 12, 4, 8, 1, "partly leave")}
    rows = [("a", "approved", 1), ("a", "approved", 3), ("b", "approved", 5), ("b", "rejected", 2), ("c", "approved", 1), ("c", "submitted", None), ("d", "rejected", None)]
    got = {r.k: (r.state, r.reviewed_at) for r in workload.week_reviews(spark.createDataFrame(rows, "k string, status string, reviewed_at int"), ["k"]).collect()}
    assert got == {"a": ("approved", 3), "b": ("rejected", 2), "c": ("submitted", None), "d": ("rejected", None)}


def test_room_counters(spark):
    rows = [("a", s, True, p) for s, p in [("certain", "net"), ("confirmed", "generous"), ("generous", None), ("not_applicable", "no length")]] + [("b", "estimated", False, "estimated"), ("b", "missing", None, None), ("c", "not_applicable", False, None)]
    got = {r.k: r for r in workload.room_counters(spark.createDataFrame(rows, "k string, state string, floor_linked boolean, plinth string"), ["k"]).collect()}
    assert (got["a"].certain, got["a"].floors, got["a"].plinths, got["a"].plinth_missing, got["a"].ready) == (2, 4, 2, 1, True)
    assert (got["b"].blocking, got["b"].ready, got["c"].blocking, got["c"].ready) == (1, False, 0, False)


def test_work_outcomes(spark):
    from crewspark.operators import work_match

    catalog = spark.createDataFrame([(1, "Tapijt Desso"), (1, "Tapijt Ege"), (1, "PVC Gerflor"), (2, "Vinyl Forbo"), (1, " ")], "project int, name string")
    cases = {
        "Schuren en egaliseren": ("matched", "Primen/egaliseren"), "Primer onder pvc gerflor": ("matched", "PVC Gerflor"), "leggen TAPIJT desso": ("matched", "Tapijt Desso"), "tapijt leggen": ("review", None),
        "vinyl banen": ("matched", "Vinyl"), "pvc stroken": ("matched", "PVC Gerflor"), "transport tapijt": ("warning", "Tapijt"), "voorrij kosten": ("matched", "Overige"), "diversen": ("review", None), "": ("review", None),
    }
    rows = [(1, i, d, None) for i, d in enumerate(cases)] + [(1, 100, "arbeid", ["Coral Brush"]), (1, 101, "arbeid", ["Tapijt b", "Tapijt a"]), (1, 102, "arbeid", ["Tapijt b", "Vinyl a"]), (1, 103, None, None)]
    got = {r.id: r for r in work_match.matched_works(spark.createDataFrame(rows, "project int, id int, description string, materials array<string>"), catalog).collect()}
    assert {d: (got[i].outcome, got[i].label) for i, d in enumerate(cases)} == cases
    assert got[list(cases).index("tapijt leggen")].candidates == ["Tapijt Desso", "Tapijt Ege"]
    assert [(got[i].outcome, got[i].label) for i in (100, 101, 102, 103)] == [("matched", "Coral Brush"), ("warning", "Tapijt a"), ("review", None), ("review", None)]


def test_booking_warnings_and_metres(spark):
    d = date(2026, 9, 7)
    rows = [("t", "b", d, 0, 9), ("t", "b", d, 8, 12), ("t", "a", d, 0, 5), ("t", "a", d, 4, 6), ("t", "c", d, 0, 5), ("t", "c", d, 5, 9), ("u", "e", d, 0, 5)]
    got = workload.booking_warnings(spark.createDataFrame(rows, "team string, person string, day date, s long, e long"), "team", "person", "day", "s", "e").collect()
    assert [(r.team, r.people, r.first_day, r.days) for r in got] == [("t", ["a", "b"], d, 1)]
    rows = [("a", "M2.", 2.5, True), ("a", " lm", 1.0, True), ("a", "uur", 9.0, True), ("a", "m2", 9.0, False), ("b", "m1", 0.00001, True), ("c", "st", 4.0, True)]
    got = {r.k: r.quantity for r in workload.metre_quantity(spark.createDataFrame(rows, "k string, unit string, quantity double, labour boolean"), ["k"]).collect()}
    assert got == {"a": 3.5, "b": None, "c": None}


def test_phone_numbers(spark):
    cases = {"06-12345678": ("31612345678", "06-12345678"), "+31 (0)6 12 34 56 78": ("31612345678", "06-12345678"), "0031612345678": ("31612345678", "06-12345678"), "+48 690668857": ("48690668857", "+48 690668857"), "0612": (None, "0612"), "020-1234567": ("0201234567", "020-1234567"), "": (None, "")}
    for written, want in cases.items():
        assert one(spark, text.phone_id(F.lit(written)), text.phone_shown(F.lit(written))) == want, written
    assert one(spark, text.phone_id(F.lit(None).cast("string")), text.phone_shown(F.lit(None).cast("string"))) == (None, "")

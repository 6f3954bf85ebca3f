"""Floor plans, team lists, labour rows and roll-ups on stated cases."""

import random

from pyspark.sql import functions as F

from crewspark.operators import cost_rows, site_texts

PLAN = """Plattegrond
Bouwlaag: 1e verdieping
1.01 Kantoor 23,50 m²
1.02
Hal
12 m2
Schaal 1:100
1.03 - Berging

4,0 m²
1.04
1.05 Spoel ruimte | 1.234,5 m²
9.99 Geen ruimte
11.01 Ook niet 3 m²
1.50 m²
1.02 Entree 99 m²
Begane grond
1-07a  kantoor   m¹ schaal 1:50
17,25 m² en 12,5 m1"""


def lines(spark, text, document=1):
    return spark.createDataFrame([(document, i, t) for i, t in enumerate(text.split("\n"))], "document_id long, line_no long, text string")


def test_floor_plan(spark):
    rows = {(r.storey, r.number): (r.name, r.area and float(r.area), r.needs_review) for r in site_texts.floor_plan_rooms(lines(spark, PLAN)).collect()}
    assert rows == {
        ("verdieping 1", "1.01"): ("Kantoor", 23.5, False),
        ("verdieping 1", "1.02"): ("Hal", 12.0, False),  # its first place gives both
        ("verdieping 1", "1.03"): ("Berging", None, True),  # an empty line ends the search
        ("verdieping 1", "1.05"): ("Spoel ruimte | 1.", 234.5, False),  # an amount has no points between thousands
        ("begane grond", "1-07a"): ("kantoor m¹", 17.25, False),
    }
    unsure = [r.number for r in site_texts.floor_plan_lines(lines(spark, PLAN)).where("uncertain").collect()]
    assert unsure == ["1.04"]
    assert site_texts.floor_plan_rooms(lines(spark, "")).count() == 0


def test_floor_plan_takes_what_is_missing_from_a_later_place(spark):
    text = "0.01\n\n0.01 Hal\n\n0,02\n0.01 5 m²\n0.03\n0.01 Gang 7 m²"
    got = [tuple(r) for r in site_texts.floor_plan_rooms(lines(spark, text)).collect()]
    assert [(r[1], r[2], r[3], float(r[4]), r[5]) for r in got] == [("onbekend", "0.01", "Hal", 5.0, False)]


def test_team_lists(spark):
    text = "Ploegen 2026\nTeam 7 noord\nzzp\n4 personen\nNamen: An, Bo\nVakkennis: pvc, Tapijt; pvc\nTel: 0612345678\nContact: Cy\n\nPLOEG Zuid\r\nType: onderaannemer\nmail: Info@Zuid.nl\nBedrijf - Zuid bv\nstraat: Laan 1\nPostcode: 1234ab\nPersonen: 80"
    df = spark.createDataFrame([(1, text), (2, "geen ploeg hier"), (3, None), (4, "Naam: Los\nTeamleden: a/b/c")], "document_id long, text string")
    got = {(r.document_id, r.name): r for r in site_texts.team_lists(df).collect()}
    assert set(got) == {(1, "Team 7"), (1, "PLOEG Zuid"), (4, "Los")}
    a, b, c = got[1, "Team 7"], got[1, "PLOEG Zuid"], got[4, "Los"]
    assert (a.type, a.people, a.crew, a.skills, a.phone, a.contact) == ("zzp", 4, ["An", "Bo"], ["pvc", "Tapijt"], "+31612345678", "Cy")
    assert (b.type, b.people, b.email, b.company, b.address, b.postcode) == ("onderaannemer", 50, "info@zuid.nl", "Zuid bv", "Laan 1", "1234AB")
    assert (c.type, c.people) == ("eigen", 3)


def test_claimed_materials(spark):
    """Only the first labour row can have what stands before it, and only if nothing follows."""
    rows = [("a", i, kind, q) for i, (kind, q) in enumerate([("m", 5), ("l", 0), ("l", 0), ("m", 2), ("m", None), ("m", 3), ("l", 0)])]
    rows += [("b", 0, "m", 7), ("b", 1, "l", 0), ("b", 2, "m", 1), ("c", 0, "m", 1), (None, 0, "m", 4), (None, 1, "l", 0)]
    df = spark.createDataFrame(rows, "k string, at int, kind string, q long")
    got = cost_rows.claimed_materials(df, ["k"], ["at"], F.col("kind") == "l", F.col("q") > 0, "q")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1, 1, 5), ("a", 2, 2, 5), ("a", 6, 0, 0), ("b", 1, 1, 1), (None, 1, 1, 4)], key=str)


def test_rolled_up(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice("xy"), rng.choice([2025, 2026]), rng.randint(1, 3), rng.randint(1, 9)) for _ in range(60)]
    got = cost_rows.rolled_up(spark.createDataFrame(rows, "work string, team string, year int, week int, h long"), ["work", "team"], ["year", "week"], h=F.sum("h")).collect()
    want = {}
    for w, t, y, k, h in rows:
        for level, down in enumerate([(None, None), (w, None), (w, t)]):
            for span, across in enumerate([(None, None), (y, None), (y, k)]):
                key = (*down, *across, level, span)
                want[key] = want.get(key, 0) + h
    assert {tuple(r)[:-1]: r.h for r in got} == want and len(got) == len(want)
    sheet = cost_rows.week_sheet(spark.createDataFrame(rows, "work string, team string, year int, week int, h long"), ["work", "team"], "week", "h", [1, 2, 3]).collect()
    assert len(sheet) == 7 and all(r.total == (r.w1 or 0) + (r.w2 or 0) + (r.w3 or 0) for r in sheet)

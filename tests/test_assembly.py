"""Take-off sheets, pairing, absences and the like on small inputs."""

import datetime as dt

from pyspark.sql import functions as F

from crewspark.operators import assembly, takeoff_text

SHEET = """Meetstaat
Opdrachtgever : Gemeente Zuid
Werknr : 55

10.1a Gietvloer glad,
grijs
Bouwlaag: begane grond
Ruimte Oppervlakte Omtrek
00.10 hal 200.00 m² 60.00 m
00.11 1.321,86 m²
Totaal 1521.86 m² 60.00 m
Pagina 2

Bouwlaag: verdieping 1
01.02 grote zaal 40,50 m²
Netto : 1.562,36 m²
10.2 Tapijt
Bouwlaag: verdieping 2
02.01 kantoor 80.00 m² 36.00 m
Netto : 90,00 m²"""


def test_take_off_sheet(spark):
    lines = spark.createDataFrame([(7, i, t) for i, t in enumerate(SHEET.split("\n"))], "document_id long, line_no int, text string")
    parsed = takeoff_text.parsed(lines)
    rooms = [(r.product, r.storey, r.number, r.name, float(r.area), r.perimeter and float(r.perimeter)) for r in takeoff_text.rooms(parsed).orderBy("line_no").collect()]
    first = "10.1a Gietvloer glad, grijs"
    assert rooms == [
        (first, "begane grond", "00.10", "hal", 200.0, 60.0), (first, "begane grond", "00.11", None, 1321.86, None),
        (first, "verdieping 1", "01.02", "grote zaal", 40.5, None), ("10.2 Tapijt", "verdieping 2", "02.01", "kantoor", 80.0, 36.0),
    ]
    totals = {r.product: (r.rooms, float(r.calculated), float(r.declared), r.status) for r in takeoff_text.products(parsed).collect()}
    assert totals == {first: (3, 1562.36, 1562.36, "ok"), "10.2 Tapijt": (1, 80.0, 90.0, "check")}
    assert {(r.field, r.value) for r in takeoff_text.headers(lines).collect()} == {("opdrachtgever", "Gemeente Zuid"), ("werknr", "55")}


def test_pairs_by_place(spark):
    left = spark.createDataFrame([(1, 1, "a", "x"), (2, 2, "a", "x"), (3, 3, "a", "y")], "id long, at long, floor string, name string")
    right = spark.createDataFrame([(10, 1, "a", "x"), (11, 2, "a", "z")], "id long, at long, floor string, name string")
    got = {(r.id, r.other, r.confidence) for r in assembly.positional_pairs(left, right, [["floor", "name"], ["floor"]], [0.82, 0.55], "at").collect()}
    assert got == {(1, 10, 0.82), (2, 11, 0.55)}


def test_tasks_and_hints(spark):
    df = spark.createDataFrame([("k", 1, 10.0), ("k", 2, 10.02), ("k", 3, 4.0), ("k", 4, 12.0)], "k string, at long, q double")
    assert assembly.merged_tasks(df, ["k"], ["at"], "q", 0.05).first().q == 12.0
    rows = spark.createDataFrame([("k", None, "t"), ("l", 1.0, None)], "k string, v double, t string")
    hints = spark.createDataFrame([("k", 2, 7.0, "u"), ("k", 1, None, "w"), ("m", 1, 1.0, "u")], "k string, at long, v double, t string")
    got = {r.k: (r.v, r.t, r.filled) for r in assembly.enriched(rows, hints, ["k"], ["v", "t"], "at").collect()}
    assert got == {"k": (7.0, "t", ["v"]), "l": (1.0, None, [])}
    assert {r.k: r.q for r in assembly.first_positive(spark.createDataFrame([("k", 1, 0.0), ("k", 2, 3.0), ("n", 1, None)], "k string, at long, q double"), ["k"], ["at"], "q").collect()} == {"k": 3.0, "n": None}


def test_absences_by_rank_and_slot(spark):
    d = dt.date
    w = spark.createDataFrame([(1, d(2026, 1, 5), d(2026, 1, 6), "leave", "day"), (1, d(2026, 1, 6), d(2026, 1, 6), "sick", "afternoon"), (1, d(2026, 1, 5), d(2026, 1, 5), "leave", "morning")], "person long, first_day date, last_day date, kind string, slot string")
    got = {r.day.day: (r.kind, r.start_min, r.end_min) for r in assembly.absences(w, ["person"], {"sick": 0, "leave": 1}).collect()}
    assert got == {5: ("leave", 0, 1440), 6: ("sick", 720, 1440)}


def test_initials_and_labels(spark):
    df = spark.createDataFrame([(1, "Ann Bo"), (2, " alice  b"), (3, "Cor")], "id long, name string")
    assert {r.id: r.initials for r in assembly.initials(df, "name", "id").collect()} == {1: "AB", 2: "AB2", 3: "C"}
    r = df.select(assembly.label_score(F.lit("1.02"), F.lit("Hal"), F.lit("x 1.02")).alias("a"), assembly.label_score(F.lit("9"), F.lit("Hal"), F.lit("HAL")).alias("b"), assembly.label_score(F.lit(""), F.lit("q"), F.lit("x")).alias("c")).first()
    assert tuple(r) == (1.0, 0.82, None)


def test_parts_and_uncertain_lines(spark):
    sheet = """00.01 hal 2,00 m²
10.1 Vloer grijs
00.02 hal 10,00 m² 4,00 m
Bouwlaag: kelder
x1 gang 3,00 m²
X1 gang 2,00 m² 1,00 m
00.02 hal 1,00 m²
10.2 Tapijt
a9 nis 7,00 m²"""
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(sheet.split("\n"))], "document_id long, line_no int, text string")
    parsed = takeoff_text.parsed(lines)
    tasks = {(r.storey, r.number, r.product): (float(r.area), r.perimeter and float(r.perimeter), r.parts, r.duplicate) for r in takeoff_text.room_tasks(parsed).collect()}
    assert tasks == {
        ("begane grond", "00.02", "10.1 Vloer grijs"): (10.0, 4.0, 1, False), ("kelder", "x1", "10.1 Vloer grijs"): (5.0, 1.0, 2, True),
        ("kelder", "00.02", "10.1 Vloer grijs"): (1.0, None, 1, False), ("onbekend", "a9", "10.2 Tapijt"): (7.0, None, 1, False),
    }
    assert {(r.line_no, r.reason) for r in takeoff_text.uncertain_lines(parsed).collect()} == {(0, "no product"), (8, "no storey")}


def test_summed_tasks(spark):
    rows = [("r", "Coral Brush", "m2", 10.0), ("r", "coral-brush, PVC", None, 10.04), ("r", "Coral Brush", "m2", 4.0), ("r", "Coral Brush", "m2", 12.0), ("r", "Coral Brush", "m1", 3.0), ("r", "Coral", "m2", None), ("r", " ", "m2", 5.0), (None, "x", "m2", 1.0), (None, "x", "m2", 2.0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, name string, unit string, quantity double, at int")
    got = {(r.k, r.unit, r.name): (r.quantity, r.parts) for r in assembly.summed_tasks(df, ["k"], ["at"]).collect()}
    assert got == {("r", "m2", "coral-brush, PVC"): (22.0, 4), ("r", "m1", "Coral Brush"): (3.0, 1), ("r", "m2", "Coral"): (0.0, 1), (None, "m2", "x"): (3.0, 2)}

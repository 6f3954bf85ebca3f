"""Material lists, cut lists and scanned dimensions, by hand."""

from crewspark.operators import lists


def lines_of(spark, *texts):
    rows = [(d, i, line) for d, t in enumerate(texts) for i, line in enumerate(t.split("\n"))]
    return spark.createDataFrame(rows, "document_id int, line_no int, text string")


def test_material_list(spark):
    text = """Materialenstaat
Project: School
Netto: 4 m²
V.01 Marmoleum  Real 12,5 m²
kleur 3032
Pagina 2
Bruto - Deur: 99 m1
Tarkett iQ Granit
Netto: 1.234,50 m²
Plakplint wit, edit_square
Bruto - Deur: 45,2 m1
Holplint 60 mm
02.10.03a coating 7 m2
Netto: 8
een losse regel
Desso tegels 30 m²"""
    got = [(r.work_no, r.name, r.unit, None if r.declared is None else float(r.declared)) for r in lists.materials(lines_of(spark, text, "niets hier", "")).orderBy("work_no").collect()]
    assert got == [
        (1, "V.01 Marmoleum Real kleur 3032", "m2", 12.5), (2, "Tarkett iQ Granit", "m2", 1234.5), (3, "Plakplint wit", "m1", 45.2), (4, "Holplint 60 mm", "m1", None),
        (5, "02.10.03a coating een losse regel", "m2", 8.0), (6, "Desso tegels", "m2", 30.0),
    ]


def test_cut_list(spark):
    text = """Snijmaten
12 begane grond hal 8.15
Marmoleum Real, 3032
/ banen / vinyl
Verdieping 1
1.04 kantoor 12,5 m²
1.04 kantoor 99 m²
-99 verdieping 2 instructie 6.55
1.05 hal, plinten wit 4 m2
totaal 40"""
    parts = lists.cuts(lines_of(spark, text))
    got = [(r.storey, r.number, r.name, None if r.area is None else float(r.area), r.product, r.open) for r in parts.orderBy("line_no").collect()]
    product = "Marmoleum Real, 3032 / banen / vinyl"
    assert got == [
        ("begane grond", None, "hal", None, None, True), ("verdieping 1", "1.04", "kantoor", 12.5, product, False), ("verdieping 1", "1.04", "kantoor", 99.0, product, False),
        ("verdieping 2", None, "instructie", None, product, False), ("verdieping 1", "1.05", "hal,", 4.0, "plinten wit 4 m2", False),
    ]
    rooms = {r.room: (r.storey, r.name, r.area and float(r.area), r.products) for r in lists.cut_rooms(parts).collect()}
    assert rooms["1.04"] == ("verdieping 1", "kantoor", 12.5, [product.lower()]) and rooms["instructie"][0] == "verdieping 2" and len(rooms) == 3


def test_scanned_dimensions(spark):
    texts = [
        (1, "Ruimte 1: 12,5 m2 bruto 14 m²\nruimte 2a bruto 20 m² netto 18 m²\nRuimte 3 onleesbaar\nruimte 1 99 m²\nTotaal netto: 30,55 m²\nsnijverlies 8,5 %"),
        (2, "Ruimte 4 = 10 m²\nnetto totaal 12 m2"),
        (3, "niets"),
        (4, None),
    ]
    df = spark.createDataFrame(texts, "document_id int, text string")
    rooms = lists.scanned_rooms(df)
    got = {(r.document_id, r.number): (float(r.area), None if r.gross is None else float(r.gross), r.status) for r in rooms.collect()}
    assert got == {(1, "1"): (12.5, 14.0, "ok"), (1, "2A"): (18.0, 20.0, "ok"), (1, "3"): (0.0, None, "controleren"), (2, "4"): (10.0, None, "ok")}
    totals = {r.document_id: (float(r.net), r.declared_net and float(r.declared_net), r.gross and float(r.gross), r.loss and float(r.loss), r.closes) for r in lists.scanned_totals(df, rooms).collect()}
    assert totals == {1: (30.5, 30.55, 20.0, 8.5, True), 2: (10.0, 12.0, None, None, False), 3: (0.0, None, None, None, True), 4: (0.0, None, None, None, True)}

"""Delimited text, workbooks and cards."""

from pyspark.sql import functions as F

from crewspark.sources import contacts, delimited, workbook


def test_delimited_text(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Ruimte;m²\r\n\"A;1\";12,5\r\n".encode())
    (tmp_path / "b.csv").write_bytes("name,café\rx,y\r".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes(b"one\ttwo\n\n")
    got = sorted((r.file[-5:], r.row_no, r.cells) for r in delimited.read_delimited(spark, str(tmp_path)).collect())
    assert got == [("a.csv", 1, ["Ruimte", "m²"]), ("a.csv", 2, ["A;1", "12,5"]), ("b.csv", 1, ["name", "café"]), ("b.csv", 2, ["x", "y"]), ("c.csv", 1, ["one", "two"]), ("c.csv", 2, [])]


def test_headers_and_roles(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a title,\nRoom,Area,Room\n1,20,x\n")
    cells = delimited.long_cells(delimited.read_delimited(spark, str(tmp_path)))
    roles = {"room": ["room", "ruimte"], "area": ["area", "m2"]}
    heads = delimited.header_rows(cells, roles)
    assert [(r.row_no, r.found) for r in heads.collect()] == [(2, 2)]
    assert {(r.col_no, r.role) for r in delimited.column_roles(cells, heads, roles).collect()} == {(1, "room"), (2, "area")}


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, 2.5, "a<b"), ("p", 2, None, "é"), ("q", 3, 1.0, None)], "k string, n long, v double, t string")
    for r in workbook.workbooks(df, ["k"]).collect():
        (tmp_path / f"{r.k}-{r.part}.xlsx").write_bytes(bytes(r.content))
    (tmp_path / "no.xlsx").write_bytes(b"not a workbook")
    rows = workbook.read_workbooks(spark, str(tmp_path))
    got = sorted((r.file[-8:], r.row_no, r.cells) for r in rows.collect())
    assert got == [("p-0.xlsx", 1, ["n", "v", "t"]), ("p-0.xlsx", 2, ["1", "2.5", "a<b"]), ("p-0.xlsx", 3, ["2", "", "é"]), ("q-0.xlsx", 1, ["n", "v", "t"]), ("q-0.xlsx", 2, ["3", "1.0"])]


def test_column_names():
    assert [workbook.column_name(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]
    assert all(workbook.column_number(workbook.column_name(n) + "5") == n for n in range(1, 800))


def test_cards(spark):
    people = spark.createDataFrame([(1, "Ann", "06 11112222"), (2, "ann", "0611113333"), (3, "Bob", "+31622"), (4, "Bobby", "0031 622"), (5, "Nil", None)], "id long, name string, phone string")
    shown = sorted(x.split("FN:")[1].split("\r\n")[0] for (x,) in contacts.contact_cards(people).collect())
    assert shown == ["Ann (2222)", "Bob", "ann (3333)"]
    assert contacts.contact_cards(people.where(F.lit(False))).count() == 0


def test_files_that_are_not_read_have_an_error(spark, tmp_path, monkeypatch):
    (tmp_path / "small.csv").write_text("a;b\n")
    (tmp_path / "large.csv").write_text("x" * 2_000)
    (tmp_path / "middle.csv").write_text("y" * 500)
    (tmp_path / "broken.xlsx").write_bytes(b"PK not a zip")
    monkeypatch.setattr(delimited, "MAX_BYTES", 1_000)
    got = {(r.file.rsplit("/", 1)[1], r.row_no, r.error) for r in delimited.read_delimited(spark, str(tmp_path), memory=3_000).collect() if not r.file.endswith("xlsx")}
    assert got == {("small.csv", 1, None), ("large.csv", None, "2000 bytes, more than 1000"), ("middle.csv", None, "500 bytes, too many for the memory")}
    assert {r.error is None for r in delimited.read_delimited(spark, str(tmp_path)).where("file LIKE '%middle.csv'").collect()} == {True}
    broken = [r for r in workbook.read_workbooks(spark, str(tmp_path)).collect() if r.file.endswith("broken.xlsx")]
    assert len(broken) == 1 and broken[0].error and broken[0].cells is None
    assert delimited.long_cells(delimited.read_delimited(spark, str(tmp_path), memory=3_000)).where("file LIKE '%e.csv'").count() == 0


def sheet(name, rows):
    return [(name, "s", i, j, v) for i, row in enumerate(rows, 1) for j, v in enumerate(row, 1) if v is not None]


def test_columns_by_contents(spark):
    from crewspark.sources import columns

    blank = [[f"0{i}.1{i}", "kantoor", "12,5", "m2", "v0" + str(i)] for i in range(1, 5)]
    titled = [["Meetstaat", None, None], [None, "Oppervlakte", "Vertrek"], ["01-01", "20", "hal"], ["01-02", "21", "gang"], ["Totaal", "41", None]]
    double = [[f"01-0{i}", "hal", f"02-0{i}", "gang"] for i in range(1, 4)]
    learned = [["Kolom X", "Bedrag"], ["01-01", "1"], ["01-02", "2"]]
    same = [["Ruimtenr", "Vloer"], *[[f"01-0{i}", "v05"] for i in range(1, 7)]]
    rows = [*sheet("blank", blank), *sheet("titled", titled), *sheet("double", double), *sheet("learned", learned), *sheet("same", same)]
    cells = spark.createDataFrame(rows, "file string, sheet string, row_no int, col_no int, value string")
    memory = spark.createDataFrame([("kolom x", "room_number"), ("bedrag", "unit")], "header string, role string")
    got = {}
    for r in columns.guessed_columns(cells, memory).collect():
        got.setdefault((r.file, r.part), set()).add((r.header_row, r.role, r.col_no, r.sure))
    assert got[("blank", 1)] == {(None, "room_number", 1, True), (None, "room_name", 2, True), (None, "floor_finish", 5, True), (None, "unit", 4, True)}
    assert got[("titled", 1)] == {(2, "room_number", 1, True), (2, "room_name", 3, True), (2, "quantity", 2, True)}
    assert got[("double", 1)] == {(None, "room_number", 1, True), (None, "room_name", 2, True)}
    assert got[("double", 2)] == {(None, "room_number", 3, True), (None, "room_name", 4, True)}
    assert got[("learned", 1)] == {(1, "room_number", 1, True)}  # a memory counts where the contents agree
    assert got[("same", 1)] == {(1, "room_number", 1, True)}  # one code all along is no finish of rooms
    assert columns.guessed_columns(cells.limit(0)).count() == 0


def test_values_are_not_repeated_for_each_header(spark):
    from crewspark.sources import columns

    rows = [("f", None, i, 1, "Ruimte nr." if i == 1 else f"01-{i % 90 + 10}") for i in range(1, 61)]
    got = columns.guessed_columns(spark.createDataFrame(rows, "file string, sheet string, row_no int, col_no int, value string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1  # places in a column; none below each header
    assert [(r.header_row, r.role, r.col_no, r.points, r.sure) for r in got.collect()] == [(1, "room_number", 1, 10, True)]


def test_cells_of_a_sheet_stay_together(spark):
    from crewspark.catalogue import QUERIES

    plan = QUERIES["guessed_columns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # lines and orders are dealt by order; no cell or header is shuffled after that
    assert plan.count("Exchange hashpartitioning(") == plan.count("REPARTITION_BY_NUM") == 2
    assert plan.count("regexp_extract") == 1 and "collect_list" not in plan


def test_sheets_in_pieces(monkeypatch):
    import pyarrow as pa

    from crewspark.sources import columns

    names = ["file", "sheet", "part", "header_row", "role", "col_no", "points", "sure"]
    schema = pa.schema(list(zip(names, [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_()], strict=True)))
    rooms, head = [(i, True, 1, None, 0, 0) for i in range(2, 6)], (1, True, 0, None, 6, 0)  # a header of a number, and room numbers
    rows = [(f, None, c, *r) for f in "abc" for c in (1, 4) for r in ([head, *rooms] if c == 1 else rooms[:2] if f == "b" else rooms[:0])]
    batch = pa.RecordBatch.from_pydict(dict(zip(["file", "sheet", "col_no", "row_no", "seen", "bits", "code", "points", "learned"], map(list, zip(*rows, strict=True)), strict=True)))
    batch = batch.set_column(1, "sheet", pa.nulls(len(rows), pa.string())).set_column(6, "code", pa.nulls(len(rows), pa.string()))
    got = []
    for most in (1, 4, 1000):
        monkeypatch.setattr(columns, "ROWS_AT_ONCE", most)
        pieces = [batch.slice(i, 3) for i in range(0, len(rows), 3)]
        got.append(sorted(tuple(r.values()) for b in columns._sheet_by_sheet(schema)(iter(pieces)) for r in b.to_pylist()))
    assert got[0] == got[1] == got[2]  # wherever a batch ends
    assert got[0] == [("a", None, 1, 1, "room_number", 1, 10, True), ("b", None, 1, 1, "room_number", 1, 10, True), ("b", None, 2, None, "room_number", 4, 4, True), ("c", None, 1, 1, "room_number", 1, 10, True)]


def test_numbers_are_known_without_being_read(spark):
    from crewspark.functions import numbers

    texts = ["12", "12,5", "1.234,5", "V01", "xm2", "m2", "m 2", "m12", "12 m2", "-3", "a-3", "3.", ",5", "1e5", "e5", "n.v.t.", "-", "", "½", "9" * 13, "9" * 20, "x" + "9" * 20, "1 2", "5\n"]
    df = spark.createDataFrame([(x,) for x in texts], "c string")
    got = df.select("c", numbers.is_machine_number(F.col("c")).alias("a"), numbers.machine_number(F.col("c")).isNotNull().alias("b")).collect()
    assert [(r.c, r.a) for r in got] == [(r.c, r.b) for r in got]

"""Steps whose work and memory must not grow with a table's size or be done more than once a line."""

import pytest
from pyspark.sql import functions as F

from crewspark import storage
from crewspark.catalogue import QUERIES
from crewspark.functions import numbers, text
from crewspark.operators import takeoff_text

DATA = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["labor_project", "group_totals", "floor_split"])
def test_tasks_are_as_many_as_rows_need(spark, monkeypatch, name):
    monkeypatch.setattr(storage, "ROWS_A_TASK", 500)
    n = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert n > 4 and f", {n})" in plan and "REPARTITION_BY_NUM" in plan


def test_line_kinds_are_found_once(spark):
    lines = spark.createDataFrame([(1, 1, "Vloer"), (1, 2, "Ruimte Oppervlakte"), (1, 3, "rood"), (1, 4, "Bouwlaag: 1"), (1, 5, "1.01 hal 3,50 m² 1.234,5 m"), (1, 6, "1.02 2.5 m²"), (1, 7, "Netto: 6,0 m²")], "document_id int, line_no int, text string")
    parsed = takeoff_text.parsed(lines)
    # a skipped line between two lines of a name doesn't part them
    assert [(r.product, r.rooms, float(r.calculated), r.status) for r in takeoff_text.products(parsed).collect()] == [("Vloer rood", 2, 6.0, "ok")]
    assert [float(r.perimeter) for r in parsed.where("perimeter IS NOT NULL").collect()] == [1234.5]
    table = spark.read.parquet(f"{DATA}/part.parquet").select(F.col("p_partkey").alias("document_id"), F.col("p_size").alias("line_no"), F.upper("p_name").alias("text"))
    assert optimized(takeoff_text.products(takeoff_text.parsed(table))).count(takeoff_text.SKIPPED) == 1


def test_cells_are_read_as_texts(spark):
    cells = ["", "-", "12", "12,5", "12.50", "1.234", "1,234", "1.234,5", "0012", "-3", "3,", "3.", "n.v.t.", "1234567890123", "12,345.6", ".5", "5 m2", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    c = F.col("c")
    got = df.select("c", numbers.cell_number(c).alias("a"), numbers.parse_number(c).alias("b"), numbers.sheet_number(c).alias("d"), numbers.machine_number(c).alias("e")).collect()
    assert [(r.c, r.a, r.d) for r in got] == [(r.c, r.b, r.e) for r in got]


def test_room_ranges_are_taken_apart_once(spark):
    df = spark.createDataFrame([("A-00-08/11",), ("B-1",), ("9/8",), ("1/99",), (None,)], "n string")
    got = [r[0] for r in df.select(text.expand_rooms(F.col("n"))).collect()]
    assert got == [["A-00-08", "A-00-09", "A-00-10", "A-00-11"], ["B-1"], ["9/8"], ["1/99"], [None]]
    labels = spark.read.parquet(f"{DATA}/part.parquet").select(text.expand_rooms(F.col("p_name")).alias("x"))
    assert optimized(labels).count("regexp_extract") == 3


def test_imports_are_shared_without_issues(spark):
    plan = QUERIES["closure_shares"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    # imports, rooms, tasks, storeys and documents (twice) are dealt by import once; nothing is shuffled again, no issue becomes a row
    assert plan.count("Exchange hashpartitioning(") == plan.count("REPARTITION_BY_NUM") == 6 and "to be reviewed" not in plan

"""Columns of sheets made of order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewspark.plans.registry import query, table
from crewspark.sources import columns
from crewspark.storage import tasks_for

HEADS = {"F": ("Ruimte nr.", "Ruimtenaam", "Hoeveelheid", "Eenheid", "Vloerafwerking"), "O": ("Code", "Omschrijving", "m2", "Eh", "Kleur")}
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


@query("""WITH l AS (SELECT l_orderkey AS file, o_orderstatus AS kind, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
  s AS (SELECT *, CASE WHEN n > 1 THEN 4 ELSE 2 END AS c FROM l),
  r AS (SELECT file, kind, n, unnest(CASE
    WHEN kind = 'F' THEN [{'role': 'room_number', 'col_no': 1, 'points': 6 + c, 'sure': true}, {'role': 'room_name', 'col_no': 2, 'points': 6 + c, 'sure': true}, {'role': 'floor_finish', 'col_no': 5, 'points': 6 + c, 'sure': true},
      {'role': 'quantity', 'col_no': 3, 'points': 6 + c, 'sure': true}, {'role': 'unit', 'col_no': 4, 'points': 6 + c, 'sure': true}]
    WHEN kind = 'O' AND n > 1 THEN [{'role': 'room_number', 'col_no': 1, 'points': 4, 'sure': true}, {'role': 'room_name', 'col_no': 2, 'points': 4, 'sure': true}, {'role': 'floor_finish', 'col_no': 5, 'points': 4, 'sure': true},
      {'role': 'quantity', 'col_no': 3, 'points': 8, 'sure': true}, {'role': 'unit', 'col_no': 4, 'points': 8, 'sure': true}]
    WHEN kind = 'O' THEN [{'role': 'product', 'col_no': 2, 'points': 5, 'sure': false}, {'role': 'quantity', 'col_no': 3, 'points': 6, 'sure': true}, {'role': 'unit', 'col_no': 4, 'points': 6, 'sure': true}]
    WHEN n > 1 THEN [{'role': 'room_number', 'col_no': 1, 'points': 4, 'sure': true}, {'role': 'room_name', 'col_no': 2, 'points': 4, 'sure': true}, {'role': 'floor_finish', 'col_no': 5, 'points': 4, 'sure': true}, {'role': 'unit', 'col_no': 4, 'points': 4, 'sure': true}]
    ELSE [{'role': 'quantity', 'col_no': 4, 'points': 4, 'sure': false}] END) AS x FROM s)
  SELECT CAST(file AS VARCHAR) AS file, CASE WHEN kind <> 'P' OR n = 1 THEN 1 END AS header_row, x.role AS role, x.col_no AS col_no, x.points AS points, x.sure AS sure FROM r""")
def guessed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sheets, with full headers, with vague ones, and without any: roles by words and contents."""
    li, p, o = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    # an order's lines come together once; its cells stay where they are
    n = tasks_for(li)
    joined = li.join(p, li["l_partkey"] == p["p_partkey"]).repartition(n, "l_orderkey").join(o.repartition(n, "o_orderkey"), li["l_orderkey"] == o["o_orderkey"])
    own = joined.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", "))))
    k = F.col("k")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    cells = F.array(
        F.concat(F.lit("0"), F.col("l_linenumber"), F.lit("."), two(F.col("l_partkey") % 100)), F.col("p_name"),
        F.format_string("%d,%02d", F.col("l_quantity").cast("int"), (F.round(F.col("l_quantity") * 100) % 100).cast("int")), F.lit("m2"), F.concat(F.lit("V"), two(k % 100)),
    )
    status = F.col("o_orderstatus")
    head = F.when(status == "F", F.array(*map(F.lit, HEADS["F"]))).otherwise(F.array(*map(F.lit, HEADS["O"])))
    row = lambda at, c: F.struct(at.cast("int").alias("row_no"), c.alias("cells"))
    body = F.when(status == "P", F.array(row(k, cells))).when(k == 1, F.array(row(F.lit(1), head), row(k + 1, cells))).otherwise(F.array(row(k + 1, cells)))
    each = own.select(F.col("l_orderkey").alias("file"), F.lit(None).cast("string").alias("sheet"), F.inline(body)).select("file", "sheet", "row_no", F.posexplode("cells").alias("at", "value"))
    return columns.guessed_columns(each.withColumn("col_no", F.col("at") + 1), together=True).select(F.col("file").cast("string").alias("file"), "header_row", "role", "col_no", "points", "sure")

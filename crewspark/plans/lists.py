"""Material lists, cut lists and scanned dimensions: written from lines of the tables, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewspark.operators import lists
from crewspark.plans.production import LINES, lines
from crewspark.plans.registry import query, table

#: Forms of lines: {q} is a line's quantity, {d} its last digit.
MATERIALS = ("Pagina {q}", "V.0{d} Marmoleum {q},5 m²", "V.1{d} Gietvloer", "kleur {q}", "Netto: {q} m²", "Bruto - Deur: {q},25 m1", "Tarkett serie {q}", "Holplint wit", "Tapijt, soort, {q}", "Coral {q} m2")
CUTS = ("Verdieping {d}", "Marmoleum rood, {q}", "/ banen / vinyl", "1.0{d} kantoor {q} m²", "2-1{d} hal, plint zwart", "{q} begane grond lokaal {q}.15", "Totaal {q}")

WRITTEN = f"{LINES}, w AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY room, item, q) AS n, item + 3 * room AS t, CAST(q AS INTEGER) AS q, CAST(q AS INTEGER) % 10 AS d FROM lines)"


def written(spark: SparkSession, sf_dir: str, forms: tuple[str, ...]) -> DataFrame:
    li = lines(spark, sf_dir)
    form = F.element_at(F.array(*[F.lit(f) for f in forms]), ((F.col("item") + 3 * F.col("room")) % len(forms) + 1).cast("int"))
    q = F.col("q").cast("int")
    text = F.replace(F.replace(form, F.lit("{q}"), q.cast("string")), F.lit("{d}"), (q % 10).cast("string"))
    n = F.row_number().over(Window.partitionBy("project").orderBy("room", "item", "q"))
    return li.select(F.col("project").alias("document_id"), n.alias("line_no"), text.alias("text"))


def _double(c: str) -> Column:
    return F.col(c).cast("double").alias(c)


@query(f"""WITH {WRITTEN}, k AS (SELECT project, n, t % 10 AS t, q, d, coalesce(last_value(CASE WHEN t % 10 IN (1, 2) THEN true WHEN t % 10 IN (6, 9) THEN false END IGNORE NULLS) OVER (PARTITION BY project ORDER BY n), false) AS under FROM w),
  b AS (SELECT *, t IN (1, 2, 6, 9) OR (t IN (7, 8) AND NOT under) AS begins, under AND t IN (3, 7, 8) AS more FROM k),
  c AS (SELECT *, count(*) FILTER (WHERE begins) OVER (PARTITION BY project ORDER BY n) AS work_no FROM b),
  a AS (SELECT project, work_no, string_agg(CASE WHEN begins OR more THEN CASE t WHEN 1 THEN 'V.0' || d || ' Marmoleum' WHEN 2 THEN 'V.1' || d || ' Gietvloer' WHEN 3 THEN 'kleur ' || q WHEN 6 THEN 'Tarkett serie ' || q WHEN 7 THEN 'Holplint wit' WHEN 8 THEN 'Tapijt, soort, ' || q WHEN 9 THEN 'Coral' END END, ' ' ORDER BY n) AS name,
    max(CASE t WHEN 1 THEN q + 0.5 WHEN 9 THEN q END) AS area, arg_max(q, n) FILTER (WHERE t = 4) AS net, arg_min(q + 0.25, n) FILTER (WHERE t = 5) AS gross, max(n) FILTER (WHERE t = 4) AS net_at, min(n) FILTER (WHERE t = 5) AS gross_at, coalesce(max(n) FILTER (WHERE more), -1) AS more_at FROM c WHERE work_no > 0 GROUP BY 1, 2)
  SELECT project AS document_id, work_no, name, CASE WHEN net_at > more_at THEN 'm2' WHEN net IS NULL AND area IS NULL AND gross_at > more_at THEN 'm1' WHEN contains(name, 'plint') THEN 'm1' ELSE 'm2' END AS unit, CAST(coalesce(net, area, gross) AS DOUBLE) AS declared FROM a""")
def material_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products and totals of material lists."""
    return lists.materials(written(spark, sf_dir, MATERIALS)).select("document_id", "work_no", "name", "unit", _double("declared"))


@query(f"""WITH {WRITTEN}, k AS (SELECT project, n, t % 7 AS t, q, d, count(*) FILTER (WHERE t % 7 = 1) OVER (PARTITION BY project ORDER BY n) AS p, coalesce(last_value(CASE WHEN t % 7 = 0 THEN 'verdieping ' || d END IGNORE NULLS) OVER (PARTITION BY project ORDER BY n), 'Onbekend') AS storey FROM w),
  f AS (SELECT *, string_agg(CASE t WHEN 1 THEN 'Marmoleum rood, ' || q WHEN 2 THEN '/ banen / vinyl' END, ' ') OVER (PARTITION BY project, p ORDER BY n) AS names FROM k),
  r AS (SELECT project, n, CASE WHEN t = 5 THEN 'begane grond' ELSE storey END AS storey, CASE t WHEN 3 THEN '1.0' || d WHEN 4 THEN '2-1' || d ELSE 'lokaal' END AS room, CASE t WHEN 3 THEN 'kantoor' WHEN 4 THEN 'hal,' ELSE 'lokaal' END AS name, CASE WHEN t = 3 THEN q END AS area,
    CASE WHEN t = 4 THEN 'plint zwart' WHEN p > 0 THEN lower(names) END AS product FROM f WHERE t IN (3, 4, 5) AND (t <> 5 OR p > 0))
  SELECT project AS document_id, storey, room, arg_min(name, n) AS name, CAST(arg_min(area, n) FILTER (WHERE area IS NOT NULL) AS DOUBLE) AS area, coalesce(string_agg(DISTINCT product, ';' ORDER BY product), '') AS products FROM r GROUP BY 1, 2, 3""")
def cut_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms of cut lists with their products."""
    rooms = lists.cut_rooms(lists.cuts(written(spark, sf_dir, CUTS)))
    return rooms.select("document_id", "storey", "room", "name", _double("area"), F.array_join("products", ";").alias("products"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each order: totals, a room with its number from the order, and a second one."""
    k = F.col("o_orderkey")
    last = F.when(k % 3 == 0, "onleesbaar").when(k % 3 == 1, "bruto 6 m² netto 4 m²").otherwise("4,75 m 2")
    text = F.concat(
        F.lit("Totaal netto: "), k % 20 + 5, F.lit(" m² bruto 99,5 m2, snijverlies 8,5 %. Verder staat op dit blad niets van belang. RUIMTE "), k % 9, F.lit("a: "), k % 20, F.lit(",5 m²\nruimte 77 "), last
    )
    return table(spark, sf_dir, "orders").select(k.alias("document_id"), text.alias("text"))


SCANS = """s AS (SELECT o_orderkey AS document_id, o_orderkey % 20 AS a, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 4.75 END AS b, CASE WHEN o_orderkey % 3 = 1 THEN 6 END AS g, o_orderkey % 9 AS room FROM orders)"""


@query(f"""WITH {SCANS} SELECT document_id, room || 'A' AS number, CAST(a + 0.5 AS DOUBLE) AS area, CAST(NULL AS DOUBLE) AS gross, 'ok' AS status FROM s
  UNION ALL SELECT document_id, '77', CAST(b AS DOUBLE), CAST(g AS DOUBLE), CASE WHEN b = 0 THEN 'controleren' ELSE 'ok' END FROM s""")
def scanned_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms read from scanned dimensions."""
    return lists.scanned_rooms(scans(spark, sf_dir)).select("document_id", "number", _double("area"), _double("gross"), "status")


@query(f"""WITH {SCANS} SELECT document_id, CAST(a + 0.5 + b AS DOUBLE) AS net, CAST(a + 5 AS DOUBLE) AS declared_net, CAST(99.5 AS DOUBLE) AS gross, CAST(8.5 AS DOUBLE) AS loss, abs(a + 5 - (a + 0.5 + b)) <= 0.10 AS closes FROM s""")
def scanned_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of scanned dimensions as written and as summed."""
    s = scans(spark, sf_dir)
    return lists.scanned_totals(s, lists.scanned_rooms(s)).select("document_id", _double("net"), _double("declared_net"), _double("gross"), _double("loss"), "closes")

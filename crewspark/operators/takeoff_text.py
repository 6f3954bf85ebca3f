"""Take-off sheets as text lines: headings, storeys, rooms, totals.

A line's kind is found from the line alone; what it belongs to (product, storey) is carried down by
windows over the document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewspark.functions.numbers import sheet_number
from crewspark.functions.text import floor_from_number
from crewspark.operators.reconcile import total_status

#: The words of the sheets.
HEADER = r"(?i)^(opdrachtgever|referentie|werknr|datum|project)\s*:\s*(.+)$"
STOREY = r"(?i)^bouwlaag\s*:\s*(.+)$"
DECLARED = r"(?i)^(netto|bruto|snijverlies)\b[^:]*:\s*([\d.,]+)"
TOTAL = r"(?i)^totaal\b"
SKIPPED = r"(?i)^(pagina\s+\d+.*|meetstaat|ruimte\b.*oppervlakte.*|)$"
ROOM = r"^(\S*\d\S*)\s+(.*?)\s*([\d.,]+)\s*m²(?:\s+([\d.,]+)\s*m1?)?\s*$"


def line_kind(line: Column) -> Column:
    return (
        F.when(line.rlike(SKIPPED), "skipped")
        .when(line.rlike(HEADER), "header")
        .when(line.rlike(STOREY), "storey")
        .when(line.rlike(DECLARED), F.lower(F.regexp_extract(line, DECLARED, 1)))
        .when(line.rlike(TOTAL), "total")
        .when(line.rlike(ROOM), "room")
        .otherwise("name")
    )


def parsed(lines: DataFrame) -> DataFrame:
    """document_id, line_no, kind, product_no, product, storey and the fields of rooms and totals.

    lines: document_id, line_no, text.  Name lines that follow each other are one product's name, and
    the next name begins another product; a storey holds until the next one or the next product.
    """
    clean = F.trim(F.regexp_replace("text", r"[ \t]+", " "))
    # skipped lines go after the windows: a filter on the kind before them would be evaluated on the line's whole expression
    own = lines.select("document_id", "line_no", clean.alias("line")).withColumn("kind", line_kind(F.col("line")))
    order = Window.partitionBy("document_id").orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    name = F.col("kind") == "name"
    above = F.last(F.nullif("kind", F.lit("skipped")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = name & (F.coalesce(above, F.lit("")) != "name")
    numbered = own.withColumn("product_no", F.count_if(begins).over(so_far))
    product = Window.partitionBy("document_id", "product_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    names = F.array_join(F.collect_list(F.when(name, F.col("line"))).over(product), " ")
    storey = F.last(F.when(F.col("kind") == "storey", F.regexp_extract("line", STOREY, 1)), ignorenulls=True).over(product)
    room, total = F.col("kind") == "room", F.col("kind").isin("netto", "bruto", "snijverlies")
    cells = {c: F.when(room, F.regexp_extract("line", ROOM, i)) for i, c in enumerate(("number", "name", "area", "perimeter"), 1)} | {"declared": F.when(total, F.regexp_extract("line", DECLARED, 2))}
    # numbers are read from cells that are columns, so that a line is taken apart once for each cell
    told = numbered.select("document_id", "line_no", "kind", "product_no", names.alias("product"), storey.alias("storey"), *[x.alias(c) for c, x in cells.items()])
    given = lambda c: F.nullif(c, F.lit(""))
    read = {"number": given("number"), "name": given("name")} | {c: sheet_number(F.col(c)) for c in ("area", "perimeter", "declared")}
    return told.where("kind <> 'skipped'").withColumns(read)


def rooms(parsed_lines: DataFrame) -> DataFrame:
    return parsed_lines.where("kind = 'room'").drop("kind", "declared")


def _placed(parsed_lines: DataFrame) -> DataFrame:
    """Rooms with their storey: the one above, else that of their number, else unknown."""
    own = parsed_lines.where("kind = 'room' AND product_no > 0")
    return own.withColumn("storey", F.coalesce("storey", floor_from_number(F.col("number")), F.lit("onbekend")))


def room_tasks(parsed_lines: DataFrame) -> DataFrame:
    """document_id, storey, number, name, product, area, perimeter, parts and duplicate: one row for each room and product.
    A room is its storey and number in any case, without a number its storey and name; lines of one
    room and product are parts of one surface, and told as duplicates."""
    own = _placed(parsed_lines)
    room = F.coalesce(F.lower("number"), F.concat(F.lit("name:"), F.lower("name")))
    each = own.withColumn("__room", room).groupBy("document_id", "storey", "__room", F.lower("product").alias("__product"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    tasks = each.agg(first("number"), first("name"), first("product"), F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"), F.count("*").alias("parts"))
    return tasks.withColumn("duplicate", F.col("parts") > 1).drop("__room", "__product")


def uncertain_lines(parsed_lines: DataFrame) -> DataFrame:
    """document_id, line_no, reason of rooms without a product above, or without a storey above or in their number."""
    own = parsed_lines.where("kind = 'room'")
    no_storey = F.col("storey").isNull() & floor_from_number(F.col("number")).isNull()
    reason = F.when(F.col("product_no") == 0, "no product").when(no_storey, "no storey")
    return own.select("document_id", "line_no", reason.alias("reason")).where("reason IS NOT NULL")


def products(parsed_lines: DataFrame) -> DataFrame:
    """document_id, product_no, product, rooms, calculated, declared (the net total) and status."""
    net = F.max(F.when(F.col("kind") == "netto", F.col("declared")))
    own = parsed_lines.where("product_no > 0").groupBy("document_id", "product_no").agg(
        F.max_by("product", "line_no").alias("product"), F.count_if(F.col("kind") == "room").alias("rooms"), F.sum("area").alias("calculated"), net.alias("declared")
    )
    return own.withColumn("status", total_status(F.col("declared"), F.col("calculated")))


def headers(lines: DataFrame) -> DataFrame:
    """document_id, field, value: the first of each field."""
    line = F.trim("text")
    found = lines.where(line.rlike(HEADER)).select("document_id", "line_no", F.lower(F.regexp_extract(line, HEADER, 1)).alias("field"), F.trim(F.regexp_extract(line, HEADER, 2)).alias("value"))
    return found.groupBy("document_id", "field").agg(F.min_by("value", "line_no").alias("value"))

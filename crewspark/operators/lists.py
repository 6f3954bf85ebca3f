"""Material lists, cut lists and scanned dimensions as text lines.

As with take-off sheets, a line's kind is found from the line alone and what it belongs to is carried
down by windows over the document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewspark.functions.numbers import cell_number, parse_number
from crewspark.functions.text import floor_label
from crewspark.operators.takeoff_text import HEADER

#: The words of the lists.
CODED = r"(?i)^(V\.\d{2}|\d{2}\.\d{2}\.\d{2}[a-z]?)\b"
MEASURED = r"^(.+?)\s+(\d+(?:[.,]\d+)?)\s*m(?:²|2\b)"
SECTION = r"(?i)^(materialenstaat|materiaalstaat|pagina|totaal|bouwlaag|artikel|opdrachtgever|referentie|werknr|werknummer|datum)\b"
BRAND = r"(?i)\b(tarkett|desso|ege|marmoleum|sikkens|coral)\b"
PRODUCT = r"(?i)tarkett|desso|ege|marmoleum|plint|gietvloer|entreemat|pvc|tapijt|linoleum|coral|coating|vinyl|granit|desert|oak|safe\.?\s*t|directie"
THREE_PARTS = r"^[^,]{2,},\s*[^,]{1,},\s*[^,]{2,}$"
METRES = r"\d+\s*m(?:²|¹|[21]?\b)"
NET, GROSS = r"(?i)^netto\s*:\s*(.+)$", r"(?i)^bruto\s*-\s*deur\s*:\s*(.+)$"
NOISE = r"(?i)\b(edit_square|banen|omtrek\s*-?\s*deur|oppervlakte|naden)\b"
CUT_SKIPPED = r"(?i)^(totaal|pagina)\b"
CUT_SECTION = r"(?i)^(snijmaten|pagina|totaal|bouwlaag|baan|groep|ruimte|tekening)\b"
CUT_MORE = r"(?i)^(?:/\s*)?(?:banen\s*/\s*)?vinyl\b|^\d{4,}\s+white\s+moss\b"
NAMED_CUT = r"(?i)^(?:\d+|-99)\s+(begane\s+grond|verdieping\s+\d+|kelder|souterrain|installatie(?:\s+ruimten?)?)\s+(.+?)\s+(\d+(?:[.,]\d+)?)$"
CUT_ROOM = r"(?<![0-9])(\d{1,2}[.\-]\d{1,3}[a-zA-Z]?)(?![0-9.\-])"
CUT_AREA = r"(\d+(?:[.,]\d+)?)\s*m(?:²|2\b)"
CUT_PRODUCT = r"(?i)(marmoleum[^,]*|plint(?:en)?[^,]*|pvc[^,]*|gietvloer[^,]*|tapijt[^,]*|vinyl[^,]*|linoleum[^,]*|coral[^,]*|coating[^,]*)"
SCAN_ROOM = r"(?i)\bruimte\s*([0-9]{1,3}[a-z]?)\b"
SCAN_AREA = r"(\d+(?:[.,]\d+)?)\s*m(?:²|2\b)"
ASIDE = r"(?i)\b(bruto|snijverlies|snij|baanlengte|baan)\b"


def _clean(text: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[\ue000-\uf8ff]", ""), "[\u00a0 \t]+", " "))


def _stripped(text: Column, marks: str) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "), F.lit(marks))


def _unit(name: Column) -> Column:
    return F.when(F.lower(name).contains("plint"), "m1").otherwise("m2")


def _is_product(line: Column, section: str) -> Column:
    return ~line.rlike(section) & ~line.rlike(METRES) & (line.rlike(PRODUCT) | line.rlike(THREE_PARTS))


def _windows():
    order = Window.partitionBy("document_id").orderBy("line_no")
    return order.rowsBetween(Window.unboundedPreceding, 0)


def materials(lines: DataFrame) -> DataFrame:
    """document_id, work_no, name, unit, declared: the products of material lists.

    lines: document_id, line_no, text.  A code, a product with its area, or a product's name begins a
    work; below a code all lines but sections and known brands continue its name.  A net total counts
    before the work's own area, and that before a gross one.
    """
    line = F.col("line")
    own = lines.select("document_id", "line_no", _clean("text").alias("line")).where((line != "") & ~line.rlike(HEADER))
    total = F.when(line.rlike(NET), parse_number(F.regexp_extract(line, NET, 1))).when(line.rlike(GROSS), parse_number(F.regexp_extract(line, GROSS, 1)))
    name = lambda x: _stripped(F.regexp_replace(x, NOISE, ""), " ,")
    inline = name(F.regexp_extract(line, MEASURED, 1))
    measured = line.rlike(MEASURED)
    kind = (
        F.when(line.rlike(CODED), "coded")
        .when(measured & (inline.rlike(PRODUCT) | inline.rlike(THREE_PARTS)), "measured")
        .when(total.isNotNull(), F.when(line.rlike(NET), "net").otherwise("gross"))
        .when(line.rlike(SECTION), "section")
        .when(_is_product(line, SECTION), F.when(line.rlike(BRAND), "brand").otherwise("product"))
        .otherwise("other")
    )
    own = own.withColumns({"kind": kind, "total": total})
    under = F.coalesce(F.last(F.when(F.col("kind").isin("coded", "measured", "brand"), F.col("kind") == "coded"), ignorenulls=True).over(_windows()), F.lit(False))
    own = own.withColumn("under", under)
    k = F.col("kind")
    begins = k.isin("coded", "measured", "brand") | ((k == "product") & ~F.col("under"))
    more = F.col("under") & k.isin("product", "other") & ~line.rlike(BRAND)
    numbered = own.withColumns({"begins": begins, "more": more}).withColumn("work_no", F.count_if(begins).over(_windows())).where("work_no > 0")
    part = F.when(F.col("begins"), name(F.when(k.isin("coded", "measured") & measured, F.regexp_extract(line, MEASURED, 1)).otherwise(line))).when(F.col("more"), _stripped(line, " ,"))
    area = F.when(k.isin("coded", "measured") & measured, parse_number(F.regexp_extract(line, MEASURED, 2)))
    at, net, gross = F.col("line_no"), k == "net", k == "gross"
    metre = F.regexp_extract(line, GROSS, 1)
    long = ~metre.rlike(r"m(²|2\b)") & (metre.rlike(r"m(¹|1\b)") | metre.rlike(r"\bm\b") | F.lower(metre).contains("m1") | F.lower(line).contains(" m"))
    works = numbered.withColumns({"part": part, "area": area, "gross_unit": F.when(long, "m1").otherwise("m2")}).groupBy("document_id", "work_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct(at, "part")))).alias("parts"), F.max("area").alias("area"),
        F.max_by("total", F.when(net, at)).alias("net"), F.min_by("total", F.when(gross, at)).alias("gross"), F.min_by("gross_unit", F.when(gross, at)).alias("gross_unit"),
        F.max(F.when(net, at)).alias("net_at"), F.min(F.when(gross, at)).alias("gross_at"), F.coalesce(F.max(F.when(F.col("more"), at)), F.lit(-1)).alias("more_at"),
    )
    full = _stripped(F.array_join(F.transform("parts", lambda p: p["part"]), " "), " ,")
    unit = (
        F.when(F.col("net_at") > F.col("more_at"), "m2")
        .when(F.col("net").isNull() & F.col("area").isNull() & (F.col("gross_at") > F.col("more_at")), F.col("gross_unit"))
        .otherwise(_unit(F.col("name")))
    )
    return works.withColumn("name", full).select("document_id", "work_no", "name", unit.alias("unit"), F.coalesce("net", "area", "gross").alias("declared")).where("name <> ''")


def cuts(lines: DataFrame) -> DataFrame:
    """document_id, line_no, storey, number, name, area, product, open: the rooms of cut lists by line.

    A storey and a product hold until the next one.  A cut that names its storey has no number and no
    area; without a product it is open.
    """
    line = F.col("line")
    own = lines.select("document_id", "line_no", _clean("text").alias("line")).where((line != "") & ~line.rlike(CUT_SKIPPED))
    number, area = F.regexp_extract(line, CUT_ROOM, 1), F.nullif(F.regexp_extract(line, CUT_AREA, 1), F.lit(""))
    is_room = (number != "") & ~F.coalesce(F.translate(F.lower(number), ",", ".") == F.translate(area, ",", "."), F.lit(False))
    kind = (
        F.when(line.rlike(CUT_MORE), "more")
        .when(line.rlike(NAMED_CUT), "named")
        .when(floor_label(line).isNotNull(), "storey")
        .when(is_room, "room")
        .when(_is_product(line, CUT_SECTION), "product")
        .otherwise("other")
    )
    k = F.col("kind")
    w = _windows()
    own = own.withColumn("kind", kind).withColumn("product_no", F.count_if(k == "product").over(w))
    by_product = Window.partitionBy("document_id", "product_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    names = F.array_join(F.collect_list(F.when(k.isin("product", "more"), line)).over(by_product), " ")
    tidy = lambda x: _stripped(F.regexp_replace(x, r"\s*/\s*", " / "), " ,/")
    current = F.when(F.col("product_no") > 0, F.nullif(tidy(F.col("names")), F.lit("")))
    own = own.withColumns({"names": names, "storey": F.coalesce(F.last(F.when(k == "storey", floor_label(line)), ignorenulls=True).over(w), F.lit("Onbekend"))})
    rest = F.trim(F.replace(line, number, F.lit(" ")))
    inline = F.regexp_extract(rest, CUT_PRODUCT, 1)
    left = F.when(inline != "", F.trim(F.replace(rest, inline, F.lit(" ")))).otherwise(rest)

    def room(x: Column) -> Column:
        x = F.trim(F.regexp_replace(x, r"(\d+(?:[.,]\d+)?)\s*m(?:²|¹|[21]\b)|(?i)\d+\s*[x×]\s*\d+", ""), F.lit(" \t-–—:|"))
        return F.when(~x.rlike(r"^[\d.,\s]*$") & (F.length(x) <= 80), x).otherwise("")

    named = k == "named"
    name = F.when(named, room(F.regexp_extract(line, NAMED_CUT, 2))).otherwise(room(left))
    storey = F.when(named, F.coalesce(floor_label(F.regexp_extract(line, NAMED_CUT, 1)), F.lower(F.regexp_extract(line, NAMED_CUT, 1)))).otherwise(F.col("storey"))
    product = F.coalesce(F.when(k == "room", F.nullif(tidy(inline), F.lit(""))), current)
    found = own.where(k.isin("room", "named")).select(
        "document_id", "line_no", storey.alias("storey"), F.when(~named, number).alias("number"), name.alias("name"),
        F.when(~named, F.coalesce(area, F.lit(""))).alias("area"), product.alias("product"), named.alias("__named"),
    ).withColumn("area", cell_number(F.col("area")))
    fits = ~F.col("__named") | ((F.col("name") != "") & ~F.col("name").rlike(r"(?i)^(totaal|groep|ruimte|tekening|baan)$"))
    opened = F.col("product").isNull() & (F.col("__named") | ((F.col("name") == "") & F.col("area").isNull()))
    return found.where(fits).withColumn("open", opened).drop("__named")


def cut_rooms(cut_lines: DataFrame) -> DataFrame:
    """document_id, storey, room (the number, else the name), name, area, products of the lines that
    aren't open; the first area and the first name that isn't the number count."""
    own = cut_lines.where(~F.col("open"))
    room = F.lower(F.coalesce(F.regexp_replace(F.translate("number", ",", "."), r"\s", ""), F.col("name")))
    at = F.col("line_no")
    named = F.when((F.col("name") != "") & (F.col("name") != F.coalesce("number", F.lit(""))), at)
    rooms = own.groupBy("document_id", "storey", room.alias("room")).agg(
        F.min_by("name", named).alias("n"), F.min_by("number", at).alias("number"), F.min_by("area", F.when(F.col("area").isNotNull(), at)).alias("area"),
        F.array_sort(F.collect_set(F.lower("product"))).alias("products"),
    )
    return rooms.select("document_id", "storey", "room", F.coalesce("n", "number").alias("name"), "area", "products")


def scanned_rooms(texts: DataFrame) -> DataFrame:
    """document_id, number, area, gross, status (ok, controleren): the rooms of scanned dimensions.

    texts: document_id, text.  A text is cut at each "ruimte n"; the area is what follows within 80
    characters, unless words tell that it is something else, then a net area in the piece.  The first
    piece of a number with an area counts.
    """
    whole = F.regexp_replace(F.regexp_replace("text", "\u00a0", " "), r"m\s*[²2]", "m²")
    pieces = texts.select("document_id", F.posexplode(F.split(whole, r"(?i)(?=\bruimte\s*[0-9]{1,3}[a-z]?\b)")).alias("at", "piece"))
    before = F.lower(F.right(F.coalesce(F.lag("piece").over(Window.partitionBy("document_id").orderBy("at")), F.lit("")), F.lit(24)))
    p, near = F.col("piece"), r"(?is)^ruimte\s*[0-9]{1,3}[a-z]?\b(.{0,80}?)" + SCAN_AREA
    between = F.regexp_extract(p, near, 1)
    aside = (between.rlike(ASIDE) & ~between.rlike(r"(?i)\bnetto\b")) | F.col("before").contains("totaal") | F.col("before").contains("snij")
    first = F.when(~aside, F.nullif(F.regexp_extract(p, near, 2), F.lit("")))
    net = F.nullif(F.regexp_extract(p, r"(?is)(?<!totaal )(?<!totaal)\bnetto\b[^0-9]{0,20}" + SCAN_AREA, 1), F.lit(""))
    gross = F.nullif(F.regexp_extract(p, r"(?is)\bbruto\b[^0-9]{0,20}" + SCAN_AREA, 1), F.lit(""))
    above = lambda x: F.when(parse_number(x) > 0, F.round(parse_number(x), 2))
    rows = pieces.withColumn("before", before).where(p.rlike(r"(?i)^ruimte\s*[0-9]{1,3}[a-z]?\b")).select(
        "document_id", "at", F.upper(F.regexp_extract(p, SCAN_ROOM, 1)).alias("number"), F.coalesce(above(first), above(net)).alias("area"), above(gross).alias("gross")
    )
    best = rows.groupBy("document_id", "number").agg(F.min_by(F.struct("area", "gross"), F.struct(F.col("area").isNull(), "at")).alias("b"))
    return best.select("document_id", "number", F.coalesce("b.area", F.lit(0)).cast("decimal(18,2)").alias("area"), F.col("b.gross").cast("decimal(18,2)").alias("gross"), F.when(F.col("b.area").isNotNull(), "ok").otherwise("controleren").alias("status"))


def scanned_totals(texts: DataFrame, rooms: DataFrame) -> DataFrame:
    """document_id, net (the sum of the rooms), declared_net, gross, loss (per cent) and closes: whether
    the net total as written is within 0.10 of the sum."""
    t = F.regexp_replace(F.regexp_replace("text", "\u00a0", " "), r"m\s*[²2]", "m²")
    one = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    written = parse_number(F.coalesce(one(r"(?i)\btotaal\s*netto\b[^0-9]{0,20}" + SCAN_AREA), one(r"(?i)\bnetto\s*totaal\b[^0-9]{0,20}" + SCAN_AREA)))
    all_gross = F.regexp_extract_all(t, F.lit(r"(?i)\bbruto\b[^0-9]{0,20}" + SCAN_AREA), F.lit(1))
    loss = parse_number(one(r"(?i)\bsnijverlies\b[^0-9%]{0,20}(\d+(?:[.,]\d+)?)\s*%"))
    own = texts.select("document_id", written.alias("declared_net"), F.array_max(F.transform(all_gross, parse_number)).alias("gross"), loss.alias("loss"))
    sums = rooms.groupBy("document_id").agg(F.sum("area").alias("net"))
    off = F.abs(F.col("declared_net") - F.col("net")) > 0.10
    return own.join(sums, "document_id", "left").withColumns({"net": F.coalesce("net", F.lit(0)).cast("decimal(18,2)"), "closes": ~F.coalesce(off, F.lit(False))})

"""Texts of floor plans and of team lists as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewspark.functions.numbers import cell_number
from crewspark.functions.text import floor_label, phone

#: A room's number, amounts of a line, and the longest name.
ROOM_NUMBER = r"(?<![0-9])([0-3][.\-]\d{1,3}[a-zA-Z]?)(?![0-9.\-])"
AREA = r"(\d+(?:[.,]\d+)?)\s*m[²2](?![\p{L}\p{N}])"
LENGTH = r"(\d+(?:[.,]\d+)?)\s*m[¹1](?![\p{L}\p{N}])"
LONGEST_NAME, LOOK_AHEAD = 80, 2

#: Labels of a team's fields, the longest first where one begins another.
LABELS = {
    "name": ["naam van het team", "teamnaam", "ploegnaam", "naam"],
    "type": ["dienstverband", "soort", "type"],
    "people": ["aantal personen", "personen", "grootte", "aantal"],
    "crew": ["personen in het team", "namen van het team", "medewerkers", "teamleden", "namen"],
    "skills": ["specialismen", "specialisatie", "werkzaamheden", "vakkennis"],
    "email": ["e-mail", "email", "mail"],
    "phone": ["telefoonnummer", "telefoon", "mobiel", "tel", "gsm"],
    "company": ["bedrijfsnaam", "zzp-bedrijf", "bedrijf"],
    "address": ["adres", "straat"],
    "postcode": ["postcode"],
    "town": ["woonplaats", "plaats", "stad"],
    "contact": ["contactpersoon", "contactnaam", "contact"],
}
MOST_PEOPLE = 50


def _name(text: Column) -> Column:
    """What is left of a line as a room's name; empty if that is a number or too long."""
    bare = reduce(lambda t, p: F.regexp_replace(t, p, ""), [AREA, LENGTH, r"(?i)\bschaal\b.*$"], text)
    own = F.btrim(bare, F.lit(" \t-–—:|"))
    return F.when(own.rlike(r"^[\d.,\s]*$") | (F.length(own) > LONGEST_NAME), "").otherwise(own)


def floor_plan_lines(lines: DataFrame) -> DataFrame:
    """document_id, line_no, storey, number, name, area and uncertain (neither name nor area) of the lines
    (document_id, line_no, text) of floor plans that begin a room.

    A storey holds until the next one.  A room without name or area takes it from the two lines below,
    up to an empty line, a storey or another room.  A number that is the line's area is no room.
    """
    flat = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x{E000}-\x{F8FF}]", ""), r"\x{A0}", " ")
    clean = F.trim(F.regexp_replace(flat, r"[ \t]+", " "))
    line = F.col("line")
    named = F.regexp_extract(line, r"(?i)bouwlaag\s*:\s*(.+)$", 1)
    number = F.regexp_extract(line, ROOM_NUMBER, 1)
    own = lines.select("document_id", "line_no", clean.alias("line")).select(
        "document_id", "line_no", (line == "").alias("blank"), floor_label(F.when(named != "", F.trim(named)).otherwise(line)).alias("head"), number.alias("number"),
        F.regexp_extract(line, AREA, 1).alias("area"), _name(line).alias("plain"), F.when(number != "", _name(F.replace(line, number, F.lit(" ")))).alias("rest"),
    ).withColumn("area", cell_number(F.col("area")))
    value = F.regexp_extract("number", r"^[0-9]+(\.[0-9]+)?", 0).try_cast("double")
    is_number = F.coalesce(F.abs(F.col("area").cast("double") - value) < 0.001, F.lit(False))
    own = own.withColumn("room", F.col("head").isNull() & (F.col("number") != "") & ~is_number)
    order = Window.partitionBy("document_id").orderBy("line_no")
    open_ = F.lit(True)
    names, areas = [F.nullif("rest", F.lit(""))], [F.col("area")]
    for n in range(1, LOOK_AHEAD + 1):
        at = lambda c, k=n: F.lead(c, k).over(order)
        open_ = open_ & F.coalesce(~at("blank") & at("head").isNull() & ~at("room"), F.lit(False))
        names.append(F.when(open_, F.nullif(at("plain"), F.lit(""))))
        areas.append(F.when(open_, at("area")))
    storey = F.last("head", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = own.withColumns({"storey": F.coalesce(storey, F.lit("onbekend")), "name": F.coalesce(*names), "found": F.coalesce(*areas)}).where("room")
    return found.select("document_id", "line_no", "storey", "number", "name", F.col("found").alias("area"), (F.col("name").isNull() & F.col("found").isNull()).alias("uncertain"))


def floor_plan_rooms(lines: DataFrame) -> DataFrame:
    """document_id, storey, number, name, area, needs_review: one row for each room; a number that a storey
    has again gives what its first place lacks.  Rooms without a name have their number as one."""
    sure = floor_plan_lines(lines).where("NOT uncertain")
    key = F.regexp_replace(F.translate(F.lower("number"), ",", "."), r"\s+", "")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    each = sure.groupBy("document_id", "storey", key.alias("key")).agg(first("number").alias("number"), first("name").alias("name"), first("area").alias("area"))
    review = F.col("name").isNull() | F.col("area").isNull()
    return each.select("document_id", "storey", "number", F.coalesce("name", "number").alias("name"), "area", review.alias("needs_review"))


def _labelled(text: Column, field: str) -> Column:
    labels = "|".join(LABELS[field])
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?i)(?:^|\n)[^\S\n]*(?:{labels})\s*[:\-][^\S\n]*(.+)", 1)), F.lit(""))


def _list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[,;/]"), lambda p: F.trim(p)), lambda p: p != "")


def team_lists(texts: DataFrame) -> DataFrame:
    """document_id, team_no, name, type (eigen, zzp, onderaannemer), people, crew, skills, email, phone, company,
    address, postcode, town, contact of the teams of texts (document_id, text).

    A line that begins with "team" or "ploeg" begins a section; fields have labels.  A section without a
    team's name is left out.  people: as stated, at least one and the named ones, at most fifty.
    """
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), r"\x{A0}", " "), r"[ \t]+\n", "\n"))
    parts = F.filter(F.split(flat, r"(?im)(?=^(?:team|ploeg)\s+\S)"), lambda p: F.trim(p) != "")
    own = texts.select("document_id", F.posexplode(parts).alias("team_no", "t"))
    t = F.col("t")
    titled = F.regexp_extract(t, r"(?im)^(?:team|ploeg)\s+([^\n]+)$", 1)
    numbered = F.regexp_extract(titled, r"^(\d+)\b", 1)
    plain = F.trim(F.regexp_extract(t, r"(?im)^((?:team|ploeg)\s+[^\n]+)$", 1))
    name = F.coalesce(_labelled(t, "name"), F.when(numbered != "", F.concat(F.lit("Team "), numbered)).when(titled != "", plain))
    said = F.lower(F.coalesce(_labelled(t, "type"), F.regexp_extract(t, r"(?im)^\s*(zzp|eigen medewerker|eigen|onderaannemer|intern)\s*$", 1)))
    kind = F.when(said.contains("onderaannemer"), "onderaannemer").when(said.rlike(r"\bzzp\b|zelfstandig"), "zzp").otherwise("eigen")
    crew = _list(_labelled(t, "crew"))
    count = F.coalesce(F.nullif(F.regexp_extract(_labelled(t, "people"), r"(\d{1,2})", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"(?i)(\d{1,2})\s*personen\b", 1), F.lit(""))).cast("int")
    people = F.least(F.lit(MOST_PEOPLE), F.greatest(F.lit(1), F.coalesce(count, F.lit(1)), F.coalesce(F.size(crew), F.lit(0))))
    email = F.nullif(F.lower(F.regexp_extract(F.coalesce(_labelled(t, "email"), t), r"(?i)[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}", 0)), F.lit(""))
    code = F.upper(F.regexp_extract(_labelled(t, "postcode"), r"(?i)\b(\d{4}\s*[A-Z]{2})\b", 1))
    rows = own.select(
        "document_id", "team_no", name.alias("name"), kind.alias("type"), people.alias("people"), crew.alias("crew"), F.array_distinct(_list(_labelled(t, "skills"))).alias("skills"),
        email.alias("email"), phone(_labelled(t, "phone")).alias("phone"), _labelled(t, "company").alias("company"), _labelled(t, "address").alias("address"),
        F.coalesce(F.nullif(code, F.lit("")), _labelled(t, "postcode")).alias("postcode"), _labelled(t, "town").alias("town"), _labelled(t, "contact").alias("contact"),
    )
    return rows.where("name IS NOT NULL")

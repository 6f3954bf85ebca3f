"""Contact cards as text rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crewspark.functions.text import phone


def contact_cards(people: DataFrame, group: str = "Crew") -> DataFrame:
    """value: one card for each number (people: id, name, phone).

    A number that several rows share is one card under the name of the least id; a name that several
    numbers have is told apart by the number's last four digits; rows without a number give none.
    """
    own = people.select("id", F.trim("name").alias("name"), phone(F.col("phone")).alias("number")).where("number IS NOT NULL")
    one = own.groupBy("number").agg(F.min_by("name", "id").alias("name"))
    shared = F.count("*").over(Window.partitionBy(F.lower("name"))) > 1
    shown = F.when(shared, F.concat("name", F.lit(" ("), F.right("number", F.lit(4)), F.lit(")"))).otherwise(F.col("name"))
    card = F.concat_ws("\r\n", F.lit("BEGIN:VCARD"), F.lit("VERSION:3.0"), F.concat(F.lit("FN:"), shown), F.concat(F.lit("TEL;TYPE=CELL:"), "number"), F.lit(f"CATEGORIES:{group}"), F.lit("END:VCARD"))
    return one.select(card.alias("value"))

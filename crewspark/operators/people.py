"""Names of people as contacts have them: which are one person, and the fullest name of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewspark.operators.clusters import connected
from crewspark.storage import rewritten

_INITIAL = r"^(.+?)\s*,\s*(\p{L}{1,2})\.?$"
_TURNED = r"^(\p{L}[\p{L}'\-]+)\s*,\s*(\p{L}[\p{L}'\-]{2,})$"


def display_name(value: Column) -> Column:
    """A name with single blanks; "Anna Vries, A." without the initial, "Vries, Anna" turned round."""
    name = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    before, initial = F.trim(F.regexp_extract(name, _INITIAL, 1)), F.upper(F.regexp_extract(name, _INITIAL, 2))
    repeats = (before != "") & F.startswith(F.upper(before), initial)
    return F.when(name.rlike(_INITIAL), F.when(repeats, before).otherwise(name)).otherwise(F.regexp_replace(name, _TURNED, "$2 $1"))


def _words(name: Column) -> Column:
    return F.filter(F.split(name, " "), lambda w: w != "")


def same_person(names: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of ids (unique) whose names (id, name) are of one person: equal ones, one that
    begins the other at a word's end, and "Vries, A." with a full name of that family and initial."""
    own = rewritten(names.select("id", F.lower(display_name(F.col("name"))).alias("name")).where("name <> ''"))
    words = own.select("id", _words(F.col("name")).alias("w"))
    starts = words.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda n: F.array_join(F.slice("w", 1, n), " "))).alias("name"))
    by_start = starts.join(own.withColumnRenamed("id", "other"), "name").select("id", "other")
    turned = own.where(F.col("name").rlike(_INITIAL)).select("id", F.trim(F.regexp_extract("name", _INITIAL, 1)).alias("family"), F.regexp_extract("name", _INITIAL, 2).alias("initial"))
    full = words.where("size(w) > 1").select(F.col("id").alias("other"), F.element_at("w", -1).alias("family"), F.explode(F.array_distinct(F.array(*[F.left(F.get("w", F.lit(0)), F.lit(n)) for n in (1, 2)]))).alias("initial"))
    pairs = by_start.union(turned.join(full, ["family", "initial"]).select("id", "other"))
    return pairs.where("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def merged_people(contacts: DataFrame) -> DataFrame:
    """person (least id), name (most words, then longest, then first), names and contacts, of contacts
    (id, name) whose names are of one person, also over others; blank names are no one's."""
    shown = contacts.select("id", display_name(F.col("name")).alias("name")).where("name <> ''")
    distinct = rewritten(shown.groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("contacts")))
    labels = connected(same_person(distinct))
    placed = distinct.join(labels.withColumnRenamed("vertex", "id"), "id", "left")
    fullest = F.max_by("name", F.struct(F.size(_words(F.col("name"))), F.length("name"), -F.col("id")))
    return placed.groupBy(F.coalesce("component", "id").alias("person")).agg(fullest.alias("name"), F.count("*").alias("names"), F.sum("contacts").alias("contacts"))

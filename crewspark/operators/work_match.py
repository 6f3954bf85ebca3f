"""Which work a cost line is: matched, with a warning, or to be reviewed with candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewspark.functions.text import first_keyword, folded

#: Kinds of works by their words, in order; words of preparing, covering, and costs.
TYPES = (
    ("Gietvloer", ["gietvloer"]), ("Entreemat", ["entreemat", "coral"]), ("PVC", ["pvc", "lvt"]), ("Tapijt", ["tapijt"]), ("Linoleum", ["linoleum", "marmoleum"]),
    ("Vinyl", ["vinyl"]), ("Coating", ["coating"]), ("Plinten", ["plint"]), ("Overgangsprofielen", ["overgangsprofiel"]),
)
PREPARING, PREPARED = r"schuur|primer|primen|egalis|voorber", "Primen/egaliseren"
COVERING = r"\b(pvc|tapijt|linoleum|marmoleum|vinyl|lvt|gietvloer|coating|vloerbedekking|entreemat|coral)\b"
COSTS, OTHER = r"\b(toeslag|kosten|kilometer|kilometers|opslag|transport|voorrij|proefkamer)\b", "Overige"


def _type(text: Column, types: Sequence[tuple[str, list[str]]]) -> Column:
    return F.nullif(first_keyword(F.coalesce(text, F.lit("")), list(types), ""), F.lit(""))


def matched_works(lines: DataFrame, catalog: DataFrame, types: Sequence[tuple[str, list[str]]] = TYPES, covering: str = COVERING) -> DataFrame:
    """project, id, outcome (matched, warning, review), label and candidates of cost lines (project, id,
    description, materials: names of what the line is about).

    In this order: preparing without a covering; the one name of the project's catalog (project, name) that
    the description holds; a line's one material; several materials of one type (the first of them, with
    a warning); the type that the description names, as the one name of that type in the catalog, itself
    if there is none, or to be reviewed with the names; costs, by their type with a warning or as other.
    Names meet descriptions on their first word.
    """
    own = lines.select("project", "id", folded(F.coalesce("description", F.lit(""))).alias("text"), F.array_sort(F.array_distinct(F.filter(F.coalesce("materials", F.array().cast("array<string>")), lambda m: F.trim(m) != ""))).alias("materials"))
    names = catalog.where(F.trim("name") != "").select("project", "name").distinct()
    words = own.select("project", "id", "text", F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}]+"))).alias("word"))
    first = names.select("project", "name", F.get(F.split(folded("name"), r"[^\p{L}\p{N}]+"), F.lit(0)).alias("word"))
    held = words.join(first, ["project", "word"]).where(F.col("text").contains(folded(F.col("name"))))
    named = held.groupBy("project", "id").agg(F.count("*").alias("named"), F.min("name").alias("one"))
    kinds = names.withColumn("type", _type(F.col("name"), types)).where("type IS NOT NULL").groupBy("project", "type").agg(F.array_sort(F.collect_set("name")).alias("of_type"))
    typed = own.withColumns({"type": _type(F.col("text"), types), "kinds": F.array_distinct(F.transform("materials", lambda m: _type(m, types)))})
    joined = typed.join(named, ["project", "id"], "left").join(kinds, ["project", "type"], "left")
    n, of_type = F.size("materials"), F.coalesce("of_type", F.array().cast("array<string>"))
    costs, prepares = F.col("text").rlike(COSTS), F.col("text").rlike(PREPARING) & ~F.col("text").rlike(covering)
    one_kind = (n > 1) & (F.size("kinds") == 1) & F.get("kinds", F.lit(0)).isNotNull()
    known = F.col("type").isNotNull()

    def result(outcome: str, label: Column, candidates: Column) -> Column:
        return F.struct(F.lit(outcome).alias("outcome"), label.cast("string").alias("label"), candidates.alias("candidates"))

    sure = lambda label: result("matched", label, F.array(label))
    x = (
        F.when(prepares, sure(F.lit(PREPARED)))
        .when(F.col("named") == 1, sure(F.col("one")))
        .when(n == 1, sure(F.get("materials", F.lit(0))))
        .when(one_kind, result("warning", F.get("materials", F.lit(0)), F.col("materials")))
        .when(known & ~costs & (F.size(of_type) == 1), sure(F.get(of_type, F.lit(0))))
        .when(known & ~costs & (F.size(of_type) == 0), sure(F.col("type")))
        .when(known & ~costs, result("review", F.lit(None), of_type))
        .when(costs & known, result("warning", F.col("type"), F.array("type")))
        .when(costs, sure(F.lit(OTHER)))
        .otherwise(result("review", F.lit(None), F.array().cast("array<string>")))
    )
    return joined.select("project", "id", x.alias("x")).select("project", "id", "x.*")

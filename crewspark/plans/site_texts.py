"""Floor plans and team lists written as texts and read back; labour rows and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewspark.operators import cost_rows, site_texts
from crewspark.plans.billing import CENTS, cents
from crewspark.plans.registry import ENTRIES, entries, query, table

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


@query(f"""WITH o AS (SELECT l_orderkey AS document_id, CASE WHEN l_linenumber < 4 THEN 'begane grond' ELSE 'verdieping 2' END AS storey, '1.0' || l_linenumber AS number, p_name AS name, CAST(l_quantity AS DECIMAL(12,2)) AS area, l_partkey % 5 AS kind,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
  f AS (SELECT *, CASE WHEN kind < 3 THEN area END AS own_area, CASE WHEN kind <> 3 THEN name END AS own_name FROM o WHERE kind <> 3)
  SELECT document_id, storey, number, min_by(own_name, k) AS name, CAST(min_by(own_area, k) FILTER (own_area IS NOT NULL) AS DOUBLE) AS area, min_by(own_area, k) FILTER (own_area IS NOT NULL) IS NULL AS needs_review FROM f GROUP BY 1, 2, 3""")
def floor_plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms written on floor plans in one line, over three lines, with a scale between, as a bare number or
    without an area; the bare ones are uncertain."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    own = li.join(p, li["l_partkey"] == p["p_partkey"])
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", ")))
    number = F.concat(F.lit("1.0"), F.col("l_linenumber").cast("string"))
    area = F.concat(F.format_string("%d,%02d", F.col("l_quantity").cast("int"), (F.round(F.col("l_quantity") * 100) % 100).cast("int")), F.lit(" m²"))
    head = F.when(F.col("l_linenumber") < 4, "Bouwlaag: Begane grond").otherwise("2e verdieping")
    blank, kind = F.lit(""), F.col("l_partkey") % 5
    written = (
        F.when(kind == 0, F.array(head, F.concat_ws(" ", number, "p_name", area), blank))
        .when(kind == 1, F.array(head, number, F.col("p_name"), area))
        .when(kind == 2, F.array(head, F.concat_ws(" - ", number, F.col("p_name")), F.lit("schaal 1:50"), area))
        .when(kind == 3, F.array(head, number, blank, F.col("p_name")))
        .otherwise(F.array(head, F.concat_ws("  ", F.col("p_name"), number)))
    )
    lines = own.select(F.col("l_orderkey").alias("document_id"), k.alias("k"), F.posexplode(written).alias("i", "text")).select("document_id", (F.col("k") * 10 + F.col("i")).alias("line_no"), "text")
    return site_texts.floor_plan_rooms(lines).select("document_id", "storey", "number", "name", F.col("area").cast("double").alias("area"), "needs_review")


@query("""SELECT s_suppkey // 3 AS document_id, CAST(s_suppkey % 3 AS INTEGER) AS team_no, CASE WHEN s_nationkey < 8 THEN 'Team ' || s_suppkey WHEN s_nationkey < 16 THEN 'Ploeg ' || s_name ELSE 'Naam ' || s_suppkey END AS name,
  CASE WHEN s_acctbal < 2000 THEN 'zzp' WHEN s_acctbal < 5000 THEN 'onderaannemer' ELSE 'eigen' END AS type,
  greatest(1 + s_nationkey, 3) AS people, 3 AS crew, lower(s_name) || '@example.org' AS email, '+316' || lpad(CAST(s_suppkey % 100000000 AS VARCHAR), 8, '0') AS phone, '1234 AB' AS postcode, n_name AS town
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""".replace("lower(s_name) ||", "replace(lower(s_name), '#', '.') ||"))
def team_list_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams of three suppliers each, written as one list."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    own = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    text = F.concat_ws(
        "\n",
        F.when(nation < 8, F.concat(F.lit("TEAM "), key, F.lit(" noord"))).when(nation < 16, F.concat(F.lit("Ploeg "), "s_name")).otherwise(F.concat(F.lit("Ploeg x\nTeamnaam : Naam "), key)),
        F.when(F.col("s_acctbal") < 2000, "ZZP").when(F.col("s_acctbal") < 5000, "Dienstverband: als onderaannemer").otherwise("Soort - vast"),
        F.when(key % 2 == 0, F.concat(F.lit("Aantal personen: "), nation + 1)).otherwise(F.concat(nation + 1, F.lit(" personen"))),
        F.lit("Teamleden: Anna, Bert ;Carla / "),
        F.concat(F.lit("E-mail: "), F.replace("s_name", F.lit("#"), F.lit(".")), F.lit("@Example.ORG")),
        F.concat(F.lit("Mobiel: 06-"), F.lpad((key % 100000000).cast("string"), 8, "0")),
        F.concat(F.lit("Postcode: 1234 ab\nWoonplaats: "), "n_name"),
    )
    texts = own.select(F.floor(key / 3).alias("document_id"), key.alias("k"), text.alias("t")).groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n\n").alias("text"))
    teams = site_texts.team_lists(texts)
    return teams.select("document_id", "team_no", "name", "type", "people", F.size("crew").alias("crew"), "email", "phone", "postcode", "town")


@query(f"""WITH {CENTS}, g AS (SELECT project, room, item, max(kind) AS kind, CAST(sum(q) AS BIGINT) AS q FROM cents GROUP BY 1, 2, 3),
  i AS (SELECT *, count(*) FILTER (kind = 'R') OVER (PARTITION BY project ORDER BY room, item) AS island FROM g),
  s AS (SELECT project, island, min(room) FILTER (kind = 'R') AS room, min(item) FILTER (kind = 'R') AS item, count(*) FILTER (kind <> 'R' AND q > 500) AS materials, CAST(coalesce(sum(q) FILTER (kind <> 'R' AND q > 500), 0) AS BIGINT) AS q FROM i GROUP BY 1, 2)
  SELECT s.project, s.room, s.item, coalesce(z.materials, s.materials) AS materials, coalesce(z.q, s.q) AS q FROM s LEFT JOIN s AS z ON z.project = s.project AND z.island = 0 AND s.island = 1 AND s.materials = 0 WHERE s.island > 0""")
def labour_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labour rows of a project and the materials that they are about; small amounts are no material."""
    g = cents(spark, sf_dir).groupBy("project", "room", "item").agg(F.max("kind").alias("kind"), F.sum("q").cast("bigint").alias("q"))
    return cost_rows.claimed_materials(g, ["project"], ["room", "item"], F.col("kind") == "R", F.col("q") > 500, "q").select("project", "room", "item", "materials", F.col("q").cast("bigint").alias("q"))


@query(f"""WITH {ENTRIES}, e AS (SELECT status AS work, person // 10 AS team, person, isoyear(day) AS year, weekofyear(day) AS week, CAST(day AS VARCHAR) AS day, (e - s) // 900 AS quarters FROM entries)
  SELECT work, team, person, CAST(year AS INTEGER) AS year, CAST(week AS INTEGER) AS week, day, CAST(3 - grouping(work) - grouping(team) - grouping(person) AS INTEGER) AS level, CAST(3 - grouping(year) - grouping(week) - grouping(day) AS INTEGER) AS span,
    CAST(sum(quarters) AS BIGINT) AS quarters, count(*) AS entries FROM e
  GROUP BY ROLLUP (work, team, person), ROLLUP (year, week, day)""")
def planning_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of an hour of works, teams and people by year, week and day, with all sub-totals."""
    e = entries(spark, sf_dir)
    rows = e.select(
        F.col("status").alias("work"), F.floor(F.col("person") / 10).alias("team"), "person", F.expr("CAST(extract(YEAROFWEEK FROM day) AS INT)").alias("year"), F.weekofyear("day").alias("week"),
        F.col("day").cast("string").alias("day"), F.floor((F.col("e") - F.col("s")) / 900).alias("quarters"),
    )
    return cost_rows.rolled_up(rows, ["work", "team", "person"], ["year", "week", "day"], quarters=F.sum("quarters").cast("bigint"), entries=F.count("*"))


@query(f"""WITH {ENTRIES}, e AS (SELECT status AS work, person // 10 AS team, weekofyear(day) AS week, (e - s) // 900 AS quarters FROM entries)
  SELECT work, team, {", ".join(f"CAST(sum(quarters) FILTER (week = {w}) AS BIGINT) AS w{w}" for w in range(1, 54))}, CAST(sum(quarters) AS BIGINT) AS total FROM e GROUP BY ROLLUP (work, team)""")
def planning_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by week of the year as a sheet: teams, works and all, with sums where a sheet has formulas."""
    rows = entries(spark, sf_dir).select(F.col("status").alias("work"), F.floor(F.col("person") / 10).alias("team"), F.weekofyear("day").alias("week"), F.floor((F.col("e") - F.col("s")) / 900).alias("quarters"))
    return cost_rows.week_sheet(rows, ["work", "team"], "week", "quarters", range(1, 54))

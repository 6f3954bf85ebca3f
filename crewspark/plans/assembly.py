"""Rooms and tasks put together from several sources; completions; labels; weeks of people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewspark.functions import calendar as cal
from crewspark.operators import assembly, takeoff_text
from crewspark.plans.billing import CENTS, cents, total
from crewspark.plans.capacity import week_of
from crewspark.plans.registry import ENTRIES, entries, query, table


@query("""WITH l AS (SELECT p_partkey AS id, p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 0), r AS (SELECT p_partkey AS other, p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 1),
  l1 AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, id) AS k FROM l), r1 AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, other) AS k FROM r),
  m1 AS (SELECT id, other FROM l1 JOIN r1 USING (p_brand, p_type, k)),
  l2 AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, id) AS k FROM l WHERE id NOT IN (SELECT id FROM m1)), r2 AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, other) AS k FROM r WHERE other NOT IN (SELECT other FROM m1))
  SELECT id, other, CAST(0.82 AS DOUBLE) AS confidence FROM m1 UNION ALL SELECT id, other, CAST(0.55 AS DOUBLE) FROM l2 JOIN r2 USING (p_brand, k)""")
def positional_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_size")
    return assembly.positional_pairs(p.where("id % 2 = 0"), p.where("id % 2 = 1"), [["p_brand", "p_type"], ["p_brand"]], [0.82, 0.55], "p_size")


@query(f"""WITH {CENTS}, g AS (SELECT project, item, list(q ORDER BY room, q) AS qs FROM cents GROUP BY 1, 2)
  SELECT project, item, CAST(list_reduce(qs, lambda s, v: CASE WHEN v <= s + 5 THEN s ELSE v END) AS BIGINT) AS q, CAST(len(qs) AS INTEGER) AS parts FROM g""")
def task_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cents(spark, sf_dir).select("project", "item", "room", "q")
    m = assembly.merged_tasks(c, ["project", "item"], ["room"], "q", 5)
    return m.select("project", "item", "q", F.col("parts").cast("int").alias("parts"))


@query(f"""WITH {CENTS}, t AS (SELECT project, CASE document WHEN 'F' THEN 'PVC, ' ELSE '' END || p_name || CASE kind WHEN 'R' THEN ' (lvt)' ELSE '' END AS name, p_name, CASE WHEN q > 4000 THEN 'm1' ELSE 'm2' END AS unit, q, room, item, day, kind, document FROM cents JOIN part ON item = p_partkey),
  g AS (SELECT project, unit, p_name, list(q ORDER BY room, item, day, kind, document, q) AS qs, max_by(name, {{'l': length(name), 'n': name}}) AS name FROM t GROUP BY 1, 2, 3)
  SELECT project, unit, name, CAST(list_reduce(qs, lambda s, v: CASE WHEN v <= s + 5 THEN s ELSE s + v END) AS BIGINT) AS quantity, len(qs) AS parts FROM g""")
def summed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of projects by name: equal ones count once, smaller ones are parts, larger ones are added."""
    c, p = cents(spark, sf_dir), table(spark, sf_dir, "part")
    name = F.concat(F.when(F.col("document") == "F", "PVC, ").otherwise(""), "p_name", F.when(F.col("kind") == "R", " (lvt)").otherwise(""))
    t = c.join(p, c["item"] == p["p_partkey"]).select("project", name.alias("name"), F.when(F.col("q") > 4000, "m1").otherwise("m2").alias("unit"), F.col("q").alias("quantity"), "room", "item", "day", "kind", "document")
    return assembly.summed_tasks(t, ["project"], ["room", "item", "day", "kind", "document"], 5)


@query(f"""WITH {CENTS}, n AS (SELECT project, item, max(amount) FILTER (WHERE kind = 'N') AS amount FROM cents GROUP BY 1, 2), h AS (SELECT item, min_by(amount, project * 10 + room) AS amount FROM cents WHERE kind = 'R' GROUP BY 1)
  SELECT project, n.item AS item, CAST(coalesce(n.amount, h.amount) AS BIGINT) AS amount, n.amount IS NULL AND h.amount IS NOT NULL AS filled FROM n LEFT JOIN h ON n.item = h.item""")
def enriched_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor amounts, and where a project has none the first one that a hint gives for the item."""
    c = cents(spark, sf_dir)
    rows = c.groupBy("project", "item").agg(F.max(F.when(F.col("kind") == "N", F.col("amount"))).alias("amount"))
    hints = c.where("kind = 'R'").select("item", "amount", (F.col("project") * 10 + F.col("room")).alias("at"))
    return assembly.enriched(rows, hints, ["item"], ["amount"], "at").select("project", "item", "amount", (F.size("filled") > 0).alias("filled"))


@query(f"""WITH {CENTS}, d AS (SELECT item, document, CAST(sum(q) AS BIGINT) AS q FROM cents WHERE q > 2500 GROUP BY 1, 2), a AS (SELECT DISTINCT item FROM cents)
  SELECT a.item AS item, coalesce(CAST(min(q) FILTER (WHERE document = 'F') AS BIGINT), CAST(min(q) FILTER (WHERE document = 'O') AS BIGINT)) AS q, count(document) AS n FROM a LEFT JOIN d USING (item) GROUP BY 1""")
def declared_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that two documents declare for a work: the first one's, else the second one's."""
    c = cents(spark, sf_dir)
    d = c.groupBy("item", "document").agg(F.sum(F.when(F.col("q") > 2500, F.col("q"))).alias("q"))
    both = assembly.first_positive(d, ["item"], ["document"], "q")
    n = d.groupBy("item").agg(F.count("q").alias("n"))
    return both.select("item", "q").join(n, "item").select("item", "q", "n")


@query(f"""WITH {CENTS}, g AS (SELECT project, worker, day, item, CAST(sum(q) AS BIGINT) AS q FROM cents WHERE document = 'F' GROUP BY ALL), o AS (SELECT project, CAST(sum(q) FILTER (WHERE document = 'O') AS BIGINT) AS ordered FROM cents GROUP BY 1),
  r AS (SELECT g.*, coalesce(ordered, 0) AS ordered, coalesce(sum(q) OVER (PARTITION BY g.project ORDER BY day, worker, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
    row_number() OVER (PARTITION BY g.project, worker, day ORDER BY item) AS rn FROM g JOIN o ON g.project = o.project)
  SELECT project, CAST(sum(least(greatest(0, q), greatest(0, ordered - done))) AS BIGINT) AS counted, CAST(sum(CASE WHEN rn = 1 THEN 8 ELSE 0 END) AS BIGINT) AS hours, count(*) AS tasks FROM r GROUP BY 1""")
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities up to what is left of the order, in order of time; a visit's hours go to its first task."""
    c = cents(spark, sf_dir)
    ordered = c.groupBy("project").agg(total(F.col("document") == "O").alias("ordered"))
    g = c.where("document = 'F'").groupBy("project", "worker", "day", "item").agg(F.sum("q").alias("q")).join(ordered, "project")
    before = Window.partitionBy("project").orderBy("day", "worker", "item").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.greatest(F.lit(0), F.col("ordered") - F.coalesce(F.sum("q").over(before), F.lit(0)))
    visit = F.row_number().over(Window.partitionBy("project", "worker", "day").orderBy("item"))
    r = g.select("project", F.least(F.greatest(F.lit(0), F.col("q")), rest).alias("counted"), F.when(visit == 1, 8).otherwise(0).alias("hours"))
    return r.groupBy("project").agg(F.sum("counted").cast("bigint").alias("counted"), F.sum("hours").cast("bigint").alias("hours"), F.count("*").alias("tasks"))


@query(f"""WITH {ENTRIES}, e AS (SELECT *, isoyear(day) * 100 + weekofyear(day) AS week FROM entries WHERE isodow(day) < 6), g AS (SELECT week, count(DISTINCT day) AS days FROM e GROUP BY 1),
  a AS (SELECT week, person, count(DISTINCT day) FILTER (WHERE status = 'error') AS away, count(DISTINCT day) AS present FROM e GROUP BY 1, 2)
  SELECT week, person, away, present, away = days AS whole_week FROM a JOIN g USING (week)""")
def weeks_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work days with an absence, and whether those are all work days that the week's grid has."""
    e = entries(spark, sf_dir).where(cal.is_workday(F.col("day"))).withColumn("week", week_of("day"))
    grid = e.groupBy("week").agg(F.countDistinct("day").alias("days"))
    each = e.groupBy("week", "person", "day").agg(F.max(F.col("status") == "error").alias("away"))
    a = each.groupBy("week", "person").agg(F.count_if("away").alias("away"), F.count("*").alias("present"))
    return a.join(grid, "week").select("week", "person", "away", "present", (F.col("away") == F.col("days")).alias("whole_week"))


@query("""WITH n AS (SELECT c_custkey, upper(left(c_mktsegment, 1) || substr(c_name, 10, 1)) AS own FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY c_custkey) AS k FROM n)
  SELECT c_custkey, CASE WHEN k = 1 THEN own ELSE own || k END AS initials FROM k""")
def unique_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.concat_ws(" ", "c_mktsegment", F.substring("c_name", 10, 20))
    c = table(spark, sf_dir, "customer").select("c_custkey", names.alias("name"))
    return assembly.initials(c, "name", "c_custkey").select("c_custkey", "initials")


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(json_extract(props, '$.none')) AS none FROM events GROUP BY 1""")
def traced_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON traces, by a schema; one that isn't there is null."""
    x = F.from_json("props", "k long, none string")
    e = table(spark, sf_dir, "events").select("event_type", x.alias("x"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("x.k").alias("k"), F.count("x.none").alias("none"))


@query("""SELECT o_orderkey, array_to_string(list_transform([1, 3, 5], lambda k: CAST(CAST(date_trunc('week', o_orderdate) AS DATE) + CAST(k - 1 AS INTEGER) AS VARCHAR)), ',') AS days,
  CAST(isoyear(o_orderdate) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS week FROM orders""")
def worked_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of a list of weekdays in an ISO week, and the week's label."""
    d = F.to_date("o_orderdate")
    days = F.transform(F.array(*[F.lit(k) for k in (1, 3, 5)]), lambda k: F.date_add(cal.monday(d), k - 1).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(days, ",").alias("days"), cal.week_label(d).alias("week"))


@query("""WITH b AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
  SELECT doc_id, CASE WHEN contains(t, '12') THEN 1.0::DOUBLE WHEN contains(t, 'the') THEN 0.82::DOUBLE END AS score FROM b""")
def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", assembly.label_score(F.lit("12"), F.lit("the"), F.coalesce("text", F.lit(""))).alias("score"))


@query(f"""WITH w AS (SELECT o_custkey AS person, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER) AS b, o_orderstatus AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'morning' WHEN 1 THEN 'afternoon' ELSE 'day' END AS slot FROM orders),
  d AS (SELECT person, kind, slot, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM w),
  r AS (SELECT *, row_number() OVER (PARTITION BY person, day ORDER BY CASE kind WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, CASE slot WHEN 'day' THEN 0 ELSE 1 END, kind, slot) AS rn FROM d)
  SELECT person, CAST(day AS VARCHAR) AS day, kind, CASE slot WHEN 'afternoon' THEN 720 ELSE 0 END AS start_min, CASE slot WHEN 'morning' THEN 720 ELSE 1440 END AS end_min FROM r WHERE rn = 1""")
def absence_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One absence a person and day, by rank of kinds, with its clock times."""
    a, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    slot = F.when(k % 3 == 0, "morning").when(k % 3 == 1, "afternoon").otherwise("day")
    w = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), a.alias("first_day"), F.date_add(a, (k % 4).cast("int")).alias("last_day"), F.col("o_orderstatus").alias("kind"), slot.alias("slot"))
    return assembly.absences(w, ["person"], {"F": 0, "P": 1}).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {CENTS}, s AS (SELECT project, kind, CAST(sum(q) AS BIGINT) AS q, count(*) AS n FROM cents GROUP BY 1, 2)
  SELECT project, 'Vloer ' || kind AS product, n AS rooms, CAST(q AS DOUBLE) / 100 AS calculated, CASE kind WHEN 'R' THEN 'check' ELSE 'ok' END AS status FROM s""")
def takeoff_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress lines written as a take-off sheet and read back from its text."""
    p = takeoff_text.products(takeoff_text.parsed(sheet_lines(spark, sf_dir)))
    return p.select(F.col("document_id").alias("project"), "product", "rooms", F.col("calculated").cast("double").alias("calculated"), "status")


def sheet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, line_no, text: a sheet for each project."""
    two = lambda c: F.concat_ws(",", ((c - c % 100) / 100).cast("bigint"), F.lpad((c % 100).cast("string"), 2, "0"))
    c = cents(spark, sf_dir)
    order = Window.partitionBy("project", "kind").orderBy("room", "item", "q", "day", "worker", "amount")
    numbered = c.withColumn("k", F.row_number().over(order))
    room = F.concat_ws(" ", F.concat(F.lpad("room", 2, "0"), F.lit("."), F.col("item")), F.lit("kamer 7 oost"), F.concat(two(F.col("q")), F.lit(" m²")), F.concat(F.col("room"), F.lit(",50 m")))
    at = lambda k: (F.ascii("kind") * 10_000_000 + k).cast("bigint").alias("line_no")
    body = numbered.select("project", at(F.col("k") + 10), room.alias("text"))
    sums = c.groupBy("project", "kind").agg(F.sum("q").alias("q"))
    net = F.concat(F.lit("Netto : "), two(F.col("q") + F.when(F.col("kind") == "R", 1000).otherwise(0)), F.lit(" m²"))
    frame = sums.select("project", "kind", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), x.alias("t")) for i, x in ((0, F.concat(F.lit("Vloer  "), "kind")), (1, F.lit("Bouwlaag: begane grond")), (2, F.lit("Ruimte Oppervlakte Omtrek")), (9_000_000, F.lit("Totaal 1 m²")), (9_000_001, net))])).alias("x"))
    return body.union(frame.select("project", at(F.col("x.i")), F.col("x.t").alias("text"))).withColumnRenamed("project", "document_id")


@query(f"""WITH {CENTS} SELECT project, lpad(CAST(room AS VARCHAR), 2, '0') || '.' || item AS number, 'Vloer ' || kind AS product, CAST(sum(q) AS DOUBLE) / 100 AS area, CAST(sum(room * 100 + 50) AS DOUBLE) / 100 AS perimeter, count(*) AS parts, count(*) > 1 AS duplicate, CAST(NULL AS VARCHAR) AS reason FROM cents GROUP BY project, room, item, kind""")
def takeoff_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms and products of those sheets with the parts that make them up; no line of them is uncertain."""
    parsed = takeoff_text.parsed(sheet_lines(spark, sf_dir))
    tasks = takeoff_text.room_tasks(parsed).select(F.col("document_id").alias("project"), "number", "product", F.col("area").cast("double").alias("area"), F.col("perimeter").cast("double").alias("perimeter"), "parts", "duplicate", F.lit(None).cast("string").alias("reason"))
    none = F.lit(None)
    unsure = takeoff_text.uncertain_lines(parsed).select("document_id", none.cast("string"), none.cast("string"), none.cast("double"), none.cast("double"), F.lit(0).cast("long"), F.lit(False), "reason")
    return tasks.union(unsure)

"""Production, labour, prices, settlement.

lineitem stands for progress and voucher lines: (order, line number) isn't unique there, so that
lines are summed before they are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewspark.functions import labor as lab
from crewspark.operators import matching, sequences
from crewspark.plans.registry import money, query, table
from crewspark.storage import tasks_for


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("project"), F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("worker"), F.col("l_linenumber").cast("bigint").alias("room"),
        F.to_date("l_shipdate").alias("day"), money("l_quantity").alias("q"), money("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("document"),
    )


LINES = """lines AS (SELECT l_orderkey AS project, l_partkey AS item, l_suppkey AS worker, CAST(l_linenumber AS BIGINT) AS room, CAST(l_shipdate AS DATE) AS day,
  CAST(l_quantity AS DECIMAL(12,2)) AS q, CAST(l_extendedprice AS DECIMAL(12,2)) AS amount, l_returnflag AS kind, l_linestatus AS document FROM lineitem)"""


def number(c):
    return (F.col(c) if isinstance(c, str) else c).cast("double")


@query(f"""WITH {LINES} SELECT worker, project, room, item, CAST(sum(q) FILTER (WHERE kind = 'N') AS DOUBLE) AS m2, CAST(sum(q) FILTER (WHERE kind <> 'N') AS DOUBLE) AS m1,
  CAST(sum(amount) AS DOUBLE) AS amount, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS n FROM lines GROUP BY 1, 2, 3, 4""")
def production_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    m2 = F.col("kind") == "N"
    out = lines(spark, sf_dir).groupBy("worker", "project", "room", "item").agg(F.sum(F.when(m2, F.col("q"))).alias("m2"), F.sum(F.when(~m2, F.col("q"))).alias("m1"), F.sum("amount").alias("amount"), F.max("day").alias("d"), F.count("*").alias("n"))
    return out.select("worker", "project", "room", "item", number("m2").alias("m2"), number("m1").alias("m1"), number("amount").alias("amount"), F.col("d").cast("string").alias("last_day"), "n")


@query(f"""WITH {LINES} SELECT coalesce(s_name, 'all') AS worker, coalesce(o_orderstatus, 'all') AS status, CAST(sum(q) AS DOUBLE) AS quantity, CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS n
  FROM lines JOIN orders ON project = o_orderkey JOIN supplier ON worker = s_suppkey GROUP BY ROLLUP (s_name, o_orderstatus)""")
def production_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by worker and status; lines are summed by worker and project before the joins."""
    leaf = lines(spark, sf_dir).groupBy("worker", "project").agg(F.sum("q").alias("q"), F.sum("amount").alias("amount"), F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project"), F.col("o_orderstatus").alias("status"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("worker"), F.col("s_name").alias("name"))
    out = leaf.join(o, "project").join(s, "worker").rollup("name", "status").agg(F.sum("q").alias("q"), F.sum("amount").alias("a"), F.sum("n").alias("n"))
    return out.select(F.coalesce("name", F.lit("all")).alias("worker"), F.coalesce("status", F.lit("all")).alias("status"), number("q").alias("quantity"), number("a").alias("amount"), "n")


@query(f"""WITH {LINES} SELECT worker, CAST(sum(q) AS DOUBLE) AS quantity, count(DISTINCT project) AS projects, array_to_string(list_sort(list(DISTINCT room)), ',') AS rooms FROM lines GROUP BY 1""")
def worker_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = F.array_join(F.transform(F.array_sort(F.collect_set("room")), lambda r: r.cast("string")), ",")
    out = lines(spark, sf_dir).groupBy("worker").agg(F.sum("q").alias("q"), F.countDistinct("project").alias("projects"), rooms.alias("rooms"))
    return out.select("worker", number("q").alias("quantity"), "projects", "rooms")


LABOR = f"""{LINES}, labor AS (SELECT project, item, sum(q) AS used, sum(q) FILTER (WHERE document = 'F') AS actual, sum(amount) AS cost, bool_and(document = 'F') AS complete FROM lines GROUP BY 1, 2),
  facts AS (SELECT project, item, used AS planned, coalesce(actual, 0) AS actual, complete, CAST(p_size AS DECIMAL(12,2)) AS budget, cost, CAST(p_retailprice AS DECIMAL(12,2)) AS rate,
  CASE WHEN complete AND coalesce(actual, 0) > 0.0001 THEN coalesce(actual, 0) ELSE coalesce(actual, 0) + greatest(0, used - coalesce(actual, 0)) END AS expected FROM labor JOIN part ON item = p_partkey)"""


def labor_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("document") == "F"
    li = lines(spark, sf_dir)
    n = tasks_for(li)  # what a task sums and sorts doesn't grow with the tables
    each = li.repartition(n, "project").groupBy("project", "item").agg(
        F.sum("q").alias("planned"), F.coalesce(F.sum(F.when(done, F.col("q"))), F.lit(0).cast("decimal(22,2)")).alias("actual"), F.sum("amount").alias("cost"), F.bool_and(done).alias("complete")
    )
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").cast("decimal(12,2)").alias("budget"), money("p_retailprice").alias("rate"))
    return each.repartition(n, "item").join(p.repartition(n, "item"), "item").withColumn("expected", lab.expected_hours(F.col("planned"), F.col("actual"), F.col("complete")))


@query(f"""WITH {LABOR} SELECT project, item, CAST(planned AS DOUBLE) AS planned, CAST(actual AS DOUBLE) AS actual, CAST(budget AS DOUBLE) AS budget, CAST(expected AS DOUBLE) AS expected, CAST(expected - budget AS DOUBLE) AS beyond FROM facts""")
def labor_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = labor_facts(spark, sf_dir)
    return f.select("project", "item", *[number(c).alias(c) for c in ("planned", "actual", "budget", "expected")], number(F.col("expected") - F.col("budget")).alias("beyond"))


@query(f"""WITH {LABOR} SELECT project, o_orderstatus AS status, CAST(sum(planned) AS DOUBLE) AS planned, CAST(sum(actual) AS DOUBLE) AS actual, CAST(sum(budget) AS DOUBLE) AS budget, CAST(sum(expected) AS DOUBLE) AS expected,
  CAST(CASE WHEN count(DISTINCT rate) = 1 THEN max(rate) END AS DOUBLE) AS rate, count(*) AS items FROM facts JOIN orders ON project = o_orderkey GROUP BY 1, 2""")
def labor_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.when(F.min("rate") == F.max("rate"), F.max("rate"))
    out = labor_facts(spark, sf_dir).groupBy("project").agg(*[F.sum(c).alias(c) for c in ("planned", "actual", "budget", "expected")], one.alias("rate"), F.count("*").alias("items"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project"), F.col("o_orderstatus").alias("status"))
    return out.join(o, "project").select("project", "status", *[number(c).alias(c) for c in ("planned", "actual", "budget", "expected", "rate")], "items")


@query(f"""WITH {LABOR} SELECT CASE WHEN budget <= 0.0001 THEN 'none' WHEN expected > budget THEN 'over' WHEN expected * 100 >= budget * 80 THEN 'warn' ELSE 'ok' END AS tone,
  complete, count(*) AS items, CAST(sum(expected) AS DOUBLE) AS expected FROM facts GROUP BY 1, 2""")
def labor_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = labor_facts(spark, sf_dir)
    return f.groupBy(lab.tone(F.col("budget"), F.col("expected")).alias("tone"), "complete").agg(F.count("*").alias("items"), number(F.sum("expected")).alias("expected"))


@query(f"""WITH {LINES} SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS revenue, CAST(coalesce(c, 0) AS DOUBLE) AS cost, CAST(CAST(o_totalprice AS DECIMAL(12,2)) - coalesce(c, 0) AS DOUBLE) AS margin,
  CAST(coalesce(c, 0) > CAST(o_totalprice AS DECIMAL(12,2)) AS BOOLEAN) AS loss FROM orders LEFT JOIN (SELECT project, sum(amount) AS c FROM lines GROUP BY 1) ON project = o_orderkey""")
def order_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = lines(spark, sf_dir).groupBy(F.col("project").alias("o_orderkey")).agg(F.sum("amount").alias("c"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", money("o_totalprice").alias("r")).join(cost, "o_orderkey", "left")
    c = F.coalesce("c", F.lit(0).cast("decimal(22,2)"))
    return o.select("o_orderkey", number("r").alias("revenue"), number(c).alias("cost"), number(F.col("r") - c).alias("margin"), (c > F.col("r")).alias("loss"))


@query(f"""WITH {LINES}, w AS (SELECT worker, item, min(amount) AS price FROM lines WHERE document = 'O' AND kind = 'N' GROUP BY 1, 2),
  o AS (SELECT item, min(amount) AS price FROM lines WHERE document = 'F' AND kind = 'A' GROUP BY 1),
  k AS (SELECT DISTINCT worker, item FROM lines)
  SELECT k.worker, k.item, CAST(coalesce(w.price, o.price, CASE WHEN p_size > 40 THEN CAST(p_retailprice AS DECIMAL(12,2)) END, CAST(s_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS price,
  CASE WHEN w.price IS NOT NULL THEN 'voucher' WHEN o.price IS NOT NULL THEN 'order' WHEN p_size > 40 THEN 'rate' WHEN s_acctbal IS NOT NULL THEN 'hourly' END AS source
  FROM k LEFT JOIN w ON k.worker = w.worker AND k.item = w.item LEFT JOIN o ON k.item = o.item LEFT JOIN part ON k.item = p_partkey LEFT JOIN supplier ON k.worker = s_suppkey""")
def price_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = lines(spark, sf_dir)
    w = li.where("document = 'O' AND kind = 'N'").groupBy("worker", "item").agg(F.min("amount").alias("voucher"))
    o = li.where("document = 'F' AND kind = 'A'").groupBy("item").agg(F.min("amount").alias("order"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.when(F.col("p_size") > 40, money("p_retailprice")).alias("rate"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("worker"), money("s_acctbal").alias("hourly"))
    price, source = matching.waterfall(*[(c, F.col(c)) for c in ("voucher", "order", "rate", "hourly")])
    keys = li.select("worker", "item").distinct()
    return keys.join(w, ["worker", "item"], "left").join(o, "item", "left").join(p, "item", "left").join(s, "worker", "left").select("worker", "item", number(price).alias("price"), source.alias("source"))


BILLS = f"""{LINES}, bill AS (SELECT project, item, coalesce(sum(q) FILTER (WHERE document = 'O'), 0) AS ordered, coalesce(sum(q) FILTER (WHERE document = 'F'), 0) AS invoiced FROM lines GROUP BY 1, 2)"""


@query(f"""WITH {BILLS} SELECT project, CAST(sum(greatest(0, ordered - invoiced)) AS DOUBLE) AS remaining, CAST(sum(greatest(0, invoiced - ordered)) AS DOUBLE) AS beyond, bool_and(ordered - invoiced <= 0.001) AS settled, count(*) AS items FROM bill GROUP BY 1""")
def billing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda d: F.coalesce(F.sum(F.when(F.col("document") == d, F.col("q"))), F.lit(0).cast("decimal(22,2)"))
    bill = lines(spark, sf_dir).groupBy("project", "item").agg(part("O").alias("ordered"), part("F").alias("invoiced"))
    left, zero = F.col("ordered") - F.col("invoiced"), F.lit(0).cast("decimal(22,2)")
    out = bill.groupBy("project").agg(F.sum(F.greatest(zero, left)).alias("r"), F.sum(F.greatest(zero, -left)).alias("b"), F.bool_and(left <= 0.001).alias("settled"), F.count("*").alias("items"))
    return out.select("project", number("r").alias("remaining"), number("b").alias("beyond"), "settled", "items")


@query(f"""WITH {LINES} SELECT item, {", ".join(f"CAST(coalesce(sum(q) FILTER (WHERE room = {r}), 0) AS DOUBLE) AS invoice_{r}" for r in range(1, 8))}, CAST(sum(q) AS DOUBLE) AS total FROM lines WHERE document = 'F' GROUP BY 1""")
def settlement_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda r: F.coalesce(F.sum(F.when(F.col("room") == r, F.col("q"))), F.lit(0).cast("decimal(22,2)"))
    out = lines(spark, sf_dir).where("document = 'F'").groupBy("item").agg(*[number(part(r)).alias(f"invoice_{r}") for r in range(1, 8)], number(F.sum("q")).alias("total"))
    return out


@query(f"""WITH {LINES} SELECT project, kind, CAST(CASE WHEN count(DISTINCT CAST(floor(CAST(amount AS DOUBLE) / CAST(q AS DOUBLE)) AS BIGINT)) = 1 THEN max(amount) END AS DOUBLE) AS agreed, count(*) AS n FROM (SELECT * FROM lines WHERE q > 0) GROUP BY 1, 2""")
def agreed_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amount if all lines of a project and kind agree on the whole euros of their price."""
    unit = F.floor(number("amount") / number("q"))
    out = lines(spark, sf_dir).where("q > 0").groupBy("project", "kind").agg(F.min(unit).alias("a"), F.max(unit).alias("b"), F.max("amount").alias("m"), F.count("*").alias("n"))
    return out.select("project", "kind", number(F.when(F.col("a") == F.col("b"), F.col("m"))).alias("agreed"), "n")


@query(f"""WITH {LINES}, o AS (SELECT project, day, item, sum(q) AS q FROM lines GROUP BY 1, 2, 3),
  r AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY project ORDER BY day, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM o)
  SELECT project, CAST(r.day AS VARCHAR) AS day, item, CAST(q AS DOUBLE) AS hours, CAST(least(q, greatest(0, 100 - used)) AS DOUBLE) AS within, CAST(q - least(q, greatest(0, 100 - used)) AS DOUBLE) AS "over" FROM r""")
def budget_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = lines(spark, sf_dir).groupBy("project", "day", "item").agg(F.sum("q").alias("hours"))
    out = sequences.budget_split(o, ["project"], ["day", "item"], "hours", F.lit(100))
    return out.select("project", F.col("day").cast("string").alias("day"), "item", *[number(c).alias(c) for c in ("hours", "within", "over")])


@query(f"""WITH {LINES}, k AS (SELECT project, worker, day, sum(q) FILTER (WHERE document = 'F') AS actual, sum(q) FILTER (WHERE document = 'O') AS planned FROM lines GROUP BY 1, 2, 3)
  SELECT project, count(*) AS days, CAST(sum(CASE WHEN day < DATE '1997-01-01' AND actual IS NOT NULL THEN actual ELSE coalesce(planned, 0) END) AS DOUBLE) AS hours FROM k GROUP BY 1""")
def plan_actual_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned hours, but actual ones for past days that have any, by project, worker and day."""
    part = lambda d: F.sum(F.when(F.col("document") == d, F.col("q")))
    k = lines(spark, sf_dir).groupBy("project", "worker", "day").agg(part("F").alias("actual"), part("O").alias("planned"))
    hours = F.when((F.col("day") < "1997-01-01") & F.col("actual").isNotNull(), F.col("actual")).otherwise(F.coalesce("planned", F.lit(0).cast("decimal(22,2)")))
    return k.groupBy("project").agg(F.count("*").alias("days"), number(F.sum(hours)).alias("hours"))


@query(f"""WITH {LINES} SELECT worker, isoyear(day) AS iso_year, {", ".join(f"CAST(coalesce(sum(q) FILTER (WHERE weekofyear(day) BETWEEN {4 * i + 1} AND {4 * i + 4}), 0) AS DOUBLE) AS p{i + 1:02d}" for i in range(14))}, CAST(sum(q) AS DOUBLE) AS total FROM lines GROUP BY 1, 2""")
def matrix_year_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of each worker and ISO year in periods of four weeks."""
    week, zero = F.weekofyear("day"), F.lit(0).cast("decimal(22,2)")
    part = lambda i: F.coalesce(F.sum(F.when(week.between(4 * i + 1, 4 * i + 4), F.col("q"))), zero)
    year = F.extract(F.lit("YEAROFWEEK"), F.col("day")).cast("bigint")
    return lines(spark, sf_dir).groupBy("worker", year.alias("iso_year")).agg(*[number(part(i)).alias(f"p{i + 1:02d}") for i in range(14)], number(F.sum("q")).alias("total"))


@query(f"""WITH {LINES} SELECT project, room, CASE WHEN bool_and(document = 'F' AND kind = 'R') THEN 'approved' WHEN bool_and(document = 'F') THEN 'done' WHEN bool_or(document = 'F') THEN 'started' ELSE 'open' END AS status,
  count(*) FILTER (WHERE document = 'F') AS done, count(*) AS total FROM lines GROUP BY 1, 2""")
def progress_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, good = F.col("document") == "F", (F.col("document") == "F") & (F.col("kind") == "R")
    status = F.when(F.bool_and(good), "approved").when(F.bool_and(done), "done").when(F.bool_or(done), "started").otherwise("open")
    return lines(spark, sf_dir).groupBy("project", "room").agg(status.alias("status"), F.count(F.when(done, 1)).alias("done"), F.count("*").alias("total"))


@query(f"""WITH {LINES}, r AS (SELECT worker, project, sum(amount) AS a FROM lines GROUP BY 1, 2)
  SELECT worker, project, CAST(a AS DOUBLE) AS amount, rank() OVER (PARTITION BY worker ORDER BY a DESC, project) AS place FROM r QUALIFY place <= 3""")
def top_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest projects of each worker."""
    r = lines(spark, sf_dir).groupBy("worker", "project").agg(F.sum("amount").alias("a"))
    w = Window.partitionBy("worker").orderBy(F.desc("a"), "project")
    return r.withColumn("place", F.rank().over(w).cast("bigint")).where("place <= 3").select("worker", "project", number("a").alias("amount"), "place")

"""Prices, vouchers, tickets, budgets and the sources they come from.

Money and quantities are whole hundredths here, so that quotients round alike everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewspark.operators import matching, reconcile, sequences
from crewspark.plans.production import LINES, lines
from crewspark.plans.registry import money, query, table


def hundredths(c: str) -> Column:
    return (money(c) * 100).cast("bigint")


def cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress lines with q and amount in hundredths."""
    return lines(spark, sf_dir).withColumns({"q": (F.col("q") * 100).cast("bigint"), "amount": (F.col("amount") * 100).cast("bigint")})


def total(condition: Column, value: str = "q") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0)).cast("bigint")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").cast("bigint").alias("size"), hundredths("p_retailprice").alias("price"), "p_brand", "p_type")


CENTS = f"""{LINES}, cents AS (SELECT * REPLACE (CAST(q * 100 AS BIGINT) AS q, CAST(amount * 100 AS BIGINT) AS amount) FROM lines),
  parts AS (SELECT p_partkey AS item, CAST(p_size AS BIGINT) AS size, CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS price, p_brand, p_type FROM part)"""


@query(f"""WITH {CENTS}, g AS (SELECT project, item, kind, CAST(sum(q) AS BIGINT) AS q, CAST(sum(amount) AS BIGINT) AS amount FROM cents GROUP BY 1, 2, 3)
  SELECT project, 'item:' || g.item || ':' || kind AS activity, q, CASE kind WHEN 'R' THEN amount ELSE (q * price + 50) // 100 END AS amount FROM g JOIN parts USING (item)""")
def voucher_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by activity: fixed prices are summed, unit prices multiply the summed quantity."""
    g = cents(spark, sf_dir).groupBy("project", "item", "kind").agg(F.sum("q").alias("q"), F.sum("amount").alias("amount"))
    amount = F.when(F.col("kind") == "R", F.col("amount")).otherwise(F.expr("(q * price + 50) div 100"))
    return g.join(parts(spark, sf_dir), "item").select("project", F.concat_ws(":", F.lit("item"), "item", "kind").alias("activity"), "q", amount.alias("amount"))


@query(f"""WITH {CENTS}, t AS (SELECT project, item, min(kind) AS method, CAST(sum(q) AS BIGINT) AS q FROM cents WHERE q > 0 GROUP BY 1, 2)
  SELECT project, t.item AS item, method, q, CASE method WHEN 'A' THEN (q * price + 50) // 100 WHEN 'N' THEN (q * size + 50) // 100 END AS amount FROM t JOIN parts USING (item)""")
def ticket_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket totals of each item, billed by quantity, by hours, or not at all (null)."""
    t = cents(spark, sf_dir).where("q > 0").groupBy("project", "item").agg(F.min("kind").alias("method"), F.sum("q").alias("q"))
    amount = F.when(F.col("method") == "A", F.expr("(q * price + 50) div 100")).when(F.col("method") == "N", F.expr("(q * size + 50) div 100"))
    return t.join(parts(spark, sf_dir), "item").select("project", "item", "method", "q", amount.alias("amount"))


@query(f"""WITH {CENTS} SELECT item, CASE WHEN q > 4500 THEN 'too large' WHEN q < 300 THEN 'too small' ELSE 'ok' END AS outcome, count(*) AS pieces, CAST(sum(q) AS BIGINT) AS q FROM cents GROUP BY 1, 2""")
def piece_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces by item, and those that are rejected with the reason."""
    outcome = F.when(F.col("q") > 4500, "too large").when(F.col("q") < 300, "too small").otherwise("ok")
    return cents(spark, sf_dir).groupBy("item", outcome.alias("outcome")).agg(F.count("*").alias("pieces"), F.sum("q").alias("q"))


@query(f"""WITH {CENTS} SELECT project, CAST(coalesce(sum(q) FILTER (WHERE kind = 'N' AND document = 'F'), sum(q) FILTER (WHERE kind = 'N'), sum(q)) AS BIGINT) AS q,
  CASE WHEN bool_or(kind = 'N' AND document = 'F') THEN 'priming' WHEN bool_or(kind = 'N') THEN 'area' ELSE 'all' END AS source FROM cents GROUP BY 1""")
def board_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantity that a project shows: its best source only."""
    n = F.col("kind") == "N"
    part = lambda c: F.sum(F.when(c, F.col("q")))
    q, source = matching.waterfall(("priming", part(n & (F.col("document") == "F"))), ("area", part(n)), ("all", F.sum("q")))
    return cents(spark, sf_dir).groupBy("project").agg(q.alias("q"), source.alias("source"))


@query(f"""WITH {CENTS}, u AS (SELECT item, CAST(sum(q) AS BIGINT) AS used, count(DISTINCT project) AS projects FROM cents WHERE document = 'F' GROUP BY 1)
  SELECT item, size * 2000 AS available, coalesce(used, 0) AS used, coalesce(used, 0) > size * 2000 AS "exceeds", coalesce(projects, 0) AS projects FROM parts LEFT JOIN u USING (item)""")
def allocation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = cents(spark, sf_dir).where("document = 'F'").groupBy("item").agg(F.sum("q").alias("u"), F.countDistinct("project").alias("p"))
    used = F.coalesce("u", F.lit(0))
    return parts(spark, sf_dir).join(u, "item", "left").select("item", (F.col("size") * 2000).alias("available"), used.alias("used"), (used > F.col("size") * 2000).alias("exceeds"), F.coalesce("p", F.lit(0)).alias("projects"))


@query(f"""WITH {CENTS}, g AS (SELECT worker, day, project, item, CAST(sum(q) AS BIGINT) AS q FROM cents GROUP BY ALL),
  r AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY worker, day ORDER BY project, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM g)
  SELECT worker, CAST(sum(q) FILTER (WHERE used + q <= 6000) AS BIGINT) AS accepted, count(*) FILTER (WHERE used + q > 6000) AS rejected_lines, count(*) AS all_lines FROM r GROUP BY 1""")
def running_consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a worker's day against what remains of sixty units, in order."""
    g = cents(spark, sf_dir).groupBy("worker", "day", "project", "item").agg(F.sum("q").alias("q"))
    w = Window.partitionBy("worker", "day").orderBy("project", "item").rowsBetween(Window.unboundedPreceding, -1)
    r = g.withColumn("fits", F.coalesce(F.sum("q").over(w), F.lit(0)) + F.col("q") <= 6000)
    return r.groupBy("worker").agg(F.sum(F.when(F.col("fits"), F.col("q"))).alias("accepted"), F.count_if(~F.col("fits")).alias("rejected_lines"), F.count("*").alias("all_lines"))


@query(f"""WITH {LINES} SELECT project, item, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, datediff('day', min(day), max(day)) AS span, count(DISTINCT day) AS days FROM lines GROUP BY 1, 2""")
def worked_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lines(spark, sf_dir).groupBy("project", "item").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.countDistinct("day").alias("days"))
    return p.select("project", "item", F.col("a").cast("string").alias("first_day"), F.col("b").cast("string").alias("last_day"), F.datediff("b", "a").cast("bigint").alias("span"), "days")


@query(f"""WITH {CENTS} SELECT item, CAST(sum(q) AS BIGINT) AS hours, CAST(sum(amount) AS BIGINT) AS cost, CAST(sum(q) FILTER (WHERE kind = 'N') AS BIGINT) AS metres,
  CASE WHEN count(DISTINCT amount * 100 // q) = 1 THEN CAST(max(amount * 100 // q) AS BIGINT) WHEN sum(q) > 0 THEN CAST((sum(amount) * 100 + sum(q) // 2) // sum(q) AS BIGINT) END AS rate FROM cents WHERE q > 0 GROUP BY 1""")
def item_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget of each item from its labour lines: the one rate they share, else cost by hours."""
    each = F.expr("amount * 100 div q")
    s = cents(spark, sf_dir).where("q > 0").groupBy("item").agg(F.sum("q").alias("hours"), F.sum("amount").alias("cost"), F.sum(F.when(F.col("kind") == "N", F.col("q"))).alias("metres"), F.min(each).alias("a"), F.max(each).alias("b"))
    return s.select("item", "hours", "cost", "metres", F.when(F.col("a") == F.col("b"), F.col("b")).otherwise(F.expr("(cost * 100 + hours div 2) div hours")).alias("rate"))


@query(f"""WITH {CENTS}, f AS (SELECT project, CAST(sum(q) FILTER (WHERE kind = 'N') AS BIGINT) AS primed FROM cents GROUP BY 1)
  SELECT c.project, c.room, count(*) AS labour_lines, CAST(max(coalesce(primed, 0)) AS BIGINT) AS primed FROM cents c JOIN f ON c.project = f.project WHERE kind = 'R' GROUP BY 1, 2""")
def preparation_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preparation work gets the primed floor of its whole project."""
    c = cents(spark, sf_dir)
    primed = c.groupBy("project").agg(total(F.col("kind") == "N").alias("primed"))
    return c.where("kind = 'R'").groupBy("project", "room").agg(F.count("*").alias("labour_lines")).join(primed, "project").select("project", "room", "labour_lines", "primed")


@query(f"""WITH {CENTS}, g AS (SELECT project, room, item, max(kind) AS kind, CAST(sum(q) AS BIGINT) AS q FROM cents GROUP BY 1, 2, 3),
  i AS (SELECT *, count(*) FILTER (WHERE kind = 'R') OVER (PARTITION BY project ORDER BY room, item ROWS UNBOUNDED PRECEDING) AS island FROM g)
  SELECT project, island, min(item) FILTER (WHERE kind = 'R') AS labour_item, count(*) FILTER (WHERE kind <> 'R') AS materials, CAST(coalesce(sum(q) FILTER (WHERE kind <> 'R'), 0) AS BIGINT) AS q FROM i GROUP BY 1, 2""")
def labor_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials go to the labour row above them; those before the first one are island 0."""
    g = cents(spark, sf_dir).groupBy("project", "room", "item").agg(F.max("kind").alias("kind"), F.sum("q").alias("q"))
    labour = F.col("kind") == "R"
    w = Window.partitionBy("project").orderBy("room", "item").rowsBetween(Window.unboundedPreceding, 0)
    i = g.withColumn("island", F.count_if(labour).over(w))
    return i.groupBy("project", "island").agg(F.min(F.when(labour, F.col("item"))).alias("labour_item"), F.count_if(~labour).alias("materials"), total(~labour).alias("q"))


@query(f"""WITH {CENTS}, g AS (SELECT project, item, list(q ORDER BY room, q) AS qs FROM cents GROUP BY 1, 2)
  SELECT project, item, CAST(list_reduce(qs, lambda s, v: CASE WHEN abs(s - v) <= 500 THEN s ELSE s + v END) AS BIGINT) AS q FROM g""")
def collapsed_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums in which a value that repeats the running one (within five units) isn't added."""
    c = cents(spark, sf_dir).select("project", "item", F.struct("room", "q").alias("at"), F.col("q").cast("bigint").alias("q"))
    return reconcile.collapse_near(c, ["project", "item"], "at", "q", 500)


@query(f"""WITH {LINES}, h AS (SELECT item, list(struct_pack(role := kind, strength := 1) ORDER BY day, project, room, kind) AS ms FROM lines GROUP BY 1),
  r AS (SELECT item, list_reduce(ms, lambda m, x: CASE WHEN m.role = x.role THEN struct_pack(role := m.role, strength := m.strength + 1) WHEN m.strength <= 1 THEN x ELSE m END) AS m FROM h)
  SELECT item, m.role AS role, CAST(m.strength AS BIGINT) AS strength FROM r""")
def header_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kind an item's lines have taught, in order of time."""
    r = sequences.remembered(lines(spark, sf_dir), ["item"], ["day", "project", "room"], "kind")
    return r.select("item", "role", F.col("strength").cast("bigint").alias("strength"))


@query(f"""WITH {CENTS}, f AS (SELECT worker, project, CAST(sum(q) AS BIGINT) AS q, max(item) AS item FROM cents WHERE document = 'F' GROUP BY 1, 2),
  o AS (SELECT worker, project, CAST(sum(q) AS BIGINT) AS q, max(item) AS item FROM cents WHERE document = 'O' GROUP BY 1, 2)
  SELECT coalesce(f.worker, o.worker) AS worker, coalesce(f.project, o.project) AS project, CASE WHEN f.worker IS NULL THEN 'ticket' ELSE 'progress' END AS source,
  CASE WHEN f.worker IS NULL THEN o.q ELSE f.q END AS q, CASE WHEN f.worker IS NULL THEN o.item ELSE f.item END AS item FROM f FULL JOIN o ON f.worker = o.worker AND f.project = o.project""")
def merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second fact fills only the groups that the first leaves empty: one pass, no join."""
    g = cents(spark, sf_dir).groupBy("worker", "project").agg(*[F.max(F.when(F.col("document") == d, F.col("item"))).alias(f"i_{d}") for d in "FO"], *[F.sum(F.when(F.col("document") == d, F.col("q"))).alias(f"q_{d}") for d in "FO"])
    own = F.col("q_F").isNotNull()
    return g.select("worker", "project", F.when(own, "progress").otherwise("ticket").alias("source"), F.coalesce("q_F", "q_O").alias("q"), F.when(own, F.col("i_F")).otherwise(F.col("i_O")).alias("item"))


@query(f"""WITH {CENTS}, b AS (SELECT project, item, coalesce(sum(q) FILTER (WHERE document = 'O'), 0) - coalesce(sum(q) FILTER (WHERE document = 'F'), 0) AS remaining FROM cents GROUP BY 1, 2)
  SELECT project, b.item AS item, CAST(remaining AS BIGINT) AS remaining, CAST((remaining * price + 50) // 100 AS BIGINT) AS amount FROM b JOIN parts USING (item) WHERE remaining > 0""")
def remaining_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invoice's draft: what is left of each order line, at its price."""
    d = F.col("document")
    b = cents(spark, sf_dir).groupBy("project", "item").agg((total(d == "O") - total(d == "F")).alias("remaining")).where("remaining > 0")
    return b.join(parts(spark, sf_dir), "item").select("project", "item", "remaining", F.expr("(remaining * price + 50) div 100").alias("amount"))


@query(f"""WITH {CENTS}, i AS (SELECT project, item, min(amount) AS a FROM cents WHERE document = 'O' GROUP BY 1, 2), k AS (SELECT project, kind, min(amount) AS a FROM cents WHERE document = 'O' GROUP BY 1, 2)
  SELECT c.project, c.item, c.kind, count(*) AS n, CAST(min(coalesce(i.a, k.a)) AS BIGINT) AS price, CASE WHEN min(i.a) IS NOT NULL THEN 'item' WHEN min(k.a) IS NOT NULL THEN 'kind' END AS matched
  FROM cents c LEFT JOIN i ON c.project = i.project AND c.item = i.item LEFT JOIN k ON c.project = k.project AND c.kind = k.kind WHERE c.document = 'F' GROUP BY 1, 2, 3""")
def first_match_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order's price of a line's item, else of its kind."""
    c = cents(spark, sf_dir)
    o = c.where("document = 'O'")
    i = o.groupBy("project", "item").agg(F.min("amount").alias("i"))
    k = o.groupBy("project", "kind").agg(F.min("amount").alias("k"))
    f = c.where("document = 'F'").groupBy("project", "item", "kind").agg(F.count("*").alias("n")).join(i, ["project", "item"], "left").join(k, ["project", "kind"], "left")
    price, matched = matching.waterfall(("item", F.col("i")), ("kind", F.col("k")))
    return f.select("project", "item", "kind", "n", price.alias("price"), matched.alias("matched"))


@query(f"""WITH {LINES} SELECT project, coalesce(min_by(item, room * 100000000 + item) FILTER (WHERE kind = 'N'), min_by(item, room * 100000000 + item)) AS item, bool_or(kind = 'N') AS own FROM lines GROUP BY 1""")
def resolved_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project's first floor item, else its first item."""
    n, order = F.col("kind") == "N", F.struct("room", "item")
    return lines(spark, sf_dir).groupBy("project").agg(F.coalesce(F.min_by(F.when(n, F.col("item")), F.when(n, order)), F.min_by("item", order)).alias("item"), F.bool_or(n).alias("own"))


@query(f"""WITH {CENTS}, p AS (SELECT project, CAST(sum(amount) AS BIGINT) AS calculated FROM cents GROUP BY 1),
  s AS (SELECT o_custkey AS customer, CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS BIGINT) // 100000 AS declared, calculated // 100000 AS calculated FROM orders LEFT JOIN p ON o_orderkey = project),
  r AS (SELECT customer, CASE WHEN calculated IS NULL THEN 3 WHEN abs(declared - calculated) <= 10 THEN 0 WHEN abs(declared - calculated) <= 200 THEN 1 ELSE 2 END AS rank FROM s)
  SELECT customer, ['ok', 'warning', 'check', 'unknown'][max(rank) + 1] AS worst, count(*) AS projects, count(*) FILTER (WHERE rank = 0) AS ok FROM r GROUP BY 1""")
def declared_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared against calculated totals, and the worst state of each customer."""
    p = cents(spark, sf_dir).groupBy(F.col("project").alias("o_orderkey")).agg(F.sum("amount").alias("c"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), F.expr("div(cast(cast(o_totalprice as decimal(12,2)) * 100 as bigint), 100000)").alias("declared"))
    off = F.abs(F.col("declared") - F.expr("c div 100000"))
    rank = F.when(F.col("c").isNull(), 3).when(off <= 10, 0).when(off <= 200, 1).otherwise(2)
    r = o.join(p, "o_orderkey", "left").select("customer", rank.alias("rank"))
    names = F.array(*[F.lit(x) for x in ("ok", "warning", "check", "unknown")])
    return r.groupBy("customer").agg(F.get(names, F.max("rank")).alias("worst"), F.count("*").alias("projects"), F.count_if(F.col("rank") == 0).alias("ok"))


@query(f"""WITH {CENTS}, t AS (SELECT item, CAST(sum(amount) FILTER (WHERE document = 'O') AS BIGINT) AS budget, CAST(sum(amount) AS BIGINT) AS actual, CAST(sum(q) AS BIGINT) AS q FROM cents GROUP BY 1)
  SELECT item, CASE WHEN budget > 0 AND q > 0 THEN (budget * 100 + q // 2) // q END AS budget_price, CASE WHEN actual > 0 AND q > 0 THEN (actual * 100 + q // 2) // q END AS actual_price,
  CASE WHEN budget > 0 THEN (actual * 1000 + budget // 2) // budget END AS per_mille FROM t""")
def unit_price_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit prices and the share of the budget that is used; null where nothing divides."""
    t = cents(spark, sf_dir).groupBy("item").agg(F.sum(F.when(F.col("document") == "O", F.col("amount"))).alias("budget"), F.sum("amount").alias("actual"), F.sum("q").alias("q"))
    ratio = lambda a, b, k: F.when((F.col(a) > 0) & (F.col(b) > 0), F.expr(f"({a} * {k} + {b} div 2) div nullif({b}, 0)"))
    return t.select("item", ratio("budget", "q", 100).alias("budget_price"), ratio("actual", "q", 100).alias("actual_price"), ratio("actual", "budget", 1000).alias("per_mille"))


@query(f"""WITH {CENTS}, d AS (SELECT project, room, count(*) AS n, CAST(sum(q) AS BIGINT) AS q, min(item) AS item FROM cents GROUP BY 1, 2)
  SELECT project, q, min(room) AS room, count(*) AS ghosts, string_agg(CAST(room AS VARCHAR), ',' ORDER BY room) AS rooms FROM d GROUP BY 1, 2 HAVING count(*) > 1""")
def ghost_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms of a project with one total; the first one survives."""
    d = cents(spark, sf_dir).groupBy("project", "room").agg(F.sum("q").alias("q"))
    rooms = F.array_join(F.transform(F.array_sort(F.collect_list("room")), lambda r: r.cast("string")), ",")
    return d.groupBy("project", "q").agg(F.min("room").alias("room"), F.count("*").alias("ghosts"), rooms.alias("rooms")).where("ghosts > 1")


@query(f"""WITH {CENTS} SELECT count(*) AS lines, count(DISTINCT project) AS projects, count(DISTINCT item) AS items, CAST(sum(q) AS BIGINT) AS q, CAST(sum(q) FILTER (WHERE kind = 'N') * 1000 // sum(q) AS BIGINT) AS floor_per_mille,
  CAST(count(*) FILTER (WHERE q >= 4000) AS BIGINT) AS large FROM cents""")
def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cents(spark, sf_dir).agg(F.count("*").alias("lines"), F.countDistinct("project").alias("projects"), F.countDistinct("item").alias("items"), F.sum("q").alias("q"), total(F.col("kind") == "N").alias("n"), F.count_if(F.col("q") >= 4000).alias("large"))
    return s.select("lines", "projects", "items", "q", F.expr("n * 1000 div q").alias("floor_per_mille"), "large")


@query("""WITH h AS (SELECT p_type, min(p_retailprice) AS p, count(DISTINCT p_brand) AS brands, min(p_brand) AS brand FROM part GROUP BY 1)
  SELECT p_type, brands, CASE WHEN brands = 1 THEN brand END AS brand FROM h""")
def single_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attribute that a group shares, or null if it has several."""
    g = table(spark, sf_dir, "part").groupBy("p_type").agg(F.countDistinct("p_brand").alias("brands"), F.min("p_brand").alias("b"))
    return g.select("p_type", "brands", F.when(F.col("brands") == 1, F.col("b")).alias("brand"))


@query("""SELECT o_custkey, o_orderkey, revision, revision = max(revision) OVER (PARTITION BY o_custkey, o_orderpriority) AS current FROM (
  SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS revision FROM orders)""")
def document_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision of each document of a customer and type, and whether it is the current one."""
    key = Window.partitionBy("o_custkey", "o_orderpriority")
    r = table(spark, sf_dir, "orders").withColumns({"revision": F.row_number().over(key.orderBy("o_orderdate", "o_orderkey")).cast("bigint"), "n": F.count("*").over(key)})
    return r.select("o_custkey", "o_orderkey", "revision", (F.col("revision") == F.col("n")).alias("current"))


@query("""SELECT c_custkey, c_name, count(o_orderkey) AS orders, CAST(coalesce(max(o_orderkey), 0) AS BIGINT) AS latest FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""")
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("m"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("m", F.lit(0)).alias("latest"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3)
  OR (o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))""")
def named_or_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects that name a worker, or belong to their team and name nobody: a union of key sets."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    named = li.where("l_suppkey = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    team = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    unnamed = o.join(team, "o_custkey", "left_semi").join(li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")
    return o.join(named.union(unnamed), "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 3), u AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM a) AND o_orderpriority IN ('1-URGENT', '2-HIGH'))
  SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM u GROUP BY 1""")
def accessible_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects to which a person is linked (by lines of suppliers of one nation), and kinds, are chosen
    before anything is summed."""
    own = table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    links = table(spark, sf_dir, "lineitem").join(own, "l_suppkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    u = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(links, "o_orderkey", "left_semi")
    return u.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).cast("double").alias("total"))

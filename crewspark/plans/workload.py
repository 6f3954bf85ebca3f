"""Workload, search and money rules over orders, entries and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewspark.functions import calendar as cal
from crewspark.functions import labor as lab
from crewspark.functions import text
from crewspark.operators import search, work_match, workload
from crewspark.plans.billing import CENTS, cents
from crewspark.plans.registry import ENTRIES, entries, query, table

TERM, BADGES = "old", {"P": "Sold out", "F": "Done", "O": "Open"}


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE contains(lower(o_orderpriority), 'old') OR contains(lower(CAST(o_orderkey AS VARCHAR)), 'old') OR o_orderstatus = 'P'
  OR o_custkey IN (SELECT c_custkey FROM customer WHERE contains(lower(c_name), 'old') OR contains(lower(c_mktsegment), 'old'))
  OR o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_name), 'old') OR contains(lower(p_type), 'old'))""")
def searched_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects by a term in seven columns, in their customer, in their activities or those's kinds, or by badge."""
    o = table(spark, sf_dir, "orders").withColumns({"number": F.col("o_orderkey").cast("string"), "day": F.to_date("o_orderdate").cast("string"), "amount": F.floor("o_totalprice").cast("string"), "quarter": F.quarter("o_orderdate").cast("string")})
    c = table(spark, sf_dir, "customer").where(search.holds(TERM, ["c_name", "c_mktsegment"])).select(F.col("c_custkey").alias("o_custkey"))
    p = table(spark, sf_dir, "part").where(search.holds(TERM, ["p_name", "p_type"])).select(F.col("p_partkey").alias("l_partkey"))
    activities = table(spark, sf_dir, "lineitem").join(p, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    columns = ["number", "o_orderpriority", "o_orderstatus", "day", "o_custkey", "amount", "quarter"]
    return search.matching_search(o, TERM, columns, [(c, "o_custkey"), (activities, "o_orderkey")], "o_orderstatus", BADGES).select("o_orderkey", "o_orderstatus")


@query(r"""WITH w AS (SELECT p_name, l_linenumber % 5 AS v, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  t AS (SELECT *, string_split(regexp_replace(p_name, '[^a-z]', '', 'g'), '') AS c FROM w),
  x AS (SELECT *, array_to_string(c, '') AS a, CASE v WHEN 0 THEN ['r', 'u', 'i', 'm', 't', 'e'] || c WHEN 1 THEN flatten(list_transform(c, lambda y: [y, y])) WHEN 2 THEN flatten(list_transform(c, lambda y: CASE WHEN y = 'o' THEN ['o', 'o', 'o'] ELSE [y] END))
    WHEN 3 THEN flatten(list_transform(c, lambda y: [y, 'x'])) ELSE list_reverse(c) END AS l FROM t),
  y AS (SELECT *, array_to_string(l, '') AS b, array_to_string(list_filter(l, lambda z, i: i = 1 OR l[i - 1] <> z), '') AS runs,
    CASE WHEN len(l) >= 4 AND len(list_filter(range(1, len(l), 2), lambda i: l[i] = l[i + 1])) / (len(l) // 2) >= 0.55 THEN array_to_string(list_transform(range(1, len(l) + 1, 2), lambda i: l[i]), '') ELSE array_to_string(l, '') END AS und FROM x)
  SELECT p_name, v, n, contains(b, a) OR contains(runs, a) OR contains(und, a) OR (length(a) >= 4 AND length(b) <= ceil(length(a) * 2.6) AND regexp_matches(b, array_to_string(c, '.*'))) AS found FROM y""")
def names_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of products in texts as drawings have them: with noise, with letters twice or three times, spread out,
    and turned round."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    w = li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy("p_name", (F.col("l_linenumber") % 5).alias("v")).agg(F.count("*").alias("n"))
    v, name = F.col("v"), F.col("p_name")
    written = (
        F.when(v == 0, F.concat(F.lit("Ruimte: "), F.upper(name), F.lit(" 12")))
        .when(v == 1, F.regexp_replace(name, "(.)", "$1$1"))
        .when(v == 2, F.regexp_replace(name, "o", "ooo"))
        .when(v == 3, F.regexp_replace(name, "([a-z])", "$1x"))
        .otherwise(F.reverse(name))
    )
    return w.select("p_name", "v", "n", text.name_in_text(name, written).alias("found"))


_RANGES = """r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 6 AS INTEGER) AS b, CASE WHEN o_custkey % 4 > 0 THEN 420 + o_custkey % 4 * 60 END AS s, 700 + o_custkey % 7 * 60 AS e, o_orderpriority = '1-URGENT' AS sat FROM orders)"""


@query(f"""WITH {_RANGES}, d AS (SELECT *, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM r), w AS (SELECT *, min(day) OVER (PARTITION BY o_orderkey) AS first, max(day) OVER (PARTITION BY o_orderkey) AS last FROM d WHERE isodow(day) < 6 OR (isodow(day) = 6 AND sat)),
  x AS (SELECT o_orderkey, day, CASE WHEN day = first THEN coalesce(s, 480) ELSE 480 END AS f, CASE WHEN day = last THEN e ELSE 960 END AS t FROM w)
  SELECT o_orderkey, CAST(day AS VARCHAR) AS day, CAST(f AS BIGINT) AS start_min, CAST(t AS BIGINT) AS end_min FROM x WHERE t > f""")
def assignment_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work days of assignments with their clock times; the first and the last one are partial."""
    a, c = F.to_date("o_orderdate"), F.col("o_custkey")
    r = table(spark, sf_dir, "orders").select(
        "o_orderkey", a.alias("first_day"), F.date_add(a, (F.col("o_orderkey") % 6).cast("int")).alias("last_day"), F.when(c % 4 > 0, 420 + c % 4 * 60).alias("start_min"), (700 + c % 7 * 60).alias("end_min"), (F.col("o_orderpriority") == "1-URGENT").alias("sat"),
    )
    d = workload.day_intervals(r, ["o_orderkey"], F.col("sat"))
    return d.select("o_orderkey", F.col("day").cast("string").alias("day"), F.col("start_min").cast("long").alias("start_min"), F.col("end_min").cast("long").alias("end_min"))


@query(f"""WITH {ENTRIES}, t AS (SELECT day, status AS team, CASE WHEN status IN ('error', 'signup') THEN 1 ELSE 3 END AS capacity, person, s, e FROM entries),
  h AS (SELECT day, team, max(capacity) AS capacity, round(sum(e - s) / 3600.0::DOUBLE, 2) AS hours FROM t GROUP BY 1, 2),
  m AS (SELECT day, team, pos, sum(d) AS d FROM (SELECT day, team, s AS pos, 1 AS d FROM t WHERE e > s UNION ALL SELECT day, team, e, -1 FROM t WHERE e > s) GROUP BY ALL),
  p AS (SELECT day, team, max(present) AS peak FROM (SELECT day, team, sum(d) OVER (PARTITION BY day, team ORDER BY pos) AS present FROM m) GROUP BY 1, 2)
  SELECT CAST(h.day AS VARCHAR) AS day, h.team AS team, CAST(peak AS BIGINT) AS peak, CAST(capacity AS INTEGER) AS capacity, hours FROM h JOIN p ON h.day = p.day AND h.team = p.team WHERE NOT (capacity = 1 AND hours <= 2 + 0.01::DOUBLE) AND peak > capacity""")
def team_double_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a team has more at once than people; single workers only beyond two hours."""
    rows = entries(spark, sf_dir).select("day", F.col("status").alias("team"), F.when(F.col("status").isin("error", "signup"), 1).otherwise(3).alias("capacity"), F.lit(2).alias("budget"), "s", "e")
    d = workload.double_bookings(rows, ["day", "team"], "s", "e")
    return d.select(F.col("day").cast("string").alias("day"), "team", F.col("peak").cast("long").alias("peak"), "capacity", F.col("hours").cast("double").alias("hours"))


@query(f"""WITH {ENTRIES}, p AS (SELECT id AS proposal, person, day, s // 60 AS a, e // 60 AS b, ((e - s) * 100 + 1800) // 3600 AS hours FROM entries WHERE status = 'signup'),
  x AS (SELECT id, person, day, s // 60 AS a, e // 60 AS b, ((e - s) * 100 + 1800) // 3600 AS hours FROM entries WHERE status <> 'signup'),
  m AS (SELECT proposal, p.day AS day, x.id, any_value(p.hours) AS adding, any_value(x.hours) AS hours, max(x.person) AS person FROM p JOIN x ON p.person = x.person AND p.day = x.day AND p.a < x.b AND x.a < p.b GROUP BY 1, 2, 3),
  d AS (SELECT proposal, day, sum(hours) + max(adding) AS used, max(person) AS person FROM m GROUP BY 1, 2)
  SELECT proposal, CAST(day AS VARCHAR) AS day, person, CAST(used AS DOUBLE) / 100 AS used FROM d WHERE used > 151""")
def named_crew_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals for named people who are over their hours of the day with what overlaps."""
    own = F.col("status") == "signup"
    minute = lambda c: F.floor(F.col(c) / 60)
    e = entries(spark, sf_dir).select("id", "person", "day", minute("s").alias("start_min"), minute("e").alias("end_min"), (cal.hundredths_of_hours(F.col("e") - F.col("s")).cast("decimal(12,2)") / 100).cast("decimal(12,2)").alias("hours"), own.alias("own"))
    c = workload.crew_conflicts(e.where("own").withColumnRenamed("id", "proposal"), e.where("NOT own"), 1.5)
    return c.select("proposal", F.col("day").cast("string").alias("day"), "person", F.col("used").cast("double").alias("used"))


@query(f"""WITH {ENTRIES}, p AS (SELECT person // 4 AS team, person, day, bool_or(status = 'purchase') AS skilled, bool_or(s < 43200 AND e > 36000 AND status <> 'purchase') AS busy, bool_or(status = 'error') AS away FROM entries GROUP BY 1, 2, 3),
  s AS (SELECT *, CASE WHEN NOT skilled THEN 'no_skill' WHEN busy OR away THEN 'busy' ELSE 'available' END AS st FROM p)
  SELECT team, CAST(day AS VARCHAR) AS day, count(*) FILTER (st = 'available') > 0 AS selectable, CASE WHEN count(*) > 1 THEN CASE WHEN count(*) FILTER (st = 'available') > 0 THEN 'partial' ELSE 'unavailable' END ELSE max(st) END AS status,
    count(*) FILTER (st = 'available') AS suitable, count(*) AS total FROM s GROUP BY team, s.day""")
def team_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams and how many of their people have the skill and are free from 10 to 12 on a day."""
    st = F.col("status")
    busy = (F.col("s") < 43200) & (F.col("e") > 36000) & (st != "purchase")
    people = entries(spark, sf_dir).groupBy(F.floor(F.col("person") / 4).alias("team"), "person", "day").agg(F.bool_or(st == "purchase").alias("skilled"), F.bool_or(busy).alias("busy"), F.bool_or(st == "error").alias("away"))
    return workload.fitting_teams(people, ["team", "day"]).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {CENTS}, g AS (SELECT project, item, CAST(sum(q) FILTER (kind = 'N') AS BIGINT) AS b, CAST(coalesce(sum(q) FILTER (kind = 'A'), 0) AS BIGINT) AS p, CAST(coalesce(sum(q) FILTER (document = 'F'), 0) AS BIGINT) AS a, CAST(max(amount) FILTER (kind = 'N') AS BIGINT) AS bp, CAST(max(amount) FILTER (document = 'F') AS BIGINT) AS ap FROM cents GROUP BY 1, 2),
  w AS (SELECT *, coalesce(b, 0) > 0 AS given, p + a AS used, list_filter([CASE WHEN b > 0 AND a > b THEN 'actual above budget' END, CASE WHEN b > 0 AND p > b THEN 'planned above budget' END, CASE WHEN ap > bp THEN 'price above budget' END], lambda x: x IS NOT NULL) AS told FROM g),
  s AS (SELECT *, CAST(floor(used::DOUBLE / b * 100 + 0.5) AS INTEGER) AS share FROM w),
  t AS (SELECT *, CASE WHEN share > 100 OR len(told) > 0 THEN 'over' WHEN share >= 80 THEN 'warn' ELSE 'ok' END AS own FROM s)
  SELECT project, item, CASE WHEN given THEN greatest(0, b - used) END AS remaining, CASE WHEN given THEN greatest(0, used - b) ELSE 0 END AS overrun, CASE WHEN given THEN share END AS percent, CASE WHEN given THEN own WHEN len(told) > 0 THEN 'over' ELSE 'none' END AS tone,
    array_to_string(CASE WHEN given AND own = 'over' AND len(told) = 0 THEN ['hours used up'] WHEN given AND own = 'warn' THEN ['hours nearly used up'] ELSE told END, ',') AS warnings FROM t""")
def labor_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours used of a budget, its tone and all that is to be warned of."""
    k, d, q, m = F.col("kind"), F.col("document"), F.col("q"), F.col("amount")
    none = F.lit(0).cast("long")
    g = cents(spark, sf_dir).groupBy("project", "item").agg(
        F.sum(F.when(k == "N", q)).alias("b"), F.coalesce(F.sum(F.when(k == "A", q)), none).alias("p"), F.coalesce(F.sum(F.when(d == "F", q)), none).alias("a"), F.max(F.when(k == "N", m)).alias("bp"), F.max(F.when(d == "F", m)).alias("ap")
    )
    x = g.withColumn("x", lab.status(F.col("b"), F.col("p") + F.col("a"), F.col("p"), F.col("a"), F.col("bp"), F.col("ap")))
    return x.select("project", "item", F.col("x.remaining").cast("long").alias("remaining"), F.col("x.overrun").cast("long").alias("overrun"), "x.percent", "x.tone", F.array_join("x.warnings", ",").alias("warnings"))


@query(f"""WITH {CENTS}, c AS (SELECT project, CAST(coalesce(sum(amount) FILTER (kind = 'N'), 0) AS BIGINT) AS budget, CAST(coalesce(sum(amount) FILTER (kind <> 'N'), 0) AS BIGINT) AS actual FROM cents GROUP BY 1),
  o AS (SELECT o_orderkey AS project, CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS BIGINT) END AS amount FROM orders),
  x AS (SELECT project, o.amount AS amount, budget, actual FROM c JOIN o USING (project))
  SELECT project, amount - budget AS budget_result, amount - actual AS result, CASE WHEN amount <> 0 THEN CAST(CAST(sign(amount - actual) AS BIGINT) * ((abs(amount - actual) * 2000 + amount) // (2 * amount)) AS DOUBLE) / 10 END AS margin_percent,
    actual - budget AS cost_delta, CASE WHEN budget <> 0 THEN CAST(CAST(sign(actual - budget) AS BIGINT) * ((abs(actual - budget) * 2000 + budget) // (2 * budget)) AS DOUBLE) / 10 END AS delta_percent,
    CASE WHEN amount IS NULL THEN 'none' WHEN amount < actual THEN 'over' ELSE 'ok' END AS result_tone, CASE WHEN actual > budget THEN 'over' ELSE 'ok' END AS budget_tone FROM x""")
def order_finance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and shares of orders on whole cents; one kind of order has no amount."""
    k, m = F.col("kind"), F.col("amount")
    none = F.lit(0).cast("long")
    c = cents(spark, sf_dir).groupBy("project").agg(F.coalesce(F.sum(F.when(k == "N", m)), none).alias("budget"), F.coalesce(F.sum(F.when(k != "N", m)), none).alias("actual"))
    amount = (F.col("o_totalprice").cast("decimal(12,2)") * 100).cast("long")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project"), F.when(F.col("o_orderstatus") != "P", amount).alias("amount"))
    return c.join(o, "project").select("project", lab.finance(F.col("amount"), F.col("budget"), F.col("actual")).alias("x")).select("project", "x.*")


@query(f"""WITH {ENTRIES}, a AS (SELECT CASE status WHEN 'purchase' THEN 'approved' ELSE 'submitted' END AS state, person, day, cents, CASE WHEN id % 3 = 0 THEN cents - 50 WHEN id % 3 = 1 THEN cents END AS reviewed FROM entries)
  SELECT person, isoyear(day) * 100 + weekofyear(day) AS week, CAST(sum(CASE WHEN state = 'approved' THEN coalesce(reviewed, 0) ELSE cents END) AS BIGINT) AS accounted, count(*) FILTER (state = 'approved' AND reviewed <> cents) AS adjusted FROM a GROUP BY 1, 2""")
def accounted_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that count of a week, and how many reviews gave others than were submitted."""
    i, c = F.col("id"), F.col("cents")
    e = entries(spark, sf_dir).withColumns({"state": F.when(F.col("status") == "purchase", "approved").otherwise("submitted"), "reviewed": F.when(i % 3 == 0, c - 50).when(i % 3 == 1, c)})
    x = e.select("person", (cal.iso_year(F.col("day")) * 100 + cal.iso_week(F.col("day"))).cast("long").alias("week"), lab.accounted(F.col("state"), c, F.col("reviewed")).alias("x"))
    return x.groupBy("person", "week").agg(F.sum("x.hours").cast("long").alias("accounted"), F.count_if("x.adjusted").alias("adjusted"))


@query("""WITH g AS (SELECT l_orderkey AS project, CAST(max(l_shipdate) AS DATE) AS due, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) FILTER (l_linestatus = 'O') AS DOUBLE) AS rest FROM lineitem GROUP BY 1)
  SELECT project, CASE WHEN rest > 0 THEN due <= CAST(o_orderdate AS DATE) + 62 ELSE false END AS behind, CASE WHEN o_custkey % 40 // 10 = 0 THEN 'begane grond' ELSE 'verdieping ' || (o_custkey % 40 // 10) END AS storey FROM g JOIN orders ON project = o_orderkey""")
def behind_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects with work left that is due within two days from a day after the order; the storey of a room's number."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("project")).agg(F.max(F.to_date("l_shipdate")).alias("due"), F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("decimal(12,2)"))).alias("rest"))
    o = table(spark, sf_dir, "orders")
    number = F.concat(F.floor(F.col("o_custkey") % 40 / 10).cast("string"), F.lit("."), F.lpad(F.col("o_custkey").cast("string"), 3, "0"))
    late = lab.behind(F.col("due"), F.col("rest"), F.date_add(F.to_date("o_orderdate"), 60))
    return li.join(o, li["project"] == o["o_orderkey"]).select("project", late.alias("behind"), text.floor_from_number(number).alias("storey"))


@query(f"""WITH {CENTS}, l AS (SELECT project, item, room, sum(q) AS q, sum(amount) AS amount FROM cents WHERE kind <> 'N' GROUP BY 1, 2, 3), d AS (SELECT item, CAST(max(q) * 3 AS BIGINT) AS q, CAST(max(amount) * 2 AS BIGINT) AS amount FROM cents WHERE kind = 'N' GROUP BY 1),
  r AS (SELECT l.*, d.q AS mq, d.amount AS ma, coalesce(sum(l.q) OVER w, 0) AS uq, coalesce(sum(l.amount) OVER w, 0) AS ua FROM l LEFT JOIN d USING (item) WINDOW w AS (PARTITION BY item ORDER BY project, room ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT project, item, room, CASE WHEN mq IS NULL THEN 'unknown' WHEN uq + q > mq THEN 'quantity' WHEN ua + amount > ma THEN 'amount' ELSE 'ok' END AS outcome, CAST(CASE WHEN mq IS NOT NULL THEN greatest(0, mq - uq) END AS BIGINT) AS left_q, CAST(CASE WHEN mq IS NOT NULL THEN greatest(0, ma - ua) END AS BIGINT) AS left_amount FROM r""")
def voucher_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of invoices against what an order leaves of their activity, in quantity and in money, in order: what
    the lines before use up counts, and the first limit that a line breaks is named."""
    c = cents(spark, sf_dir)
    lines_ = c.where("kind <> 'N'").groupBy("project", "item", "room").agg(F.sum("q").alias("q"), F.sum("amount").alias("amount"))
    limits = c.where("kind = 'N'").groupBy("item").agg((F.max("q") * 3).alias("mq"), (F.max("amount") * 2).alias("ma"))
    w = Window.partitionBy("item").orderBy("project", "room").rowsBetween(Window.unboundedPreceding, -1)
    used = lambda x: F.coalesce(F.sum(x).over(w), F.lit(0))
    r = lines_.withColumns({"uq": used("q"), "ua": used("amount")}).join(limits, "item", "left")
    outcome = F.when(F.col("mq").isNull(), "unknown").when(F.col("uq") + F.col("q") > F.col("mq"), "quantity").when(F.col("ua") + F.col("amount") > F.col("ma"), "amount").otherwise("ok")
    left = lambda m, u: F.when(F.col("mq").isNotNull(), F.greatest(F.lit(0), F.col(m) - F.col(u))).cast("long")
    return r.select("project", "item", "room", outcome.alias("outcome"), left("mq", "uq").alias("left_q"), left("ma", "ua").alias("left_amount"))


@query(f"""WITH {ENTRIES}, d AS (SELECT person, isoyear(day) * 100 + weekofyear(day) AS week, day, CAST(sum((e - s) // 900) AS BIGINT) AS planned, max(CASE status WHEN 'error' THEN 5 WHEN 'signup' THEN 8 END) AS away,
    CASE WHEN bool_or(status = 'error') THEN 'ill' WHEN bool_or(status = 'signup') THEN 'leave' END AS kind, person % 3 = 0 AS structural FROM entries GROUP BY ALL),
  x AS (SELECT *, greatest(0, least(planned, 8 - coalesce(away, 0))) AS worked, CASE WHEN kind IS NOT NULL AND NOT structural THEN coalesce(away, 0) ELSE 0 END AS told FROM d),
  s AS (SELECT person, week, CAST(sum(worked) AS BIGINT) AS worked, CAST(sum(told) AS BIGINT) AS absence, CAST(coalesce(sum(told) FILTER (kind = 'ill'), 0) AS BIGINT) AS away_ill, CAST(coalesce(sum(told) FILTER (kind = 'leave'), 0) AS BIGINT) AS away_leave, count(*) FILTER (told > 0 AND worked = 0) AS days_away FROM x GROUP BY 1, 2)
  SELECT *, CASE WHEN absence = 0 THEN 'present' ELSE CASE WHEN worked > 0 THEN 'partly ' ELSE '' END || CASE WHEN away_ill >= away_leave THEN 'ill' ELSE 'leave' END END AS summary FROM s""")
def person_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of people: hours that absence leaves, absence by kind, and what the week was."""
    st = F.col("status")
    away = F.when(st == "error", 5).when(st == "signup", 8)
    kind = F.when(F.bool_or(st == "error"), "ill").when(F.bool_or(st == "signup"), "leave")
    week = (cal.iso_year(F.col("day")) * 100 + cal.iso_week(F.col("day"))).cast("long").alias("week")
    d = entries(spark, sf_dir).groupBy("person", week, "day").agg(F.sum(F.floor((F.col("e") - F.col("s")) / 900)).alias("planned"), F.max(away).alias("away"), kind.alias("kind"))
    w = workload.person_weeks(d.withColumn("structural", F.col("person") % 3 == 0), ["person", "week"], ["ill", "leave"])
    return w.select("person", "week", *[F.col(c).cast("long").alias(c) for c in ("worked", "absence", "away_ill", "away_leave")], "days_away", "summary")


@query(f"""WITH {ENTRIES}, r AS (SELECT person, isoyear(day) * 100 + weekofyear(day) AS week, CASE status WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'rejected' ELSE CASE WHEN id % 4 = 0 THEN 'submitted' ELSE 'approved' END END AS status, day + CAST(id % 5 AS INTEGER) AS seen FROM entries),
  s AS (SELECT person, week, CASE WHEN bool_and(status = 'approved') THEN 'approved' WHEN bool_or(status = 'submitted') THEN 'submitted' ELSE 'rejected' END AS state, max(seen) FILTER (status = 'approved') AS a, max(seen) FILTER (status = 'rejected') AS r FROM r GROUP BY 1, 2)
  SELECT person, week, state, CAST(CASE state WHEN 'approved' THEN a WHEN 'rejected' THEN r END AS VARCHAR) AS reviewed_at FROM s""")
def week_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of people's weeks and when they were reviewed."""
    st = F.col("status")
    own = F.when(st == "purchase", "approved").when(st.isin("error", "view"), "rejected").when(F.col("id") % 4 == 0, "submitted").otherwise("approved")
    week = (cal.iso_year(F.col("day")) * 100 + cal.iso_week(F.col("day"))).cast("long").alias("week")
    r = entries(spark, sf_dir).select("person", week, own.alias("status"), F.date_add("day", (F.col("id") % 5).cast("int")).alias("reviewed_at"))
    return workload.week_reviews(r, ["person", "week"]).withColumn("reviewed_at", F.col("reviewed_at").cast("string"))


@query(f"""WITH {CENTS}, r AS (SELECT project, CASE WHEN q < 500 THEN 'missing' WHEN q < 1000 THEN 'review' WHEN kind = 'R' THEN 'estimated' WHEN kind = 'A' THEN CASE WHEN document = 'F' THEN 'confirmed' ELSE 'generous' END WHEN q > 4500 THEN 'not_applicable' ELSE 'certain' END AS state, document = 'O' AS linked,
    CASE WHEN worker % 5 = 0 THEN 'no length' WHEN worker % 5 = 1 THEN 'net' WHEN worker % 5 = 2 THEN 'generous' WHEN worker % 5 = 3 THEN 'estimated' END AS plinth FROM cents),
  s AS (SELECT project, count(*) AS rooms, count(*) FILTER (state IN ('certain', 'confirmed')) AS certain, count(*) FILTER (state = 'generous') AS generous, count(*) FILTER (state = 'estimated') AS estimated, count(*) FILTER (state = 'review') AS review, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'not_applicable') AS not_applicable,
    count(*) FILTER (linked) AS floors, count(*) FILTER (plinth = 'net') AS plinth_net, count(*) FILTER (plinth = 'generous') AS plinth_generous, count(*) FILTER (plinth = 'estimated') AS plinth_estimated, count(*) FILTER (plinth = 'no length') AS plinth_missing FROM r GROUP BY 1)
  SELECT *, review + missing AS blocking, plinth_net + plinth_generous + plinth_estimated AS plinths, review + missing = 0 AND certain + generous + estimated > 0 AS ready FROM s""")
def room_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a sheet's rooms by state, and whether it is ready."""
    q, k, w = F.col("q"), F.col("kind"), F.col("worker") % 5
    a = F.when(F.col("document") == "F", "confirmed").otherwise("generous")
    state = F.when(q < 500, "missing").when(q < 1000, "review").when(k == "R", "estimated").when(k == "A", a).when(q > 4500, "not_applicable").otherwise("certain")
    plinth = F.when(w == 0, "no length").when(w == 1, "net").when(w == 2, "generous").when(w == 3, "estimated")
    return workload.room_counters(cents(spark, sf_dir).select("project", state.alias("state"), (F.col("document") == "O").alias("floor_linked"), plinth.alias("plinth")), ["project"])


GOODS = tuple((w, [w]) for w in ("ring", "bolt", "gear", "plate", "rod"))


@query(f"""WITH l AS (SELECT DISTINCT l_orderkey AS project, l_partkey AS item, l_linenumber, l_returnflag AS flag, p_name, p_size, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
  c AS (SELECT DISTINCT project, p_name AS name FROM l WHERE flag = 'N'),
  o AS (SELECT DISTINCT project, item * 10 + l_linenumber AS id, CASE WHEN p_size < 8 THEN 'primer op ' || p_type WHEN p_size < 16 THEN 'aanbrengen ' || p_name || ' grijs' WHEN p_size < 24 THEN 'transport ' || split_part(p_name, ' ', 2) WHEN p_size < 28 THEN 'opslag' WHEN p_size < 44 THEN 'stuks ' || split_part(p_name, ' ', 2) ELSE 'diversen' END AS text,
    CASE WHEN p_size > 46 THEN [p_name] WHEN p_size > 44 THEN ['grey ' || p_name, 'green ' || p_name] ELSE [] END AS materials, split_part(p_name, ' ', 2) AS noun, p_size, p_name FROM l WHERE flag <> 'N'),
  h AS (SELECT project, id, count(*) AS n, min(name) AS one FROM (SELECT DISTINCT o.project, id, name FROM o JOIN c ON c.project = o.project AND contains(' ' || text, ' ' || name)) GROUP BY 1, 2),
  k AS (SELECT project, split_part(name, ' ', 2) AS noun, list_sort(list(name)) AS names FROM c GROUP BY 1, 2),
  x AS (SELECT o.*, h.n AS n, h.one AS one, CASE WHEN o.noun IN ('ring', 'bolt', 'gear', 'plate', 'rod') THEN o.noun END AS type, coalesce(k.names, []) AS names FROM o LEFT JOIN h USING (project, id) LEFT JOIN k ON k.project = o.project AND k.noun = o.noun)
  SELECT DISTINCT project, id, CASE WHEN p_size < 8 THEN 'matched' WHEN n = 1 OR len(materials) = 1 THEN 'matched' WHEN len(materials) > 1 THEN CASE WHEN type IS NOT NULL THEN 'warning' ELSE 'review' END WHEN p_size BETWEEN 16 AND 23 THEN CASE WHEN type IS NOT NULL THEN 'warning' ELSE 'matched' END WHEN p_size BETWEEN 24 AND 27 THEN 'matched'
      WHEN p_size = 44 OR type IS NULL THEN 'review' WHEN len(names) < 2 THEN 'matched' ELSE 'review' END AS outcome,
    CASE WHEN p_size < 8 THEN 'Primen/egaliseren' WHEN n = 1 THEN one WHEN len(materials) = 1 THEN materials[1] WHEN len(materials) > 1 THEN CASE WHEN type IS NOT NULL THEN 'green ' || p_name END WHEN p_size BETWEEN 16 AND 23 THEN coalesce(type, 'Overige') WHEN p_size BETWEEN 24 AND 27 THEN 'Overige'
      WHEN p_size = 44 OR type IS NULL THEN NULL WHEN len(names) = 1 THEN names[1] WHEN len(names) = 0 THEN type END AS label,
    CASE WHEN len(materials) > 1 AND type IS NOT NULL THEN 2 WHEN p_size BETWEEN 8 AND 15 OR p_size BETWEEN 28 AND 43 THEN CASE WHEN n = 1 THEN 1 WHEN type IS NULL THEN 0 ELSE greatest(1, len(names)) END WHEN p_size < 28 OR p_size > 46 THEN 1 ELSE 0 END AS candidates FROM x""")
def work_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost lines of orders and the works that they are, against the names of the order's other lines."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    own = li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("project"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag", "p_name", "p_size", "p_type").distinct()
    size, name = F.col("p_size"), F.col("p_name")
    noun = F.split_part(name, F.lit(" "), F.lit(2))
    said = (
        F.when(size < 8, F.concat(F.lit("primer op "), "p_type"))
        .when(size < 16, F.concat(F.lit("aanbrengen "), name, F.lit(" grijs")))
        .when(size < 24, F.concat(F.lit("transport "), noun))
        .when(size < 28, F.lit("opslag"))
        .when(size < 44, F.concat(F.lit("stuks "), noun))
        .otherwise("diversen")
    )
    materials = F.when(size > 46, F.array(name)).when(size > 44, F.array(F.concat(F.lit("grey "), name), F.concat(F.lit("green "), name)))
    lines_ = own.where("l_returnflag <> 'N'").select("project", "id", said.alias("description"), materials.alias("materials")).distinct()
    catalog = own.where("l_returnflag = 'N'").select("project", name.alias("name"))
    return work_match.matched_works(lines_, catalog, GOODS).select("project", "id", "outcome", "label", F.size("candidates").alias("candidates")).distinct()


@query(f"""WITH {ENTRIES}, m AS (SELECT person, day, pos, sum(d) AS d FROM (SELECT person, day, s AS pos, 1 AS d FROM entries WHERE e > s UNION ALL SELECT person, day, e, -1 FROM entries WHERE e > s) GROUP BY ALL),
  p AS (SELECT person, day, max(present) AS peak FROM (SELECT person, day, sum(d) OVER (PARTITION BY person, day ORDER BY pos) AS present FROM m) GROUP BY 1, 2),
  b AS (SELECT person // 4 AS team, person, day FROM p WHERE peak > 1)
  SELECT team, string_agg(DISTINCT CAST(person AS VARCHAR), ',' ORDER BY CAST(person AS VARCHAR)) AS people, CAST(min(day) AS VARCHAR) AS first_day, count(DISTINCT day) AS days FROM b GROUP BY 1""")
def booking_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams with people who are booked twice at once: who, since when, on how many days."""
    rows = entries(spark, sf_dir).select(F.floor(F.col("person") / 4).alias("team"), F.col("person").cast("string").alias("person"), "day", "s", "e")
    w = workload.booking_warnings(rows, "team", "person", "day", "s", "e")
    return w.select("team", F.array_join("people", ",").alias("people"), F.col("first_day").cast("string").alias("first_day"), "days")


@query(f"""WITH {CENTS}, s AS (SELECT project, item, round(sum(CASE WHEN kind = 'R' AND room % 4 < 2 THEN q - 500 END) / 100.0::DOUBLE, 2) AS q FROM cents GROUP BY 1, 2) SELECT project, item, CASE WHEN q > 0.0001 THEN q END AS quantity FROM s""")
def metre_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres of items by their labour lines; other units don't count, nothing is null."""
    unit = F.when(F.col("room") % 4 == 0, " M2.").when(F.col("room") % 4 == 1, "lm").when(F.col("room") % 4 == 2, "uren").otherwise("stuks")
    c = cents(spark, sf_dir).select("project", "item", unit.alias("unit"), ((F.col("q") - 500) / 100).alias("quantity"), (F.col("kind") == "R").alias("labour"))
    return workload.metre_quantity(c, ["project", "item"])

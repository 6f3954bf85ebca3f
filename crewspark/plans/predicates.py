"""Filters, unions, sets and shifts over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewspark.functions import numbers, text
from crewspark.operators import intervals, predicates
from crewspark.plans.registry import money, query, table

@query("SELECT conv_id, turn, role FROM conversations WHERE text IS NOT NULL AND length(text) >= 200")
def soft_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that aren't archived; the short ones are."""
    c = table(spark, sf_dir, "conversations").withColumn("archived_at", F.when(F.coalesce(F.length("text"), F.lit(0)) < 200, F.col("turn")))
    return predicates.archived(c, "archived_at").select("conv_id", "turn", "role")


@query("""SELECT 'open' AS stand, count(*) AS n FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' UNION ALL SELECT 'finished', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'all', count(*) FROM orders""")
def tri_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    each = [predicates.by_state(o, F.col("o_orderstatus") == "F", s).agg(F.count("*").alias("n")).select(F.lit(s).alias("stand"), "n") for s in ("open", "finished", "all")]
    return each[0].union(each[1]).union(each[2])


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1""")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three optional parameters, one of which is given."""
    o = table(spark, sf_dir, "orders")
    for column, value in (("o_orderstatus", "P"), ("o_orderpriority", None), ("o_custkey", "")):
        o = predicates.when_given(o, value, lambda v, c=column: F.col(c) == v)
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, user_id AS worker, CASE WHEN event_type = 'view' THEN user_id END AS member FROM events)
  SELECT 'member-7' AS person, event_id FROM e WHERE member = 7 UNION ALL SELECT 'worker-7', event_id FROM e WHERE worker = 7 AND member IS NULL""")
def tagged_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("worker"), F.when(F.col("event_type") == "view", F.col("user_id")).alias("member"))
    one = lambda p: predicates.by_person(e, p, "member", "worker").select(F.lit(p).alias("person"), "event_id")
    return one("member-7").union(one("worker-7"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE isodow(o_orderdate) = 3")
def weekday_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return predicates.on_weekday(o, "day", 3).select("o_orderkey", F.col("day").cast("string").alias("day"))


@query("""SELECT event_id, origin FROM (SELECT event_id, CASE WHEN event_type <> 'click' THEN event_type END AS origin FROM events) WHERE origin IS NULL OR origin <> 'view'""")
def null_or_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("origin"))
    return predicates.not_of(e, "origin", "view")


@query("""SELECT c_custkey, c_name || '@Site.example' AS mail FROM customer WHERE lower(c_name || '@Site.example') = 'customer#000000007@site.example'""")
def mail_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit("@Site.example")).alias("mail"))
    return predicates.same_mail(c, "mail", "CUSTOMER#000000007@site.Example")


@query("""WITH li AS (SELECT l_orderkey, l_linenumber, l_partkey % 40 AS row, lower(l_returnflag) AS file FROM lineitem), p AS (SELECT p_partkey % 40 AS row, CASE WHEN p_size < 17 THEN 'A' WHEN p_size < 34 THEN 'N' ELSE 'R' END AS file, count(*) AS parts FROM part GROUP BY 1, 2)
  SELECT l_orderkey, l_linenumber, parts FROM li JOIN p ON li.file || '#' || li.row = lower(p.file) || '#' || p.row""")
def composite_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines meet what belongs to a label "file#row", in any case, counted before the join."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.row_label(F.col("l_returnflag"), F.col("l_partkey") % 40).alias("label"))
    file = F.when(F.col("p_size") < 17, "A").when(F.col("p_size") < 34, "N").otherwise("R")
    p = table(spark, sf_dir, "part").groupBy(text.row_label(file, F.col("p_partkey") % 40).alias("label")).agg(F.count("*").alias("parts"))
    return li.join(p, "label").select("l_orderkey", "l_linenumber", "parts")


@query("""SELECT coalesce(CASE WHEN event_type <> 'error' THEN user_id END, 0) AS item, count(*) AS n, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1""")
def unassigned_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "error", F.col("user_id")).alias("item"), F.floor(F.col("value") * 100 + 0.5).alias("cents"))
    return predicates.with_unassigned(e, "item", F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE trim(c_mktsegment) <> ''")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.distinct_values(table(spark, sf_dir, "customer"), "c_mktsegment").select(F.col("c_mktsegment").alias("value"))


@query("""SELECT CAST(sum(CAST(floor(value * 60) AS BIGINT)) AS BIGINT) AS planned, count(DISTINCT user_id) AS people FROM events WHERE user_id IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)""")
def planned_of_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All planned time of the people of the chosen teams."""
    teams = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    people = table(spark, sf_dir, "customer").join(teams, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("user_id"))
    e = table(spark, sf_dir, "events").join(people, "user_id", "left_semi")
    return e.agg(F.sum(F.floor(F.col("value") * 60)).alias("planned"), F.countDistinct("user_id").alias("people"))


@query("""WITH a AS (SELECT * FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
  SELECT o_orderkey, 'running' AS kind FROM a UNION ALL SELECT o_orderkey, 'upcoming' FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)""")
def running_or_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    running = o.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("running").alias("kind"))
    upcoming = o.where(F.col("o_orderdate") >= "1998-01-01").select("o_orderkey", F.lit("upcoming").alias("kind"))
    return predicates.union_by_id(running, upcoming, "o_orderkey")


@query("""SELECT 'project' AS source, o_custkey AS person, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderkey AS project FROM orders UNION ALL SELECT 'internal', user_id, CAST(CAST(ts AS DATE) AS VARCHAR), NULL FROM events""")
def all_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.to_date(c).cast("string").alias("day")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), day("o_orderdate"), F.col("o_orderkey").alias("project"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("person"), day("ts"))
    return predicates.occupancy(("project", o), ("internal", e)).select("source", "person", "day", "project")


@query(r"""WITH c AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type || ' ' || p_name[1:5]), ' ') AS b FROM part), d AS (SELECT p_partkey, list_distinct(a) AS u, a, b FROM c)
  SELECT p_partkey, array_to_string(list_sort(list_filter(u, lambda x: list_contains(b, x))), ',') AS both, array_to_string(list_sort(list_filter(u, lambda x: NOT list_contains(b, x))), ',') AS alone, len(list_filter(u, lambda x: list_contains(b, x))) > 0 AS any FROM d""")
def code_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a name against those of a type and the name's beginning."""
    p = table(spark, sf_dir, "part")
    both, alone, shared = predicates.code_sets(F.split("p_name", " "), F.split(F.lower(F.concat_ws(" ", "p_type", F.substring("p_name", 1, 5))), " "))
    return p.select("p_partkey", F.array_join(F.array_sort(both), ",").alias("both"), F.array_join(F.array_sort(alone), ",").alias("alone"), shared.alias("any"))


@query("""WITH w AS (SELECT conv_id, turn, role FROM conversations), f AS (SELECT conv_id, role, min(turn) AS t FROM w GROUP BY 1, 2)
  SELECT conv_id, string_agg(role, ',' ORDER BY t, role) AS roles FROM f GROUP BY 1""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different roles of a conversation in order of their first turns: an aggregate by (conversation,
    role) first, so that what is collected is a handful of roles."""
    f = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    roles = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("t", "role"))), lambda x: x["role"]))
    return f.groupBy("conv_id").agg(F.array_join(roles, ",").alias("roles"))


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 12 AS VARCHAR) AS start, CAST(CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + 26 END AS VARCHAR) AS until FROM orders""")
def shifted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("start"), F.when(F.col("o_orderstatus") != "O", F.date_add(day, 14)).alias("until"))
    out = predicates.shifted(o, 12, "start", "until")
    return out.select("o_orderkey", F.col("start").cast("string").alias("start"), F.col("until").cast("string").alias("until"))


@query("""WITH a AS (SELECT o_custkey AS person, CAST(o_orderdate AS DATE) AS day, o_orderkey AS id, CAST((o_orderkey % 9) * 5 + 10 AS DOUBLE) / 10 AS hours FROM orders),
  b AS (SELECT *, min(id) OVER w AS target, count(*) OVER w AS n, CAST(7 + person % 3 AS DOUBLE) AS budget FROM a WINDOW w AS (PARTITION BY person, day)),
  c AS (SELECT *, hours + 1.5 AS wanted FROM b), t AS (SELECT person, day, min(CASE WHEN id <> target THEN id END) AS other, max(CASE WHEN id = target THEN hours END) AS held FROM c GROUP BY ALL),
  d AS (SELECT c.*, CASE WHEN n = 1 THEN hours WHEN id = target THEN round(held + 1.5, 1) WHEN id = other THEN round(hours - 1.5, 1) ELSE hours END AS new FROM c JOIN t USING (person, day)),
  s AS (SELECT person, day, min(new) >= -0.01 AND round(sum(new), 2) <= any_value(budget) + 0.01 AS fits FROM d GROUP BY ALL)
  SELECT d.id, CASE WHEN fits THEN new ELSE hours END AS hours_after, NOT fits AS refused FROM d JOIN s USING (person, day)""")
def day_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first activity of a person's day gets an hour and a half more."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("id"), (((F.col("o_orderkey") % 9) * 5 + 10).cast("double") / 10).alias("hours"))
    first = o.groupBy("person", "day").agg(F.min(F.struct("id", "hours")).alias("x")).select("person", "day", F.col("x.id").alias("target"), (F.col("x.hours") + 1.5).alias("wanted"))
    out = predicates.rebalanced(o.join(first, ["person", "day"]), ["person", "day"], "id", "hours", "target", "wanted", (7 + F.col("person") % 3).cast("double"))
    return out.select("id", "hours_after", "refused")


@query("""WITH a AS (SELECT l_orderkey AS project, sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS DECIMAL(12,2)) ELSE 0 END) AS items, sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS DECIMAL(12,2)) ELSE 0 END) AS areas FROM lineitem GROUP BY 1)
  SELECT project, CAST(greatest(items, areas) AS DOUBLE) AS target FROM a WHERE greatest(items, areas) > 0.0001""")
def derived_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project's quantity: the larger of what its items and its areas say."""
    part = lambda f: F.sum(F.when(F.col("l_returnflag") == f, money("l_quantity")).otherwise(0))
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("project")).agg(F.greatest(part("N"), part("A")).alias("target"))
    return a.where("target > 0.0001").select("project", F.col("target").cast("double").alias("target"))


@query("""WITH v AS (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS q, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS price FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_suppkey % 9 AS form, CASE l_suppkey % 9 WHEN 0 THEN price WHEN 1 THEN q WHEN 2 THEN q WHEN 3 THEN -(q + 0.5) WHEN 4 THEN q WHEN 5 THEN price WHEN 6 THEN (q % 1000) * 1000 + 250 WHEN 7 THEN q * 1000 + 125 END AS value FROM v""")
def written_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written forms of numbers, as people and sheets write them: "1.234,50 m2", "€ 1,234,567", "12 stuks",
    "-12,5", "Vloer 12", "1234.50", "5.250", "12,125", "n.v.t."."""
    price, q = money("l_extendedprice"), F.floor("l_extendedprice")
    s = lambda c: c.cast("string")
    forms = [
        F.concat(numbers.european(price), F.lit(" m2")), F.concat(F.lit("€ "), F.when(q < 1000, s(q)).otherwise(F.format_number(q, 0)), F.lit(" euro")),
        F.concat(s(q), F.lit(" stuks")), F.concat(F.lit("-"), s(q), F.lit(",5")), F.concat(F.lit("Vloer "), s(q)), s(price),
        F.concat(s(q % 1000), F.lit(".250")), F.concat(s(q), F.lit(",125 lm")), F.lit("n.v.t."),
    ]
    form = F.col("l_suppkey") % 9
    own = F.element_at(F.array(*forms), (form + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", form.alias("form"), numbers.parse_number(own).cast("double").alias("value"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS n, p_partkey % 8 AS form FROM part)
  SELECT id, CASE form WHEN 0 THEN 'verdieping ' || n WHEN 1 THEN 'verdieping ' || n WHEN 2 THEN 'begane grond' WHEN 3 THEN 'fase 2 verdieping ' || n WHEN 4 THEN 'kelder' WHEN 5 THEN 'fase 1 souterrain' WHEN 6 THEN 'tussenlaag' END AS label,
    CASE form WHEN 0 THEN 'verdieping ' || n WHEN 1 THEN 'verdieping ' || n WHEN 2 THEN 'begane grond' WHEN 3 THEN 'verdieping ' || n WHEN 4 THEN 'kelder' WHEN 5 THEN 'kelder' WHEN 6 THEN 'tussenlaag' ELSE 'dak ' || n END AS base FROM p""")
def floor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    forms = [
        F.concat(F.lit(" Verdieping "), n), F.concat(n, F.lit("e verdieping")), F.lit("Begane grond sporthal"), F.concat(F.lit("Fase 2 verdieping "), n),
        F.lit("Kelder"), F.lit("fase 1 Souterrain"), F.lit("middenlaag"), F.concat(F.lit("Dak "), n),
    ]
    own = F.element_at(F.array(*forms), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.floor_label(own).alias("label"), text.floor_base(own).alias("base"))


@query("""WITH e AS (SELECT event_id AS id, epoch(date_trunc('day', ts))::BIGINT // 86400 - 9000 AS d, user_id % 50 AS k FROM events),
  o AS (SELECT o_orderkey AS id, epoch(date_trunc('day', o_orderdate))::BIGINT // 86400 AS d, o_custkey % 50 AS k FROM orders)
  SELECT e.k AS worker, count(*) AS overlaps, CAST(sum(least(e.d + 40, o.d + 30) - greatest(e.d, o.d)) AS BIGINT) AS days FROM e JOIN o ON e.k = o.k AND e.d < o.d + 30 AND o.d < e.d + 40 GROUP BY 1""")
def overlap_totals_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals by pairs, for ranges short enough to make them."""
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("worker"), F.col("event_id").alias("id"), (day("ts") - 9000).alias("s")).withColumn("e", F.col("s") + 40)
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("worker"), F.col("o_orderkey").alias("id"), day("o_orderdate").alias("s")).withColumn("e", F.col("s") + 30)
    p = intervals.overlap_pairs(e, o, ["worker"], 40)
    return p.groupBy("worker").agg(F.count("*").alias("overlaps"), F.sum(F.least("e_a", "e_b") - F.greatest("s_a", "s_b")).alias("days"))



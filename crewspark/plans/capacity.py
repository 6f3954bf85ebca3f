"""Planning rules: bookings, absences, free people, edits of ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewspark.functions import calendar as cal
from crewspark.operators import intervals, sequences
from crewspark.plans.registry import ENTRIES, entries, query, table


def text(c: str):
    return F.col(c).cast("string").alias(c)


def week_of(c: str):
    return (cal.iso_year(F.col(c)) * 100 + cal.iso_week(F.col(c))).cast("bigint").alias("week")


@query(f"""WITH {ENTRIES}, moves AS (SELECT person, day, pos, sum(d) AS d FROM (
    SELECT person, day, s AS pos, 1 AS d FROM entries WHERE e > s UNION ALL SELECT person, day, e, -1 FROM entries WHERE e > s) GROUP BY ALL),
  seg AS (SELECT person, day, pos, lead(pos) OVER w AS until, sum(d) OVER w AS present FROM moves WINDOW w AS (PARTITION BY person, day ORDER BY pos))
  SELECT person, CAST(day AS VARCHAR) AS day, CAST(sum(until - pos) AS BIGINT) AS double_seconds, CAST(max(present) AS BIGINT) AS bookings
  FROM seg WHERE until IS NOT NULL AND present > 1 GROUP BY person, seg.day""")
def double_booked(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = intervals.over_capacity(entries(spark, sf_dir), ["person", "day"], "s", "e", 1)
    return o.select("person", text("day"), F.col("over_length").cast("bigint").alias("double_seconds"), F.col("peak").cast("bigint").alias("bookings"))


@query(f"""WITH {ENTRIES} SELECT person, CAST(day AS VARCHAR) AS day, arg_min(id, s * 100000000 + id) AS id, min(s) AS s, count(*) AS n
  FROM entries WHERE s < 43200 AND e > 36000 GROUP BY person, entries.day""")
def first_busy_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry that stands in the way of a proposal from 10:00 to 12:00."""
    busy = entries(spark, sf_dir).where(intervals.overlap(F.col("s"), F.col("e"), F.lit(36000), F.lit(43200)))
    return busy.groupBy("person", "day").agg(F.min_by("id", F.struct("s", "id")).alias("id"), F.min("s").alias("s"), F.count("*").alias("n")).select("person", text("day"), "id", "s", "n")


ABSENCES = """absences AS (SELECT o_custkey AS person, o_orderkey AS id, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER) AS b,
  CASE WHEN o_orderkey % 3 = 0 THEN 'morning' ELSE 'day' END AS slot FROM orders WHERE o_orderstatus <> 'O')"""


def absences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absence windows: orders that aren't open, of a customer, for up to nine days."""
    a = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(
        F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("id"), a.alias("a"),
        F.date_add(a, (F.col("o_orderkey") % 9).cast("int")).alias("b"), F.when(F.col("o_orderkey") % 3 == 0, "morning").otherwise("day").alias("slot"),
    )


@query(f"""WITH {ABSENCES}, d AS (SELECT person, slot, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM absences)
  SELECT person, substr(CAST(day AS VARCHAR), 1, 7) AS month, count(DISTINCT day) AS days, CAST(sum(CASE slot WHEN 'morning' THEN 4 ELSE 8 END) AS BIGINT) AS hours
  FROM (SELECT person, day, min(slot) AS slot FROM d WHERE isodow(day) < 6 GROUP BY 1, 2) GROUP BY person, month""")
def absence_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of absence by work day; a whole day goes before a half one of the same date."""
    days = absences(spark, sf_dir).select("person", "slot", F.explode(cal.workdays(F.col("a"), F.col("b"))).alias("day"))
    each = days.groupBy("person", "day").agg(F.min("slot").alias("slot"))
    hours = F.when(F.col("slot") == "morning", 4).otherwise(8)
    return each.groupBy("person", F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("days"), F.sum(hours).cast("bigint").alias("hours"))


@query(f"""WITH {ENTRIES}, w AS (SELECT DISTINCT person, day + k AS day FROM entries, (SELECT unnest([0, 1, 2]) AS k) WHERE status = 'error')
  SELECT e.person, CAST(e.day AS VARCHAR) AS day, count(*) AS entries, CAST(sum(e.e - e.s) AS BIGINT) AS seconds
  FROM entries e JOIN w ON e.person = w.person AND e.day = w.day WHERE e.status = 'purchase' GROUP BY e.person, e.day""")
def leave_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved entries inside a leave of three days from each rejected one."""
    e = entries(spark, sf_dir)
    leave = e.where("status = 'error'").select("person", F.explode(F.sequence("day", F.date_add("day", 2))).alias("day")).distinct()
    hit = e.where("status = 'purchase'").join(leave, ["person", "day"])
    return hit.groupBy("person", "day").agg(F.count("*").alias("entries"), F.sum(F.col("e") - F.col("s")).alias("seconds")).select("person", text("day"), "entries", "seconds")


@query(f"""WITH {ENTRIES}, d AS (SELECT person, isoyear(day) * 100 + weekofyear(day) AS week, day, bool_or(status = 'purchase') AS ok, sum(cents) AS planned,
    coalesce(sum(cents) FILTER (WHERE status = 'purchase'), 0) AS approved FROM entries WHERE isodow(day) < 6 GROUP BY ALL)
  SELECT person, week, bool_and(ok) AS covered, CAST(CASE WHEN bool_and(ok) THEN sum(approved) ELSE sum(planned) END AS BIGINT) AS cents FROM d GROUP BY 1, 2""")
def approved_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved hours replace planned ones only where every work day of the week has some."""
    ok = F.col("status") == "purchase"
    e = entries(spark, sf_dir).where(cal.is_workday(F.col("day")))
    days = e.groupBy("person", week_of("day"), "day").agg(F.bool_or(ok).alias("ok"), F.sum("cents").alias("planned"), F.sum(F.when(ok, F.col("cents")).otherwise(0)).alias("approved"))
    return days.groupBy("person", "week").agg(F.bool_and("ok").alias("covered"), F.when(F.bool_and("ok"), F.sum("approved")).otherwise(F.sum("planned")).cast("bigint").alias("cents"))


@query(f"""WITH {ENTRIES}, e AS (SELECT *, isoyear(day) * 100 + weekofyear(day) AS week FROM entries), w AS (SELECT week, count(DISTINCT person) AS people FROM e GROUP BY 1),
  d AS (SELECT week, day, count(DISTINCT person) FILTER (WHERE s < 39600 AND e > 32400) AS busy, count(DISTINCT person) FILTER (WHERE status = 'error') AS away,
    count(DISTINCT person) FILTER (WHERE status = 'error' OR (s < 39600 AND e > 32400)) AS taken FROM e GROUP BY 1, 2)
  SELECT CAST(d.day AS VARCHAR) AS day, busy, away, people - taken AS free FROM d JOIN w USING (week)""")
def fit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of the week that are neither busy from 9:00 to 11:00 nor away on a day."""
    e = entries(spark, sf_dir).withColumn("week", week_of("day"))
    busy, away = intervals.overlap(F.col("s"), F.col("e"), F.lit(32400), F.lit(39600)), F.col("status") == "error"
    each = e.groupBy("week", "day", "person").agg(F.max(busy).alias("busy"), F.max(away).alias("away"))
    days = each.groupBy("week", "day").agg(F.count_if("busy").alias("busy"), F.count_if("away").alias("away"), F.count_if(F.col("busy") | F.col("away")).alias("taken"))
    people = each.groupBy("week").agg(F.countDistinct("person").alias("people"))
    return days.join(people, "week").select(text("day"), "busy", "away", (F.col("people") - F.col("taken")).alias("free"))


@query(f"""WITH {ENTRIES} SELECT status, count(*) FILTER (WHERE cents % 25 = 0) AS valid, count(*) FILTER (WHERE cents % 25 <> 0) AS off_grid,
  CAST(sum(cents - (cents + 12) // 25 * 25) AS BIGINT) AS difference FROM entries GROUP BY 1""")
def quarter_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundredths of hours on the grid of quarters, and what rounding to it would change."""
    on, snapped = F.col("cents") % 25 == 0, F.floor((F.col("cents") + 12) / 25) * 25
    return entries(spark, sf_dir).groupBy("status").agg(F.count_if(on).alias("valid"), F.count_if(~on).alias("off_grid"), F.sum(F.col("cents") - snapped).cast("bigint").alias("difference"))


@query(f"""WITH {ENTRIES}, m AS (SELECT *, CASE WHEN status = lag(status) OVER w THEN 0 ELSE 1 END AS new FROM entries WINDOW w AS (PARTITION BY person, day ORDER BY s, id)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY person, day ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS run FROM m)
  SELECT person, CAST(day AS VARCHAR) AS day, CAST(run AS BIGINT) AS run, min(status) AS status, min(s) AS s, max(e) AS e, count(*) AS jobs FROM r GROUP BY person, r.day, run""")
def adjacent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive jobs of one kind as one."""
    w = Window.partitionBy("person", "day").orderBy("s", "id")
    new = F.when(F.col("status") == F.lag("status").over(w), 0).otherwise(1)
    runs = entries(spark, sf_dir).withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("person", "day", "run").agg(F.min("status").alias("status"), F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("jobs"))
    return out.withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {ENTRIES}, f AS (SELECT day, status, person, min(s * 100000000 + id) AS pos FROM entries GROUP BY 1, 2, 3)
  SELECT CAST(day AS VARCHAR) AS day, status, string_agg(CAST(person AS VARCHAR), ',' ORDER BY pos) AS people, count(*) AS n FROM f GROUP BY f.day, status""")
def absence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each day and kind, its people in order of appearance."""
    first = entries(spark, sf_dir).groupBy("day", "status", "person").agg(F.min(F.struct("s", "id")).alias("pos"))
    people = F.transform(F.array_sort(F.collect_list(F.struct("pos", "person"))), lambda x: x["person"].cast("string"))
    return first.groupBy("day", "status").agg(F.array_join(people, ",").alias("people"), F.count("*").alias("n")).select(text("day"), "status", "people", "n")


@query(f"""WITH {ENTRIES}, w AS (SELECT *, e - s AS len, sum(e - s) OVER (PARTITION BY person, day) AS total,
    coalesce(sum(e - s) OVER (PARTITION BY person, day ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM entries WHERE e > s)
  SELECT id, CAST((before * 10000 + total // 2) // total AS BIGINT) AS left_edge, CAST((len * 10000 + total // 2) // total AS BIGINT) AS width FROM w""")
def share_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each entry lies in its day's total, in ten-thousandths."""
    day = Window.partitionBy("person", "day")
    before = F.coalesce(F.sum("len").over(day.orderBy("s", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = entries(spark, sf_dir).where("e > s").withColumn("len", F.col("e") - F.col("s")).withColumns({"total": F.sum("len").over(day), "before": before})
    part = lambda c: F.expr(f"({c} * 10000 + total div 2) div total").cast("bigint")
    return e.select("id", part("before").alias("left_edge"), part("len").alias("width"))


@query(f"""WITH {ENTRIES} SELECT CAST(day AS VARCHAR) AS day, s // 3600 AS from_hour, e // 3600 AS to_hour, count(*) AS people, min(id) AS first_id FROM entries GROUP BY entries.day, 2, 3""")
def equal_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's crew in groups of equal clock hours."""
    hour = lambda c: F.expr(f"{c} div 3600").cast("bigint")
    out = entries(spark, sf_dir).groupBy("day", hour("s").alias("from_hour"), hour("e").alias("to_hour")).agg(F.count("*").alias("people"), F.min("id").alias("first_id"))
    return out.withColumn("day", F.col("day").cast("string"))


@query("""WITH r AS (SELECT o_orderkey AS project, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INTEGER) AS b FROM orders),
  d AS (SELECT project, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM r), k AS (SELECT * FROM d WHERE isodow(day) <> 3),
  i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY project ORDER BY day) AS INTEGER) AS run FROM k)
  SELECT project, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS days FROM i GROUP BY project, run""")
def removed_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of up to a week without their Wednesday: gone, shorter, or in two."""
    a = F.to_date("o_orderdate")
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project"), a.alias("a"), F.date_add(a, (F.col("o_orderkey") % 7).cast("int")).alias("b"))
    out = sequences.without_day(r, ["project"], "a", "b", F.date_add(cal.monday(F.col("a")), F.when(F.weekday("a") > 2, 9).otherwise(2)))
    return out.select("project", text("first_day"), text("last_day"), "days")


@query(f"""WITH {ENTRIES}, p AS (SELECT person, min(day) AS a, max(day) AS b FROM entries GROUP BY 1), c AS (SELECT person, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM p),
  f AS (SELECT * FROM c WHERE isodow(day) < 7 AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.person = c.person AND e.day = c.day)),
  i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY person ORDER BY day) AS INTEGER) AS run FROM f)
  SELECT person, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS days FROM i GROUP BY person, run""")
def open_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of days without an entry between a person's first and last one, no Sundays."""
    e = entries(spark, sf_dir)
    span = e.groupBy("person").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select("person", F.explode(cal.workdays(F.col("a"), F.col("b"), saturday=True)).alias("day"))
    free = days.join(e.select("person", "day").distinct(), ["person", "day"], "left_anti")
    return sequences.date_runs(free, ["person"], "day").select("person", text("first_day"), text("last_day"), "days")


@query(f"""WITH {ENTRIES}, m AS (SELECT person, day, id, s // 600 AS s, e // 600 AS e FROM entries)
  SELECT a.id AS id, count(*) AS neighbours, min(b.id) AS first_neighbour FROM m a JOIN m b ON a.person = b.person AND a.day = b.day AND a.e = b.s AND a.id <> b.id GROUP BY 1""")
def touching_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one person that begin where another ends, by marks of ten minutes."""
    mark = lambda c: F.expr(f"{c} div 600")
    e = entries(spark, sf_dir)
    a = e.select("person", "day", "id", mark("e").alias("at"))
    b = e.select("person", "day", F.col("id").alias("other"), mark("s").alias("at"))
    met = a.join(b, ["person", "day", "at"]).where("id <> other")
    return met.groupBy("id").agg(F.count("*").alias("neighbours"), F.min("other").alias("first_neighbour"))


@query(f"""WITH {ENTRIES}, b AS (SELECT person, day, min(s) AS s, max(e) AS e, sum(e - s) AS work FROM entries GROUP BY ALL)
  SELECT person, CAST(day AS VARCHAR) AS day, CAST(greatest(0, (e - s) // 60 - 30) AS BIGINT) AS net_minutes, CAST(least(8, greatest(2, (work // 3600 + 1) // 2 * 2)) AS BIGINT) AS snapped FROM b""")
def net_day_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's day from the first to the last clock less half an hour, and its work on the grid of
    two hours."""
    b = entries(spark, sf_dir).groupBy("person", "day").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum(F.col("e") - F.col("s")).alias("work"))
    net = F.greatest(F.lit(0), F.expr("(e - s) div 60 - 30")).cast("bigint")
    return b.select("person", text("day"), net.alias("net_minutes"), cal.snap_hours(F.expr("work div 3600")).cast("bigint").alias("snapped"))


@query(f"""WITH {ENTRIES} SELECT person, max_by(status, day::VARCHAR || lpad(CAST(s * 100000000 + id AS VARCHAR), 14, '0')) AS status, CAST(max(day) AS VARCHAR) AS day, count(*) AS changes FROM entries GROUP BY 1""")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each person from an append-only history."""
    out = entries(spark, sf_dir).groupBy("person").agg(F.max_by("status", F.struct("day", "s", "id")).alias("status"), F.max("day").alias("day"), F.count("*").alias("changes"))
    return out.select("person", "status", text("day"), "changes")


@query("""SELECT o_orderkey, datediff('day', DATE '1998-08-02', CAST(o_orderdate AS DATE)) AS days_left,
  CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN CAST(o_orderdate AS DATE) < DATE '1998-08-02' THEN 'overdue' WHEN CAST(o_orderdate AS DATE) <= DATE '1998-08-04' THEN 'behind' ELSE 'on time' END AS label FROM orders""")
def due_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.datediff(F.to_date("o_orderdate"), F.lit("1998-08-02").cast("date")).cast("bigint")
    label = F.when(F.col("o_orderstatus") == "F", "done").when(left < 0, "overdue").when(left <= 2, "behind").otherwise("on time")
    return table(spark, sf_dir, "orders").select("o_orderkey", left.alias("days_left"), label.alias("label"))

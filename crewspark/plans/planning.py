"""Planning: hours, weeks, work days, intervals, capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewspark.functions import calendar as cal
from crewspark.operators import intervals, matching, sequences
from crewspark.plans.registry import ENTRIES, entries, query, table


@query(f"""WITH {ENTRIES} SELECT isoyear(day) * 100 + weekofyear(day) AS week, count(*) AS n,
  CAST(sum(cents) AS DOUBLE) / 100 AS submitted,
  CAST(coalesce(sum(cents) FILTER (WHERE status = 'purchase'), 0) AS DOUBLE) / 100 AS approved,
  CAST(sum(cents) - coalesce(sum(cents) FILTER (WHERE status = 'purchase'), 0) AS DOUBLE) / 100 AS difference
  FROM entries GROUP BY 1""")
def hours_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    approved = F.sum(F.when(F.col("status") == "purchase", F.col("cents")).otherwise(0))
    out = e.groupBy((cal.iso_year(F.col("day")) * 100 + cal.iso_week(F.col("day"))).cast("bigint").alias("week")).agg(F.count("*").alias("n"), F.sum("cents").alias("s"), approved.alias("a"))
    return out.select("week", "n", (F.col("s") / 100).alias("submitted"), (F.col("a") / 100).alias("approved"), ((F.col("s") - F.col("a")) / 100).alias("difference"))


@query(f"""WITH {ENTRIES} SELECT id, person, CAST(day AS VARCHAR) AS day, status, cents FROM entries
  ORDER BY entries.day DESC, id DESC LIMIT 50""")
def hours_overview_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = entries(spark, sf_dir).orderBy(F.desc("day"), F.desc("id")).limit(50)
    return page.select("id", "person", F.col("day").cast("string").alias("day"), "status", "cents")


@query("""SELECT o_orderkey, c_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE contains(lower(c_name), '00001') OR contains(lower(c_mktsegment), 'auto') OR contains(lower(o_orderpriority), 'urgent')""")
def project_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    hit = F.contains(F.lower("c_name"), F.lit("00001")) | F.contains(F.lower("c_mktsegment"), F.lit("auto")) | F.contains(F.lower("o_orderpriority"), F.lit("urgent"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).where(hit).select("o_orderkey", "c_name", "o_orderstatus")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 40)""")
def active_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O' AND l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def unmanned_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders
  WHERE isoyear(o_orderdate) = 1996 AND weekofyear(o_orderdate) = 10""")
def iso_week_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range on the column itself, so that it reaches the scan; a week that isn't gives no rows."""
    first = cal.monday_of(F.lit(1996), F.lit(10))
    o = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < F.date_add(first, 7)))
    return o.select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


@query("""SELECT isoyear(d) AS iso_year, weekofyear(d) AS iso_week, count(*) AS projects,
  CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day,
  array_to_string(list_sort(list(DISTINCT lpad(CAST(month(d) AS VARCHAR), 2, '0'))), ',') AS months
  FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY 1, 2""")
def week_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    months = F.array_join(F.array_sort(F.collect_set(F.lpad(F.month(d).cast("string"), 2, "0"))), ",")
    return days.groupBy(cal.iso_year(d).cast("bigint").alias("iso_year"), cal.iso_week(d).cast("bigint").alias("iso_week")).agg(
        F.count("*").alias("projects"), F.min(d).cast("string").alias("first_day"), F.max(d).cast("string").alias("last_day"), months.alias("months")
    )


@query("""SELECT CAST(day AS VARCHAR) AS day, count(*) AS projects FROM (
  SELECT unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 9, INTERVAL 1 DAY))::DATE AS day FROM orders)
  WHERE isodow(day) < 6 GROUP BY 1""")
def workday_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.to_date("o_orderdate")
    days = table(spark, sf_dir, "orders").select(F.explode(cal.workdays(start, F.date_add(start, 9))).alias("day"))
    return days.groupBy("day").agg(F.count("*").alias("projects")).select(F.col("day").cast("string").alias("day"), "projects")


@query("""SELECT o_orderkey, count(*) AS days,
  CAST(sum(960 - CASE WHEN day = lo THEN 90 ELSE 0 END - CASE WHEN day = hi THEN 120 ELSE 0 END - 480) AS BIGINT) AS minutes
  FROM (SELECT *, min(day) OVER (PARTITION BY o_orderkey) AS lo, max(day) OVER (PARTITION BY o_orderkey) AS hi FROM (
    SELECT o_orderkey, unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 12 AS INTEGER), INTERVAL 1 DAY))::DATE AS day FROM orders)
    WHERE isodow(day) < 6) GROUP BY 1""")
def interval_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of ranges whose days run from 8:00 to 16:00; the first work day begins at 9:30, the
    last ends at 14:00.  All in one row: the days are an array, not rows."""
    start = F.to_date("o_orderdate")
    days = cal.workdays(start, F.date_add(start, F.pmod("o_orderkey", F.lit(12)).cast("int")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.size(days).cast("bigint").alias("days")).where("days > 0")
    return o.withColumn("minutes", F.col("days") * 480 - 90 - 120)


@query(f"""WITH {ENTRIES}, c AS (SELECT *, greatest(0, e - greatest(s, coalesce(max(e) OVER (PARTITION BY person, day ORDER BY s, e, CAST(id AS VARCHAR)
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s))) AS claim FROM entries)
  SELECT person, CAST(day AS VARCHAR) AS day, count(*) AS n, CAST((sum(claim) * 100 + 1800) // 3600 AS BIGINT) AS claimed_hundredths,
  CAST(sum(CASE WHEN claim < e - s THEN 1 ELSE 0 END) AS BIGINT) AS shortened FROM c GROUP BY person, c.day""")
def claimed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = intervals.claimed(entries(spark, sf_dir), ["person", "day"], "s", "e", "id", "claim")
    out = c.groupBy("person", "day").agg(F.count("*").alias("n"), F.sum("claim").alias("t"), F.sum(F.when(F.col("claim") < F.col("e") - F.col("s"), 1).otherwise(0)).alias("shortened"))
    return out.select("person", F.col("day").cast("string").alias("day"), "n", cal.hundredths_of_hours(F.col("t")).alias("claimed_hundredths"), "shortened")


@query(f"""WITH {ENTRIES}, i AS (SELECT *, sum(CASE WHEN s > b THEN 1 ELSE 0 END) OVER (PARTITION BY person, day ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, max(e) OVER (PARTITION BY person, day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM entries)),
  m AS (SELECT person, day, island, max(e) - min(s) AS len FROM i GROUP BY ALL)
  SELECT person, CAST(day AS VARCHAR) AS day, count(*) AS blocks, CAST((sum(len) * 100 + 1800) // 3600 AS BIGINT) AS unique_hundredths FROM m GROUP BY person, m.day""")
def unique_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = intervals.merged(entries(spark, sf_dir), ["person", "day"], "s", "e")
    out = m.groupBy("person", "day").agg(F.count("*").alias("blocks"), F.sum(F.col("e") - F.col("s")).alias("t"))
    return out.select("person", F.col("day").cast("string").alias("day"), "blocks", cal.hundredths_of_hours(F.col("t")).alias("unique_hundredths"))


SWEEP = f"""WITH {ENTRIES}, moves AS (SELECT status, day, pos, sum(d) AS d FROM (
    SELECT status, day, s AS pos, 1 AS d FROM entries WHERE e > s UNION ALL SELECT status, day, e, -1 FROM entries WHERE e > s) GROUP BY ALL),
  seg AS (SELECT status, day, pos, lead(pos) OVER w AS until, sum(d) OVER w AS present FROM moves WINDOW w AS (PARTITION BY status, day ORDER BY pos))"""


@query(f"""{SWEEP} SELECT status, CAST(day AS VARCHAR) AS day, CAST(max(present) AS BIGINT) AS peak FROM seg WHERE until IS NOT NULL GROUP BY status, seg.day""")
def peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = intervals.peak(entries(spark, sf_dir), ["status", "day"], "s", "e")
    return p.select("status", F.col("day").cast("string").alias("day"), F.col("peak").cast("bigint").alias("peak"))


@query(f"""{SWEEP} SELECT status, CAST(day AS VARCHAR) AS day, CAST(sum(until - pos) AS BIGINT) AS over_seconds, count(*) AS segments, CAST(max(present) AS BIGINT) AS peak
  FROM seg WHERE until IS NOT NULL AND present > 2 GROUP BY status, seg.day""")
def over_capacity_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = intervals.over_capacity(entries(spark, sf_dir), ["status", "day"], "s", "e", 2)
    return o.select("status", F.col("day").cast("string").alias("day"), F.col("over_length").cast("bigint").alias("over_seconds"), "segments", F.col("peak").cast("bigint").alias("peak"))


@query(f"""WITH {ENTRIES} SELECT a.person, CAST(a.day AS VARCHAR) AS day, a.id AS id_a, b.id AS id_b, least(a.e, b.e) - greatest(a.s, b.s) AS common_seconds
  FROM entries a JOIN entries b ON a.person = b.person AND a.day = b.day AND a.id < b.id AND a.s < b.e AND b.s < a.e""")
def pair_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = intervals.self_overlaps(entries(spark, sf_dir), ["person", "day"], 3600)
    return p.select("person", F.col("day").cast("string").alias("day"), "id_a", "id_b", (F.least("e_a", "e_b") - F.greatest("s_a", "s_b")).alias("common_seconds"))


@query("""WITH e AS (SELECT event_id AS id, epoch(date_trunc('day', ts))::BIGINT // 86400 AS d, user_id AS k FROM events),
  o AS (SELECT o_orderkey AS id, epoch(date_trunc('day', o_orderdate))::BIGINT // 86400 AS d, o_custkey AS k FROM orders)
  SELECT a.k AS worker, count(*) AS overlaps, CAST(sum(least(a.d + 400, b.d + 30) - greatest(a.d, b.d)) AS BIGINT) AS days
  FROM (SELECT id, d - 9000 AS d, k % 50 AS k FROM e) a JOIN (SELECT id, d, k % 50 AS k FROM o) b ON a.k = b.k AND a.d < b.d + 30 AND b.d < a.d + 400 GROUP BY 1""")
def range_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("worker"), F.col("event_id").alias("id"), (day("ts") - 9000).alias("s")).withColumn("e", F.col("s") + 400)
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("worker"), F.col("o_orderkey").alias("id"), day("o_orderdate").alias("s")).withColumn("e", F.col("s") + 30)
    return intervals.overlap_totals(e, o, ["worker"]).withColumnRenamed("length", "days")


@query(f"""WITH {ENTRIES}, d AS (SELECT DISTINCT person, day FROM entries),
  r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY person ORDER BY day) AS INTEGER) AS run FROM d)
  SELECT person, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS days FROM r GROUP BY person, run""")
def contiguous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sequences.date_runs(entries(spark, sf_dir), ["person"], "day")
    return r.select("person", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "days")


@query(f"""WITH RECURSIVE {ENTRIES}, b AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY s, e, id) AS rn FROM entries),
  r AS (SELECT day, id, s, e, rn, CAST(0 AS BIGINT) AS lane, [e] AS ends FROM b WHERE rn = 1
    UNION ALL SELECT day, id, s, e, rn, lane, list_concat(list_concat(ends[1:lane], [e]), ends[lane + 2:]) FROM (
      SELECT b.day, b.id, b.s, b.e, b.rn, r.ends, CAST(coalesce(nullif(list_position(list_transform(r.ends, lambda x: x < b.s), true), 0) - 1, len(r.ends)) AS BIGINT) AS lane FROM r JOIN b ON b.day = r.day AND b.rn = r.rn + 1))
  SELECT CAST(day AS VARCHAR) AS day, id, s, e, lane FROM r""")
def lane_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = entries(spark, sf_dir).select("day", "id", "s", "e")
    return sequences.lanes(bars.withColumn("day", F.col("day").cast("string")), ["day"], "s", "e", "id")


@query(f"""WITH {ENTRIES}, p AS (SELECT DISTINCT day, person FROM entries), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY person) AS rn FROM p)
  SELECT CAST(day AS VARCHAR) AS day, person, CAST(least(8, greatest(0, 20 - 8 * (rn - 1))) AS BIGINT) AS dealt FROM r""")
def pool_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = entries(spark, sf_dir).select("day", "person").distinct()
    d = sequences.pool_shares(present, ["day"], ["person"], 20)
    return d.select(F.col("day").cast("string").alias("day"), "person", F.col("dealt").cast("bigint").alias("dealt"))


@query(f"""WITH {ENTRIES} SELECT person, isoyear(day) * 100 + weekofyear(day) AS week,
  CAST(coalesce(sum(cents) FILTER (WHERE status = 'purchase'), 0) AS BIGINT) AS approved, CAST(coalesce(sum(cents) FILTER (WHERE status = 'error'), 0) AS BIGINT) AS rejected,
  CAST(coalesce(sum(cents) FILTER (WHERE status NOT IN ('purchase', 'error')), 0) AS BIGINT) AS pending, count(DISTINCT day) AS days,
  CASE WHEN bool_and(status = 'purchase') THEN 'approved' WHEN bool_or(status NOT IN ('purchase', 'error')) THEN 'submitted' WHEN bool_and(status = 'error') THEN 'rejected' ELSE 'submitted' END AS state
  FROM entries GROUP BY 1, 2""")
def week_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    st, c = F.col("status"), F.col("cents")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0)).cast("bigint")
    open_ = ~st.isin("purchase", "error")
    state = F.when(F.bool_and(st == "purchase"), "approved").when(F.bool_or(open_), "submitted").when(F.bool_and(st == "error"), "rejected").otherwise("submitted")
    week = (cal.iso_year(F.col("day")) * 100 + cal.iso_week(F.col("day"))).cast("bigint").alias("week")
    return entries(spark, sf_dir).groupBy("person", week).agg(
        total(st == "purchase").alias("approved"), total(st == "error").alias("rejected"), total(open_).alias("pending"), F.countDistinct("day").alias("days"), state.alias("state")
    )


@query(f"""WITH {ENTRIES}, p AS (SELECT person, day, least(28800, sum(e - s)) AS t FROM entries GROUP BY ALL)
  SELECT CAST(day AS VARCHAR) AS day, count(*) AS heads, CAST(sum(t) AS BIGINT) AS planned_seconds, CAST(greatest(0, count(*) * 28800 - sum(t)) AS BIGINT) AS free_seconds FROM p GROUP BY p.day""")
def mandays(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = entries(spark, sf_dir).groupBy("person", "day").agg(F.least(F.lit(28800), F.sum(F.col("e") - F.col("s"))).alias("t"))
    out = each.groupBy("day").agg(F.count("*").alias("heads"), F.sum("t").cast("bigint").alias("planned_seconds"))
    return out.select(F.col("day").cast("string").alias("day"), "heads", "planned_seconds", F.greatest(F.lit(0), F.col("heads") * 28800 - F.col("planned_seconds")).cast("bigint").alias("free_seconds"))


@query(f"""WITH {ENTRIES} SELECT CAST(day AS VARCHAR) AS day, count(DISTINCT person) AS people, count(*) AS bars FROM entries GROUP BY entries.day""")
def daily_headcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = entries(spark, sf_dir).groupBy("day").agg(F.countDistinct("person").alias("people"), F.count("*").alias("bars"))
    return out.withColumn("day", F.col("day").cast("string"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 20 AS b FROM orders)
  SELECT CAST(w AS VARCHAR) AS week, count(*) AS projects, CAST(sum(greatest(0, datediff('day', greatest(a, w), least(b, w + 6)) + 1)) AS BIGINT) AS days
  FROM (SELECT *, unnest([CAST(date_trunc('week', a) AS DATE), CAST(date_trunc('week', a) AS DATE) + 7, CAST(date_trunc('week', a) AS DATE) + 14, CAST(date_trunc('week', a) AS DATE) + 21]) AS w FROM o)
  WHERE w <= b GROUP BY w""")
def prorated_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of three-week projects in each ISO week; a project's weeks come from its own dates."""
    a = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select(a.alias("a"), F.date_add(a, 20).alias("b"))
    weeks = F.sequence(cal.monday(F.col("a")), cal.monday(F.col("b")), F.expr("INTERVAL 7 DAYS"))
    w = o.select("a", "b", F.explode(weeks).alias("w"))
    days = F.datediff(F.least("b", F.date_add("w", 6)), F.greatest("a", "w")) + 1
    return w.groupBy("w").agg(F.count("*").alias("projects"), F.sum(F.greatest(F.lit(0), days)).alias("days")).select(F.col("w").cast("string").alias("week"), "projects", "days")


@query(f"""WITH {ENTRIES} SELECT person, CAST(day AS VARCHAR) AS day,
  CASE WHEN bool_and(status = 'purchase') THEN 'approved' WHEN bool_or(status IN ('view', 'click', 'signup')) THEN 'submitted' WHEN bool_and(status = 'error') THEN 'rejected' ELSE 'submitted' END AS state,
  max_by(status, s * 100000000 + id) AS last_status FROM entries GROUP BY person, entries.day""")
def status_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = F.col("status")
    state = F.when(F.bool_and(st == "purchase"), "approved").when(F.bool_or(st.isin("view", "click", "signup")), "submitted").when(F.bool_and(st == "error"), "rejected").otherwise("submitted")
    out = entries(spark, sf_dir).groupBy("person", "day").agg(state.alias("state"), F.max_by(st, F.struct("s", "id")).alias("last_status"))
    return out.withColumn("day", F.col("day").cast("string"))


@query("""SELECT substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 4) AS year, 'P' || substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 4) || '-' || lpad(CAST(max(o_orderkey) + 1 AS VARCHAR), 8, '0') AS next_number FROM orders GROUP BY 1""")
def next_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.date_format("o_orderdate", "yyyy")
    out = table(spark, sf_dir, "orders").groupBy(year.alias("year")).agg(F.max("o_orderkey").alias("m"))
    return out.select("year", F.concat(F.lit("P"), "year", F.lit("-"), F.lpad((F.col("m") + 1).cast("string"), 8, "0")).alias("next_number"))


@query("""SELECT o_orderkey, bucket, row_number() OVER (PARTITION BY bucket ORDER BY d, o_orderstatus, o_orderkey) AS position FROM (
  SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderdate IS NULL THEN 3 WHEN o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' THEN 0 WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 1 ELSE 2 END AS bucket FROM orders)""")
def sort_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the window, later, earlier, undated; then by date, kind and id.

    Positions come from day totals and a rank inside each day, so that no bucket is sorted in one task.
    """
    d = F.to_date("o_orderdate")
    bucket = F.when(d.isNull(), 3).when((d >= "1996-01-01") & (d < "1997-01-01"), 0).when(d >= "1997-01-01", 1).otherwise(2)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", d.alias("d"), bucket.alias("bucket"))
    days = o.groupBy("bucket", "d").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = o.withColumn("r", F.row_number().over(Window.partitionBy("bucket", "d").orderBy("o_orderstatus", "o_orderkey")))
    joined = inside.alias("i").join(days.withColumn("before", before).alias("t"), F.expr("i.bucket = t.bucket AND i.d <=> t.d"))
    return joined.select("i.o_orderkey", "i.bucket", (F.col("before") + F.col("r")).alias("position"))


@query("""SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, max_by(role, turn) AS last_role, count(*) FILTER (WHERE role = 'user') AS asked,
  CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1""")
def message_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.count(F.when(F.col("role") == "user", 1)).alias("asked"), F.sum(F.length("text")).alias("chars")
    )


@query("""SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus, max_by(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1""")
def latest_order_voucher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.latest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_orderpriority"])

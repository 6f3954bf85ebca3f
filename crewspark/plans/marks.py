"""Cards, colours of lists, lines of pages, repaired numbers and kept lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewspark.functions import colors, text
from crewspark.operators import planning_rules, sequences
from crewspark.plans.registry import ENTRIES, entries, query, table
from crewspark.sources import contacts


@query(r"""WITH c AS (SELECT c_custkey AS id, c_mktsegment || ' ' || c_nationkey AS name, '+316' || lpad(CAST(c_custkey // 2 AS VARCHAR), 8, '0') AS number FROM customer WHERE c_acctbal > 0),
  o AS (SELECT number, min_by(name, id) AS name FROM c GROUP BY 1), s AS (SELECT *, count(*) OVER (PARTITION BY lower(name)) > 1 AS shared FROM o)
  SELECT concat_ws(chr(13) || chr(10), 'BEGIN:VCARD', 'VERSION:3.0', 'FN:' || CASE WHEN shared THEN name || ' (' || right(number, 4) || ')' ELSE name END, 'TEL;TYPE=CELL:' || number, 'CATEGORIES:Crew', 'END:VCARD') AS value FROM s""")
def contact_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of customers, two of whom share a number; those without a balance have none."""
    number = F.concat(F.lit("06-"), F.lpad(F.floor(F.col("c_custkey") / 2).cast("string"), 8, "0"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("name"), F.when(F.col("c_acctbal") > 0, number).alias("phone"))
    return contacts.contact_cards(c)


PALETTE = ("#848482", "#be0032", "#f38400")


@query(f"""WITH p AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part),
  h AS (SELECT *, n * 137.508::DOUBLE - floor(n * 137.508::DOUBLE / 360) * 360 AS hue FROM p),
  c AS (SELECT *, list_transform([0, 8, 4], lambda shift: CAST(round((0.38::DOUBLE - 0.72::DOUBLE * 0.38::DOUBLE * greatest(-1.0::DOUBLE, least(fmod(shift + hue / 30, 12) - 3, 9 - fmod(shift + hue / 30, 12), 1.0::DOUBLE))) * 255) AS BIGINT)) AS rgb FROM h)
  SELECT p_partkey, p_brand, CASE n WHEN 0 THEN '{PALETTE[0]}' WHEN 1 THEN '{PALETTE[1]}' WHEN 2 THEN '{PALETTE[2]}' ELSE '#' || array_to_string(list_transform(rgb, lambda x: lpad(lower(to_hex(x)), 2, '0')), '') END AS color FROM c""")
def list_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colour for each part of a brand: the palette's first, then hues a golden angle apart."""
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", n.alias("n")).select("p_partkey", "p_brand", colors.place_color(F.col("n"), PALETTE).alias("color"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '0' || p_size % 10 || '.' || lpad(CAST(p_size AS VARCHAR), 2, '0') WHEN 1 THEN 'B-1' || p_size || '.50' WHEN 2 THEN upper(p_brand[1:5]) ELSE 'A-OILBS' END AS number,
  CASE p_size % 4 WHEN 0 THEN 'yyy.' ELSE '' END || CASE WHEN p_size < 10 THEN '0000' || p_size ELSE '000' || p_size END AS sort_key FROM part""")
def repaired_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Room numbers as scanned, with letters for digits, blanks and commas; and keys to sort by."""
    size = F.col("p_size")
    k = size % 4
    read = (
        F.when(k == 0, F.concat(F.lit("o "), size % 10, F.lit(","), F.lpad(size.cast("string"), 2, "0")))
        .when(k == 1, F.concat(F.lit("b-l"), size, F.lit(" , so")))
        .when(k == 2, F.left("p_brand", F.lit(5)))
        .otherwise("A-OILBS")
    )
    key = F.concat(F.when(k == 0, "a").otherwise(""), size.cast("string"))
    sort_key = F.regexp_replace(text.room_sort_key(key), "^yyy\\.a", "yyy.")
    return table(spark, sf_dir, "part").select("p_partkey", text.repaired_number(read).alias("number"), sort_key.alias("sort_key"))


@query("""WITH t AS (SELECT l_orderkey AS page, l_linenumber AS y, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
  r AS (SELECT page, y, (k - 1) // 3 AS run, string_agg(p_name, ' ' ORDER BY k) AS text, count(*) AS parts FROM t GROUP BY 1, 2, 3)
  SELECT page, text, CAST(y AS DOUBLE) / 10 AS y, CAST(run AS DOUBLE) AS x FROM r""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a page on one baseline, joined while they follow closely: three and three."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    own = li.join(p, li["l_partkey"] == p["p_partkey"])
    k = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")) - 1
    items = own.select(F.col("l_orderkey").alias("page"), F.col("p_name").alias("text"), (F.col("l_linenumber") / 10).alias("y"), k.alias("k")).select("page", "text", (F.floor(F.col("k") / 3) + F.col("k") % 3 * 0.25).cast("double").alias("x"), "y", F.lit(0.24).alias("w"))
    return planning_rules.clustered_lines(items, ["page"]).select("page", "text", "y", "x")


@query(f"""WITH {ENTRIES}, l AS (SELECT id, day, person, status, CAST(person % 7 AS BIGINT) AS lane FROM entries), k AS (SELECT * FROM l WHERE status IN ('view', 'purchase'))
  SELECT id, CAST(day AS VARCHAR) AS day, CAST(dense_rank() OVER (PARTITION BY day ORDER BY lane) - 1 AS BIGINT) AS lane FROM k""")
def kept_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of two kinds, their lanes numbered without gaps."""
    e = entries(spark, sf_dir).select("id", "day", "status", (F.col("person") % 7).cast("long").alias("lane"))
    kept = planning_rules.renumbered(e, e.where("status IN ('view', 'purchase')"), "id", ["day"], "lane")
    return kept.select("id", F.col("day").cast("string").alias("day"), F.col("lane").cast("long").alias("lane"))


@query("""WITH c AS (SELECT c_custkey, c_nationkey % 5 AS form, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS n FROM customer)
  SELECT c_custkey, CASE WHEN form < 3 THEN '316' || n WHEN form = 3 THEN '49' || n END AS id, CASE WHEN form < 3 THEN '06-' || n WHEN form = 3 THEN '+49 ' || n ELSE '12-34' END AS shown FROM c""")
def phone_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in five forms: Dutch mobiles in three of them, a foreign one, and one that is too short."""
    n, form = F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.col("c_nationkey") % 5
    written = F.when(form == 0, F.concat(F.lit("06 "), F.left(n, F.lit(4)), F.lit("-"), F.right(n, F.lit(4)))).when(form == 1, F.concat(F.lit("+31 (0)6 "), n)).when(form == 2, F.concat(F.lit("0031-6"), n)).when(form == 3, F.concat(F.lit(" +49 "), n)).otherwise("12-34")
    return table(spark, sf_dir, "customer").select("c_custkey", text.phone_id(written).alias("id"), text.phone_shown(written).alias("shown"))


@query("""WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderkey % 9 AS INTEGER) AS n FROM orders), d AS (SELECT o_orderkey, a, n, unnest(generate_series(a, a + n, INTERVAL 1 DAY))::DATE AS day FROM r),
  k AS (SELECT * FROM d WHERE day <> a + 2 AND isodow(day) <> 7), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY day) AS INTEGER) AS run FROM k)
  SELECT o_orderkey, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS days FROM g GROUP BY o_orderkey, run""")
def removed_day_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges without their third day; Sundays, which they don't cover, part them too."""
    a = F.to_date("o_orderdate")
    r = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), F.date_add(a, (F.col("o_orderkey") % 9).cast("int")).alias("b"))
    sundays = F.filter(F.sequence("a", "b"), lambda d: F.weekday(d) == 6)
    runs = sequences.without_day(r, ["o_orderkey"], "a", "b", F.date_add("a", 2), sundays)
    return runs.select("o_orderkey", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "days")

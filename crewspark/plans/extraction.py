"""Texts, codes, colours and candidate scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewspark.functions import numbers, text
from crewspark.operators import loading, matching, rooms
from crewspark.plans.production import LINES, lines
from crewspark.plans.registry import query, table


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:20]) AS line, generate_subscripts(string_split(text, chr(10))[1:20], 1) AS pos FROM documents WHERE text IS NOT NULL),
  s AS (SELECT doc_id, pos, len(list_filter(string_split(line, ' '), lambda x: length(x) BETWEEN 1 AND 4)) AS score FROM l)
  SELECT doc_id, min_by(pos, (1000000 - score) * 1000 + pos) AS header_line, max(score) AS score FROM s GROUP BY 1""")
def header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a text's first twenty lines the one with the most short cells; the first one among equals."""
    lines = F.slice(F.split("text", "\n"), 1, 20)
    scores = F.transform(lines, lambda x: F.size(F.filter(F.split(x, " "), lambda c: F.length(c).between(1, 4))))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", scores.alias("scores"))
    best = F.array_max("scores")
    return d.select("doc_id", F.array_position("scores", best).alias("header_line"), best.cast("bigint").alias("score"))


@query("""WITH c AS (SELECT a.p_partkey AS id, b.p_partkey AS other, a.p_brand AS brand,
    20 + CASE WHEN a.p_type = b.p_type THEN 100 ELSE 0 END + CASE WHEN abs(a.p_size - b.p_size) <= 1 THEN 40 WHEN abs(a.p_size - b.p_size) <= 3 THEN 12 ELSE -30 END AS score
    FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size // 10 = b.p_size // 10 AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1),
  r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS runner_up FROM c WINDOW w AS (PARTITION BY id ORDER BY score DESC, other))
  SELECT id, other, CAST(score AS BIGINT) AS score FROM r WHERE rn = 1 AND score >= 70 AND (runner_up IS NULL OR score - runner_up >= 25 OR (score >= 100 AND (score - runner_up >= 10 OR runner_up < 70)))""")
def room_identity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidates of a brand, type and size class, and the decision for the best one.

    Another type never reaches the least score, nor does it come near one that does; and of odd parts
    of one size all score alike, so that the first two of them decide.
    """
    same = ["p_brand", "class", "p_type"]
    p = table(spark, sf_dir, "part").select("p_brand", F.expr("p_size div 10").alias("class"), F.col("p_partkey").alias("id"), "p_type", "p_size")
    b = p.where("id % 2 = 1").select(*same, F.col("id").alias("other"), F.col("p_size").alias("s"))
    off = F.abs(F.col("p_size") - F.col("s"))
    score = F.lit(120) + F.when(off <= 1, 40).when(off <= 3, 12).otherwise(-30)
    c = p.where("id % 2 = 0").join(matching.first_rows(b, [*same, "s"], ["other"], 2), same).select("id", "other", score.cast("bigint").alias("score"))
    return matching.uniquely_best(c, ["id"], "score", ["other"]).select("id", "other", "score")


@query("""WITH c AS (SELECT a.p_partkey AS id, min(b.p_partkey) AS other, count(*) AS n FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey % 5 = 0 AND b.p_partkey % 5 <> 0 GROUP BY 1)
  SELECT id, other FROM c WHERE n = 1""")
def only_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of one list (every fifth key) with exactly one partner of their brand, type and size among
    all others: a key's only row is found before the lists meet."""
    p, same = table(spark, sf_dir, "part"), ["p_type", "p_brand", "p_size"]
    one = matching.only_candidate(p.where("p_partkey % 5 <> 0"), same).select(*same, F.col("p_partkey").alias("other"))
    return p.where("p_partkey % 5 = 0").join(one, same).select(F.col("p_partkey").alias("id"), "other")


@query(r"""SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'metal' WHEN contains(lower(p_type), 'copper') OR contains(lower(p_type), 'brass') THEN 'alloy' WHEN contains(lower(p_type), 'tin') THEN 'soft' ELSE 'other' END AS kind FROM part""")
def work_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first keyword decides."""
    rules = [("metal", ["steel"]), ("alloy", ["copper", "brass"]), ("soft", ["tin"])]
    return table(spark, sf_dir, "part").select("p_partkey", text.first_keyword(F.col("p_type"), rules, "other").alias("kind"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, min('A-' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || lpad(CAST(r AS VARCHAR), 2, '0')) AS first_room, count(DISTINCT r) AS rooms
  FROM (SELECT l_orderkey, l_linenumber, unnest(generate_series(l_suppkey % 7 + 1, l_suppkey % 7 + l_linenumber)) AS r FROM lineitem) GROUP BY 1, 2""")
def room_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts such as A-03-12/15, taken apart into rooms."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    low = F.col("l_suppkey") % 7
    label = F.concat(F.lit("A-"), two(F.col("l_linenumber")), F.lit("-"), two(low + 1), F.lit("/"), two(low + F.col("l_linenumber")))
    rooms = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(text.expand_rooms(label)).alias("room"))
    return rooms.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("room").alias("first_room"), F.countDistinct("room").alias("rooms"))


@query(r"""SELECT c_custkey, '+31' || CAST(c_custkey * 7919 % 900000000 + 100000000 AS VARCHAR) AS phone, regexp_replace(regexp_replace(lower(c_name), '(\d+)', '0000\1', 'g'), '0+(\d{5})', '\1', 'g') AS sort_key FROM customer""")
def contact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written as 06 12-34... in one form, and natural sort keys of names."""
    digits = (F.col("c_custkey") * 7919 % 900000000 + 100000000).cast("string")
    written = F.concat(F.lit("0"), F.left(digits, F.lit(2)), F.lit(" "), F.substring(digits, 3, 3), F.lit("-"), F.substring(digits, 6, 4))
    return table(spark, sf_dir, "customer").select("c_custkey", text.phone(written).alias("phone"), text.natural_key(F.col("c_name")).alias("sort_key"))


@query("""WITH h AS (SELECT DISTINCT p_brand, sha256(p_brand) AS h FROM part), c AS (SELECT p_brand, CAST('0x' || substr(h, 1, 2) AS INTEGER) AS r, CAST('0x' || substr(h, 3, 2) AS INTEGER) AS g, CAST('0x' || substr(h, 5, 2) AS INTEGER) AS b, h FROM h)
  SELECT p_brand, '#' || substr(h, 1, 6) AS color, CAST((r - 128) * (r - 128) + (g - 128) * (g - 128) + (b - 128) * (b - 128) AS BIGINT) AS from_grey FROM c""")
def material_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed colour for each code, and its squared distance from grey."""
    from crewspark.functions import geometry

    c = table(spark, sf_dir, "part").select("p_brand").distinct().withColumn("color", F.concat(F.lit("#"), F.left(F.sha2("p_brand", 256), F.lit(6))))
    rgb = geometry.hex_rgb(F.col("color"))
    return c.select("p_brand", "color", sum(((rgb[x] - 128) * (rgb[x] - 128) for x in "rgb"), F.lit(0)).cast("bigint").alias("from_grey"))


@query("""SELECT l_orderkey, l_partkey, CAST(ceil((2 * (sqrt(2.5::DOUBLE * q) + sqrt(q / 2.5::DOUBLE))) * 1000 - 1e-9::DOUBLE) AS BIGINT) AS millimetres
  FROM (SELECT l_orderkey, l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)""")
def skirting_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perimeter of a room of proportions 5 to 2 with a given area, rounded up."""
    from crewspark.functions import geometry

    rooms = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    return rooms.select("l_orderkey", "l_partkey", geometry.estimated_perimeter_mm(F.col("q")).alias("millimetres"))


@query("""SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS content, count(*) AS copies FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id < 20) GROUP BY 2""")
def idempotent_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content isn't loaded yet, each content once."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    new = loading.not_yet_loaded(d, d.where("doc_id < 20"), "text", "content")
    return new.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""WITH n AS (SELECT c_custkey, c_name || '*' AS c_name, c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 100000000, c_name, c_acctbal FROM customer WHERE c_custkey % 10 = 0)
  SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, n.c_custkey IS NOT NULL AS written FROM customer o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(False).alias("written"))
    changed = old.where("c_custkey % 3 = 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), F.lit(True).alias("written"))
    added = old.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 100000000).alias("c_custkey"), "c_name", F.lit(True).alias("written"))
    return loading.upsert(old, changed.union(added), ["c_custkey"])


@query(r"""SELECT page_id, CASE WHEN regexp_matches(lower(url), '\.(xlsx|xls|csv)($|[?#])') THEN 'sheet' WHEN regexp_matches(lower(url), '\.pdf($|[?#])') THEN 'drawing' WHEN starts_with(ltrim(lower(html)), '<!doctype') OR starts_with(ltrim(lower(html)), '<html') THEN 'web page' ELSE 'text' END AS kind FROM pages""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type by name, else by the first characters."""
    return table(spark, sf_dir, "pages").select("page_id", loading.file_kind(F.col("url"), F.col("html")).alias("kind"))


@query(r"""SELECT l_orderkey, l_linenumber, min(label) AS label, count(*) AS n FROM (SELECT l_orderkey, l_linenumber,
    CASE WHEN q % 100 = 0 THEN CAST(q // 100 AS VARCHAR) ELSE CAST(q // 100 AS VARCHAR) || ',' || rtrim(lpad(CAST(q % 100 AS VARCHAR), 2, '0'), '0') END || 'u' AS label
    FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity / 4 AS DECIMAL(12,2)) * 100 AS BIGINT) AS q FROM lineitem)) GROUP BY 1, 2""")
def hour_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = (F.col("l_quantity") / 4).cast("decimal(12,2)")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.hours_label(hours).alias("label"))
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.min("label").alias("label"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings),
  x AS (SELECT label, vec_id AS polygon, least(a, c) AS x0, greatest(a, c) AS x1, least(b, d) AS y0, greatest(b, d) AS y1 FROM e WHERE vec_id % 2 = 0),
  h AS (SELECT e.label, vec_id, polygon, abs((x0 * y0 - x1 * y0) + (x1 * y1 - x1 * y0) + (x1 * y1 - x0 * y1) + (x0 * y0 - x0 * y1)) / 2 AS area FROM e JOIN x ON e.label = x.label AND a >= x0 AND a < x1 AND b >= y0 AND b < y1 WHERE vec_id % 2 = 1)
  SELECT label, vec_id, polygon, area FROM (SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY area, polygon) AS rn FROM h) WHERE rn = 1""")
def enclosing_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each odd vector's first two components the smallest even vector's box of its label around them."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    e = table(spark, sf_dir, "embeddings")
    lo = lambda i: F.least(at(i), at(i + 2))
    hi = lambda i: F.greatest(at(i), at(i + 2))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    boxes = e.where("vec_id % 2 = 0").select("label", F.col("vec_id").alias("polygon"), F.array(corner(lo(0), lo(1)), corner(hi(0), lo(1)), corner(hi(0), hi(1)), corner(lo(0), hi(1))).alias("points"))
    marks = e.where("vec_id % 2 = 1").select("label", "vec_id", at(0).alias("x"), at(1).alias("y"))
    return matching.smallest_enclosing(marks, boxes, ["label"], "vec_id", 0.05)


@query("""WITH t AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part), d AS (SELECT DISTINCT p_partkey, left(w, 5) AS stem FROM t WHERE length(w) >= 5)
  SELECT stem, count(*) AS products, min(p_partkey) AS first_product FROM d GROUP BY 1""")
def stem_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by the stems on which their words align."""
    stems = F.array_distinct(F.transform(F.filter(F.split(F.lower("p_name"), " "), lambda w: F.length(w) >= 5), lambda w: F.left(w, F.lit(5))))
    s = table(spark, sf_dir, "part").select("p_partkey", F.explode(stems).alias("stem"))
    return s.groupBy("stem").agg(F.count("*").alias("products"), F.min("p_partkey").alias("first_product"))


@query("""WITH r AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rn, count(*) OVER (PARTITION BY source, lang) AS n FROM documents)
  SELECT source, lang, max(n) AS n, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY rn) || CASE WHEN max(n) > 2 THEN ' and others' ELSE '' END AS label FROM r WHERE rn <= 2 GROUP BY 1, 2""")
def first_two_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two longest texts of a group by name, and whether there are others; two rows a group suffice."""
    w = Window.partitionBy("source", "lang").orderBy(F.desc("n_chars"), "doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    n = d.groupBy("source", "lang").agg(F.count("*").alias("n"))
    two = d.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy("source", "lang").agg(F.array_sort(F.collect_list(F.struct("rn", "doc_id"))).alias("x"))
    joined = two.join(n, (two["source"].eqNullSafe(n["source"])) & (two["lang"].eqNullSafe(n["lang"])))
    names = F.array_join(F.transform("x", lambda y: y["doc_id"].cast("string")), ", ")
    return joined.select(two["source"], two["lang"], "n", F.concat(names, F.when(F.col("n") > 2, " and others").otherwise("")).alias("label"))


NAMES = ("Kantoor", "kantoor", "kantoorruimte", "hal", "ruimte", "kantor")


@query(f"""WITH {LINES}, r AS (SELECT project, item * 8 + room AS id, max(kind) = 'N' AS host, coalesce(['begane grond', 'Begane grond', 'onbekend'][item % 4 + 1], '') AS floor, CASE WHEN room % 3 > 0 THEN '1.0' || room % 5 ELSE '' END AS number,
    lower({list(NAMES)}[item % {len(NAMES)} + 1]) AS name, CAST(CAST(max(q) AS INTEGER) // 4 AS DOUBLE) AS area, CASE WHEN item % 5 < 3 THEN 1 + item % 5 // 2 ELSE 0 END AS page, CAST(item % 50 AS DOUBLE) AS x FROM lines GROUP BY project, room, item),
  p AS (SELECT a.project, a.id, b.id AS other, a.number AS na, b.number AS nb, a.name AS ma, b.name AS mb, a.floor IN ('', 'onbekend') OR b.floor IN ('', 'onbekend') AS unknown_floor, abs(a.area - b.area) AS off, a.page = 0 OR b.page = 0 OR a.page = b.page AS page,
    10 * abs(a.x - b.x) <= 120 AS near FROM r a JOIN r b ON a.project = b.project AND a.host AND NOT b.host),
  s AS (SELECT *, na <> '' AND na = nb AS exact, na <> '' AND nb <> '' AS numbers, ma = mb AS same, ma <> 'ruimte' AND mb <> 'ruimte' AND (ma = mb OR (ma LIKE 'kanto%' AND mb LIKE 'kanto%' AND (ma <> 'kantor' OR mb <> 'kantoorruimte') AND (mb <> 'kantor' OR ma <> 'kantoorruimte'))) AS alike FROM p),
  c AS (SELECT *, ma <> 'ruimte' AND mb <> 'ruimte' AND NOT alike AS conflict, CASE WHEN unknown_floor THEN 8 ELSE 20 END + CASE WHEN exact THEN 100 ELSE 0 END + CASE WHEN same THEN 50 WHEN alike THEN 18 WHEN ma <> 'ruimte' AND mb <> 'ruimte' THEN -30 ELSE 0 END
    + CASE WHEN off = 0 THEN 40 WHEN off <= 1 AND (exact OR same) THEN 12 ELSE 0 END + CASE WHEN near AND page THEN 15 ELSE 0 END AS total FROM s),
  d AS (SELECT *, CAST(CASE WHEN NOT exact AND NOT numbers THEN CASE WHEN alike AND off = 0 THEN total + CASE WHEN same THEN 20 ELSE 10 END WHEN same AND near AND page THEN total + 10 ELSE least(total, 60) END
    WHEN NOT exact AND alike AND off = 0 THEN total + CASE WHEN same THEN 20 ELSE 8 END ELSE total END AS DOUBLE) AS score FROM c
    WHERE page AND NOT (exact AND conflict AND off > 2) AND NOT (NOT exact AND off > 2) AND NOT (NOT exact AND numbers AND conflict) AND NOT (NOT exact AND numbers AND NOT alike AND off > 0)),
  t AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(score) OVER w, 0) AS next FROM d WINDOW w AS (PARTITION BY project, id ORDER BY score DESC, other))
  SELECT project, id, other, score, exact FROM t WHERE rn = 1 AND score >= 70 AND CASE WHEN exact AND score >= 100 THEN score - next >= 10 OR next < 70 ELSE score - next >= 25 END""")
def room_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms of one source of a project and those of the other that they are, by number, name, area and place."""
    k = lambda n: F.col("item") % n
    q = lines(spark, sf_dir).groupBy("project", "room", "item").agg(F.max("kind").alias("kind"), F.expr("max(q) div 4").cast("double").alias("area"))
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (k(len(NAMES)) + 1).cast("int"))
    floor = F.when(k(4) == 0, "begane grond").when(k(4) == 1, "Begane grond ").when(k(4) == 2, "onbekend")
    page = F.when(k(5) < 3, 1 + F.floor(k(5) / 2))
    number = F.when(F.col("room") % 3 > 0, F.concat(F.lit("1,0"), F.col("room") % 5))
    r = q.select("project", (F.col("item") * 8 + F.col("room")).alias("id"), (F.col("kind") == "N").alias("host"), F.struct(
        floor.alias("floor"), number.alias("number"), name.alias("name"), "area", page.alias("page"), (k(50) * 10.0).alias("x"), F.lit(0.0).alias("y")
    ).alias("room"))
    return rooms.identified(r.where("host"), r.where("NOT host"), ["project"])

"""Identity of product names, and works that are declared under several names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewspark.operators import matching, people, products
from crewspark.plans.registry import query, table


#: Names as lists of materials have them: an article number, a work code with or without how it is carried
#: out, or a bare code, shared by products of about one price.
NAMES = """coded AS (SELECT p_partkey, p_name || ' ' || lower(p_type) AS plain, p_size, CAST(floor(p_retailprice * 2.5) AS BIGINT) AS c, p_brand FROM part),
  named AS (SELECT p_partkey, plain || CASE WHEN p_size <= 10 THEN ' rf ' || (600000 + c) WHEN p_size <= 25 THEN ', 43.' || lpad(CAST(c // 100 % 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') ||
    CASE WHEN length(p_brand) = 7 THEN 'a' ELSE '' END || CASE WHEN p_size > 20 THEN ' ral 90' || p_size || CASE WHEN p_size > 23 THEN ' (sp)' ELSE ' (hp)' END ELSE '' END
    WHEN p_size <= 40 THEN ' ' || (1000 + c % 9000) ELSE '' END AS name FROM coded)"""

_SHARED = """f AS (SELECT id, name, lower(trim(name)) AS t FROM n),
  g AS (SELECT *, regexp_extract_all(t, '\\b(\\d{2}\\.\\d{2}\\.\\d{2}[a-z]?)\\b', 1) AS work, list_distinct(list_concat(regexp_extract_all(t, '\\b(?:rf\\s*)?(\\d{6,})\\b', 1), regexp_extract_all(t, '\\b([a-z]\\d\\.\\d{2}\\.\\d{2})\\b', 1),
    regexp_extract_all(t, '\\b(\\d{2,}\\.\\d{2}\\.\\d{2}[a-z]?)\\b', 1), regexp_extract_all(regexp_replace(t, '\\bral\\s*\\d{3,5}\\b', ' ', 'g'), '\\b(\\d{4,5})\\b', 1))) AS codes,
    nullif(regexp_extract(t, '\\((sp|hp)\\)', 1), '') AS method, nullif(regexp_extract(t, '\\bral\\s*(\\d{3,5})\\b', 1), '') AS ral,
    trim(regexp_replace(regexp_replace(t, '\\b(banen|vinyl|pvc|tapijttegels?|coating|lvt)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key FROM f),
  k AS (SELECT *, list_distinct(list_concat(codes, list_filter(string_split(regexp_replace(t, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 4))) AS tokens FROM g),
  p AS (SELECT a.id AS a, b.id AS b, a.work AS aw, b.work AS bw, a.codes AS ac, b.codes AS bc, a.key AS ak, b.key AS bk, len(a.tokens) AS an, len(b.tokens) AS bn,
    (a.method IS NULL OR b.method IS NULL OR a.method = b.method) AND a.ral IS NOT DISTINCT FROM b.ral AS marks,
    list_filter(a.tokens, lambda x: len(list_filter(b.tokens, lambda y: x = y OR (length(x) >= 5 AND starts_with(y, x)) OR (length(y) >= 5 AND starts_with(x, y)))) > 0) AS ain,
    list_filter(b.tokens, lambda x: len(list_filter(a.tokens, lambda y: x = y OR (length(x) >= 5 AND starts_with(y, x)) OR (length(y) >= 5 AND starts_with(x, y)))) > 0) AS bin
    FROM k AS a JOIN k AS b ON a.id < b.id AND (list_has_any(a.tokens, b.tokens) OR starts_with(a.key, b.key) OR starts_with(b.key, a.key))),
  q AS (SELECT *, CASE WHEN an <= bn THEN len(bin) = bn ELSE len(ain) = an END AS adds_none FROM p),
  x AS (SELECT *, CASE WHEN list_has_any(aw, bw) THEN marks WHEN an >= 5 AND bn >= 5 THEN adds_none ELSE true END AS execution,
    ak = bk OR (least(length(ak), length(bk)) >= 12 AND CASE WHEN length(ak) <= length(bk) THEN starts_with(bk, ak) AND (an >= 3 OR adds_none) ELSE starts_with(ak, bk) AND (bn >= 3 OR adds_none) END) AS by_key FROM q),
  y AS (SELECT *, by_key OR CASE WHEN len(ain) >= 3 THEN NOT (len(ain) < an AND len(bin) < bn) AND execution
    ELSE least(an, bn) >= 2 AND CASE WHEN an <= bn THEN len(ain) = an ELSE len(bin) = bn END AND adds_none END AS by_name,
    list_filter(ac, lambda z: NOT list_contains(aw, z)) AS ao, list_filter(bc, lambda z: NOT list_contains(bw, z)) AS bo FROM x),
  same AS (SELECT a, b FROM y WHERE CASE WHEN len(aw) > 0 AND len(bw) > 0 THEN list_has_any(aw, bw) AND execution AND CASE WHEN len(ao) > 0 AND len(bo) > 0 THEN list_has_any(ao, bo) ELSE by_name END
    WHEN list_has_any(ac, bc) THEN execution WHEN len(ac) > 0 AND len(bc) > 0 THEN false ELSE by_name END)"""


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, name."""
    c = F.floor(F.col("p_retailprice") * 2.5).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    size = F.col("p_size")
    letter = F.when(F.length("p_brand") == 7, "a").otherwise("")
    how = F.when(size > 20, F.concat(F.lit(" ral 90"), size, F.when(size > 23, " (sp)").otherwise(" (hp)"))).otherwise("")
    work = F.concat(F.lit(", 43."), two(F.floor(c / 100) % 100), F.lit("."), two(c % 100), letter, how)
    tail = F.when(size <= 10, F.concat(F.lit(" rf "), c + 600000)).when(size <= 25, work).when(size <= 40, F.concat(F.lit(" "), 1000 + c % 9000)).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" "), F.lower("p_type"), tail).alias("name"))


@query(f"WITH {NAMES}, n AS (SELECT min(p_partkey) AS id, name FROM named GROUP BY name), {_SHARED} SELECT a, b FROM same")
def product_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different names (by their least key) that are one product: by codes, keys or words."""
    names = named(spark, sf_dir).groupBy("name").agg(F.min("p_partkey").alias("id"))
    return products.identical(names)


@query(rf"""WITH RECURSIVE {NAMES}, n AS (SELECT min(p_partkey) AS id, name FROM named GROUP BY name), {_SHARED},
  two AS (SELECT a, b FROM same UNION ALL SELECT b, a FROM same),
  reach(v, c) AS (SELECT id, id FROM n UNION SELECT two.b, reach.c FROM reach JOIN two ON two.a = reach.v WHERE two.b > reach.c),
  comp AS (SELECT v, min(c) AS grp FROM reach GROUP BY v),
  d AS (SELECT l_partkey AS key, CAST(floor(sum(l_quantity)) AS BIGINT) - 100 AS total FROM lineitem GROUP BY 1),
  w AS (SELECT named.p_partkey AS id, name, total FROM named LEFT JOIN d ON d.key = named.p_partkey),
  r AS (SELECT comp.grp, w.* FROM w JOIN n USING (name) JOIN comp ON comp.v = n.id),
  best AS (SELECT comp.grp, k.name, row_number() OVER (PARTITION BY comp.grp ORDER BY (k.method IS NOT NULL)::INT + (k.ral IS NOT NULL)::INT + (len(k.work) > 0)::INT DESC, len(k.codes) > 0 DESC, length(trim(k.name)) DESC, k.name DESC) AS rn
    FROM k JOIN comp ON comp.v = k.id)
  SELECT best.grp AS "group", best.name, any_value(s.total) AS total, count(DISTINCT r.name) AS names, count(*) AS rows
  FROM best JOIN r USING (grp) JOIN (SELECT grp, min_by(total, id) FILTER (total > 0) AS total FROM r GROUP BY grp) AS s USING (grp) WHERE rn = 1 GROUP BY 1, 2""")
def declared_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works declared for products, one for all names of a product; a total counts above a threshold."""
    declared = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg((F.floor(F.sum("l_quantity")) - 100).alias("total"))
    own = named(spark, sf_dir)
    works = own.join(declared, own["p_partkey"] == declared["key"], "left").select(F.col("p_partkey").alias("id"), "name", "total")
    return products.declared_groups(works)


@query("""WITH RECURSIVE e AS (SELECT l_orderkey AS o, l_suppkey AS s, l_partkey AS p, l_linenumber AS ln, l_quantity AS q FROM lineitem WHERE l_returnflag = 'N'),
  c AS (SELECT DISTINCT a.o AS o, a.ln AS l, b.l_linenumber AS r, CASE WHEN abs(a.q - b.l_quantity) <= 1 THEN 1.0 ELSE 0.82 END AS conf, length(CAST(a.p AS VARCHAR)) AS len, count(*) OVER (PARTITION BY a.o, a.ln, b.l_linenumber) AS n
    FROM e AS a JOIN lineitem AS b ON a.o = b.l_orderkey AND b.l_returnflag <> 'N' AND abs(a.q - b.l_quantity) <= 10),
  d AS (SELECT o, l, r, max(conf) AS conf, max(len) AS len FROM c GROUP BY 1, 2, 3),
  k AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY conf DESC, len DESC, l, r) AS rn FROM d),
  g AS (SELECT o, l, r, conf, rn, true AS taken, ['l' || l, 'r' || r] AS used FROM k WHERE rn = 1
    UNION ALL SELECT k.o, k.l, k.r, k.conf, k.rn, NOT list_has_any(g.used, ['l' || k.l, 'r' || k.r]), CASE WHEN list_has_any(g.used, ['l' || k.l, 'r' || k.r]) THEN g.used ELSE list_concat(g.used, ['l' || k.l, 'r' || k.r]) END
    FROM g JOIN k ON k.o = g.o AND k.rn = g.rn + 1)
  SELECT o AS project, CAST(l AS BIGINT) AS area, CAST(r AS BIGINT) AS marker, CAST(conf AS DOUBLE) AS confidence FROM g WHERE taken""")
def marker_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms of a project (lines not returned) and markers (the others) that are near in quantity, one to one:
    the surest first, then the longest number; candidates meet in bands of quantity."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"), (F.col("l_returnflag") == "N").alias("room"))
    band = F.floor(F.col("q") / 10)
    a = li.where("room").select("project", F.col("n").alias("area"), "p", "q", F.explode(F.array(*[band + d for d in (-1, 0, 1)])).alias("band"))
    b = li.where("NOT room").select("project", F.col("n").alias("marker"), F.col("q").alias("own"), band.alias("band"))
    off = F.abs(F.col("q") - F.col("own"))
    scored = a.join(b, ["project", "band"]).where(off <= 10).select("project", "area", "marker", F.when(off <= 1, 1.0).otherwise(0.82).alias("confidence"), F.length(F.col("p").cast("string")).alias("length"))
    edges = scored.groupBy("project", "area", "marker").agg(F.max("confidence").alias("confidence"), F.max("length").alias("length"))
    ends = edges.withColumns({"l": F.struct("project", "area"), "r": F.struct("project", "marker")})
    return matching.greedy_edges(ends, "l", "r", [-F.col("confidence"), -F.col("length")]).select("project", "area", "marker", "confidence")


@query(r"""WITH RECURSIVE c AS (SELECT c_custkey AS id, c_mktsegment[1] || lower(c_mktsegment[2:]) AS given, 'F' || translate(CAST(c_custkey // 4 AS VARCHAR), '0123456789', 'abcdefghij') AS family, c_nationkey AS n FROM customer),
  v AS (SELECT id, CASE WHEN n < 8 THEN family || ', ' || given[1] || '.' WHEN n < 14 THEN given || '  ' || family WHEN n < 19 THEN family || ', ' || given WHEN n < 22 THEN given || ' ' || family || ' jr' ELSE given || ' ' || family || ', ' || given[1] || '.' END AS raw FROM c),
  s AS (SELECT id, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS name FROM v),
  u AS (SELECT id, CASE WHEN regexp_matches(name, '^(.+?)\s*,\s*(\p{L}{1,2})\.?$') THEN
      CASE WHEN starts_with(upper(regexp_extract(name, '^(.+?)\s*,\s*(\p{L}{1,2})\.?$', 1)), upper(regexp_extract(name, '^(.+?)\s*,\s*(\p{L}{1,2})\.?$', 2))) THEN regexp_extract(name, '^(.+?)\s*,\s*(\p{L}{1,2})\.?$', 1) ELSE name END
    ELSE regexp_replace(name, '^(\p{L}[\p{L}''\-]+)\s*,\s*(\p{L}[\p{L}''\-]{2,})$', '\2 \1') END AS name FROM s),
  d AS (SELECT name, min(id) AS id, count(*) AS contacts FROM u GROUP BY 1),
  l AS (SELECT id, lower(name) AS t, regexp_extract(lower(name), '^(.+?)\s*,\s*(\p{L}{1,2})\.?$', 1) AS fam, regexp_extract(lower(name), '^(.+?)\s*,\s*(\p{L}{1,2})\.?$', 2) AS ini, string_split(lower(name), ' ') AS w FROM d),
  p AS (SELECT a.id AS a, b.id AS b FROM l AS a JOIN l AS b ON a.id <> b.id AND (a.t = b.t OR starts_with(b.t, a.t || ' ') OR (a.fam <> '' AND len(b.w) > 1 AND b.w[len(b.w)] = a.fam AND starts_with(b.w[1], a.ini)))),
  two AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
  reach(v, c) AS (SELECT id, id FROM d UNION SELECT two.b, reach.c FROM reach JOIN two ON two.a = reach.v),
  comp AS (SELECT v, min(c) AS person FROM reach GROUP BY v)
  SELECT person, max_by(name, {'a': len(string_split(name, ' ')), 'b': length(name), 'c': -id}) AS name, count(*) AS names, CAST(sum(contacts) AS BIGINT) AS contacts FROM d JOIN comp ON comp.v = d.id GROUP BY 1""")
def merged_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts written in five ways, one for each person."""
    seg, n, key = F.col("c_mktsegment"), F.col("c_nationkey"), F.floor(F.col("c_custkey") / 4).cast("string")
    given = F.concat(F.left(seg, F.lit(1)), F.lower(F.substring(seg, 2, 100)))
    family, initial = F.concat(F.lit("F"), F.translate(key, "0123456789", "abcdefghij")), F.concat(F.left(given, F.lit(1)), F.lit("."))
    name = (
        F.when(n < 8, F.concat(family, F.lit(", "), initial))
        .when(n < 14, F.concat(given, F.lit("  "), family))
        .when(n < 19, F.concat(family, F.lit(", "), given))
        .when(n < 22, F.concat(given, F.lit(" "), family, F.lit(" jr")))
        .otherwise(F.concat(given, F.lit(" "), family, F.lit(", "), initial))
    )
    return people.merged_people(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name.alias("name")))


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS cust, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice / 1000) AS BIGINT) AS k FROM orders),
  a AS (SELECT * FROM o JOIN customer ON c_custkey = cust WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')), b AS (SELECT * FROM o JOIN customer ON c_custkey = cust WHERE c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD')),
  a1 AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, k ORDER BY day, id) AS n FROM a), b1 AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, k ORDER BY day, id) AS n FROM b),
  m1 AS (SELECT a1.id AS id, b1.id AS other FROM a1 JOIN b1 USING (c_nationkey, k, n)),
  a2 AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, day ORDER BY day, id) AS n FROM a WHERE id NOT IN (SELECT id FROM m1)), b2 AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, day ORDER BY day, id) AS n FROM b WHERE id NOT IN (SELECT other FROM m1)),
  m2 AS (SELECT a2.id AS id, b2.id AS other FROM a2 JOIN b2 USING (c_nationkey, day, n))
  SELECT a.id AS id, coalesce(m1.other, m2.other) AS other, CASE WHEN m1.id IS NOT NULL THEN 'key' WHEN m2.id IS NOT NULL THEN 'name' END AS "by" FROM a LEFT JOIN m1 ON m1.id = a.id LEFT JOIN m2 ON m2.id = a.id""")
def updated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two segments and those of the others that they stand for: of one nation and about one
    price, else of one nation and day; each is used once."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("id"), "c_nationkey", F.floor(F.col("o_totalprice") / 1000).alias("k"), F.to_date("o_orderdate").alias("day"), F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD").alias("ours")
    )
    return matching.fallback_join(rows.where("ours"), rows.where("NOT ours"), ["c_nationkey", "k"], ["c_nationkey", "day"], "day")

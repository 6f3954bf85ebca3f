"""Rooms of four sources, and drawn rooms whose storey is put right by section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewspark.operators import room_sources
from crewspark.operators.rooms import FEW_ROOMS
from crewspark.plans.registry import query, table
from crewspark.storage import tasks_for

NAMES = ("takeoff", "drawing", "materials", "cutlist")
#: Which lines a source has, which of them with a number, and its area and product.
HAS = {"takeoff": "l_discount < 0.06", "drawing": "l_tax < 0.05", "materials": "l_quantity < 30", "cutlist": "l_suppkey % 3 = 0"}
NUMBERED = {"takeoff": "l_quantity >= 10", "drawing": "l_discount >= 0.02", "materials": "l_tax >= 0.02", "cutlist": "l_returnflag = 'N'"}
AREA = {"takeoff": "l_quantity", "drawing": "CASE WHEN l_returnflag <> 'A' THEN l_quantity + 0.5 END", "materials": "CAST(NULL AS DOUBLE)", "cutlist": "l_quantity + 2"}
PRODUCT = {"takeoff": "CASE WHEN l_returnflag = 'N' THEN p_brand END", "drawing": "CASE WHEN l_suppkey % 2 = 0 THEN p_brand END", "materials": "p_brand", "cutlist": "CASE WHEN l_tax > 0.06 THEN p_type ELSE p_brand END"}

_LINES = """lines AS (SELECT l_orderkey AS project, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice * 100) AS BIGINT)) AS line, l_linestatus AS floor, l_linenumber, p_name AS name, p_brand, p_type, l_quantity, l_discount, l_tax, l_suppkey, l_returnflag, l_partkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _source_sql(k: int, name: str) -> str:
    return f"""src{k} AS MATERIALIZED (SELECT min(line) || CASE WHEN number IS NULL THEN '?' ELSE '' END || floor || '{name}' AS id, project, floor, number, name, max(area) AS area, max(product) AS product FROM (SELECT *, CASE WHEN {NUMBERED[name]} THEN CAST(l_linenumber AS VARCHAR) END AS number, {AREA[name]} AS area, {PRODUCT[name]} AS product
  FROM lines WHERE {HAS[name]}) GROUP BY project, floor, number, name)"""


def _merged_sql() -> str:
    ctes = [_LINES, *[_source_sql(k, n) for k, n in enumerate(NAMES)]]
    ids = lambda k, own, rest: ", ".join(own if i == k else rest.format(i=i) for i in range(4))
    ctes.append("pool0 AS MATERIALIZED (SELECT id AS room, project, floor, number, name, id AS i0, CAST(NULL AS VARCHAR) AS i1, CAST(NULL AS VARCHAR) AS i2, CAST(NULL AS VARCHAR) AS i3, 0 AS h0, CAST(NULL AS INTEGER) AS h1, CAST(NULL AS INTEGER) AS h2, CAST(NULL AS INTEGER) AS h3 FROM src0)")
    for k in range(1, 4):
        a = k - 1
        ctes += [
            f"""m{k}1 AS MATERIALIZED (SELECT room, id, 1 AS level FROM (SELECT project, floor, number, name, min(room) AS room FROM pool{a} WHERE number IS NOT NULL GROUP BY ALL HAVING count(*) = 1)
                JOIN (SELECT project, floor, number, name, min(id) AS id FROM src{k} WHERE number IS NOT NULL GROUP BY ALL HAVING count(*) = 1) USING (project, floor, number, name))""",
            f"""m{k}2 AS MATERIALIZED (SELECT p.room, s.id, 2 AS level FROM
                (SELECT project, floor, name, min(room) AS room, min(number) AS number FROM pool{a} WHERE room NOT IN (SELECT room FROM m{k}1) GROUP BY ALL HAVING count(*) = 1) AS p
                JOIN (SELECT project, floor, name, min(id) AS id, min(number) AS number FROM src{k} WHERE id NOT IN (SELECT id FROM m{k}1) GROUP BY ALL HAVING count(*) = 1) AS s USING (project, floor, name)
                WHERE p.number IS NULL OR s.number IS NULL OR p.number = s.number)""",
            f"m{k} AS MATERIALIZED (SELECT * FROM m{k}1 UNION ALL SELECT * FROM m{k}2)",
            f"""pool{k} AS MATERIALIZED (SELECT p.room, p.project, p.floor, coalesce(p.number, s.number) AS number, p.name, {ids(k, f"m.id AS i{k}", "i{i}")}, {ids(k, f"m.level AS h{k}", "h{i}")}
                FROM pool{a} AS p LEFT JOIN m{k} AS m ON m.room = p.room LEFT JOIN src{k} AS s ON s.id = m.id
                UNION ALL SELECT id, project, floor, number, name, {ids(k, "id", "NULL")}, {ids(k, "0", "NULL")} FROM src{k} WHERE id NOT IN (SELECT id FROM m{k}))""",
        ]
    return f"""WITH {", ".join(ctes)},
      f AS (SELECT p.*, list_filter([CASE WHEN i0 IS NOT NULL THEN 'takeoff' END, CASE WHEN i1 IS NOT NULL THEN 'drawing' END, CASE WHEN i2 IS NOT NULL THEN 'materials' END, CASE WHEN i3 IS NOT NULL THEN 'cutlist' END], lambda x: x IS NOT NULL) AS sources,
        coalesce(b.area, a.area, d.area, c.area) AS area, coalesce(a.product, c.product, d.product, b.product) AS product,
        list_filter([a.area, b.area, c.area, d.area], lambda x: x IS NOT NULL) AS areas, list_distinct(list_filter([lower(a.product), lower(b.product), lower(c.product), lower(d.product)], lambda x: x IS NOT NULL)) AS products
        FROM pool3 AS p LEFT JOIN src0 AS a ON a.id = i0 LEFT JOIN src1 AS b ON b.id = i1 LEFT JOIN src2 AS c ON c.id = i2 LEFT JOIN src3 AS d ON d.id = i3)
      SELECT room, project, number, array_to_string(sources, '+') AS sources, area, product,
        CASE WHEN len(products) > 1 THEN 'controleren' WHEN (len(sources) > 1 OR product IS NOT NULL) AND area IS NOT NULL THEN 'hoog' ELSE 'midden' END AS confidence,
        array_to_string(list_filter([CASE WHEN len(products) > 1 THEN 'materials differ' END, CASE WHEN len(areas) > 1 AND list_max(areas) - list_min(areas) > 1.0::DOUBLE THEN 'areas differ' END, CASE WHEN area IS NULL THEN 'no area' END,
          CASE WHEN greatest(coalesce(h0, 0), coalesce(h1, 0), coalesce(h2, 0), coalesce(h3, 0)) > 1 THEN 'matched by name' END, CASE WHEN len(sources) = 1 THEN 'one source' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f"""


_RAW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "p_brand", "p_type"]


def _line() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") * 100))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = li.join(p, li["l_partkey"] == p["p_partkey"])
    return joined.withColumns({"project": F.col("l_orderkey"), "line": _line(), "floor": F.col("l_linestatus"), "name": F.col("p_name")})


@query(_merged_sql())
def assembled_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms of a take-off, a drawing, a list of materials and a cut list: by storey, number and name, else by
    storey and name where one of both has no number; with what each field is taken from, and how sure it is."""
    own, keys = lines(spark, sf_dir).select("project", "floor", "name", *_RAW), ["project", "floor", "number", "name"]
    # a storey's lines of a name come together once, with what all sources need, and are told apart there
    number = lambda name: F.when(F.expr(NUMBERED[name]), F.col("l_linenumber").cast("string"))
    each = [F.when(F.expr(HAS[n]), F.struct(F.lit(n).alias("source"), number(n).alias("number"), F.expr(AREA[n]).alias("area"), F.expr(PRODUCT[n]).alias("product"))) for n in NAMES]
    told = own.repartition("project", "floor", "name").withColumn("line", _line()).select("project", "floor", "name", "line", F.explode(F.array(*each)).alias("x")).where("x IS NOT NULL")
    rows = told.select("project", "floor", "name", "line", "x.*").groupBy("source", *keys).agg(F.min("line").alias("line"), F.max("area").alias("area"), F.max("product").alias("product"))
    rows = rows.withColumn("id", F.concat("line", F.when(F.col("number").isNull(), "?").otherwise(""), "floor", "source"))
    pool = room_sources.merged_rows(rows, NAMES, [keys, ["project", "floor", "name"]], ["area", "product"])
    done = room_sources.judged(pool, NAMES, ["drawing", "takeoff", "cutlist", "materials"], ["takeoff", "materials", "cutlist", "drawing"])
    return done.select("room", "project", "number", F.array_join("sources", "+").alias("sources"), "area", "product", "confidence", F.array_join("reasons", ",").alias("reasons"))


_SECTION = """drawn AS (SELECT DISTINCT project, line AS id, CASE WHEN l_tax < 0.06 THEN '0.0' || l_linenumber ELSE '0.0' || (8 - l_linenumber) END AS number, CASE WHEN l_discount < 0.08 THEN name ELSE 'ruimte' END AS name,
    l_quantity + CASE WHEN l_suppkey % 4 = 0 THEN 0.5 ELSE 0.02 END AS area, CASE WHEN l_linenumber < 4 THEN 1 ELSE 2 END AS page FROM lines),
  known AS (SELECT DISTINCT project, line AS other, CASE WHEN l_linenumber < 4 THEN 'verdieping 1' ELSE 'fase 2 verdieping 1' END AS target, '0.0' || CASE WHEN l_linenumber < 4 THEN l_linenumber ELSE l_linenumber - 3 * (l_suppkey % 2) END AS nb, name AS mb, l_quantity AS ab FROM lines),
  p AS (SELECT d.*, target, other, nb, number = nb AS n, name <> 'ruimte' AND mb <> 'ruimte' AND (name = mb OR (least(length(name), length(mb)) >= 5 AND (contains(name, mb) OR contains(mb, name) OR levenshtein(name, mb) <= 1))) AS m,
    round(abs(area - ab), 6) <= 0.05 AS a, round(abs(area - ab), 6) AS off FROM drawn AS d JOIN known AS k ON d.project = k.project WHERE name <> 'ruimte'),
  s AS (SELECT *, NOT m AS conflict, CASE WHEN n AND NOT m AND NOT a THEN 10.0 WHEN n AND m AND a THEN 100.0 WHEN n AND m THEN 85.0 WHEN m AND a THEN 80.0 WHEN n AND NOT m THEN 15.0 WHEN m THEN 40.0 WHEN a THEN 25.0 END AS raw FROM p WHERE n OR m OR a),
  b AS (SELECT *, raw >= 70 AS strong FROM (SELECT *, row_number() OVER (PARTITION BY project, id, target ORDER BY score DESC, off, other) AS rn FROM (SELECT *, CAST(raw AS DOUBLE) + greatest(0.0::DOUBLE, 5.0::DOUBLE - least(5.0::DOUBLE, off * 20)) AS score FROM s)) WHERE rn = 1),
  x AS (SELECT * FROM b WHERE strong AND target <> 'verdieping 1'),
  v AS (SELECT project, page, target, sum(CASE WHEN n AND m AND a THEN 2 ELSE 1 END) AS votes FROM x WHERE a GROUP BY ALL HAVING votes >= 2),
  c AS (SELECT * FROM b WHERE target = 'verdieping 1')"""


@query(f"""WITH {_LINES}, {_SECTION},
  j AS (SELECT d.project, d.id, d.number, x.target, x.n AND x.m AND x.a AS triple, x.score, x.nb, x.n, x.m, x.a, v.target IS NOT NULL AS page_section, coalesce(c.strong, false) AS strong, coalesce(c.score, 0) AS now_score, coalesce(c.conflict, false) AS conflict
    FROM drawn AS d LEFT JOIN x ON x.project = d.project AND x.id = d.id LEFT JOIN v ON v.project = d.project AND v.page = d.page LEFT JOIN c ON c.project = d.project AND c.id = d.id),
  k AS (SELECT *, target IS NOT NULL AND NOT (strong AND now_score >= score) AND NOT (strong AND NOT conflict AND NOT page_section) AND NOT (NOT page_section AND NOT triple AND NOT conflict) AS moved FROM j)
  SELECT project, id, CASE WHEN moved THEN target ELSE 'verdieping 1' END AS floor, CASE WHEN moved THEN 'verdieping 1' END AS moved_from, CASE WHEN moved AND NOT n AND m AND a THEN nb ELSE number END AS number, moved AND page_section AS by_page FROM k""")
def section_storeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn rooms of a storey, of which a part is a second phase: those that are that part's go there."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    n, m, sk = F.col("l_linenumber"), F.col("m"), F.col("l_suppkey")
    # a line is sent with no more than it is told from
    told = li.select(F.col("l_orderkey").alias("project"), n, "l_partkey", sk, F.floor(F.col("l_extendedprice") * 100).alias("cents"), "l_quantity", F.when(F.col("l_tax") < 0.06, n).otherwise(8 - n).alias("m"), (F.col("l_discount") < 0.08).alias("named"))
    own = told.join(p, told["l_partkey"] == p["p_partkey"]).select(*told.columns, F.col("p_name").alias("name")).repartition(tasks_for(li), "project")
    number = lambda c: F.concat(F.lit("0.0"), c.cast("string"))
    line = F.concat_ws("-", "project", n, "l_partkey", sk, "cents").alias("id")
    drawn = F.struct(line, F.lit("Verdieping 1").alias("floor"), number(m).alias("number"), F.when(F.col("named"), F.col("name")).otherwise("ruimte").alias("name"), (F.col("l_quantity") + F.when(sk % 4 == 0, 0.5).otherwise(0.02)).alias("area"), F.when(n < 4, 1).otherwise(2).alias("page"))
    room = F.struct(line, F.when(n < 4, "Verdieping 1").otherwise("Fase 2 verdieping 1").alias("floor"), number(F.when(n < 4, n).otherwise(n - 3 * (sk % 2))).alias("number"), "name", F.col("l_quantity").alias("area"))
    large = li.groupBy(F.col("l_orderkey").alias("project")).count().where(F.col("count") > FEW_ROOMS).select("project")
    return room_sources.storeys_of_rows(own.select("project", drawn.alias("drawn"), room.alias("room")), large).withColumn("number", F.lower("number"))

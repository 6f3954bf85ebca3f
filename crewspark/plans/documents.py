"""Imported documents: kinds, roles, styles of drawings and the closing of imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewspark.operators import documents
from crewspark.plans.production import LINES, lines
from crewspark.plans.registry import query, table
from crewspark.storage import tasks_for

#: Names and texts of the files that orders stand for.
STEMS = ("Snijmaten", "snijmaat-lijst", "MaterialList", "materialen_lijst", "Plattegrond", "floor plan", "afmetingen", "Meetbon", "kalkulatie", "scan")
BODIES = (
    "too short",
    "Meetstaat werknr 12 Bouwlaag: begane grond",
    "overzicht zaagmaat per ruimte en baan",
    "Material  list of the second storey",
    "bouwlaag 1: 00.12 kantoor Marmoleum 12,5 m²",
    "Netto: 120 vinyl op de hele storey",
    "legenda schaal 1:100 kantoor 0.12a 14 m2",
    "begane grond 1-04 hal tapijt zonder maten",
    "bouwlaag 2, 2.101 hal 30 m2 zonder soort",
    "nummer, naam, verdieping, soort vloer",
    "een brief over de planning en de kleur",
)


def _listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


FILES = f"""files AS (SELECT o_orderkey AS id, {_listed(STEMS)}[o_orderkey % {len(STEMS)} + 1] || ' ' || o_custkey || '.pdf' AS name, {_listed(BODIES)}[o_custkey % {len(BODIES)} + 1] AS body,
  CASE o_orderpriority WHEN '5-LOW' THEN ' Plattegrond' WHEN '2-HIGH' THEN 'calculatie' WHEN '3-MEDIUM' THEN 'letter' END AS hint, o_orderkey % 11 = 0 AS sheet FROM orders),
 marks AS (SELECT *, lower(body) AS t, regexp_matches(lower(body), '(^|[^0-9])[0-9]{{1,2}}[.-][0-9]{{1,3}}[a-z]?($|[^0-9.-])') AS rooms, regexp_matches(lower(body), '[0-9] *m(²|2\\b)') AS areas,
  regexp_matches(lower(body), 'marmoleum|plint|linoleum|pvc|gietvloer|tapijt|vinyl|coral') AS product, contains(lower(body), 'meetstaat') OR contains(lower(body), 'bouwlaag') AS words FROM files),
 said AS (SELECT *, CASE WHEN length(t) < 20 THEN 'overig-' WHEN contains(t, 'meetstaat') AND contains(t, 'bouwlaag:') AND regexp_matches(t, 'werknr|opdrachtgever') THEN 'meetstaat+' WHEN regexp_matches(t, 'snijmaa?t|snijlijst|zaagmaat') THEN 'snijmaten+'
   WHEN regexp_matches(t, 'material(en|i?aal)staat|material\\s*list') THEN 'materialenstaat+' WHEN rooms AND areas AND product AND words THEN 'meetstaat+' WHEN regexp_matches(t, '\\b(netto|bruto)\\s*:') AND product AND NOT rooms THEN 'materialenstaat+'
   WHEN rooms AND areas AND NOT words THEN 'plattegrond+' WHEN rooms AND product AND regexp_matches(t, 'bouwlaag|begane grond|verdieping') THEN 'snijmaten-' WHEN rooms AND areas THEN 'plattegrond-'
   WHEN regexp_matches(t, '\\b(nummer|naam),') THEN 'meetstaat+' ELSE 'overig-' END AS told, CASE WHEN name LIKE 'Snijma%' OR name LIKE 'snijma%' THEN 'snijmaten' WHEN name LIKE 'Material%' OR name LIKE 'materialen%' THEN 'materialenstaat'
   WHEN name LIKE 'Platte%' OR name LIKE 'floor%' THEN 'plattegrond' WHEN name LIKE 'afm%' THEN 'afmetingen' WHEN name LIKE 'Meetb%' THEN 'meetstaat' WHEN name LIKE 'kalk%' THEN 'calculatie' END AS named,
   CASE WHEN hint IN (' Plattegrond', 'calculatie') THEN lower(trim(hint)) END AS wish FROM marks),
 kinds AS (SELECT *, CASE WHEN sheet THEN 'calculatie' WHEN wish IS NOT NULL THEN wish WHEN told LIKE '%+' THEN left(told, -1) ELSE coalesce(named, left(told, -1)) END AS kind,
   CASE WHEN sheet THEN CASE WHEN wish = 'calculatie' THEN 'manual' ELSE 'high' END WHEN wish IS NOT NULL THEN 'manual' WHEN told LIKE '%+' OR named IS NOT NULL THEN 'high' ELSE 'low' END AS confidence FROM said)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    priority = F.col("o_orderpriority")
    hint = F.when(priority == "5-LOW", " Plattegrond").when(priority == "2-HIGH", "calculatie").when(priority == "3-MEDIUM", "letter")
    name = F.concat(_pick(STEMS, F.col("o_orderkey")), F.lit(" "), "o_custkey", F.lit(".pdf"))
    own = o.select(F.col("o_orderkey").alias("id"), name.alias("name"), _pick(BODIES, F.col("o_custkey")).alias("body"), hint.alias("hint"), (F.col("o_orderkey") % 11 == 0).alias("sheet"))
    return documents.classified(own, "name", "body", F.col("sheet"), F.col("hint"))


@query(f"WITH {FILES} SELECT id, kind, confidence FROM kinds")
def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven kinds of documents, by cost sheet, hint, text and name."""
    return files(spark, sf_dir).select("id", "kind", "confidence")


@query(f"""WITH {FILES}, r AS (SELECT id, kind = 'plattegrond' OR id % 7 = 0 OR contains(t, 'legenda') OR contains(t, 'schaal') AS drawing, id % 7 = 0 OR contains(t, 'legenda') OR contains(t, 'kleur') AS colors,
   kind = 'meetstaat' OR id % 5 = 0 OR contains(t, 'meetstaat werknr') AS takeoff, id % 3 = 0 OR regexp_matches(t, '\\b(netto|bruto|totaal)\\b') AS totals, kind = 'materialenstaat' AS listed, kind = 'snijmaten' OR contains(t, 'zaagmaat') AS cut FROM kinds)
  SELECT id, concat_ws(',', CASE WHEN drawing THEN 'ROOM_SOURCE' END, CASE WHEN drawing AND colors THEN 'DRAWING_LEGEND_SOURCE' END, CASE WHEN takeoff THEN 'TASK_SOURCE' END, CASE WHEN takeoff AND totals OR listed THEN 'MATERIAL_TOTAL_SOURCE' END,
  CASE WHEN cut THEN 'MATERIAL_ROOM_HINT_SOURCE' END) AS roles FROM r""")
def document_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of each document, by its kind, its text and what was read from it."""
    each = lambda n: F.col("id") % n == 0
    roles = documents.roles(F.col("kind"), F.col("body"), each(5), each(7), each(3))
    return files(spark, sf_dir).select("id", F.array_join(roles, ",").alias("roles"))


@query(f"""WITH {LINES}, r AS (SELECT project, CASE WHEN q > 15 THEN CAST(room AS VARCHAR) END AS number, CASE WHEN q > 40 THEN CAST(room AS VARCHAR) WHEN item % 3 > 0 THEN 'hall' ELSE ' ' END AS name, CASE WHEN kind = 'N' THEN q END AS area, CASE WHEN document = 'O' AND kind <> 'N' THEN '#112233' END AS color FROM lines),
  c AS (SELECT project, count(*) AS rooms, count(number) AS numbers, count(*) FILTER (WHERE trim(name) <> '' AND trim(name) IS DISTINCT FROM number) AS names, count(area) AS areas, count(color) AS colors FROM r GROUP BY 1)
  SELECT *, CASE WHEN numbers / rooms >= 0.5 AND names / rooms >= 0.5 AND areas / rooms < 0.35 THEN 'number_name_only' WHEN numbers / rooms >= 0.5 AND names / rooms >= 0.4 THEN 'number_name_meters'
    WHEN numbers / rooms < 0.35 AND names / rooms >= 0.5 AND (areas / rooms >= 0.5 OR colors / rooms >= 0.4 OR project % 9 = 0) THEN 'name_meters_color' WHEN names / rooms >= 0.5 AND areas / rooms >= 0.5 THEN 'name_meters_color' ELSE 'mixed' END AS style FROM c""")
def drawing_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the rooms of each page are labelled."""
    room = F.col("room").cast("string")
    name = F.when(F.col("q") > 40, room).when(F.col("item") % 3 > 0, "hall").otherwise(" ")
    color = F.when((F.col("document") == "O") & (F.col("kind") != "N"), "#112233")
    r = lines(spark, sf_dir).select("project", F.when(F.col("q") > 15, room).alias("number"), name.alias("name"), F.when(F.col("kind") == "N", F.col("q")).alias("area"), color.alias("color"))
    return documents.drawing_styles(r, ["project"], F.col("project") % 9 == 0)


IMPORTS = f"""{LINES}, area AS (SELECT project, sum(q) FILTER (WHERE kind = 'N') AS area FROM lines GROUP BY 1),
 imports AS (SELECT o_orderkey AS import_id, o_orderstatus = 'F' AS measured, o_orderstatus = 'O' AS listed, o_orderpriority = '1-URGENT' AS drawn, CASE WHEN o_orderkey % 7 > 0 THEN coalesce(area, 0) + CASE WHEN o_orderkey % 3 = 0 THEN 0.03 ELSE 0 END END AS expected,
   coalesce(area, 0) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS parsed, coalesce(area, 0) AS area FROM orders LEFT JOIN area ON o_orderkey = project),
 rooms AS (SELECT project AS import_id, room, CASE WHEN room = 7 THEN ' Onbekend' ELSE 'verdieping ' || room END AS floor, CASE WHEN max(q) >= 10 THEN 'hoog' ELSE 'controleren' END AS confidence, ['plattegrond', 'meetstaat', 'snijmaten'][room % 3 + 1] AS source, CASE WHEN room = 5 THEN '#112233' END AS color FROM lines GROUP BY 1, 2),
 tasks AS (SELECT project AS import_id, room, CASE kind WHEN 'A' THEN '' WHEN 'R' THEN 'Plint ' || item ELSE 'vloer ' || item END AS name, CASE WHEN kind = 'R' THEN 'm1' ELSE 'm2' END AS unit, CASE WHEN kind = 'A' AND q < 20 THEN 0 ELSE q END AS quantity FROM lines),
 totals AS (SELECT project AS import_id, 'material' AS kind, document AS label, sum(q) AS calculated, sum(q) + CASE WHEN project % 3 = 0 AND document = 'O' THEN 0.03 WHEN project % 8 = 1 THEN 5 ELSE 0 END AS declared, CASE WHEN project % 4 = 1 THEN 'check' ELSE 'ok' END AS status, project % 16 = 1 AS accepted FROM lines WHERE kind = 'N' GROUP BY 1, 3
   UNION ALL SELECT project, 'floor', CAST(room AS VARCHAR), sum(q), sum(q) + CASE WHEN project % 6 = 0 THEN 0.01 ELSE 0 END, 'ok', NULL FROM lines GROUP BY 1, 3
   UNION ALL SELECT project, 'legend', document, sum(q), CASE WHEN project % 10 > 0 THEN sum(q) + 1 END, 'check', project % 2 = 0 FROM lines GROUP BY 1, 3),
 notes AS (SELECT o_orderkey AS import_id, CASE o_orderstatus WHEN 'F' THEN 'header' WHEN 'O' THEN 'uncertain' ELSE 'duplicate' END AS kind, 'line ' || o_custkey AS label, o_orderpriority = '5-LOW' AS resolved FROM orders WHERE o_orderkey % 13 = 0),
 by_room AS (SELECT import_id, room, count(*) FILTER (WHERE name LIKE 'vloer%') AS floorings, count(*) FILTER (WHERE name = '' AND quantity > 0) AS unnamed FROM tasks GROUP BY 1, 2),
 own AS (SELECT * FROM rooms JOIN by_room USING (import_id, room) JOIN imports USING (import_id)),
 rest AS (SELECT import_id, sum(calculated - declared) AS residual, max(abs(calculated - declared)) AS most FROM totals WHERE kind = 'material' AND NOT accepted GROUP BY 1),
 sums AS (SELECT *, import_id IN (SELECT import_id FROM rooms) AS has_rooms, area - expected AS over FROM imports LEFT JOIN rest USING (import_id)),
 issues AS (SELECT import_id, 'rooms' AS category, 'warning' AS severity FROM own WHERE confidence = 'controleren' UNION ALL SELECT import_id, 'floors', 'warning' FROM own WHERE room = 7
   UNION ALL SELECT import_id, 'materials', 'warning' FROM own WHERE unnamed > 0 OR floorings = 0 AND NOT measured AND (listed OR color IS NOT NULL) UNION ALL SELECT import_id, 'drawing', 'warning' FROM own WHERE drawn AND source = 'snijmaten' AND color IS NULL
   UNION ALL SELECT import_id, 'tasks', 'warning' FROM tasks WHERE name = '' AND quantity > 0
   UNION ALL SELECT import_id, CASE kind WHEN 'material' THEN 'quantities' ELSE kind END, 'warning' FROM totals WHERE kind <> 'floor' AND accepted IS DISTINCT FROM true AND status = 'check' AND (declared IS NULL OR abs(calculated - declared) > 0.05)
   UNION ALL SELECT import_id, 'floors', 'warning' FROM totals WHERE kind = 'floor' AND abs(calculated - declared) > 0.005
   UNION ALL SELECT import_id, CASE kind WHEN 'header' THEN 'project_header' ELSE 'source_rules' END, 'warning' FROM notes WHERE NOT resolved UNION ALL SELECT import_id, 'task_source', 'technical' FROM sums WHERE parsed - area > 0.05
   UNION ALL SELECT import_id, 'technical', 'technical' FROM sums WHERE measured AND NOT has_rooms UNION ALL SELECT import_id, 'quantities', 'warning' FROM sums WHERE expected IS NULL AND (measured OR listed)
   UNION ALL SELECT import_id, 'quantities', 'warning' FROM sums WHERE abs(over) > 0.005 AND NOT coalesce(most <= 0.05 AND most > 0.005 AND abs(over) <= 0.05 AND abs(residual - over) <= 0.005, false))"""


def imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as imports, and their open issues."""
    heads, rooms, tasks, totals, notes = import_tables(spark, sf_dir)
    return heads, documents.closure_issues(heads, rooms, tasks, totals, notes)


def import_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as imports, with their rooms, tasks, totals and notes.  Lines and orders are dealt by import into tasks of bounded
    rows, so that what is grouped or joined by import isn't shuffled again."""
    parts, exact = tasks_for(table(spark, sf_dir, "lineitem")), "decimal(14,2)"
    li = lines(spark, sf_dir).withColumnRenamed("project", "import_id").repartition(parts, "import_id")
    o = table(spark, sf_dir, "orders")
    key, status, priority, kind, q = F.col("import_id"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("kind"), F.col("q")
    plus = lambda condition, value: F.when(condition, F.lit(value)).otherwise(F.lit("0")).cast(exact)
    net = F.when(kind == "N", q)
    by_document = li.groupBy("import_id", F.col("document").alias("label")).agg(F.count_if(kind == "N").alias("n"), F.sum(net).alias("m"), F.sum("q").cast(exact).alias("l"))
    area = by_document.groupBy("import_id").agg(F.sum("m").alias("a"))
    known = F.coalesce("a", F.lit(0).cast(exact))
    heads = o.withColumnRenamed("o_orderkey", "import_id").repartition(parts, "import_id").join(area, "import_id", "left").select(
        "import_id", (status == "F").alias("measured"), (status == "O").alias("listed"), (priority == "1-URGENT").alias("drawn"),
        F.when(key % 7 > 0, known + plus(key % 3 == 0, "0.03")).alias("expected"), (known + plus(key % 5 == 0, "1")).alias("parsed"),
    )
    room = F.col("room")
    rooms = li.groupBy("import_id", "room").agg(F.when(F.max("q") >= 10, "hoog").otherwise("controleren").alias("confidence")).withColumns({
        "floor": F.when(room == 7, " Onbekend").otherwise(F.concat(F.lit("verdieping "), room)), "source": _pick(("plattegrond", "meetstaat", "snijmaten"), room), "color": F.when(room == 5, "#112233"),
    })
    name = F.when(kind == "A", "").when(kind == "R", F.concat(F.lit("Plint "), "item")).otherwise(F.concat(F.lit("vloer "), "item"))
    tasks = li.select("import_id", "room", name.alias("name"), F.when(kind == "R", "m1").otherwise("m2").alias("unit"), F.when((kind == "A") & (q < 20), 0).otherwise(q).alias("quantity"))
    m, l = F.col("m").cast(exact), F.col("l")  # noqa: E741
    more = F.when((key % 3 == 0) & (F.col("label") == "O"), "0.03").when(key % 8 == 1, "5").otherwise("0").cast(exact)
    total = lambda n, k, calculated, declared, status, accepted: F.struct(n.alias("n"), F.lit(k).alias("kind"), calculated.alias("calculated"), declared.alias("declared"), F.lit(status).alias("status"), accepted.alias("accepted"))
    checked = F.when(key % 4 == 1, "check").otherwise("ok")
    material, legend = total(F.col("n"), "material", m, m + more, checked, key % 16 == 1), total(F.lit(1), "legend", l, F.when(key % 10 > 0, l + 1), "check", key % 2 == 0)
    totals = by_document.select("import_id", "label", F.inline(F.array(material, legend))).where("n > 0").drop("n")
    floors = li.groupBy("import_id", "room").agg(F.sum("q").cast(exact).alias("calculated")).select(
        "import_id", F.col("room").cast("string").alias("label"), F.lit("floor").alias("kind"), "calculated", (F.col("calculated") + plus(key % 6 == 0, "0.01")).alias("declared"),
        F.lit("ok").alias("status"), F.lit(None).cast("boolean").alias("accepted"),
    )
    notes = o.where("o_orderkey % 13 = 0").select(
        F.col("o_orderkey").alias("import_id"), F.when(status == "F", "header").when(status == "O", "uncertain").otherwise("duplicate").alias("kind"),
        F.concat(F.lit("line "), "o_custkey").alias("label"), (priority == "5-LOW").alias("resolved"),
    )
    return heads, rooms, tasks, totals.unionByName(floors), notes


@query(f"WITH {IMPORTS} SELECT category, severity, count(*) AS n, count(DISTINCT import_id) AS imports FROM issues GROUP BY 1, 2")
def closure_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of all imports by category and severity."""
    return imports(spark, sf_dir)[1].groupBy("category", "severity").agg(F.count("*").alias("n"), F.countDistinct("import_id").alias("imports"))


@query(f"""WITH {IMPORTS}, c AS (SELECT import_id, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'technical') AS technical, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM issues GROUP BY 1)
  SELECT import_id, coalesce(warnings, 0) AS warnings, coalesce(technical, 0) AS technical, coalesce(categories, '') AS categories, CASE WHEN technical > 0 THEN 'TECHNICAL_ERROR' WHEN warnings > 0 THEN 'READY_WITH_WARNINGS' ELSE 'READY' END AS decision FROM imports LEFT JOIN c USING (import_id)""")
def import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each import may close."""
    return documents.closure(*imports(spark, sf_dir))


@query(f"""WITH {IMPORTS}, r AS (SELECT import_id, count(*) AS n, count(*) FILTER (confidence = 'controleren') AS open, count(*) FILTER (room = 7) AS lost, count(*) FILTER (unnamed > 0 OR floorings = 0 AND NOT measured AND (listed OR color IS NOT NULL)) AS unknown,
    count(*) FILTER (drawn AND source = 'snijmaten' AND color IS NULL) AS loose FROM own GROUP BY 1),
  m AS (SELECT import_id, count(*) FILTER (kind = 'material') AS n, count(*) FILTER (kind = 'material' AND accepted IS DISTINCT FROM true AND status = 'check' AND abs(calculated - declared) > 0.05) AS bad, count(*) FILTER (kind = 'floor' AND abs(calculated - declared) > 0.005) AS storeys FROM totals GROUP BY 1),
  t AS (SELECT import_id, count(*) FILTER (name LIKE 'vloer%') AS n, count(*) FILTER (name = '' AND quantity > 0) AS open FROM tasks GROUP BY 1),
  x AS (SELECT s.import_id AS import_id, drawn, coalesce(r.n, 0) AS rn, coalesce(r.open, 0) AS ro, coalesce(lost, 0) AS lost, coalesce(unknown, 0) AS unknown, coalesce(loose, 0) AS loose, coalesce(m.n, 0) AS mn, coalesce(bad, 0) AS bad, coalesce(storeys, 0) AS storeys, coalesce(t.n, 0) AS tn, coalesce(t.open, 0) AS topen,
    expected IS NULL AND (measured OR listed) OR coalesce(abs(over) > 0.005 AND NOT coalesce(most <= 0.05 AND most > 0.005 AND abs(over) <= 0.05 AND abs(residual - over) <= 0.005, false), false) AS unclosed
    FROM sums AS s LEFT JOIN r ON r.import_id = s.import_id LEFT JOIN m ON m.import_id = s.import_id LEFT JOIN t ON t.import_id = s.import_id)
  SELECT import_id, {", ".join(f"CAST(floor(100 * greatest(0, {a}) / greatest({b}, 1)::DOUBLE + 0.5) AS INTEGER) AS {n}" for n, a, b in (("rooms", "rn - ro", "rn"), ("materials", "greatest(mn, rn) - unknown - bad", "greatest(mn, rn)"), ("tasks", "tn - topen", "tn"), ("floors", "rn - lost", "rn")))},
    CASE WHEN bad + storeys = 0 AND NOT unclosed THEN 100 ELSE 0 END AS quantities, CASE WHEN drawn THEN CAST(floor(100 * (rn - loose) / greatest(rn, 1)::DOUBLE + 0.5) AS INTEGER) ELSE 100 END AS drawing FROM x""")
def closure_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each import is closed, by part."""
    heads, rooms, tasks, totals, _ = import_tables(spark, sf_dir)
    return documents.closure_shares(heads, rooms, tasks, totals)


@query(f"""WITH {IMPORTS}, k AS (SELECT category, severity, count(*) AS n FROM issues WHERE category IN ('rooms', 'drawing', 'tasks', 'legend', 'task_source') GROUP BY 1, 2)
  SELECT CASE category WHEN 'rooms' THEN 'correct or confirm the room' WHEN 'drawing' THEN 'link an outline or a colour, or confirm by hand' WHEN 'tasks' THEN 'give material and quantity, or remove the line'
    WHEN 'legend' THEN 'check the material''s link or the quantities of the storey' ELSE 'keep all tasks of the take-off' END AS suggestion, severity, n FROM k""")
def closure_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be done about open points of five categories, and how often."""
    told = documents.with_suggestions(imports(spark, sf_dir)[1]).where(F.col("category").isin("rooms", "drawing", "tasks", "legend", "task_source"))
    return told.groupBy("suggestion", "severity").agg(F.count("*").alias("n"))

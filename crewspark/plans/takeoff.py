"""Take-off totals, room pivots, diffs, texts, matches, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewspark.functions import geometry, numbers, text
from crewspark.operators import matching, reconcile, sequences
from crewspark.plans.production import LINES, lines, number
from crewspark.plans.registry import money, query, table
from crewspark.storage import tasks_for


@query(f"""WITH {LINES}, flagged AS (SELECT DISTINCT project, room FROM lines WHERE kind = 'R' AND q > 48)
  SELECT lower(p_brand) AS code, kind AS unit, CAST(sum(q) AS DOUBLE) AS quantity, count(*) AS n FROM lines l JOIN part ON item = p_partkey
  WHERE NOT EXISTS (SELECT 1 FROM flagged f WHERE f.project = l.project AND f.room = l.room) GROUP BY 1, 2""")
def group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = lines(spark, sf_dir)
    flagged = li.where("kind = 'R' AND q > 48").select("project", "room").distinct()
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.lower("p_brand").alias("code"))
    n, room = tasks_for(li), ["project", "room"]
    own = li.repartition(n, *room).join(flagged.repartition(n, *room), room, "left_anti").groupBy("item", F.col("kind").alias("unit")).agg(F.sum("q").alias("q"), F.count("*").alias("n"))
    return own.join(p, "item").groupBy("code", "unit").agg(number(F.sum("q")).alias("quantity"), F.sum("n").alias("n"))


@query(f"""WITH {LINES} SELECT project, room, CAST(max(q) FILTER (WHERE kind = 'N') AS DOUBLE) AS floor_area, CAST(sum(q) FILTER (WHERE kind = 'A') AS DOUBLE) AS skirting,
  array_to_string(list_sort(list(DISTINCT item)), ',') AS items, CASE WHEN count(*) FILTER (WHERE kind = 'N') = 0 THEN 'no floor' WHEN count(*) FILTER (WHERE kind = 'A') = 0 THEN 'no skirting' ELSE 'complete' END AS status FROM lines GROUP BY 1, 2""")
def room_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    floor, skirting = F.col("kind") == "N", F.col("kind") == "A"
    status = F.when(F.count(F.when(floor, 1)) == 0, "no floor").when(F.count(F.when(skirting, 1)) == 0, "no skirting").otherwise("complete")
    items = F.array_join(F.transform(F.array_sort(F.collect_set("item")), lambda i: i.cast("string")), ",")
    return lines(spark, sf_dir).groupBy("project", "room").agg(number(F.max(F.when(floor, F.col("q")))).alias("floor_area"), number(F.sum(F.when(skirting, F.col("q")))).alias("skirting"), items.alias("items"), status.alias("status"))


@query("""WITH n AS (SELECT p_brand, count(DISTINCT p_type) AS kinds FROM part GROUP BY 1)
  SELECT CASE WHEN kinds > 3 THEN p_brand || '/' || p_type ELSE p_brand END AS key, count(*) AS n, CAST(sum(CAST(p_retailprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM part JOIN n USING (p_brand) GROUP BY 1""")
def ambiguous_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand is one group, or one for each type if it has more than three."""
    leaf = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.sum(money("p_retailprice")).alias("t"))
    kinds = leaf.groupBy("p_brand").agg(F.count("*").alias("kinds"))
    key = F.when(F.col("kinds") > 3, F.concat_ws("/", "p_brand", "p_type")).otherwise(F.col("p_brand"))
    return leaf.join(kinds, "p_brand").groupBy(key.alias("key")).agg(F.sum("n").alias("n"), number(F.sum("t")).alias("total"))


@query(f"""WITH {LINES}, a AS (SELECT project, item, sum(q) AS q, max(kind) AS kind FROM lines WHERE room <> 7 GROUP BY 1, 2),
  b AS (SELECT project, item, sum(CASE WHEN room = 3 THEN q + 1 ELSE q END) AS q, max(kind) AS kind FROM lines WHERE room <> 1 GROUP BY 1, 2)
  SELECT coalesce(a.project, b.project) AS project, coalesce(a.item, b.item) AS item,
  CASE WHEN a.project IS NULL THEN 'new' WHEN b.project IS NULL THEN 'removed' WHEN abs(a.q - b.q) < 0.005 AND a.kind = b.kind THEN 'unchanged' ELSE 'changed' END AS state,
  CAST(a.q AS DOUBLE) AS old_q, CAST(b.q AS DOUBLE) AS new_q FROM a FULL JOIN b ON a.project = b.project AND a.item = b.item""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = lines(spark, sf_dir)
    old = li.where("room <> 7").groupBy("project", "item").agg(F.sum("q").alias("q"), F.max("kind").alias("kind"))
    new = li.where("room <> 1").groupBy("project", "item").agg(F.sum(F.when(F.col("room") == 3, F.col("q") + 1).otherwise(F.col("q"))).alias("q"), F.max("kind").alias("kind"))
    d = reconcile.snapshot_diff(old, new, ["project", "item"], ["q"], ["kind"])
    return d.select("project", "item", "state", number("old_q").alias("old_q"), number("new_q").alias("new_q"))


@query("""WITH p AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
  m AS (SELECT a.id, b.id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, a.label FROM p a JOIN p b ON a.label = b.label AND a.id % 2 = 0 AND b.id % 2 = 1)
  SELECT label, id, arg_min(other, {'d': d2, 'o': other}) AS other FROM m WHERE d2 < 0.18 * 0.18 GROUP BY 1, 2""")
def nearest_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    p = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"))
    return matching.nearest_within(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ["label"], 0.18).select("label", "id", "other")


@query("""WITH p AS (SELECT vec_id, list_transform(range(len(embedding) // 2), lambda i: CAST(embedding[2 * i + 1] AS DOUBLE)) AS x, list_transform(range(len(embedding) // 2), lambda i: CAST(embedding[2 * i + 2] AS DOUBLE)) AS y, len(embedding) // 2 AS n FROM embeddings WHERE len(embedding) >= 6),
  e AS (SELECT vec_id, unnest(range(n)) AS i, x[i + 1] AS x0, y[i + 1] AS y0, x[(i + 1) % n + 1] AS x1, y[(i + 1) % n + 1] AS y1 FROM p)
  SELECT vec_id, abs(list_reduce(list(x0 * y1 - x1 * y0 ORDER BY i), lambda a, b: a + b)) / 2 AS area, count(*) FILTER (WHERE (y0 > 0) <> (y1 > 0) AND 0 < (x1 - x0) * (0 - y0) / (y1 - y0) + x0) % 2 = 1 AS holds_origin FROM e GROUP BY 1""")
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the polygon whose corners are a vector's consecutive pairs, and whether it holds (0, 0)."""
    v = F.col("embedding")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda i: F.struct(F.get(v, 2 * i).cast("double").alias("x"), F.get(v, 2 * i + 1).cast("double").alias("y")))
    p = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 6).select("vec_id", pairs.alias("points"))
    return p.select("vec_id", geometry.polygon_area(F.col("points")).alias("area"), geometry.inside(F.col("points"), F.lit(0.0), F.lit(0.0)).alias("holds_origin"))


@query("""SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS total, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices printed as "1.234,50 m2" and read back."""
    printed = F.concat(numbers.european(money("l_extendedprice")), F.lit(" m2"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.parse_number(printed).alias("v"))
    return li.groupBy("l_orderkey", "l_linenumber").agg(number(F.sum("v")).alias("total"), F.count("v").alias("n"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b([A-Z]{1,4}[0-9]{2,6})\b', 1))), ',') AS codes FROM documents""")
def product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(F.array_sort(text.product_codes(F.col("text"))), ",").alias("codes"))


@query(r"""WITH n AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\b([A-Z]?-?[0-9]{1,2}[.-][0-9]{2,3}[a-z]?)\b', 1))) AS f FROM documents)
  SELECT doc_id, array_to_string(list_filter(f, lambda x: len(list_filter(f, lambda y: y <> x AND starts_with(y, x))) = 0), ',') AS rooms FROM n WHERE len(f) > 0""")
def room_numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(text.room_numbers(F.col("text"))).alias("f"))
    return d.where(F.size("f") > 0).select("doc_id", F.array_join("f", ",").alias("rooms"))


@query(r"""WITH t AS (SELECT p_partkey AS id, unnest(list_distinct(list_filter(string_split_regex(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 4))) AS token FROM part),
  d AS (SELECT token, count(*) AS df FROM t GROUP BY 1)
  SELECT id, count(*) AS tokens, min(df) AS rarest, CAST(sum(df) AS BIGINT) AS shared FROM t JOIN d USING (token) GROUP BY 1""")
def token_overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinctive tokens of each product and how many products share them, without pairing products."""
    tokens = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(text.distinctive_tokens(F.col("p_name"))).alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df"))
    return tokens.join(df, "token").groupBy("id").agg(F.count("*").alias("tokens"), F.min("df").alias("rarest"), F.sum("df").alias("shared"))


@query("""WITH c AS (SELECT p_brand, p_partkey, p_size * 2 AS score FROM part), r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS runner_up FROM c WINDOW w AS (PARTITION BY p_brand ORDER BY score DESC, p_partkey))
  SELECT p_brand, p_partkey, CAST(score AS BIGINT) AS score, CAST(runner_up AS BIGINT) AS runner_up FROM r WHERE rn = 1 AND score >= 70 AND (runner_up IS NULL OR score - runner_up >= 2)""")
def best_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") * 2).cast("bigint").alias("score"))
    return matching.best_with_margin(c, ["p_brand"], "score", ["p_partkey"], 70, 2).select("p_brand", "p_partkey", "score", "runner_up")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
  h AS (SELECT *, last_value(CASE WHEN length(line) <= 12 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS header FROM l)
  SELECT doc_id, coalesce(header, '') AS header, count(*) AS rows, CAST(sum(length(line)) AS BIGINT) AS chars FROM h WHERE length(line) > 12 GROUP BY 1, 2""")
def header_carry_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines are headings; each other line belongs to the latest heading above it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    h = sequences.carry_down(d, ["doc_id"], "pos", F.when(F.length("line") <= 12, F.col("line")), "header")
    return h.where(F.length("line") > 12).groupBy("doc_id", F.coalesce("header", F.lit("")).alias("header")).agg(F.count("*").alias("rows"), F.sum(F.length("line")).alias("chars"))


@query(r"""SELECT page_id, CASE WHEN contains(lower(html), '<table') THEN 'table' WHEN contains(lower(html), '<article') THEN 'article' WHEN contains(lower(html), '<nav') THEN 'navigation' ELSE 'other' END AS kind,
  CAST(length(html) AS BIGINT) AS chars, CAST(len(regexp_extract_all(lower(html), '<a ')) AS BIGINT) AS links FROM pages""")
def html_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.lower("html")
    has = lambda x: F.contains(h, F.lit(x))
    kind = F.when(has("<table"), "table").when(has("<article"), "article").when(has("<nav"), "navigation").otherwise("other")
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), F.length("html").cast("bigint").alias("chars"), F.regexp_count(h, F.lit("<a ")).cast("bigint").alias("links"))


@query("""WITH RECURSIVE p AS (SELECT p_brand, p_type, p_partkey AS id, CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS cents FROM part),
  c AS (SELECT a.p_brand, a.p_type, a.id AS l, b.id AS r, abs(a.cents - b.cents) AS d, row_number() OVER (PARTITION BY a.p_brand, a.p_type ORDER BY abs(a.cents - b.cents), a.id, b.id) AS rn FROM p a JOIN p b USING (p_brand, p_type) WHERE a.id % 2 = 0 AND b.id % 2 = 1),
  g AS (SELECT p_brand, p_type, rn, l, r, d, true AS taken, [l, r] AS used FROM c WHERE rn = 1
    UNION ALL SELECT c.p_brand, c.p_type, c.rn, c.l, c.r, c.d, NOT list_has_any(g.used, [c.l, c.r]), CASE WHEN list_has_any(g.used, [c.l, c.r]) THEN g.used ELSE list_concat(g.used, [c.l, c.r]) END
    FROM g JOIN c ON g.p_brand = c.p_brand AND g.p_type = c.p_type AND c.rn = g.rn + 1)
  SELECT p_brand, CAST(l AS BIGINT) AS left_id, CAST(r AS BIGINT) AS right_id, -d / 100.0 AS score FROM g WHERE taken""")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one pairs of parts of a brand: even keys with odd ones of the same type, nearest price
    first, until no even or no odd part is left."""
    cents = (money("p_retailprice") * 100).cast("bigint")
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", F.col("p_partkey").cast("bigint").alias("id"), cents.alias("cents"), (F.col("p_partkey") % 2 == 0).alias("even"))
    pairs = sequences.nearest_pairs(p, ["p_brand", "p_type"], "even", "id", "cents")
    return pairs.select("p_brand", "left_id", "right_id", (-F.col("distance") / 100.0).alias("score"))


@query(f"""WITH {LINES}, t AS (SELECT project, sum(q) FILTER (WHERE kind = 'N') AS a, sum(q) FILTER (WHERE kind = 'A') AS b, sum(q) FILTER (WHERE kind = 'R') AS c FROM lines GROUP BY 1)
  SELECT project, CAST(coalesce(a, b, c) AS DOUBLE) AS leading, CASE WHEN a IS NOT NULL THEN 'a' WHEN b IS NOT NULL THEN 'b' ELSE 'c' END AS leading_source,
  CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT = 1 THEN 'single' WHEN greatest(a, b, c) - least(a, b, c) > 10 THEN 'differs' ELSE 'confirmed' END AS status FROM t""")
def source_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.sum(F.when(F.col("kind") == k, F.col("q")))
    t = lines(spark, sf_dir).groupBy("project").agg(part("N").alias("a"), part("A").alias("b"), part("R").alias("c"))
    return reconcile.three_sources(t, "a", "b", "c", 10).select("project", number("leading").alias("leading"), "leading_source", "status")


@query(f"""WITH {LINES}, t AS (SELECT project, count(*) AS n, sum(q) AS q, bool_or(q > 49) AS big FROM lines GROUP BY 1)
  SELECT project, CASE WHEN big THEN 'TECHNICAL_ERROR' WHEN n > 6 OR q < 20 THEN 'READY_WITH_WARNINGS' ELSE 'READY' END AS decision,
  array_to_string(list_filter([CASE WHEN n > 6 THEN 'many' END, CASE WHEN big THEN 'oversize' END, CASE WHEN q < 20 THEN 'small' END], lambda x: x IS NOT NULL), ',') AS issues FROM t""")
def import_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir).groupBy("project").agg(F.count("*").alias("n"), F.sum("q").alias("q"), F.bool_or(F.col("q") > 49).alias("big"))
    rules = {"many": ("warning", F.col("n") > 6), "oversize": ("error", F.col("big")), "small": ("warning", F.col("q") < 20)}
    return reconcile.gate(t, ["project"], rules).select("project", "decision", F.array_join("issues", ",").alias("issues"))

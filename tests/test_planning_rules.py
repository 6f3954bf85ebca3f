"""Proposals, clocks, agendas, lines of texts and labels."""

import random

from pyspark.sql import functions as F

from crewspark.functions import colors, text
from crewspark.operators import planning_rules as rules


def test_proposals_against_a_count(spark):
    rng = random.Random(4)
    rows = []
    for i in range(80):
        a = rng.randint(0, 40)
        rows.append((i % 3, i, a, a + rng.randint(1, 12), rng.randint(1, 3)))
    df = spark.createDataFrame(rows, "k long, id long, s long, e long, people long")
    planned, proposed = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    got = {r.id: (r.first_at, r.most) for r in rules.proposal_conflicts(planned, proposed, ["k"], F.col("k") + 8, 10).collect()}
    want = {}
    for k, i, s, e, n in rows:
        if i % 4 == 0:
            load = {p: n + sum(m for kk, j, a, b, m in rows if kk == k and j % 4 and a <= p < b) for p in range(s, e)}
            over = {p: v for p, v in load.items() if v > k + 8}
            if over:
                want[i] = (min(over), max(over.values()))
    assert got == want and want


def test_proposals_at_one_time_are_not_paired(spark):
    # 30,000 entries and as many proposals at one time: 900 million pairs
    ids = spark.range(60_000).select(F.lit("k").alias("k"), "id", (F.col("id") % 7).alias("s"), (F.col("id") % 7 + 100 + F.col("id") % 3).alias("e"), F.lit(1).cast("long").alias("people"))
    got = rules.proposal_conflicts(ids.where("id % 2 = 1"), ids.where("id % 2 = 0"), ["k"], F.lit(2), 200)
    assert "__bucket" not in got._jdf.queryExecution().toString()
    assert tuple(got.agg(F.count("*"), F.min("first_at"), F.max("first_at"), F.min("most"), F.max("most")).first()) == (30_000, 0, 6, 30_001, 30_001)


def test_proposals_before_after_and_between_what_is_planned(spark):
    planned = spark.createDataFrame([("k", 1, 10, 20, 2), ("k", 2, 30, 40, 5), (None, 3, 0, 50, 9)], "k string, id long, s long, e long, people long")
    cases = [("k", 11, 0, 10, 1), ("k", 12, 20, 30, 1), ("k", 13, 15, 31, 1), ("k", 14, 0, 50, 4), ("k", 15, 0, 31, 2), ("k", 16, 50, 60, 6), ("k", 17, 12, 12, 9), ("o", 18, 0, 1, 7), (None, 19, 5, 9, 8), (None, 20, 5, 9, 1)]
    proposed = spark.createDataFrame(cases, "k string, id long, s long, e long, people long")
    got = {r.id: (r.first_at, r.most) for r in rules.proposal_conflicts(planned, proposed, ["k"], F.lit(5)).collect()}
    assert got == {13: (30, 6), 14: (10, 9), 15: (30, 7), 16: (50, 6), 18: (0, 7), 19: (5, 8)}


def test_clamped_clocks(spark):
    df = spark.createDataFrame([(1, 500, 700), (2, None, 600), (3, 990, 1100)], "id long, a int, b int")
    a, b = rules.clamped(F.col("a"), F.col("b"), F.lit(480), F.lit(960))
    assert [tuple(r) for r in df.select(a, b).collect()] == [(500, 700), (480, 600), (480, 960)]


def test_lines_of_texts(spark):
    items = [(1, "hall", 0.10, 0.5, 0.05), (1, "12.5", 0.17, 0.501, 0.03), (1, "far", 0.6, 0.5, 0.05), (1, "below", 0.1, 0.7, 0.05), (2, "x", 0.1, 0.1, 0.1)]
    df = spark.createDataFrame(items, "page int, text string, x double, y double, w double")
    assert sorted((r.page, r.text) for r in rules.clustered_lines(df, ["page"]).collect()) == [(1, "below"), (1, "far"), (1, "hall 12.5"), (2, "x")]


def test_quantities_fields_and_lanes(spark):
    q = spark.createDataFrame([("a", "PVC ", 2), ("a", "pvc", 3), ("b", "x", 1), ("b", "y", 1), ("c", "z", 4)], "k string, p string, q long")
    assert {r.k: (r.q, r.articles) for r in rules.reliable_quantity(q, ["k"], "p", "q").collect()} == {"a": (5, 2), "b": (None, 2), "c": (4, 1)}
    h = spark.createDataFrame([("k", 1, None, "X"), ("k", 2, "n", "x "), ("k", 3, "m", None)], "k string, rank int, a string, b string")
    r = rules.resolved_fields(h, ["k"], "rank", ["a", "b"]).first()
    assert (r.a, r.b, r.mismatches) == ("n", "X", ["a"])
    rows = spark.createDataFrame([(1, "d", 0), (2, "d", 1), (3, "d", 2)], "id long, k string, lane int")
    assert {x.id: x.lane for x in rules.renumbered(rows, rows.where("id <> 2"), "id", ["k"], "lane").collect()} == {1: 0, 3: 1}
    assert spark.range(1).select(rules.double_factor(F.lit(4.0), F.lit(2.04)), rules.double_factor(F.lit(4.0), F.lit(0.0))).first()[:] == (True, False)


def test_labels(spark):
    t = F.lit
    glued = text.split_glued_number(t("00.12kantoor"))
    r = spark.range(1).select(glued["number"], glued["name"], text.activity_key(t(None).cast("int"), t(" M2"), t("Extra")), text.without_prefix(t("0.1 Hal: PVC"), t("0.1 hal")), text.without_prefix(t("PVC"), t("")), text.repaired_number(t("a-O1. I2")), text.finish_family(t("V2.1"))).first()
    assert tuple(r) == ("00.12", "kantoor", "custom:extra:m2", "PVC", "PVC", "A-01.12", "v2")
    a = text.address_parts(t("Lange Weg 12a, 1234 ab Stad"))
    b = text.address_parts(t("Plein 3"))
    r = spark.range(1).select(a["street"], a["number"], a["postcode"], a["town"], b["street"], b["number"], b["town"]).first()
    assert tuple(r) == ("Lange Weg", "12a", "1234AB", "Stad", "Plein", "3", None)


def test_colors_of_codes(spark):
    df = spark.createDataFrame([(c,) for c in ("V01.b", " v09 ", "", None, "x1", "X1 ", "x2")], "code string")
    got = [r[0] for r in df.select(colors.code_color(df.code)).collect()]
    assert got[:4] == ["#f38400", "#222222", None, None] and got[4] == got[5] != got[6]
    rgb = lambda c: [int(c[i : i + 2], 16) for i in (1, 3, 5)]
    for c in got[4:]:
        assert all(sum((a - b) ** 2 for a, b in zip(rgb(c), rgb(k), strict=True)) > 52**2 for k in colors.CODES.values())
    hues = spark.createDataFrame([(0, 100, 50, "#ff0000"), (120, 100, 25, "#008000"), (240, 100, 50, "#0000ff"), (300, 0, 50, "#808080"), (400, 100, 50, "#ffaa00")], "h int, s int, l int, want string")
    assert all(r[0] == r[1] for r in hues.select(colors.hsl_hex(hues.h, hues.s, hues.l), "want").collect())
    places = spark.range(12).select(colors.place_color(F.col("id"), ["#111111", "#222222"])).collect()
    assert places[1][0] == "#222222" and len({r[0] for r in places}) == 12


def test_finishes(spark):
    rows = [("v01", "V01.a", True, "v01.a"), ("v01.a", "v01", True, "v01.a"), ("v01.a", "v01.b", False, "v01.b"), ("", "v02", False, "v02"), ("v02", None, None, "v02"), ("", "", True, None)]
    df = spark.createDataFrame(rows, "a string, b string, fits boolean, kept string")
    assert all(r[0] == r[1] and r[2] == r[3] for r in df.select(text.finish_compatible(df.a, df.b), "fits", text.preferred_finish(df.a, df.b), "kept").collect())


def test_day_budgets(spark):
    cols = "id long, person long, day string, s long, e long, hours double, internal boolean"
    planned = spark.createDataFrame([(1, 1, "d", 0, 4, 4.0, False), (2, 1, "d", 10, 12, 2.0, False), (3, 2, "d", 0, 2, 2.0, True)], cols)
    wanted = spark.createDataFrame([(10, 1, "d", 2, 7, 5.0, None), (11, 1, "d", 4, 10, 8.0, None), (12, 2, "d", 1, 2, 1.0, None), (13, 3, "d", 0, 9, 9.0, None)], cols)
    got = {r.id: (r.used, r.met, r.internal) for r in rules.budget_conflicts(planned, wanted, F.lit(8), 5).collect()}
    assert got == {10: (9.0, 1, False), 12: (3.0, 1, True), 13: (9.0, 0, False)}

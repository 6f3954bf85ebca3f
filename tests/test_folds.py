"""Folds that depend on the order of rows, against plain loops; one key with many rows."""

import random

from pyspark.sql import functions as F

from crewspark.operators import assembly, reconcile, sequences


def test_memory_is_the_plain_one(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice(["a", "b", "c", None])) for k in range(40) for i in range(rng.randint(1, 8))]
    want = {}
    for k, _, role in rows:
        own = want.get(k)
        if own and own[0] == role:
            want[k] = (role, own[1] + 1)
        elif own is None or own[1] <= 1:
            want[k] = (role, 1)
    got = sequences.remembered(spark.createDataFrame(rows, "k long, at long, role string").repartition(3), ["k"], ["at"], "role")
    assert {r.k: (r.role, r.strength) for r in got.collect()} == want


def test_folds_are_the_plain_ones(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3, None]), i, rng.choice([None, rng.randint(1, 40)])) for i in range(300)]
    merged, collapsed = {}, {}
    for k, _, v in rows:
        for out, step in ((merged, lambda s, v: v if s is None else s if v is None or v <= s + 5 else v), (collapsed, lambda s, v: v if s is None else s if v is None or abs(s - v) <= 5 else s + v)):
            out[k] = step(out.get(k), v)
    df = spark.createDataFrame(rows, "k long, at long, q long").repartition(5)
    assert {r.k: r.q for r in assembly.merged_tasks(df, ["k"], ["at"], "q", 5).collect()} == merged
    assert {r.k: r.q for r in reconcile.collapse_near(df, ["k"], "at", "q", 5).collect()} == collapsed
    assert assembly.merged_tasks(df.limit(0), ["k"], ["at"], "q", 5).count() == 0


def test_one_key_with_many_rows(spark):
    n = 300_000
    df = spark.range(n).select(F.lit(1).alias("k"), "id", (F.col("id") % 1000).alias("q"), F.lit("x").alias("role"))
    merged = assembly.merged_tasks(df, ["k"], ["id"], "q", 0).first()
    assert (merged.q, merged.parts) == (999, n)
    assert sequences.remembered(df, ["k"], ["id"], "role").first().strength == n


def test_places_are_row_numbers(spark):
    from pyspark.sql import Window

    from crewspark.operators.ranking import with_place

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, None]), rng.choice([None, rng.randint(1, 30)]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, g int, at int, id int").repartition(6)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k", "g").orderBy("at", "id")))
    got = with_place(df, ["k", "g"], ["at", "id"], "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert with_place(df.limit(0), ["k"], ["id"], "n").count() == 0

"""Candidates of rooms, greedy edges, fallback joins and people against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from crewspark.operators import matching, people, rooms

ROOM = "project long, id long, room struct<floor: string, number: string, name: string, area: double, page: int, x: double, y: double>"


def some_rooms(rng, n, first):
    names = ["kantoor", "Kantoor ", "kantor", "kantoorruimte", "hal", "ruimte", "", None, "berging", "Bergging"]
    return [
        (rng.randint(1, 2), first + i, (
            rng.choice(["begane grond", "Begane grond", "verdieping 1", "onbekend", "", None]), rng.choice(["0.01", "0,02", "0.03", "", None]), rng.choice(names),
            rng.choice([None, 10.0, 10.04, 10.15, 10.2, 11.0, 12.0, 12.1, 30.0]), rng.choice([None, 0, 1, 2]), rng.choice([None, 0.0, 100.0, 120.0, 260.0]), rng.choice([0.0, 50.0, 130.0]),
        )) for i in range(n)
    ]


def test_candidates_hold_all_that_can_score(spark):
    rng = random.Random(3)
    left, right = (spark.createDataFrame(some_rooms(rng, 150, k), ROOM).cache() for k in (0, 1000))
    every = left.select("project", "id", F.col("room").alias("a")).join(right.select("project", F.col("id").alias("other"), F.col("room").alias("b")), "project")
    enough = rooms.scored(every).where("reject IS NULL AND score > 45")
    assert enough.select("project", "id", "other").exceptAll(rooms.candidates(left, right, ["project"])).count() == 0
    want = rooms.matched(rooms.scored(every), ["project", "id"], ["other"]).select("project", "id", "other", "score").collect()
    assert want and sorted(rooms.identified(left, right, ["project"]).drop("exact").collect()) == sorted(want)


def test_few_rooms_need_no_candidates(spark, monkeypatch):
    rng = random.Random(9)
    left, right = (spark.createDataFrame(some_rooms(rng, 60, k), ROOM).cache() for k in (0, 1000))
    monkeypatch.setattr(rooms, "FEW_ROOMS", 0)
    want = sorted(rooms.identified(left, right, ["project"]).collect())
    monkeypatch.setattr(rooms, "FEW_ROOMS", 64)
    monkeypatch.setattr(rooms, "candidates", None)
    assert sorted(rooms.identified(left, right, ["project"]).collect()) == want and want


def test_few_candidates_in_one_large_project(spark):
    n = 20_000
    made = spark.range(n).select(
        F.lit(1).cast("long").alias("project"), "id",
        F.struct(F.concat(F.lit("verdieping "), F.col("id") % 10).alias("floor"), F.col("id").cast("string").alias("number"), F.lit("kantoor").alias("name"), (5 + F.col("id") * 0.37 % 5000).alias("area"), F.lit(1).alias("page"), (F.col("id") % 200 * 150.0).alias("x"), (F.col("id") / 200 * 150.0).alias("y")).alias("room"),
    )
    assert rooms.candidates(made, made, ["project"]).count() < 60 * n


@pytest.mark.parametrize("seed", range(4))
def test_greedy_edges(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(rng.randint(1, 25), rng.randint(1, 25)) for _ in range(200)})
    rows = [(a, b, rng.randint(0, 6) if seed else a + b) for a, b in edges]
    taken, ends = [], set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if ("l", a) not in ends and ("r", b) not in ends:
            ends |= {("l", a), ("r", b)}
            taken.append((a, b, s))
    df = spark.createDataFrame(rows, "a long, b long, s long")
    got = matching.greedy_edges(df, "a", "b", [-F.col("s")])
    assert sorted(map(tuple, got.collect())) == sorted(taken)
    assert matching.greedy_edges(df.limit(0), "a", "b", [-F.col("s")]).count() == 0


def test_greedy_edges_of_one_hot_key_keep_many_partitions(spark):
    """A star has one edge taken, whatever its size."""
    df = spark.range(200_000).select(F.lit(1).alias("a"), F.col("id").alias("b"), F.xxhash64("id").alias("s"))
    assert matching.greedy_edges(df, "a", "b", [-F.col("s")]).count() == 1


def test_fallback_join(spark):
    left = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "y", 2), (3, None, "y", 3), (4, "c", None, 4)], "id long, k string, name string, at long")
    right = spark.createDataFrame([(11, "a", "y", 1), (12, "b", "y", 2), (13, None, None, 3)], "id long, k string, name string, at long")
    got = {r.id: (r.other, r.by) for r in matching.fallback_join(left, right, ["k"], ["name"], "at").collect()}
    assert got == {1: (11, "key"), 2: (12, "name"), 3: (None, None), 4: (None, None)}


def test_people(spark):
    rows = [(1, "Anna  de Vries"), (2, "de Vries, Anna"), (3, "Vries, A."), (4, "Anna"), (5, "Bert"), (6, "Berta Bos"), (7, "Bos, B."), (8, "Bos, Ka."), (9, "Kaat Bos, K."), (10, " "), (11, None), (12, "anna DE vries")]
    got = {r.person: (r.name, r.names, r.contacts) for r in people.merged_people(spark.createDataFrame(rows, "id long, name string")).collect()}
    want = {1: ("Anna de Vries", 4, 4), 2: ("de Vries, Anna", 1, 1), 5: ("Bert", 1, 1), 6: ("Berta Bos", 1, 1), 7: ("Bos", 1, 1), 8: ("Bos, Ka.", 2, 2)}
    assert got == want

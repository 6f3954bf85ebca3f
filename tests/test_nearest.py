"""Nearest points and smallest polygons of many rows: against the few rows' way, and how many candidates they meet."""

import random

import pytest
from pyspark.sql import functions as F

from crewspark.operators import matching


@pytest.fixture
def many(monkeypatch):
    monkeypatch.setattr(matching, "FEW_PAIRS", -1)


def nearest(left, right, radius):
    out = {}
    for k, i, x, y in left:
        near = [((x - u) * (x - u) + (y - v) * (y - v), j) for q, j, u, v in right if None not in (k, x, y, u, v) and q == k]
        near = [m for m in near if m[0] < radius * radius]
        if near:
            out[i] = min(near)
    return out


@pytest.mark.parametrize("spread", [0.001, 0.3, 3.0])
def test_nearest_of_many(spark, many, spread):
    rng = random.Random(5)
    at = lambda: rng.choice([0.0, 0.5, -0.5, rng.gauss(0, spread), rng.gauss(0, spread)])
    left, right = ([(rng.randint(1, 2), first + i, at(), at()) for i in range(400)] for first in (0, 1000))
    left += [(None, 500, 0.0, 0.0), (1, 501, None, 0.0), (1, 502, float("nan"), 0.0), (1, 503, float("inf"), 0.0), (3, 504, 0.0, 0.0)]
    right += [(None, 1500, 0.0, 0.0), (2, 1501, 0.0, None), (2, 1502, 0.0, float("nan")), (2, 1503, 0.0, float("-inf"))]
    schema = "page int, id long, x double, y double"
    got = matching.nearest_within(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["page"], 0.2).collect()
    assert {r.id: (r.d2, r.other) for r in got} == nearest(left, right, 0.2) and len({r.id for r in got}) == len(got) > 200


def test_nearest_of_one_square_meets_few_blocks(spark):
    """All points lie in one square, in two clusters of which one is tiny: candidates grow with the points, not their square."""
    at = lambda seed: F.rand(seed) * F.when(F.col("id") % 4 < 2, 0.5).otherwise(1e-5)
    p = spark.range(20_000).select(F.lit(1).alias("page"), "id", at(1).alias("x"), at(2).alias("y"))
    a, b = (matching.point_blocks(p.where(f"id % 2 = {i}"), ["page"], 1.0) for i in (0, 1))
    blocks = a.count()
    assert blocks == 10_000 / matching.BLOCK and matching.near_blocks(a, b, ["page"], 1.0).count() < 60 * blocks


def corners(*points):
    return [(float(x), float(y)) for x, y in points]


@pytest.mark.parametrize("cell", [0.01, 0.3, 50.0])
def test_smallest_polygon_of_many(spark, monkeypatch, cell):
    """Rectangles, slanted, slim and flat polygons, copies and equal areas, points on edges: as with few rows."""
    rng = random.Random(8)
    shapes = []
    for _ in range(300):
        x, y, w, h = rng.randint(0, 9), rng.randint(0, 9), rng.choice([0, 0.001, 1, 2, 5]), rng.choice([0, 1, 2, 3])
        whole = corners((x, y), (x + w, y), (x + w, y + h), (x, y + h))
        shapes.append(rng.choice([whole, whole[::-1], whole[1:] + whole[:1], whole[:3], corners((x, y), (x + 2, y + 1), (x + 1, y + 3)), whole[:2] + whole[:1:-1]]))
    polygons = spark.createDataFrame([(rng.choice([1, 2, None]), i, s) for i, s in enumerate(shapes + shapes[:50])], "page int, polygon long, points array<struct<x: double, y: double>>")
    marks = [(rng.choice([1, 2]), i, rng.choice([float(rng.randint(0, 12)), rng.uniform(0, 12)]), rng.choice([float(rng.randint(0, 12)), rng.uniform(0, 12)])) for i in range(300)]
    points = spark.createDataFrame([*marks, (None, 300, 1.0, 1.0), (1, 301, None, 1.0), (1, 302, float("nan"), 1.0)], "page int, id long, x double, y double")
    monkeypatch.setattr(matching, "FIRST_POLYGONS", 20)
    few = sorted(matching.smallest_enclosing(points, polygons, ["page"], "id", 0.5).collect())
    monkeypatch.setattr(matching, "FEW_PAIRS", -1)
    many = sorted(matching.smallest_enclosing(points, polygons, ["page"], "id", cell).collect())
    assert [tuple(r) for r in many] == [tuple(r) for r in few] and len(few) > 100


def test_points_meet_few_polygons(spark, many, monkeypatch):
    """Nested boxes around all points: a point that has the smallest ones meets no larger ones."""
    met = []
    candidates = matching.enclosing_candidates
    monkeypatch.setattr(matching, "enclosing_candidates", lambda *a: met.append(candidates(*a)) or met[-1])
    r = F.col("id") / 1000 + 1
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    polygons = spark.range(4000).select(F.lit(1).alias("page"), F.col("id").alias("polygon"), F.array(corner(-r, -r), corner(r, -r), corner(r, r), corner(-r, r)).alias("points"))
    points = spark.range(2000).select(F.lit(1).alias("page"), "id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    got = matching.smallest_enclosing(points, polygons, ["page"], "id", 0.05)
    assert {tuple(x) for x in got.select("polygon", "area").distinct().collect()} == {(0, 4.0)}
    assert sum(m.count() for m in met) <= 2000 * matching.FIRST_POLYGONS

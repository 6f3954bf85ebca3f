"""Small plane geometry on arrays of points struct<x, y>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon_area(points: Column) -> Column:
    """Shoelace area."""
    ahead = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    terms = F.zip_with(points, ahead, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def inside(points: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon, by counting the edges that a ray crosses."""
    ahead = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    crossed = F.zip_with(points, ahead, lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]) + p["x"]), 1).otherwise(0))
    return F.aggregate(crossed, F.lit(0), lambda s, t: s + t) % 2 == 1


def bounds(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1))


def hex_rgb(color: Column) -> Column:
    """#rrggbb as struct<r, g, b>."""
    part = lambda i: F.conv(F.substring(color, i, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def color_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum((F.pow(a[c] - b[c], 2) for c in "rgb"), F.lit(0.0)))


def estimated_perimeter_mm(area: Column) -> Column:
    """Perimeter of a rectangle of proportions 5 to 2, in thousandths, rounded up."""
    length = 2 * (F.sqrt(2.5 * area) + F.sqrt(area / 2.5))
    return F.ceil(length * 1000 - 1e-9).cast("bigint")

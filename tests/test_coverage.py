"""Sides of points, contained lines and meeting polygons against plain Python, with slanted, concave and holed shapes."""
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from regionflow.operators import coverage
from regionflow.operators.network import polygon_matches
from regionflow.operators.registry import fetch_in_region, scope_covers

SHAPES = {
    "box": [[(0, 0), (10, 0), (10, 10), (0, 10)]],
    "slanted": [[(2, -3), (14, 1), (9, 12), (1, 6)]],
    "concave": [[(0, 0), (12, 0), (12, 9), (8, 9), (8, 3), (4, 3), (4, 9), (0, 9)]],
    "holed": [[(-5, -5), (20, -5), (20, 15), (-5, 15)], [(3, 2), (9, 4), (5, 9)]],
    "two": [[(0, 0), (3, 0), (3, 3)], [(6, 6), (9, 6), (9, 9), (6, 9)]],
    "huge": [[(-1e9, 4), (1e9, 4), (1e9, 1e9), (-1e9, 1e9)]],
    "far": [[(1000, 1000), (1001, 1000), (1001, 1001)]],
}
KIND = "array<array<struct<x:double,y:double>>>"


def rings_of(name):
    return [[(float(x), float(y)) for x, y in [*ring, ring[0]]] for ring in SHAPES[name]]


def place(name, x, y):
    """1 inside, 0 on the border, -1 outside, in exact arithmetic."""
    x, y, odd = Fraction(x), Fraction(y), False
    for ring in rings_of(name):
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            ax, ay, bx, by = map(Fraction, (ax, ay, bx, by))
            if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return 0
            if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
                odd = not odd
    return 1 if odd else -1


@pytest.fixture(scope="module")
def polygons(spark):
    return spark.createDataFrame([(name, rings_of(name)) for name in SHAPES], f"name string, rings {KIND}")


def test_points(spark, polygons):
    rng = random.Random(1)
    points = [(x / 2, y / 2) for x in range(-12, 44) for y in range(-12, 34)]
    points += [(rng.uniform(-8, 22), rng.uniform(-8, 18)) for _ in range(500)]
    points += [p for name in SHAPES for ring in rings_of(name) for p in ring] + [(0.0, 0.0)] * 2
    frame = spark.createDataFrame([(*p, "z") for p in points] + [(None, 1.0, "z")], "x double, y double, dataset_id string")
    got = coverage.covered_points(coverage.identified(frame), coverage.ring_edges(polygons, "name"), "name")
    numbered = coverage.identified(frame)
    edges = coverage.ring_edges(polygons, "name")
    got = coverage.covered_points(numbered, edges, "name").join(numbered, "_pid").select("name", "x", "y", "inside")
    want = sorted((name, x, y, place(name, x, y) == 1) for name in SHAPES for x, y in points if place(name, x, y) >= 0)
    assert sorted(map(tuple, got.collect())) == want
    # another set of points makes another grid
    few = coverage.identified(frame.filter("x between 2 and 5 and y between 2 and 5"))
    got = coverage.covered_points(few, edges, "name").join(few, "_pid").select("name", "x", "y", "inside")
    assert sorted(map(tuple, got.collect())) == [r for r in want if 2 <= r[1] <= 5 and 2 <= r[2] <= 5]
    assert coverage.covered_points(numbered.limit(0), edges, "name").count() == 0
    assert coverage.covered_points(numbered, edges.limit(0), "name").count() == 0


def test_scope_covers_keeps_repeated_points(spark, polygons):
    points = spark.createDataFrame([(1, 4.5, 6.0), (1, 4.5, 6.0), (2, 4.0, 3.0), (3, 6.0, 3.0)], "node int, x double, y double")
    scopes = polygons.filter("name in ('concave', 'holed')").withColumnRenamed("name", "dataset_id")
    got = sorted(tuple(r) for r in scope_covers(points, scopes).select("node", "dataset_id").collect())
    # inside the concave notch and in the hole; on a slanted and on an upright border
    want = sorted((n, name) for n, x, y in [(1, 4.5, 6.0)] * 2 + [(2, 4.0, 3.0), (3, 6.0, 3.0)]
                  for name in ("concave", "holed") if place(name, x, y) >= 0)
    assert got == want and (3, "holed") in got and (2, "concave") in got


def test_contained_lines(spark, polygons):
    lines = {
        "through the notch": [(2, 6), (10, 6)], "in an arm": [(1, 1), (1, 8), (3, 8)], "around the hole": [(0, 0), (12, 1), (12, 14)],
        "over the hole": [(0, 5), (12, 5)], "on the border": [(0, 0), (10, 0)], "from border to border": [(0, 5), (10, 5)],
        "touching a corner inside": [(1, 1), (4, 3), (1, 5)], "out and in": [(5, 1), (5, -1), (6, 1)], "far": [(500, 500), (600, 600)],
        "along the border, then in": [(0, 0), (5, 0), (5, 2)], "no length": [(5, 1), (5, 1)],
    }
    streets = spark.createDataFrame([(n, [[(float(x), float(y)) for x, y in v]]) for n, v in lines.items()] + [("none", None)],
                                    f"street string, parts {KIND}")
    got = {tuple(r) for r in polygon_matches(streets, polygons, "street", "name").collect()}
    want = set()
    for n, v in lines.items():
        for name in SHAPES:
            steps = [place(name, Fraction(ax) + (Fraction(bx) - ax) * k / 2520, Fraction(ay) + (Fraction(by) - ay) * k / 2520)
                     for (ax, ay), (bx, by) in zip(v, v[1:]) for k in range(0, 2521, 5)]
            if min(steps) >= 0 and max(steps) > 0:
                want.add((n, name))
    assert got == want and ("touching a corner inside", "concave") in got and ("over the hole", "holed") not in got


def test_meeting_polygons(spark, polygons):
    hulls = {
        1: [(4.5, 4), (7.5, 4), (7.5, 8)], 2: [(5, 4), (6, 5), (5, 6)], 3: [(12, 9), (15, 9), (15, 12)], 4: [(6.5, 7), (7, 7), (7, 7.5)],
        5: [(-9, -9), (30, -9), (30, 30), (-9, 30)], 6: [(400, -50), (401, -50), (401, -49)],
    }
    table = spark.createDataFrame([(k, [[(float(x), float(y)) for x, y in [*v, v[0]]]]) for k, v in hulls.items()],
                                  f"region_id int, rings {KIND}")
    got = sorted(tuple(r) for r in fetch_in_region(polygons, table).select("name", "region_id").collect())
    want = {("box", 1), ("slanted", 1), ("holed", 1), ("two", 1), ("huge", 1),
            ("box", 2), ("slanted", 2), ("huge", 2), ("concave", 3), ("holed", 3), ("huge", 3), ("box", 4), ("slanted", 4),
            ("holed", 4), ("two", 4), ("huge", 4)} | {(n, 5) for n in SHAPES if n != "far"}
    assert got == sorted(want)

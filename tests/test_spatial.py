import math
import random

import pytest
from pyspark.sql import functions as F

from placeweave.operators import spatial
from placeweave.operators.spatial import CELL_EDGES, area_cover, centroids, points_in_areas
from placeweave.sources.regions import ring_edges


def edges(spark, shapes):
    data = [(k, [[list(map(float, p)) for p in ring] for ring in rings]) for k, rings in shapes.items()]
    return ring_edges(spark.createDataFrame(data, "area int, rings array<array<array<double>>>"), "area", "rings")


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


@pytest.mark.parametrize("cell", [0.13, 0.5, 3.0])
def test_against_brute_force(spark, cell):
    rng = random.Random(11)
    shapes = {}
    for k in range(6):
        cx, cy = rng.uniform(-3, 3), rng.uniform(-3, 3)
        star = [(cx + rng.uniform(.4, 1.5) * math.cos(a), cy + rng.uniform(.4, 1.5) * math.sin(a))
                for a in [i * math.tau / 11 for i in range(11)]]
        hole = [(cx + .2, cy + .1), (cx - .2, cy + .1), (cx, cy - .2)]
        shapes[k] = [star + star[:1], hole + hole[:1]]
    points = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(1500)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    got = {(r.id, r.area) for r in points_in_areas(df, edges(spark, shapes), "x", "y", "area", cell).collect()}
    want = {(i, k) for i, x, y in points for k, rings in shapes.items() if inside(rings, x, y)}
    assert got == want and want


def test_edges_missing_points_and_overlap(spark):
    square = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    over = [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]
    df = spark.createDataFrame([(1, 1.5, 1.5), (2, 2.0, 0.5), (3, None, 1.0), (4, 9.0, 9.0), (5, 0.0, 0.0), (6, 0.5, 0.5)],
                               "id int, x double, y double")
    shapes = edges(spark, {1: [square], 2: [over]})
    got = sorted((r.id, r.area) for r in points_in_areas(df, shapes, "x", "y", "area", 0.5).collect())
    assert got == [(1, 1), (1, 2), (6, 1)]
    with_edges = points_in_areas(df, shapes, "x", "y", "area", 0.5, boundary=True)
    assert sorted((r.id, r.area) for r in with_edges.collect()) == [(1, 1), (1, 2), (2, 1), (5, 1), (6, 1)]


def test_no_nested_loop_join(spark):
    df = spark.createDataFrame([(1, 1.5, 1.5)], "id int, x double, y double")
    found = points_in_areas(df, edges(spark, {1: [[(0, 0), (2, 0), (2, 2), (0, 0)]]}), "x", "y", "area", 0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_centroid_ignores_winding(spark):
    shell, hole = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    got = {r.area: (r.cx, r.cy, r.size) for r in centroids(
        edges(spark, {1: [shell, hole], 2: [shell[::-1], hole], 3: [shell]}), "area").collect()}
    want = ((16 * 2 - 1.5) / 15, (16 * 2 - 1.5) / 15, 15.0)
    assert got[1] == pytest.approx(want) and got[2] == pytest.approx(want) and got[3] == pytest.approx((2, 2, 16))


@pytest.mark.parametrize("cell", [1.0])
def test_many_edges_are_divided(spark, cell):
    n = 100_000
    rim = [((1 + .1 * math.cos(40 * a)) * math.cos(a), (1 + .1 * math.cos(40 * a)) * math.sin(a))
           for a in (i * math.tau / n for i in range(n))]
    shapes = edges(spark, {7: [rim + rim[:1]]})
    cover, levels = area_cover(shapes, "area", cell)
    largest = cover.agg(F.max(F.size("_edges"))).first()[0]
    assert levels > 1 and 0 < largest <= CELL_EDGES
    rng = random.Random(3)
    points = [(i, r * math.cos(a), r * math.sin(a)) for i in range(3000)
              for a, r in [(rng.uniform(0, math.tau), rng.choice([rng.uniform(0, 1.3), rng.uniform(.88, 1.12)]))]]
    df = spark.createDataFrame(points, "id int, x double, y double")
    got = {r.id for r in points_in_areas(df, shapes, "x", "y", "area", cell).collect()}
    near = 1e-6  # between two corners the rim is a chord, this far from the curve at most
    for i, x, y in points:
        gap = math.hypot(x, y) - (1 + .1 * math.cos(40 * math.atan2(y, x)))
        assert abs(gap) < near or (i in got) == (gap < 0)


@pytest.mark.parametrize("most", [1, 3, 64])
def test_corners_on_cell_borders(spark, monkeypatch, most):
    """Edges along cell borders and through cell corners, at any depth of division."""
    monkeypatch.setattr(spatial, "LEVELS", 4)
    monkeypatch.setattr(spatial.area_cover, "__defaults__", (most,))
    rng = random.Random(5)
    shapes = {}
    for k in range(8):
        x, y, w, h = (rng.randrange(1, 6) for _ in range(4))
        shapes[k] = [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]
    shapes[8] = [[(0, 4), (4, 0), (8, 4), (4, 8), (0, 4)]]
    shapes[9] = [[(0, 0), (8, 8), (8, 4), (4, 4), (4, 0), (0, 0)]]
    points = [(i, rng.randrange(-1, 48) / 4, rng.randrange(-1, 48) / 4) for i in range(900)]
    df = spark.createDataFrame(points, "id int, x double, y double")

    def on_edge(rings, x, y):
        return any((x2 - x1) * (y - y1) == (x - x1) * (y2 - y1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)
                   for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:]))

    for boundary in (False, True):
        got = {(r.id, r.area) for r in points_in_areas(df, edges(spark, shapes), "x", "y", "area", 2.0, boundary).collect()}
        want = {(i, k) for i, x, y in points for k, rings in shapes.items()
                if (boundary if on_edge(rings, x, y) else inside(rings, x, y))}
        assert got == want


def test_no_edges_and_missing_ends(spark):
    df = spark.createDataFrame([(1, 1.5, 1.5)], "id int, x double, y double")
    none = edges(spark, {1: [[(0, 0), (2, 0), (2, 2), (0, 0)]]}).filter("false")
    assert points_in_areas(df, none, "x", "y", "area", 0.5).count() == 0
    half = none.unionByName(spark.createDataFrame([(1, 0, 0, 0.0, 0.0, None, 1.0)], none.schema))
    assert points_in_areas(df, half, "x", "y", "area", 0.5).count() == 0

"""Exact pixel coverage and the tessellated polygon index against plain geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from glacierlens.operators import spatial as sp
from glacierlens.operators import tessellation

POLY = "hier string, id long, ring int, vertex int, x double, y double"


def ring(i, corners, number=0, hier="h"):
    return [(hier, i, number, k, float(x), float(y)) for k, (x, y) in enumerate([*corners, corners[0]])]


def star(rnd, x, y, size, n):
    """A ring with many spikes, counter-clockwise."""
    reach = [size * (0.3 + 0.7 * rnd.random()) for _ in range(n)]
    return [(x + q * math.cos(2 * math.pi * k / n), y + q * math.sin(2 * math.pi * k / n)) for k, q in enumerate(reach)]


def clipped_area(corners, x0, y0, x1, y1):
    """Signed area of a ring within a box, by cutting it at one side after the other."""
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(corners, corners[1:] + corners[:1]):
            da, db = keep * (a[axis] - bound), keep * (b[axis] - bound)
            if da >= 0:
                out.append(a)
            if (da > 0 > db) or (da < 0 < db):
                t = da / (da - db)
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        corners = out
        if not corners:
            return 0.0
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(corners, corners[1:] + corners[:1])) / 2


def pixels(spark, rows, cols):
    return spark.range(rows).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c")).withColumn("value", F.col("r") * 10.0 + F.col("c"))


def test_exact_coverage(spark):
    """A triangle, a square with a hole, spikes across all borders, and one that lies around the raster."""
    rnd = random.Random(1)
    shapes = {
        1: [[(1.0, 1.0), (4.0, 1.0), (1.0, 4.0)]],
        2: [[(2.0, 2.0), (7.5, 2.0), (7.5, 6.0), (2.0, 6.0)], [(3.0, 3.0), (3.0, 5.0), (5.25, 5.0), (5.25, 3.0)]],
        3: [star(rnd, 5, 4, 7, 40)], 4: [star(rnd, 0, 0, 3, 11)], 5: [star(rnd, 10, 8, 3, 11)[::-1]],
        6: [[(-5.0, -5.0), (50.0, -5.0), (50.0, 50.0), (-5.0, 50.0)]], 7: [[(30.0, 30.0), (31.0, 30.0), (31.0, 31.0)]], 8: [star(rnd, 4, 4, 0.2, 7)],
    }
    poly = spark.createDataFrame([r for i, rings in shapes.items() for n, c in enumerate(rings) for r in ring(i, c, n)], POLY)
    affine = sp.Affine(0.0, 8.0, 0.5, 0.25)
    found = {(r.id, r.r, r.c): r.w for r in sp.coverage_weights(pixels(spark, 32, 20), poly, affine).collect()}
    seen = 0
    for i, rings in shapes.items():
        for r in range(32):
            for c in range(20):
                box = (c * 0.5, 8 - (r + 1) * 0.25, (c + 1) * 0.5, 8 - r * 0.25)
                want = abs(sum(clipped_area(list(corners), *box) for corners in rings)) / 0.125
                assert found.get((i, r, c), 0.0) == pytest.approx(want, abs=1e-9), (i, r, c)
                seen += want > 1e-12
    assert len(found) <= seen + 5


def test_zonal_mean_of_a_triangle(spark):
    poly = spark.createDataFrame(ring(1, [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)]) + ring(9, [(90.0, 90.0), (91.0, 90.0), (90.0, 91.0)]), POLY)
    px = pixels(spark, 2, 2)
    weights = sp.coverage_weights(px, poly, sp.Affine(0.0, 2.0, 1.0, 1.0))
    out = {r.id: r.value for r in sp.zonal_mean(poly, weights, px).collect()}
    # pixels (1, 0) whole, (0, 0) and (1, 1) half
    assert out[1] == pytest.approx((10 + 0.5 * 0 + 0.5 * 11) / 2) and out[9] is None


def holds(rings, x, y):
    odd = False
    for corners in rings:
        for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


@pytest.mark.parametrize("leaf_edges, deepest", [(256, 12), (8, 12), (8, 2), (40, 5)])
def test_points_in_any_leaf(spark, monkeypatch, leaf_edges, deepest):
    """Spiky outlines, holes, shared borders and nested copies, with points on vertices, edges and cell borders."""
    monkeypatch.setattr(tessellation, "LEAF_EDGES", leaf_edges)
    monkeypatch.setattr(tessellation, "DEEPEST", deepest)
    rnd = random.Random(leaf_edges)
    shapes = {
        1: [star(rnd, 2.3, 2.2, 2.4, 90)], 2: [star(rnd, 2.5, 2.5, 0.3, 60), star(rnd, 3.5, 2.5, 0.2, 30)],
        3: [[(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)], [(1.5, 1.5), (1.5, 2.5), (2.5, 2.5), (2.5, 1.5)]],
        4: [[(3.0, 1.0), (5.0, 1.0), (5.0, 3.0), (3.0, 3.0)]], 5: [[(-2.0, -2.0), (9.0, -2.0), (9.0, 9.0), (-2.0, 9.0)]],
        6: [[(0.5, 0.5), (0.5 + 1e-7, 0.5), (0.5, 0.5 + 1e-7)]],
    }
    poly = spark.createDataFrame([r for i, rings in shapes.items() for n, c in enumerate(rings) for r in ring(i, c, n)], POLY)
    points = [(rnd.uniform(-3, 10), rnd.uniform(-3, 10)) for _ in range(300)] + [(rnd.uniform(1.9, 3.1), rnd.uniform(1.9, 3.1)) for _ in range(700)]
    points += [(round(x * 4) / 4, round(y * 4) / 4) for x, y in points[:300]] + [p for rings in shapes.values() for c in rings for p in c]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k int, lon double, lat double")
    rows = sp.containing(df, poly).collect()
    assert sorted(r.k for r in rows) == list(range(len(points)))
    for r in rows:
        assert sorted(h.id for h in r._in) == [i for i, rings in shapes.items() if holds(rings, r.lon, r.lat)], (r.lon, r.lat)


def test_long_outline_is_many_bounded_rows(spark):
    n = 20_000
    corners = [(5 + (3 + 0.2 * math.sin(40 * k)) * math.cos(2 * math.pi * k / n), 5 + (3 + 0.2 * math.sin(40 * k)) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    leaves, split, _ = tessellation.tessellate(spark.createDataFrame(ring(1, corners), POLY))
    most = leaves.select(F.max(F.aggregate("polys", F.lit(0), lambda acc, p: acc + F.size(p["edges"])))).first()[0]
    assert most <= tessellation.LEAF_EDGES and leaves.count() > 100 and split.count() > 10

"""Circle vectors, exact quantiles and covered polygons against brute force, and what their plans read."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import circles, polygons, quantiles, spatial

RINGS = "code int, rings array<array<struct<x: double, y: double>>>"


def star(corners, rng, cx, cy, r):
    return [(cx + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / corners), cy + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / corners)) for k in range(corners)]


def even_odd(px, py, rings):
    odd = on = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
                odd = not odd
            if (bx - ax) * (py - ay) == (by - ay) * (px - ax) and min(ax, bx) <= px <= max(ax, bx) and min(ay, by) <= py <= max(ay, by):
                on = True
    return odd, on


@pytest.mark.parametrize("size", [0.11, 0.5, 7.0])
def test_covered_polygons_equal_all_edges(spark, size):
    rng = random.Random(3)
    shapes = [(k, [star(rng.choice([3, 8, 60]), rng, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(0.1, 2)) for _ in range(rng.choice([1, 1, 2, 3]))]) for k in range(9)]
    grid = [(float(a), float(b)) for a, b in ((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1))]
    shapes += [(20, [grid]), (21, [[(x / 2, y / 2) for x, y in grid[::-1]], [(0.25, 0.25), (0.5, 0.25), (0.5, 0.5), (0.25, 0.5)]]), (22, [[(0.0, 0.0), (1.0, 1.0), (2.0, 0.0), (2.0, 0.0)]]), (23, [[(0.5, 0.5)]]), (24, [])]
    points = [(rng.uniform(-2.5, 2.5), rng.uniform(-2.5, 2.5)) for _ in range(700)] + [(a / 8, b / 8) for a in range(-4, 20) for b in range(-4, 12)] + [(x, y) for _, rings in shapes for ring in rings for x, y in ring]
    polys, at = spark.createDataFrame(shapes, RINGS), spark.createDataFrame([*points, (None, 1.0)], "lon double, lat double")
    want = {(x, y, code): even_odd(x, y, rings) for x, y in points for code, rings in shapes}
    held = lambda **k: {(r.lon, r.lat, r.code) for r in spatial.polygon_hits(at, polys, size, **k).collect()}
    assert held() == {k for k, (odd, on) in want.items() if odd or on}
    assert held(strict=True) == {k for k, (odd, on) in want.items() if odd and not on}
    first = {(r.lon, r.lat): r.code for r in spatial.first_feature(at, polys.withColumn("k", -F.col("code")), size, "k").collect()}
    assert first == {(x, y): max(c for a, b, c in want if (a, b) == (x, y) and want[a, b, c][0]) for x, y in points if any(want[x, y, c][0] for c, _ in shapes)}


def test_points_meet_few_edges_of_a_large_polygon(spark):
    n = 10_000
    ring = [(math.cos(2 * math.pi * k / n) * (1 + 0.01 * (k % 2)), math.sin(2 * math.pi * k / n)) for k in range(n)]
    polys = spark.createDataFrame([(1, [ring])], RINGS)
    rng = random.Random(1)
    points = [(rng.uniform(-1.2, 1.2), rng.uniform(-1.2, 1.2)) for _ in range(2000)]
    tested = polygons.tested(spark.createDataFrame(points, "x double, y double"), polygons.cover(polys, 0.02, ["code"]), 0.02, "x", "y")
    rows = tested.select("x", "y", "_in", F.coalesce(F.size("_edges"), F.lit(0)).alias("k")).collect()
    assert sum(max(r.k, 0) for r in rows) < 100 * 2000  # 10,000 for each point without cells
    assert {(r.x, r.y) for r in rows if r["_in"]} == {p for p in points if even_odd(*p, [ring])[0]}


def test_nearest_polygon_is_that_of_all_edges(spark):
    rng = random.Random(5)
    shapes = [(k, [star(12, rng, rng.uniform(-2, 2), rng.uniform(-2, 2), 0.4)]) for k in range(6)]
    points = [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(400)]

    def away(px, py, ring):
        out = []
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            t = max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            out.append(math.hypot(ax + t * (bx - ax) - px, ay + t * (by - ay) - py))
        return min(out)

    got = {(r.x, r.y): (r.code, round(r["_d"], 9)) for r in polygons.nearest(spark.createDataFrame(points, "x double, y double"), spark.createDataFrame(shapes, RINGS), 0.15, 0.5, "x", "y", "code").collect()}
    want = {}
    for p in points:
        d, code = min((away(*p, r[0]), c) for c, r in shapes)
        if d <= 0.5:
            want[p] = (code, round(d, 9))
    assert got == want


@pytest.mark.parametrize(("bins", "few"), [(32, 20), (1024, 50_000)])
def test_quantiles_are_exact(spark, bins, few):
    rng = np.random.default_rng(bins)
    values = {"even": rng.normal(0, 1e6, 400).round(3), "ties": rng.integers(0, 4, 300).astype(float), "one": np.array([5.0]), "wide": np.exp(rng.normal(0, 40, 300)), None: np.arange(50.0)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("even", None), ("none", None), ("even", float("nan"))]
    probs = (0.0, 0.013, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = quantiles.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), probs, bins, few).collect()
    assert len(got) == len(probs) * len(values)
    for r in got:
        assert r.n == len(values[r.k]) and r.v == pytest.approx(float(np.quantile(values[r.k], r.p)), rel=1e-12)


def test_quantiles_of_whole_numbers_no_double_can_tell_apart(spark):
    rows = [(2**60 + k,) for k in range(100)]
    df = spark.createDataFrame(rows, "v long")
    found = quantiles.quantiles(df, [], F.col("v"), (0.0, 0.5, 1.0), 4, 5).select("p", F.col("v").cast("decimal(38,0)")).collect()
    assert len(found) == 3
    assert quantiles.quantiles(df.limit(0), [], F.col("v"), (0.5,)).count() == 0


def test_circle_vectors_are_sums_over_places(spark):
    rng = random.Random(9)
    centers = [(k, 40.7 + rng.uniform(0, 0.02), -74 + rng.uniform(0, 0.02)) for k in range(40)] + [(99, None, None)]
    places = [(40.7 + rng.uniform(0, 0.02), -74 + rng.uniform(0, 0.02), rng.randrange(3), 2000 + rng.randrange(3), rng.randrange(1, 9)) for _ in range(600)] + [(None, None, 1, 2000, 5), (40.7, -74.0, 9, 2000, 5)]
    c, p = spark.createDataFrame(centers, "id int, lat double, lon double"), spark.createDataFrame(places, "lat double, lon double, cat int, year int, n int")
    kx, ky = 111320.0 * math.cos(math.radians(40.73)), 110950.0
    want = {}
    for k, la, lo in centers:
        for t in ("all", "0", "1"):
            near = [r for r in places if la and r[0] and math.hypot((r[1] - lo) * kx, (r[0] - la) * ky) <= 300 and r[2] in (0, 1) and t in ("all", str(r[2]))]
            want[k, t] = [sum(r[4] for r in near if r[3] == y) for y in (2000, 2001)]
    for cells in (1, 4, 9):
        got = circles.vectors(c, p, 300.0, "id", [0, 1], [2000, 2001], cells)
        assert {(r.id, r.type): r.counts for r in got.collect()} == want
    kept = circles.cover(c, 300.0, "id").persist()
    assert {(r.id, r.type): r["mean"] for r in circles.vectors(c, p, 300.0, "id", [0, 1], [2000, 2001], covered=kept).collect()} == {k: sum(v) / 2 for k, v in want.items()}
    kept.unpersist()

"""Merged areas: random cells of a grid, areas in areas, touching corners; and shapes with fewer corners without gaps."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import dissolve, polygons

RINGS = "code int, rings array<array<struct<x: double, y: double>>>"


def area_of(rings):
    return sum(a[0] * b[1] - b[0] * a[1] for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True)) / 2


def grid_areas(side, rng):
    """Cells of a grid with bent corners, each turned at random."""
    at = {(i, j): (i + rng.uniform(-0.2, 0.2), j + rng.uniform(-0.2, 0.2)) for i in range(side + 1) for j in range(side + 1)}
    out = []
    for k in range(side * side):
        i, j = divmod(k, side)
        ring = [at[i, j], at[i + 1, j], at[i + 1, j + 1], at[i, j + 1]]
        out.append((k, [ring[::-1] if rng.random() < 0.5 else ring]))
    return out


def test_areas_are_merged(spark):
    rng = random.Random(2)
    areas = grid_areas(6, rng)
    group = {k: rng.randrange(3) for k, _ in areas}
    ring = [(20.0, 20.0), (24.0, 20.0), (24.0, 24.0), (20.0, 24.0)]
    hole = [(21.0, 21.0), (23.0, 21.0), (23.0, 23.0), (21.0, 23.0)]
    areas += [(100, [ring, hole]), (101, [hole]), (102, [[(30.0, 0.0), (31.0, 0.0), (31.0, 1.0)]]), (103, [])]
    group |= {100: 7, 101: 8, 102: 9, 103: 9}
    df = spark.createDataFrame([(k, r, group[k]) for k, r in areas], RINGS + ", g int")
    got = {r.grp: [[tuple(p) for p in ring] for ring in r.rings] for r in dissolve.dissolve(df, "code", F.col("g"), 0.5).collect()}
    want_edges = {}
    for k, rings in areas:
        for r in rings:
            for a, b in zip(r, [*r[1:], r[0]], strict=True):
                e = want_edges.setdefault(group[k], set())
                e ^= {frozenset((a, b))}
    assert set(got) == set(group.values())
    for g, rings in got.items():
        edges = [frozenset((a, b)) for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True)]
        assert len(edges) == len(set(edges)) and set(edges) == want_edges[g]
        want = sum(abs(area_of(r[:1])) - sum(abs(area_of([h])) for h in r[1:]) for k, r in areas if group[k] == g and r)
        assert math.isclose(area_of(rings), want, rel_tol=1e-9)
    whole = dissolve.dissolve(df.where("code >= 100 AND code < 102"), "code", F.lit("x"), 0.5).collect()
    assert len(whole) == 1 and len(whole[0].rings) == 1 and area_of(whole[0].rings) == 16.0
    assert dissolve.dissolve(df.limit(0), "code", F.col("g"), 0.5).count() == 0


def test_thinner_shapes_share_their_borders(spark):
    n = 200
    wave = [(k / n, 0.02 * math.sin(k / 7) + 0.001 * (k % 3)) for k in range(n + 1)]
    low, high = [*wave, (1.0, -1.0), (0.0, -1.0)], [*wave[::-1], (0.0, 1.0), (1.0, 1.0)]
    island = [(5 + math.cos(k / 30), math.sin(k / 30)) for k in range(188)]
    df = spark.createDataFrame([(1, [low]), (2, [high]), (3, [island]), (4, [[(9.0, 9.0), (9.1, 9.0), (9.0, 9.1)]]), (5, [])], RINGS)
    thin = {r.code: [[tuple(p) for p in ring] for ring in r.rings] for r in dissolve.simplify(df, "code", 0.005).collect()}
    assert thin[4] == [[(9.0, 9.0), (9.1, 9.0), (9.0, 9.1)]] and thin[5] == []
    border = lambda ring: {p for p in ring if p in set(wave)}
    assert border(thin[1][0]) == border(thin[2][0]) and 10 < len(border(thin[1][0])) < n / 2
    assert 8 < len(thin[3][0]) < 100 and abs(area_of(thin[3]) - area_of([island])) < 0.05
    merged = dissolve.dissolve(dissolve.simplify(df, "code", 0.005).where("code < 3"), "code", F.lit(1), 0.1).first().rings
    assert len(merged) == 1 and math.isclose(area_of([[tuple(p) for p in merged[0]]]), 2.0, rel_tol=1e-9)  # nothing between them
    kept = dissolve.thin(np.array([(0, 0), (1, 0.1), (2, -0.1), (3, 5), (4, 6), (5, 7), (6, 8.1), (7, 9), (8, 9), (9, 9)], float), 1.0)
    assert kept.tolist() == [True, False, True, True, False, False, False, True, False, True]
    assert polygons.edge_rows(df, ["code"]).where("code = 5").count() == 0

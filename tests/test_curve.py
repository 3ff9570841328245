"""Views by ranges of Hilbert keys: whole, tight, and what they read."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import grid
from tessera.operators import cubes
from tessera.sources import files


@pytest.mark.parametrize("most", [1, 8, 48, 400])
def test_ranges_hold_every_place_of_a_view(spark, most):
    rng = random.Random(most)
    s, n, w, e = grid.BOX
    places = [(rng.uniform(s - 0.02, n + 0.02), rng.uniform(w - 0.02, e + 0.02)) for _ in range(3000)]
    keyed = spark.createDataFrame(places, "lat double, lon double").withColumn("hk", grid.hilbert_key(F.col("lat"), F.col("lon"))).collect()
    for _ in range(40):
        a, b = sorted(rng.uniform(s - 0.01, n + 0.01) for _ in range(2))
        c, d = sorted(rng.uniform(w - 0.01, e + 0.01) for _ in range(2))
        ranges = grid.hilbert_ranges((a, b, c, d), most)
        assert all(x[1] < y[0] for x, y in zip(ranges, ranges[1:], strict=False)) and len(ranges) <= 4 * most
        held = lambda k: any(x <= k <= y for x, y in ranges)  # noqa: E731, B023
        inside = [r for r in keyed if a <= r.lat <= b and c <= r.lon <= d]
        assert all(held(r.hk) for r in inside)
        if most == 400 and (b - a) * (d - c) > 0.01:
            assert sum(held(r.hk) for r in keyed) < len(inside) * 1.3 + 90
    assert grid.hilbert_ranges((40.8, 40.7, -74, -73.9)) == []
    assert grid.hilbert_ranges(grid.BOX) == [(0, 4**16 - 1)]


def test_a_view_reads_few_row_groups(spark, tmp_path):
    rng = random.Random(4)
    s, n, w, e = grid.BOX
    rows = [(rng.uniform(s, n), rng.uniform(w, e), 0, k % 12, k % 3) for k in range(40_000)]
    facts = spark.createDataFrame(rows, "lat double, lon double, lt int, m int, cat int").repartition(3)
    points = cubes.points_cube(facts)
    files.write_cube(points, str(tmp_path / "curve"), ["hk", "m", "cat"], files=4, rows_per_group=500)
    files.write_cube(points, str(tmp_path / "rows"), ["lat", "lon", "m"], files=4, rows_per_group=500)
    view = (40.60, 40.65, -74.0, -73.93)
    south, north, west, east = view
    box = F.col("lat").between(south, north) & F.col("lon").between(west, east)

    def scanned(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        (scan,) = [p for p in [plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())] if p.metrics().contains("numOutputRows")]
        return scan.metrics().apply("numOutputRows").value()

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        curve, plain = cubes.in_view(spark.read.parquet(str(tmp_path / "curve")), view), spark.read.parquet(str(tmp_path / "rows")).where(box)
        assert {tuple(r)[:5] for r in curve.select("lat", "lon", "m", "cat", "n").collect()} == {tuple(r)[:5] for r in plain.select("lat", "lon", "m", "cat", "n").collect()}
        of_curve, of_plain, inside = scanned(curve), scanned(plain), curve.count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert of_curve < of_plain / 2 and of_curve < 10 * 500 + 3 * inside

"""Grid, names and periods against their definitions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import compare, grid, names, period
from tessera.functions.period import Period, Span, baseline_of, comparison_of, days_of, fair_column, in_months, months_of, normalized, resolve_group


@pytest.fixture(scope="module")
def random_points(spark):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(40.5, 40.9, 4000), rng.uniform(-74.2, -73.7, 4000), strict=True)], "lat double, lon double")


def test_hexagon_is_the_nearest_of_seven(random_points):
    h = random_points.withColumn("h", grid.axial(F.col("lat"), F.col("lon")))
    lat, lon = grid.hex_center(F.col("h.q"), F.col("h.r"))
    own = grid.distance_m(F.col("lat"), F.col("lon"), lat, lon)
    around = []
    for dq, dr in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)):
        a, b = grid.hex_center(F.col("h.q") + dq, F.col("h.r") + dr)
        around.append(grid.distance_m(F.col("lat"), F.col("lon"), a, b))
    row = h.agg(F.max(own).alias("far"), F.max(own - F.least(*around)).alias("worse")).first()
    assert row["far"] <= grid.CITY.side + 1e-6 and row["worse"] <= 1e-6


def test_centers_round_trip_and_neighbors_are_evenly_spaced(spark):
    cells = spark.range(-30, 30).select(F.col("id").cast("int").alias("q"), (F.col("id") * 7 % 23).cast("int").alias("r"))
    lat, lon = grid.hex_center(F.col("q"), F.col("r"))
    near_lat, near_lon = grid.hex_center(F.col("q") + 1, F.col("r"))
    out = cells.select("q", "r", grid.axial(lat, lon).alias("h"), grid.distance_m(lat, lon, near_lat, near_lon).alias("d"), F.size(grid.hex_ring(F.col("q"), F.col("r"))).alias("k")).collect()
    assert all((x.q, x.r) == (x.h.q, x.h.r) and abs(x.d - math.sqrt(3) * 180) < 1e-6 and x.k == 7 for x in out)


def test_hilbert_keys_follow_the_curve(spark):
    """On a 16 x 16 lattice every key occurs once and neighbors on the curve touch."""
    box = (0.0, 15.0, 0.0, 15.0)
    cells = spark.range(256).select((F.col("id") % 16).cast("double").alias("x"), F.floor(F.col("id") / 16).cast("double").alias("y"))
    keyed = sorted((r.k, r.x, r.y) for r in cells.select("x", "y", grid.hilbert_key(F.col("y"), F.col("x"), 4, box).alias("k")).collect())
    assert [k for k, _, _ in keyed] == list(range(256))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(keyed, keyed[1:], strict=False))


KEYS = {
    "W 42nd St.": "WEST 42 STREET", "Fifth Avenue": "5 AVENUE", "5th av": "5 AVENUE", "St. Mark's Pl": "SAINT MARKS PLACE", "Avenue S": "AVENUE S", "Park Ave S": "PARK AVENUE SOUTH",
    "Dr M L King Jr Blvd": "DOCTOR M L KING JUNIOR BOULEVARD", "Harlem River Dr": "HARLEM RIVER DRIVE", "Ave of the Americas": "AVENUE AMERICAS", "Peña (north) Rd": "PENA ROAD", "St": "SAINT", "W": "W", "": "", "Dr": "DRIVE",
}
SHOWN = {"W  42 ST": "West 42nd Street", "AVE OF THE AMERICAS": "Avenue of the Americas", "ST MARKS PL": "St Marks Place", "AVE S": "Avenue S", "PARK AVE S": "Park Avenue South", "FDR DR VIADUCT": "FDR Drive Viaduct", "BCH 116 ST": "Beach 116th Street", "E 111 ST": "East 111th Street", "MCDONALD AVE": "McDonald Avenue", "RT 9A": "Rt 9A",
    "ÉCOLE LN": "École Lane", "NAÏVE'S O'BRIEN ST": "Naïve's O'Brien Street", "W 1234567890123 ST": "West 1234567890123rd Street", "E 007 ST": "East 7th Street", "MC" + "A" * 2000: "McA" + "a" * 1999, "УЛИЦА МИРА": "Улица Мира"}


def test_street_keys_and_shown_names(spark):
    df = spark.createDataFrame([(k, v) for k, v in KEYS.items()] + [(None, None)], "raw string, want string")
    assert all(r.got == r.want for r in df.select("want", names.street_key(F.col("raw")).alias("got")).collect())
    df = spark.createDataFrame(list(SHOWN.items()), "raw string, want string")
    assert [r.got for r in df.select(names.display_name(F.col("raw")).alias("got")).collect()] == list(SHOWN.values())


def test_house_numbers(spark):
    cases = {"1234": 1234, "37-012": 1_037_012, "0": -1, "": -1, None: -1, "12A": 12, "x": -1, " 7 ": 7, "12345678901": 12345678901, "1234567-12345678": 1_000_000 + 1234567_000 + 12345678, "9" * 30: -1, "9" * 30 + "-1": -1}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want long")
    assert all(r.got == r.want for r in df.select("want", names.house_number(F.col("raw")).alias("got")).collect())
    blocks = spark.createDataFrame([(357, 300), (1_037_012, 1_037_000), (-1, -1), (99, 0)], "n int, want int")
    assert all(r.got == r.want for r in blocks.select("want", names.block_of(F.col("n")).alias("got")).collect())


def test_ordinals(spark):
    want = {1: "1st", 2: "2nd", 3: "3rd", 4: "4th", 11: "11th", 12: "12th", 13: "13th", 21: "21st", 112: "112th"}
    df = spark.createDataFrame([(k,) for k in want], "n long")
    assert [r[0] for r in df.select(names.ordinal(F.col("n"))).collect()] == list(want.values())


def test_periods():
    assert months_of(Period("year", 2025, 2025)) == list(range(108, 120))
    assert months_of(Period("crossyear", 6)) == [6 + 12 * k for k in range(10)]
    assert months_of(Period("year_range", 2020, 2018)) == list(range(24, 60))
    assert comparison_of(Period("crossyear", 6)) is None and comparison_of(Period("year", 2016)) is None
    assert comparison_of(Period("month_range", 20, 24)) == list(range(15, 20))
    assert baseline_of(Period("year", 2025)) == (list(range(36, 48)), 1.0)
    assert baseline_of(Period("year_range", 2021, 2025)) == (list(range(36, 48)), 12 / 60)
    assert baseline_of(Period("month_range", 58, 61)) == ([46, 47, 48, 49], 1.0)  # a range over a year's end keeps its shape
    assert baseline_of(Period("year", 2018)) == (list(range(12, 24)), 1.0)
    assert days_of(months_of(Period("year", 2024))) == 366
    assert fair_column([1, 2], [1, 2], months_of(Period("year", 2020))) == ("all", "2020")
    assert fair_column([2], [1, 2], months_of(Period("year_range", 2020, 2022))) == ("2", "avg")
    assert fair_column([2], [1, 2], [5, 6]) is None and fair_column([1, 2], [1, 2, 3], list(range(12))) is None
    assert resolve_group([1, 2], {"a": [1, 2], "b": [3]}) == "group:a" and resolve_group([3, 1, 2], {"a": [1, 2], "b": [3]}) == "all"


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 119), st.integers(0, 119))
def test_normalized_period_covers_the_same_months(a, b):
    assert months_of(normalized(Period(), a, b)) == list(range(min(a, b), max(a, b) + 1))


def test_month_predicates(spark):
    m = spark.range(20).withColumnRenamed("id", "m")
    for months in ([], [3], [4, 5, 6], [1, 9]):
        assert [r.m for r in m.where(in_months(F.col("m"), months)).orderBy("m").collect()] == months


def test_breaks_and_classes(spark):
    assert compare.friendly_breaks([13, 21, 22]) == [15, 20, 25]
    assert compare.friendly_breaks([0, 0]) == [1, 1.5]
    breaks = [10.0, 20.0]
    df = spark.createDataFrame([(v,) for v in (1, 10, 11, 20, 99)], "v int")
    assert [r[0] for r in df.select(compare.classify(F.col("v"), breaks)).collect()] == [0, 0, 1, 1, 2] == [compare.class_of(v, breaks) for v in (1, 10, 11, 20, 99)]
    assert compare.class_labels([8, 15, 150]) == ["1-8", "9-15", "16-150", "151+"]
    assert compare.class_labels([1_234_567]) == ["1-1234567", "1234568+"]
    assert compare.class_labels([0.5, 2], whole=False) == ["0-0.5", "0.5-2", "2+"]


def test_short_numbers(spark):
    df = spark.createDataFrame([(5,), (1200,), (999_999,), (2_500_000,)], "n long")
    assert [r[0] for r in df.select(compare.short_number(F.col("n"))).collect()] == ["5", "1.2K", "1M", "2.5M"]


def test_lines(spark):
    df = spark.createDataFrame([([0, 0, 300000, 0, 300000, 400000],)], "xy array<int>").select(grid.decode_xy(F.col("xy")).alias("p"))
    row = df.select(grid.polyline_length(F.col("p")).alias("n"), grid.point_along(F.col("p"), F.lit(0.5)).alias("m"), grid.point_along(F.col("p"), F.lit(1.0)).alias("e")).first()
    assert (row.n, tuple(row.m), tuple(row.e)) == (7.0, (3.0, 0.5), (3.0, 4.0))


def test_span_of_other_years():
    span = Span(1995, 2001, 1997)
    assert months_of(Period("year", 2000), span) == list(range(60, 72)) and baseline_of(Period("year", 2000), span) == (list(range(24, 36)), 1.0)


def test_windows_of_days(spark):
    span = period.Span(2016, 2025, 2019)
    assert period.dates_of([0], span) == ("2016-01-01", "2016-02-01") and period.dates_of(list(range(108, 120)), span) == ("2025-01-01", "2026-01-01")
    with pytest.raises(ValueError):
        period.dates_of([1, 3], span)
    days = spark.sql("SELECT explode(sequence(DATE'2015-12-30', DATE'2016-02-02')) AS day")
    inside = days.where(period.in_dates(F.col("day"), "2016-01-01", "2016-02-01"))
    assert inside.count() == 31 and inside.agg(F.min("day")).first()[0].day == 1


def test_numbers_as_people_read_them(spark):
    df = spark.createDataFrame([(12.34, "NYC HOUSING-PARK/LOT"), (-4.0, ""), (0.0, None), (None, "X"), (float("inf"), "bar"), (float("nan"), "A - B")], "pct double, label string")
    got = df.select(compare.signed_change(F.col("pct")).alias("c"), compare.sentence_case(F.col("label")).alias("s")).collect()
    assert [r.c for r in got] == ["+12.3%", "−4.0%", "0.0%", "", "", ""]
    assert [r.s for r in got] == ["NYC housing, park / lot", "Not recorded", "Not recorded", "X", "Bar", "A, b"]
    assert spark.range(1).select(compare.grouped_number(F.lit(1234567.6))).first()[0] == "1,234,568"

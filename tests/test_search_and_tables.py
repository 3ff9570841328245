"""Batches of searches, routes as columns, digests of tables, prefixes as a join, profiles, wide ranges of addresses, sheets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import period
from tessera.operators import audit, quantiles, reconcile, search
from tessera.sources import files

TYPED = [
    "350 5th ave, brooklyn", "5th ave & 42nd st", "75th precinct", "75", "75th", "broadway", "37-12 80th st queens", "pct 9", "Precinct #12", "3rd, brooklyn", "", "  ", "queens", "a and b", "a AT b, bx",
    "12 & 14", "1 2", "55b main st manhattan", "x / y / z", "the bronx", "5 st staten island", "a,b", "10th Precinct, Queens", "&", "a & ",
]


def test_routes_of_a_column_equal_those_of_single_searches(spark):
    rows = spark.createDataFrame([(t,) for t in TYPED], "typed string").select("typed", search.routes(F.col("typed")).alias("r")).select("typed", "r.*").collect()
    got = {r.typed: search.Route(r.rule, r.text, r.borough, tuple(r.parts), r.precinct) for r in rows}
    assert got == {t: search.route(t) for t in TYPED}


def test_many_searches_equal_single_ones(spark, tmp_path):
    rng = random.Random(6)
    words = ["WEST", "EAST", "42", "5", "STREET", "AVENUE", "SAINT", "MARKS", "PLACE", "BROADWAY", "WESTCHESTER", "AVENUEOFTHEAMERICAS", "52"]
    names = [(k, " ".join(rng.sample(words, rng.choice([1, 2, 3]))), [" ".join(rng.sample(words, 2))] if k % 4 == 0 else None if k % 4 == 1 else [], k % 5 + 1) for k in range(120)]
    streets = spark.createDataFrame(names, "id int, key string, aliases array<string>, boro int")
    typed = ["west", "w 4", "42 st", "avenue", "avenueofthea", "st marks pl", "zzz", "", "5 5", "e 5 s", "broadway west", "west zzz"]
    files.write_cube(search.prefix_index(streets), str(tmp_path / "index"), ["prefix", "id"])
    index = spark.read.parquet(str(tmp_path / "index"))
    found = search.match_many(spark.createDataFrame([(t, t) for t in typed], "search string, typed string"), streets, index).orderBy("search", "rank").collect()
    got = {t: [(r.id, r.alias, r.exact, r.extra, r.len) for r in found if r.search == t] for t in typed}
    assert got == {t: [(r.id, r.alias, r.exact, r.extra, r.len) for r in search.match_streets(streets, t).collect()] for t in typed}
    assert sum(map(len, got.values())) > 60
    plan = search.match_many(spark.createDataFrame([("w", "w")], "search string, typed string"), streets, index)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner, true" not in plan


@pytest.mark.parametrize("bits", [2, 12])
def test_digests_find_what_differs(spark, monkeypatch, bits):
    monkeypatch.setattr(reconcile, "BITS", bits)
    monkeypatch.setattr(reconcile, "ROWS", 50)
    rows = [(k % 70, None if k % 9 == 0 else f"t{k % 40}", float(k % 11)) for k in range(600)]
    kind = "a int, b string, c double"
    a = spark.createDataFrame(rows, kind)
    other = [*rows[1:300], (5, "changed", 1.0), *rows[301:], rows[7], (None, None, None)]
    b = spark.createDataFrame(other, kind).repartition(3)
    both = lambda x, y: [sorted(map(str, f(x, y).collect())) for f in (reconcile.differing_rows, reconcile.multiset_diff)]
    one, two = both(a, b)
    assert one == two and len(one) == 5
    assert reconcile.differing_rows(a, a.repartition(5)).count() == 0 and reconcile.same_rows(a.limit(0), a.limit(0))
    assert not reconcile.same_rows(a.limit(0), a) and not reconcile.same_rows(a, a.unionByName(a))
    x, y = spark.createDataFrame([(None, "a")], "p string, q string"), spark.createDataFrame([("a", None)], "p string, q string")
    assert not reconcile.same_rows(x, y)


def test_tables_that_agree_are_not_shuffled_by_row(spark):
    a = spark.range(5000).withColumn("v", F.col("id") % 7)
    plan = reconcile.differing_rows(a, a.repartition(3))._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan  # nothing is left to compare


def test_longest_prefixes_of_a_table(spark):
    labels = ["Grand  larceny of motor vehicle", "grand larceny", "arson", None, "", "GRAND", "grand larceny"]
    prefixes = {"GRAND LARCENY": 109, "GRAND LARCENY OF MOTOR": 110, "GR": 1}
    df = spark.createDataFrame([(k, v) for k, v in enumerate(labels)], "id int, v string")
    known = spark.createDataFrame([*prefixes.items(), ("GR", 7), (None, 3), ("", 4)], "prefix string, code int")
    got = {r.id: r.code for r in reconcile.by_prefixes(df, "v", known).collect()}
    assert got == {r.id: r.c for r in df.select("id", reconcile.by_prefix(F.col("v"), prefixes).alias("c")).collect()}
    assert {r.code for r in reconcile.by_prefixes(df, "v", known.limit(0)).collect()} == {None}


def test_profiles_copy_no_row(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "UNKNOWN", None), (None, " ", None), (2, "x", None)], "a int, b string, c double")
    got = {r["column"]: (r.null_pct, r.placeholder_pct, r.n_distinct) for r in audit.profile_columns(df).collect()}
    assert got == {"a": (25.0, 0.0, 2), "b": (0.0, 50.0, 3), "c": (100.0, 0.0, 0)}
    for plan in (audit.profile_columns(df), audit.distinct_places(df, "a", "c")):
        assert "Expand" not in plan._jdf.queryExecution().executedPlan().toString()
    places = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 3.0), (1.0, 2.0)], "lat double, lon double")
    assert tuple(audit.distinct_places(places, "lat", "lon").first()) == (3, 1, 2)


def test_wide_ranges_of_numbers_make_few_rows(spark):
    segments = spark.createDataFrame([(1, 7, 1, 99_999_999, 0, 0), (2, 7, 100, 198, 101, 199), (3, 8, 1_000_001, 1_000_199, 0, 0)], "seg int, street int, lf int, lt int, rf int, rt int")
    wanted = spark.createDataFrame([(7, 150), (7, 151), (7, 54_321), (7, 99_999_999), (8, 1_000_101), (8, 5)], "street int, number int")
    got = {(r.street, r.number): r.seg for r in search.locate_addresses(wanted, segments).collect()}
    assert got == {(7, 150): 2, (7, 151): 1, (7, 54_321): 1, (8, 1_000_101): 3}
    blocks = segments.select(F.size(search._blocks("lf", "lt")).alias("n")).collect()
    assert max(r.n for r in blocks) <= 12


def test_sheets_are_parsed_where_they_lie(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"s{k}.csv").write_text(f"title\nPCT,OFFENSE,2016,2017\n{k},Robbery, 5,6\n,Murder,x,{k}\nStatistical notes,,,\n")
    got = files.read_sheets(spark, str(tmp_path), "PCT", {"ROBBERY": 105, "MURDER": 101}, range(2016, 2018), unit=True)
    assert {tuple(r) for r in got.collect()} == {(str(k), "105", y, n) for k in (1, 2) for y, n in ((2016, 5.0), (2017, 6.0))} | {(str(k), "101", 2017, float(k)) for k in (1, 2)}


def test_values_at_ranks_and_resolved_types(spark):
    df = spark.createDataFrame([(v,) for v in (5, 1, 9, None, 3)], "v int")
    assert tuple(quantiles.values_at(df, F.col("v"), {"low": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1}).first()) == (1, 5, 9)
    assert tuple(quantiles.values_at(df.limit(0), F.col("v"), {"low": lambda n: F.lit(0)}).first()) == (None,)
    groups = {"person": [0, 1], "other": [2]}
    asked = [[0, 1, 2], [2], [1, 0, 1], [0, 2], []]
    rows = spark.createDataFrame([(t,) for t in asked], "t array<int>").select("t", period.resolved(F.col("t"), groups).alias("r")).collect()
    assert [r.r for r in rows] == [period.resolve_group(t, groups) for t in asked]


def test_every_query_reads_a_given_table(spark, sf_dir):
    """Tables are read when a query is built or when it runs: a folder without tables must make every query fail."""
    from tessera.plans.queries import QUERIES

    unfit = []
    for name, f in QUERIES.items():
        try:
            f(spark, "/tmp/there-are-no-tables")
            unfit.append(name)
        except Exception as e:
            assert "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e), (name, str(e)[:200])
    assert not unfit

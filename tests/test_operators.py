"""Operators on small tables with planted cases: nulls, ties, empty tables, edges."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, clean, cubes, reconcile, report, search, spatial
from tessera.sources import files, paths, store

SQUARE = "code int, rings array<array<struct<x: double, y: double>>>"


def square(x0, y0, side):
    return [(x0, y0), (x0 + side, y0), (x0 + side, y0 + side), (x0, y0 + side)]


def test_polygon_labels_and_holes(spark):
    polys = spark.createDataFrame([(2, [square(0.0, 0.0, 1.0)]), (1, [square(1.0, 0.0, 1.0)]), (3, [square(3.0, 0.0, 1.0), square(3.25, 0.25, 0.5)])], SQUARE)
    points = spark.createDataFrame([(0.5, 0.5), (1.0, 0.5), (2.05, 0.5), (9.0, 9.0), (3.5, 0.5), (3.1, 0.1), (None, 1.0)], "lon double, lat double")
    got = {(r.lon, r.lat): (r.code, r.hits, r.label) for r in spatial.assign_polygon(points, polys, 0.4, 0.1).collect()}
    assert got == {(0.5, 0.5): (2, 1, "inside"), (1.0, 0.5): (1, 2, "boundary"), (2.05, 0.5): (1, 0, "nearest"), (9.0, 9.0): (None, 0, "none"), (3.5, 0.5): (None, 0, "none"), (3.1, 0.1): (3, 1, "inside")}
    assert spatial.assign_polygon(points.limit(0), polys, 0.4, 0.1).count() == 0


def test_radius_counts_keep_zeros(spark):
    centers = spark.createDataFrame([(1, 40.7, -74.0), (2, 40.8, -74.0)], "id int, lat double, lon double")
    places = spark.createDataFrame([(40.7, -74.0, 3), (40.7005, -74.0, 4), (40.71, -74.0, 100)], "lat double, lon double, w int")
    assert {(r.id, r.n) for r in spatial.radius_counts(centers, places, 200.0, "id", "w").collect()} == {(1, 7), (2, 0)}


def test_snapping_absorbs_and_corners_fan_out(spark):
    to = lambda *ps: [(a, b) for a, b in ps]
    segs = spark.createDataFrame(
        [(0, 10, to((40.7, -74.01), (40.7, -73.99))), (1, 11, to((40.69, -74.0), (40.71, -74.0))), (2, -1, to((40.7002, -74.01), (40.7002, -73.99)))], "seg int, street int, points array<struct<lat: double, lon: double>>"
    )
    nodes = spark.createDataFrame([(40.7, -74.0, [10, 11])], "lat double, lon double, streets array<int>")
    points = spark.createDataFrame([("corner", 40.7, -74.0), ("absorbed", 40.7002, -74.005), ("street", 40.69995, -74.005), ("far", 40.75, -74.0)], "id string, lat double, lon double")
    got = {(r.id, r.street) for r in spatial.snap_to_network(points, segs, nodes, "id").collect()}
    assert got == {("corner", 10), ("corner", 11), ("street", 10)}


def test_first_per_key_is_total_and_keeps_null_keys(spark):
    rows = [(1, None, "b"), (1, 5, "a"), (1, 5, "c"), (None, 2, "x"), (None, 1, "y")]
    df = spark.createDataFrame(rows, "k int, t int, v string")
    assert {tuple(r) for r in clean.first_per_key(df, ["k"], [F.col("t")], ["v"]).collect()} == {(1, 5, "a"), (None, 1, "y")}
    assert clean.first_per_key(df.limit(0), ["k"], [F.col("t")], ["v"]).count() == 0


def test_cleaning_functions(spark):
    df = spark.createDataFrame([(" (null) ",), ("",), (None,), (" a ",)], "v string")
    assert [r[0] for r in df.select(clean.null_normalize(F.col("v"))).collect()] == [None, None, None, "a"]
    times = spark.createDataFrame([("2016-10-01T00:00:00.000",), ("10/02/2016",), ("soon",), (None,)], "v string")
    assert [str(r[0]) if r[0] else None for r in times.select(clean.lenient_timestamp(F.col("v"))).collect()] == ["2016-10-01 00:00:00", "2016-10-02 00:00:00", None, None]
    numbers = spark.createDataFrame([("14.6",), (" 14 ",), ("",), ("x",), ("99999999999",)], "v string")
    assert [r[0] for r in numbers.select(clean.lenient_int(F.col("v"), "smallint")).collect()] == [15, 14, None, None, None]
    roads = spark.createDataFrame([(1, "MAIN ST", 1), (1, "EXIT 9", 1), (14, "FERRY", 1), (1, " ", 2), (1, "A ST", 9)], "t int, n string, b int")
    assert [r[0] for r in roads.select(clean.searchable(F.col("t"), F.col("n"), F.col("b"))).collect()] == [True, False, False, False, False]


def test_withheld_points_hide_all_events_there(spark):
    df = spark.createDataFrame([(104, 40.7, -74.0), (109, 40.7, -74.0), (109, 40.6, -74.0), (109, 10.0, 10.0), (None, None, None)], "code int, lat double, lon double")
    hidden = clean.withheld_points(df, F.col("code"), F.col("lat"), F.col("lon"))
    got = clean.classify_location(df, F.col("code").isin(*clean.WITHHELD_CODES), "lat", "lon", hidden)
    assert sorted((r.location_type, r.lat) for r in got.select("location_type", F.coalesce("lat", F.lit(0.0)).alias("lat")).collect()) == [("none", 0.0), ("none", 0.0), ("point", 40.6), ("precinct_only", 0.0), ("precinct_only", 0.0)]


def test_anti_guard_ignores_nulls(spark):
    facts = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert [r.code for r in clean.anti_guard(facts, "k", facts.where("k = 1"), "k").collect()] == [2]


def test_profile_of_an_empty_table(spark):
    rows = audit.profile_columns(spark.createDataFrame([], "a int, b string")).collect()
    assert [(r.column, r.null_pct, r.n_distinct) for r in rows] == [("a", None, 0), ("b", None, 0)]


def test_multiset_diff_counts_copies(spark):
    a, b = spark.createDataFrame([(1,), (1,), (None,)], "v int"), spark.createDataFrame([(1,), (2,)], "v int")
    assert {tuple(r) for r in reconcile.multiset_diff(a, b).collect()} == {("left", 1, 1), ("left", None, 1), ("right", 2, 1)}
    assert reconcile.same_rows(a, a) and not reconcile.same_rows(a, b)


def test_prefixes_and_carry_forward(spark):
    df = spark.createDataFrame([("Grand  larceny of motor vehicle",), ("grand larceny",), ("arson",)], "v string")
    assert [r[0] for r in df.select(reconcile.by_prefix(F.col("v"), {"GRAND LARCENY": 109, "GRAND LARCENY OF MOTOR": 110})).collect()] == [110, 109, None]
    sheet = [("1", "MURDER", 3), ("", "RAPE", 4), ("DOC", "MURDER", 1), ("Statistical notes", "", 0), ("2", "X", 9)]
    assert reconcile.carry_forward(sheet) == [("1", "MURDER", 3), ("1", "RAPE", 4), ("DOC", "MURDER", 1)]


def test_sums_of_parts_equal_totals(spark, sf_dir):
    from tessera.plans.fixtures import facts

    f = facts(spark, sf_dir)
    total, shown = f.count(), f.where("lt = 0").count()
    tables = {"hex": (cubes.hex_cube(f), shown), "points": (cubes.points_cube(f), shown), "precinct": (cubes.cube(f, ["pct"]), total)}
    assert cubes.conserved(tables) == [] and cubes.conserved({"wrong": (cubes.cube(f, ["pct"]), total + 1)}) == ["wrong"]
    assert cubes.route("circle", True) == "facts" and cubes.route("street", False) == "street_blocks"


def test_series_are_dense(spark):
    counts = spark.createDataFrame([("a", 1, 5)], "k string, m int, n int")
    dense = report.dense_series(counts, 0, 2, ["k"])
    assert [(r.k, r.m, r.n) for r in dense.orderBy("m").collect()] == [("a", 0, 0), ("a", 1, 5), ("a", 2, 0)]
    assert [r[0] for r in spark.range(1).select(F.size(report.parts_shown(F.lit(45)))).collect()] == [4]


def test_search_routes():
    assert search.route("350 5th ave, brooklyn") == search.Route("address", "350 5th ave", 3, ("350", "5th ave"))
    assert search.route("5th ave & 42nd st").parts == ("5th ave", "42nd st")
    assert search.route("75th precinct").parts == ("75",) and search.route("75").rule == "precinct"
    assert search.route("broadway").rule == "text" and search.route("37-12 80th st").rule == "address"


def test_street_matching(spark):
    rows = [(0, "5 AVENUE", [], 1), (1, "WEST 42 STREET", [], 1), (2, "EAST 42 STREET", None, 1), (3, "52 STREET", [], 3), (4, "SAINT MARKS PLACE", ["EAST 8 STREET"], 1)]
    streets = spark.createDataFrame(rows, "id int, key string, aliases array<string>, boro int")
    found = lambda q, **k: [r.id for r in search.match_streets(streets, q, **k).collect()]
    assert found("42nd st") == [1, 2] and found("5") == [0, 3] and found("5 st") == [] and found("e 8 st") == [4] and found("") == []
    assert found("52", borough=1) == [] and found("42 st", limit=1) == [1]


def test_addresses_respect_parity_and_sides(spark):
    segs = spark.createDataFrame([(1, 7, 100, 198, 101, 199), (2, 7, 298, 200, 0, 0)], "seg int, street int, lf int, lt int, rf int, rt int")
    wanted = spark.createDataFrame([(7, 150), (7, 151), (7, 249), (7, 249 + 1), (8, 150)], "street int, number int")
    got = {(r.number, r.seg, round(r.t, 4)) for r in search.locate_addresses(wanted, segs).collect()}
    assert got == {(150, 1, 0.5102), (151, 1, 0.5102), (250, 2, 0.4898)}
    shapes = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0)]), (2, [(0.0, 0.0), (1.0, 0.0)])], "seg int, points array<struct<x: double, y: double>>")
    assert {(r.number, round(r.x, 4)) for r in search.address_points(search.locate_addresses(wanted, segs), shapes).collect()} == {(150, 0.5102), (151, 0.5102), (250, 0.4898)}


def test_natural_order(spark):
    df = spark.createDataFrame([("Block 10",), ("Block 9",), ("Área 2",)], "v string")
    assert [r.v for r in df.orderBy(search.natural_key(F.col("v"))).collect()][:2] == ["Block 9", "Block 10"]
    long = ["Lot 1" + "0" * 14, "Lot 2" + "0" * 13, "Lot 1" + "0" * 13, "Lot 000000000000000000007", "Lot 8", "Lot 1" + "0" * 13 + "1"]
    df = spark.createDataFrame([(v,) for v in long], "v string")
    assert [r.v for r in df.orderBy(search.natural_key(F.col("v"))).collect()] == sorted(long, key=lambda v: int(v[4:]))


def test_numbers_that_name_a_precinct_beside_a_street():
    assert search.route("75th") == search.Route("text", "75th", 0, (), 75) and search.route("75th st").precinct == 0
    assert search.route("pct 9").precinct == 9 and search.route("3rd, brooklyn") == search.Route("text", "3rd", 3, (), 3)


def test_addresses_on_long_streets_and_wide_ranges(spark):
    """Numbers meet segments by hundreds: across hundreds, with sides that run backwards, without numbers, and hyphenated."""
    segs = spark.createDataFrame([(1, 7, 90, 310, 311, 91), (2, 7, 0, 0, 0, 0), (3, 8, 1_037_012, 1_037_098, 0, 0)], "seg int, street int, lf int, lt int, rf int, rt int")
    wanted = spark.createDataFrame([(7, n) for n in (90, 200, 310, 311, 91, 312)] + [(8, 1_037_050), (8, 37)], "street int, number int")
    got = {(r.street, r.number, r.seg) for r in search.locate_addresses(wanted, segs).collect()}
    assert got == {(7, n, 1) for n in (90, 200, 310, 311, 91)} | {(8, 1_037_050, 3)}


def test_sources_round_trip(spark, tmp_path):
    path = str(tmp_path / "cube")
    cube = spark.range(5000).select((F.col("id") % 50).alias("k"), F.col("id").alias("n"))
    files.write_cube(cube, path, ["k", "n"], files=2)
    assert files.read_table(spark, path, "a_cube").count() == 5000 and [json.loads(x) for x in files.answer(spark, "SELECT count(*) AS c FROM a_cube")] == [{"c": 5000}]
    assert files.rewrite_verified(spark, path, str(tmp_path / "same"))
    assert not files.rewrite_verified(spark, path, str(tmp_path / "less"), lambda df: df.limit(10)) and not (tmp_path / "less").exists()
    files.write_text_table(spark.createDataFrame([("1", "x"), ("2", None)], "a string, b string"), str(tmp_path / "csv"))
    assert files.read_dictionary(spark, str(tmp_path / "csv")).dtypes == [("a", "string"), ("b", "string")]
    assert files.read_dictionary(spark, str(tmp_path / "csv"), "a int, b string").agg(F.sum("a")).first()[0] == 3
    one, two = str(tmp_path / "raw/1"), str(tmp_path / "raw/2")
    spark.createDataFrame([(1, "a")], "x int, y string").write.parquet(one)
    spark.createDataFrame([(1, "b")], "x int, z string").write.parquet(two)
    raw = files.read_raw(spark, one, two)
    assert sorted(raw.columns) == ["x", "y", "z"] and raw.count() == 2 and set(dict(raw.dtypes).values()) == {"string"}


def test_shapes_are_read(spark, tmp_path):
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    features = [{"type": "Feature", "properties": {"code": "7"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Feature", "properties": {"code": "BX010100123"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]
    (tmp_path / "p.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = {(r.code, r.sort_key): len(r.rings) for r in files.read_polygons(spark, str(tmp_path / "p.json"), "code").collect()}
    assert got == {("7", "00000007"): 1, ("BX010100123", "BX010100123"): 2}
    (tmp_path / "s.json").write_text(json.dumps({"properties": {"id": "1"}, "geometry": {"type": "LineString", "coordinates": [[0.0, 1.0], [2.0, 3.0]]}}) + "\n")
    assert [tuple(p) for p in files.read_segments(spark, str(tmp_path / "s.json")).first().points] == [(0.0, 1.0), (2.0, 3.0)]


def test_retries_stop_at_client_errors():
    import urllib.error

    waits, fails = [], iter([OSError("x"), urllib.error.HTTPError("u", 429, "slow", {}, None)])

    def fetch():
        if e := next(fails, None):
            raise e
        return b"ok"

    assert files.with_retry(fetch, sleep=waits.append) == b"ok" and waits == [5, 10]


def test_paged_source(spark, tmp_path):
    """Two years in pages of two from a local server."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    class Pages(BaseHTTPRequestHandler):
        wrong = 0

        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            rows = [{"n": q["year"] - 2013 + Pages.wrong}] if "count" in q else [{"id": f"{q['year']}-{k}"} for k in range(q["year"] - 2013)][q["offset"] : q["offset"] + q["limit"]]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(rows).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(files.PagedRecords)
    url = f"http://127.0.0.1:{server.server_port}/?year={{year}}&offset={{offset}}&limit={{limit}}"
    count_url = f"http://127.0.0.1:{server.server_port}/?year={{year}}&offset=0&limit=0&count={{year}}"
    df = spark.read.format("paged").option("url", url).option("years", "2016,2017").option("limit", "2").load()
    assert {(r.year, json.loads(r.record)["id"]) for r in df.collect()} == {(2016, f"2016-{k}") for k in range(3)} | {(2017, f"2017-{k}") for k in range(4)}
    path = str(tmp_path / "years")
    options = {"url": url, "limit": "2", "count_url": count_url}
    assert files.download(spark, path, [2016, 2017], **options) == [2016, 2017]
    assert files.download(spark, path, [2016, 2017, 2018], force=(2017,), **options) == [2017, 2018]
    assert spark.read.parquet(path).groupBy("rpt_year").count().collect() and spark.read.parquet(path).count() == 3 + 4 + 5
    Pages.wrong = 1
    with pytest.raises(Exception, match="counts"):
        files.download(spark, path, [2019], **options)
    assert not (tmp_path / "years/rpt_year=2019").exists()
    server.shutdown()


def test_sheets_as_agencies_publish_them(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Historic figures\nPCT,OFFENSE,2016,2017.0,note\n1,Murder & non negl.,3,4,x\n,GRAND LARCENY,10,n/a,\n,Grand  larceny of motor vehicle,5,6,\n,TOTAL SEVEN,18,10,\nDOC,ROBBERY,1,\nStatistical notes,ROBBERY,9,9,\n")
    prefixes = {"MURDER": 101, "ROBBERY": 105, "GRAND LARCENY": 109, "GRAND LARCENY OF MOTOR": 110}
    rows = files.read_sheet(spark, str(tmp_path / "s.csv"))
    got = reconcile.sheet_totals(rows, "PCT", prefixes, range(2016, 2018), unit=True)
    assert got == [("1", "101", 2016, 3.0), ("1", "101", 2017, 4.0), ("1", "109", 2016, 10.0), ("1", "110", 2016, 5.0), ("1", "110", 2017, 6.0), ("1", "total", 2016, 18.0), ("1", "total", 2017, 10.0), ("DOC", "105", 2016, 1.0)]
    city = [["OFFENSE", 2016.0, 2017.0], ["Robbery", 7.0, 8.0], ["a note", "", ""]]
    assert reconcile.sheet_totals(city, "OFFENSE", prefixes, range(2016, 2018)) == [(None, "105", 2016, 7.0), (None, "105", 2017, 8.0)]


def test_answers_follow_their_snapshot(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("kept")
    ask = lambda: store.Answers(spark, str(tmp_path / "answers"), paths.snapshot(spark, path)).get("SELECT count(*) AS n FROM kept").first().n
    assert ask() == 3
    spark.range(5).createOrReplaceTempView("kept")
    assert ask() == 3  # the table's files are as they were
    spark.range(7).write.mode("append").parquet(path)
    assert ask() == 5
    spark.range(8).write.mode("append").parquet(path)
    assert ask() == 5 and len(paths.folders(spark, str(tmp_path / "answers"))) == 2  # the oldest is gone


def test_a_table_is_replaced_after_verification(spark, tmp_path):
    path, new = str(tmp_path / "t"), str(tmp_path / "new")
    spark.range(100).repartition(5).write.parquet(path)
    assert files.rewrite_verified(spark, path, new, lambda df: df.coalesce(1), replace=True)
    assert len(list((tmp_path / "t").glob("part-*"))) == 1 and not (tmp_path / "new").exists() and not (tmp_path / "t.old").exists()
    assert spark.read.parquet(path).count() == 100
    assert not files.rewrite_verified(spark, path, new, lambda df: df.limit(3), replace=True) and spark.read.parquet(path).count() == 100


def test_years_are_found_and_lists_made_of_few(spark):
    df = spark.createDataFrame([("a", 2001), ("a", 2003), ("b", 2001), (None, None)], "k string, y int")
    got = audit.pivot_counts(df, "k", "y")
    assert got.columns == ["k", "2001", "2003"] and {tuple(r) for r in got.collect()} == {("a", 1, 1), ("b", 1, 0), (None, 0, 0)}
    labels = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z"), (None, "p"), (None, "q"), (3, None)], "code int, label string")
    assert {tuple(r) for r in audit.labels_per_code(labels, "code", "label").collect()} == {(1, 2, "x / y"), (None, 2, "p / q")}


def test_reports_as_markdown(spark):
    df = spark.createDataFrame([("a|b", 1234567), (None, 2)], "k string, n long").orderBy(F.desc("n"))
    assert files.markdown_table(df) == "| k | n |\n|---|---|\n| a\\|b | 1,234,567 |\n|  | 2 |\n"


def test_what_an_application_wrote_is_deleted_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paths, "shared_dir", lambda _: f"file://{tmp_path}")
    spark.range(3).write.parquet(paths.fresh_path(spark, "some"))
    assert any(tmp_path.rglob("*.parquet"))
    paths.clear(spark)
    assert not any(tmp_path.rglob("*.parquet"))

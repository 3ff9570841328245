"""Views of the test tables as places, events and polygons; the same in Spark and in SQL.

Customers stand for places, nations for precincts, regions for boroughs, orders for events, priorities for categories.
Coordinates are multiples of 1/2048 degree: exact as float and double, and able to lie on polygon edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.grid import hilbert_ranges
from tessera.operators import cubes
from tessera.sources import store

YEAR0 = 1995
MONTHS = 84
LATTICE = 16

LOCS = """locs AS (
SELECT c_custkey AS loc_id, c_nationkey AS pct, n_regionkey + 1 AS boro, c_mktsegment AS premise,
  CAST(40.5 AS DOUBLE) + CAST((c_custkey * 7919) % 1024 AS DOUBLE) / CAST(2048 AS DOUBLE) AS lat,
  CAST(-74.25 AS DOUBLE) + CAST((c_custkey * 104729) % 1024 AS DOUBLE) / CAST(2048 AS DOUBLE) AS lon
FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
FACTS = """facts AS (
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS report_date,
  CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INT) AS m,
  CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS cat,
  CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS lt,
  l.loc_id, l.pct, l.boro, l.premise,
  CASE WHEN o_orderstatus = 'O' THEN l.lat END AS lat, CASE WHEN o_orderstatus = 'O' THEN l.lon END AS lon
FROM orders JOIN locs l ON o_custkey = l.loc_id)"""
POLYS = """polys AS (
SELECT n_nationkey AS code,
  CAST(-74.25 AS DOUBLE) + CAST(n_nationkey % 5 AS DOUBLE) * CAST(0.09375 AS DOUBLE) AS x0,
  CAST(-74.25 AS DOUBLE) + CAST(n_nationkey % 5 + 1 AS DOUBLE) * CAST(0.09375 AS DOUBLE) AS x1,
  CAST(40.5 AS DOUBLE) + CAST(floor(n_nationkey / 5.0) AS DOUBLE) * CAST(0.09375 AS DOUBLE) AS y0,
  CAST(40.5 AS DOUBLE) + CAST(floor(n_nationkey / 5.0) + 1 AS DOUBLE) * CAST(0.09375 AS DOUBLE) AS y1
FROM nation)"""
#: Which streets and blocks a place lies on; a third of the places are at a corner of two.
BRIDGE = """bridge AS (
SELECT CAST(lat AS FLOAT) AS lat, CAST(lon AS FLOAT) AS lon, CAST(loc_id % 7 AS INT) AS street, CAST(CASE WHEN loc_id % 5 = 0 THEN -1 ELSE loc_id % 900 // 100 * 100 END AS INT) AS block FROM locs
UNION SELECT CAST(lat AS FLOAT), CAST(lon AS FLOAT), CAST(10 + loc_id % 7 AS INT), CAST(CASE WHEN loc_id % 5 = 0 THEN -1 ELSE loc_id % 900 // 100 * 100 END AS INT) FROM locs WHERE loc_id % 3 = 0)"""
WITH = f"WITH {LOCS}, {FACTS}, {POLYS}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def locs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.col("c_custkey").alias("loc_id"), F.col("c_nationkey").alias("pct"), (F.col("n_regionkey") + 1).alias("boro"), F.col("c_mktsegment").alias("premise"),
        (40.5 + (F.col("c_custkey") * 7919 % 1024) / 2048.0).alias("lat"), (-74.25 + (F.col("c_custkey") * 104729 % 1024) / 2048.0).alias("lon"),
    )


def facts(spark: SparkSession, d: str, orders: DataFrame | None = None) -> DataFrame:
    o, at = table(spark, d, "orders") if orders is None else orders, locs(spark, d)
    shown = F.col("o_orderstatus") == "O"
    return o.join(at, F.col("o_custkey") == F.col("loc_id")).select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("report_date"), ((F.year("o_orderdate") - YEAR0) * 12 + F.month("o_orderdate") - 1).alias("m"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("cat"), F.when(shown, 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("lt"),
        "loc_id", "pct", "boro", "premise", F.when(shown, F.col("lat")).alias("lat"), F.when(shown, F.col("lon")).alias("lon"),
    )


def polys(spark: SparkSession, d: str) -> DataFrame:
    """code and rings (one rectangle each)."""
    n, w = F.col("n_nationkey"), 0.09375
    x0, x1, y0, y1 = -74.25 + n % 5 * w, -74.25 + (n % 5 + 1) * w, 40.5 + F.floor(n / 5) * w, 40.5 + (F.floor(n / 5) + 1) * w
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    return table(spark, d, "nation").select(n.alias("code"), F.array(ring).alias("rings"))


#: Places in the order of customers, four to a place; a customer's line leads from its place to the next one.
SPOTS = """spots AS (SELECT c_custkey AS seg, c_nationkey AS street, c_custkey // 4 AS k FROM customer),
named AS (SELECT DISTINCT k, street FROM spots),
met AS (SELECT a.street AS a, b.street AS b, a.k FROM named a JOIN named b ON a.k = b.k AND a.street < b.street)"""
LAT_OF, LON_OF = "(40.5 + ({k}) % 512 / 1024.0)", "(-74.25 + ({k}) // 512 % 512 / 1024.0)"
X_OF, Y_OF = (f"CAST(round_even({c} * 100000, 0) AS INT)" for c in (LON_OF, LAT_OF))


def spots(spark: SparkSession, d: str) -> DataFrame:
    """seg, street, k and the ends of a customer's line: lat0, lon0, lat1, lon1."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("seg"), F.col("c_nationkey").alias("street"), F.expr("c_custkey DIV 4").alias("k"))
    place = lambda k: (40.5 + k % 512 / 1024.0, -74.25 + F.floor(k / 512) % 512 / 1024.0)
    (lat0, lon0), (lat1, lon1) = place(F.col("k")), place(F.col("k") + 1)
    return rows.withColumns({"lat0": lat0, "lon0": lon0, "lat1": lat1, "lon1": lon1})


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Customers' lines as segments of a network: seg, street, points, from_level, to_level."""
    at = lambda k: F.struct(F.col(f"lat{k}").alias("lat"), F.col(f"lon{k}").alias("lon"))
    level = (F.col("seg") % 2).cast("int")
    return spots(spark, d).select("seg", "street", F.array(at(0), at(1)).alias("points"), level.alias("from_level"), level.alias("to_level"))


def corners(spark: SparkSession, d: str) -> DataFrame:
    """Places at which customers of several nations are: lat, lon, streets."""
    return spots(spark, d).groupBy(F.col("lat0").alias("lat"), F.col("lon0").alias("lon")).agg(F.sort_array(F.collect_set("street")).alias("streets")).where("size(streets) > 1")


def lattice(spark: SparkSession) -> DataFrame:
    """Streets on a lattice: 16 from west to east (0 to 15), 16 from south to north (16 to 31); one segment each."""
    k = F.col("k").cast("double") / 32
    row = lambda a, b: F.array(*[F.struct(F.lit(y).alias("lat"), F.lit(x).alias("lon")) for y, x in (a, b)])
    base = spark.range(LATTICE).select(F.col("id").cast("int").alias("k"))
    across = base.select(F.col("k").alias("street"), row((40.5 + k, -74.25), (40.5 + k, -73.75)).alias("points"))
    along = base.select((F.col("k") + LATTICE).alias("street"), row((40.5, -74.25 + k), (41.0, -74.25 + k)).alias("points"))
    return across.unionByName(along).withColumns({"seg": F.col("street"), "from_level": F.lit(0), "to_level": F.lit(0)})


def lattice_nodes(spark: SparkSession) -> DataFrame:
    """Every crossing with its two streets."""
    a = spark.range(LATTICE).select(F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(LATTICE - 1))))
    return a.select((40.5 + F.col("i") / 32.0).alias("lat"), (-74.25 + F.col("j") / 32.0).alias("lon"), F.array(F.col("i"), F.col("j") + LATTICE).alias("streets"))


def bridge(spark: SparkSession, d: str) -> DataFrame:
    """lat, lon (float), street, block of every place."""
    k = F.col("loc_id")
    streets = F.when(k % 3 == 0, F.array(k % 7, 10 + k % 7)).otherwise(F.array(k % 7))
    block = F.when(k % 5 == 0, -1).otherwise(k % 900 - k % 100)
    rows = locs(spark, d).select(F.col("lat").cast("float").alias("lat"), F.col("lon").cast("float").alias("lon"), F.explode(streets.cast("array<int>")).alias("street"), block.cast("int").alias("block"))
    return rows.distinct()


def _with_block(f: DataFrame) -> DataFrame:
    return f.withColumns({"street": F.col("pct"), "block": F.col("loc_id") - F.col("loc_id") % 100})


#: Cubes that questions read: how each is rolled up from the finest, and the order that it is written in.
_KINDS = {
    "hex": (cubes.hex_cube, ["q", "r", "m"]),
    "points": (lambda f: cubes.points_cube(f, ["pct"]), ["hk", "m", "cat"]),
    "areas": (lambda f: cubes.cube(f, ["pct", "boro", "lt"]), ["pct", "m"]),
    "blocks": (lambda f: cubes.cube(_with_block(f), ["street", "block"]), ["street", "block", "m"]),
    "places": (lambda f: cubes.cube(f, ["loc_id"]), ["loc_id", "m"]),
}
_CUBES = store.Cubes(lambda spark, d, orders: cubes.fine(facts(spark, d, orders), ["loc_id", "pct", "boro", "lt", "lat", "lon"]), _KINDS)


def _tables(d: str) -> tuple[str, str, list[str]]:
    return d, f"{d}/orders.parquet", [f"{d}/customer.parquet", f"{d}/nation.parquet"]


def stored(spark: SparkSession, d: str, kind: str, within: list[tuple[int, int]] | None = None) -> DataFrame:
    """A cube of the facts, kept up as orders come and go: months and keys of a question reach its scan."""
    return _CUBES.get(spark, kind, *_tables(d), within)


def all_stored(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    _CUBES.build(spark, list(_KINDS), *_tables(d))
    return {kind: stored(spark, d, kind) for kind in _KINDS}


def points_in(spark: SparkSession, d: str, view: tuple[float, float, float, float]) -> DataFrame:
    """The cube of places in a view (south, north, west, east): files and row groups by Hilbert key."""
    return cubes.in_view(stored(spark, d, "points", hilbert_ranges(view)), view)

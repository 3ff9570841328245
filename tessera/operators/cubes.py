"""Month-by-category cubes for every kind of place, and the questions that they answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.grid import CITY, Grid, axial, distance_m, hilbert_key, hilbert_ranges, in_ranges
from tessera.functions.period import in_months, in_types

#: Where each question is answered: (kind of place, needs hours) -> cube.
ROUTES = {
    ("city", False): "agg_precinct", ("city", True): "agg_time", ("borough", False): "agg_precinct", ("borough", True): "agg_time",
    ("precinct", False): "agg_precinct", ("precinct", True): "agg_time", ("neighborhood", False): "agg_nta", ("neighborhood", True): "agg_time",
    ("street", False): "street_blocks", ("street", True): "agg_time", ("hexagon", False): "hex", ("hexagon", True): "facts",
    ("spot", False): "points", ("spot", True): "facts", ("circle", False): "points", ("circle", True): "facts",
}


def route(kind: str, hours: bool) -> str:
    return ROUTES[kind, hours]


def _rows(facts: DataFrame) -> Column:
    """How many events rows stand for: one each, or the n of a finer cube that they come from."""
    return F.sum("n") if "n" in facts.columns else F.count("*")


def fine(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The finest cube, n for each combination of keys, month and category, from which coarser ones are rolled up."""
    return facts.groupBy(*keys, "m", "cat").agg(F.count("*").alias("n"))


def cube(facts: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """n for each combination of keys, month and category."""
    rows = facts if where is None else facts.where(where)
    return rows.groupBy(*keys, "m", "cat").agg(_rows(facts).alias("n"))


def hex_cube(facts: DataFrame, grid: Grid = CITY) -> DataFrame:
    """q, r, m, cat, n of the facts that have a place."""
    at = facts.where("lt = 0").withColumn("_h", axial(F.col("lat"), F.col("lon"), grid))
    return at.groupBy(F.col("_h.q").alias("q"), F.col("_h.r").alias("r"), "m", "cat").agg(_rows(facts).alias("n"))


def points_cube(facts: DataFrame, keep: list[str] = ()) -> DataFrame:
    """n for each place (float coordinates), month and category, with hk, the Hilbert key of the place: the order to write in."""
    at = facts.where("lt = 0").withColumns({"lat": F.col("lat").cast("float"), "lon": F.col("lon").cast("float")})
    n = at.groupBy("lat", "lon", *keep, "m", "cat").agg(_rows(facts).alias("n"))
    return n.withColumn("hk", hilbert_key(F.col("lat").cast("double"), F.col("lon").cast("double")))


def in_view(points: DataFrame, view: tuple[float, float, float, float]) -> DataFrame:
    """Rows of the cube of places in a view (south, north, west, east): key ranges that reach the scan, then the view itself."""
    south, north, west, east = view
    return points.where(in_ranges(F.col("hk"), hilbert_ranges(view))).where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def circle_view(lat: float, lon: float, radius: float, grid: Grid = CITY) -> tuple[float, float, float, float]:
    """The view that a circle fits into."""
    return lat - radius / grid.ky, lat + radius / grid.ky, lon - radius / grid.kx, lon + radius / grid.kx


def counts(cube_: DataFrame, by: list[str], months: list[int] | None = None, types: list[int] | None = None, where: Column | None = None) -> DataFrame:
    """Sum of n by some keys, for a set of months and types (None: all)."""
    rows = cube_
    if months is not None:
        rows = rows.where(in_months(F.col("m"), months))
    if types is not None:
        rows = rows.where(in_types(F.col("cat"), types))
    if where is not None:
        rows = rows.where(where)
    return rows.groupBy(*by).agg(F.sum("n").cast("bigint").alias("n"))


def now_and_before(cube_: DataFrame, by: list[str], now: list[int], before: list[int], types: list[int] | None = None) -> DataFrame:
    """Totals of two sets of months in one scan: by..., now, before (null: none)."""
    n, m = F.col("n"), F.col("m")
    rows = cube_.where(in_months(m, now) | in_months(m, before))
    if types is not None:
        rows = rows.where(in_types(F.col("cat"), types))
    total = lambda months: F.sum(F.when(in_months(m, months), n)).cast("bigint")
    return rows.groupBy(*by).agg(total(now).alias("now"), total(before).alias("before"))


def time_cube(rows: DataFrame, kinds: list[tuple[int, Column, Column]]) -> DataFrame:
    """kind, id, year, cat, dow, hour, n over several kinds of place. kinds: number, ids (an array, for places that belong to
    several) and which rows count. One scan and one shuffle: each row fans out to its places."""
    none = F.array().cast("array<struct<kind:int,id:bigint>>")

    def places_of(kind: int, ids: Column, where: Column) -> Column:
        return F.when(where, F.transform(ids, lambda i: F.struct(F.lit(kind).alias("kind"), i.cast("bigint").alias("id")))).otherwise(none)

    places = [places_of(*k) for k in kinds]
    flat = rows.select(F.explode(F.concat(*places)).alias("_p"), "year", "cat", "dow", "hour")
    return flat.groupBy("_p.kind", "_p.id", "year", "cat", "dow", "hour").agg(F.count("*").alias("n"))


def type_year_totals(facts: DataFrame, key: str, year: Column) -> DataFrame:
    """n by key, type and year, with a row 'all' beside the types."""
    rows = facts.select(key, F.col("cat").cast("string").alias("type"), year.alias("year"))
    both = rows.select(key, "year", F.explode(F.array(F.col("type"), F.lit("all"))).alias("type"))
    return both.groupBy(key, "type", "year").agg(F.count("*").alias("n"))


def merge_units(unit: Column, months: list[int], members: tuple[int, ...], into: int, split_month: int) -> Column:
    """Units that were one until a month count as one when the months reach back before it."""
    return F.when(unit.isin(*members), F.lit(into)).otherwise(unit) if months and min(months) < split_month else unit


def fan_out(facts: DataFrame, bridge: DataFrame) -> DataFrame:
    """Facts to every street of their place, by float coordinates; a fact counts for each street that meets there."""
    as_float = {"lat": F.col("lat").cast("float"), "lon": F.col("lon").cast("float")}
    return facts.withColumns(as_float).join(bridge.withColumns(as_float), ["lat", "lon"])


def undrawable(facts: DataFrame) -> DataFrame:
    """How many facts a map can't show: no exact place, no precinct, no borough. One scan."""
    count = lambda p: F.sum(p.cast("bigint"))
    return facts.agg(
        count(F.col("lt").isin(1, 2)).alias("no_place"), count(F.col("lt") == 1).alias("precinct_only"), count(F.col("pct") < 0).alias("no_precinct"),
        (F.count("*") - count(F.col("boro").between(1, 5))).alias("no_borough"), F.count("*").alias("total"),
    )


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """What the n of each cube add up to: cube, n."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n")).select(F.lit(name).alias("cube"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def conserved(tables: dict[str, tuple[DataFrame, int]]) -> list[str]:
    """Names of cubes whose n don't add up to what they should."""
    return [name for name, (df, want) in tables.items() if (df.agg(F.sum("n")).first()[0] or 0) != want]


def in_circle(points: DataFrame, lat: float, lon: float, radius: float, grid: Grid = CITY) -> DataFrame:
    """Rows of the cube of places within a radius of a place: its view, which reaches the scan, then the exact distance."""
    near = in_view(points, circle_view(lat, lon, radius, grid))
    return near.where(distance_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon), grid) <= radius)


def blocks_of(points: DataFrame, bridge: DataFrame, where: Column | None = None) -> DataFrame:
    """n by street and block of points (float lat and lon, n): each place counts for every street and block that it lies on.

    bridge: lat, lon (float), street, block (-1: none, left out)."""
    rows = points if where is None else points.where(where)
    return rows.join(bridge.where("block >= 0"), ["lat", "lon"]).groupBy("street", "block").agg(F.sum("n").cast("bigint").alias("n"))


def place_totals(points: DataFrame) -> DataFrame:
    """n of every place, and how many places have that many: the sorted totals that one place is compared with."""
    return points.groupBy("lat", "lon").agg(F.sum("n").cast("bigint").alias("n")).groupBy("n").agg(F.count("*").alias("places"))


def clustered_points(facts: DataFrame) -> DataFrame:
    """The cube of places with hk, the smallest Hilbert key of the doubles that became one float place: the order to write in."""
    at = facts.where("lt = 0").withColumn("hk", hilbert_key(F.col("lat"), F.col("lon")))
    return at.groupBy(F.col("lat").cast("float").alias("lat"), F.col("lon").cast("float").alias("lon"), "m", "cat").agg(_rows(facts).alias("n"), F.min("hk").alias("hk"))


def street_index(counts: DataFrame, lengths: DataFrame, key: str, least_m: float = 300.0) -> DataFrame:
    """Per 100 m: rate, index against the city (every street counts there) and whether the street is long enough to rank."""
    rows = lengths.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    city = rows.agg((F.sum("n") / F.sum("length_m") * 100).alias("_city"))
    rate = F.try_divide(F.col("n").cast("double"), F.col("length_m")) * 100
    out = rows.crossJoin(F.broadcast(city))  # one row
    return out.select(key, "n", "length_m", rate.alias("rate"), F.try_divide(100.0 * rate, F.col("_city")).alias("idx"), (F.col("length_m") >= least_m).alias("ranked"))

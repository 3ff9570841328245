"""Spatial joins without a geometry library: both sides are cut into grid cells, meet by an equi-join and are tested exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.grid import CITY, Grid, local_xy, segment_distance
from tessera.operators import polygons
from tessera.sources.paths import stored


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("bigint")


def _cover(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, size: float) -> DataFrame:
    """A row for every cell that a box touches."""
    return df.withColumn("_cx", F.explode(F.sequence(_cell(x0, size), _cell(x1, size)))).withColumn("_cy", F.explode(F.sequence(_cell(y0, size), _cell(y1, size))))


def polygon_hits(points: DataFrame, polys: DataFrame, cell: float, x: str = "lon", y: str = "lat", code: str = "code", rings: str = "rings", strict: bool = False) -> DataFrame:
    """A row for every distinct point and polygon that holds it (the boundary counts unless strict): x, y, code.

    Polygons are covered by cells; points take one cell, so only they grow with the data."""
    at = points.select(F.col(x).alias("_px"), F.col(y).alias("_py")).where("_px IS NOT NULL AND _py IS NOT NULL").distinct()
    tested = polygons.tested(at, polygons.cover(polys, cell, [code], rings), cell, "_px", "_py")
    kept = tested.where("_in AND NOT _on" if strict else "_in OR _on")
    return kept.select(F.col("_px").alias(x), F.col("_py").alias(y), code)


def assign_polygon(points: DataFrame, polys: DataFrame, cell: float, cutoff: float, x: str = "lon", y: str = "lat", code: str = "code", rings: str = "rings") -> DataFrame:
    """Each distinct point with its polygon: x, y, code, hits, label (inside, boundary, nearest, none).

    The lowest code wins; points in none take the nearest polygon within the cutoff, the lowest code of those that tie."""
    at = points.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()).distinct()
    hits = polygon_hits(at, polys, cell, x, y, code, rings).groupBy(x, y).agg(F.min(code).alias("_hit"), F.count("*").alias("hits"))
    marked = at.join(hits, [x, y], "left")
    near = polygons.nearest(marked.where("hits IS NULL"), polys, cell, cutoff, x, y, code, rings).select(x, y, F.col(code).alias("_near"))
    out = marked.join(near, [x, y], "left")
    label = F.when(F.col("hits") == 1, "inside").when(F.col("hits") > 1, "boundary").when(F.col("_near").isNotNull(), "nearest").otherwise("none")
    return out.select(x, y, F.coalesce("_hit", "_near").alias(code), F.coalesce("hits", F.lit(0)).alias("hits"), label.alias("label"))


def first_feature(points: DataFrame, polys: DataFrame, cell: float, ordinal: str, x: str = "lon", y: str = "lat", code: str = "code", rings: str = "rings") -> DataFrame:
    """The first polygon in file order that holds each point; edges follow the half-open rule of ray casting."""
    at = points.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()).distinct()
    inside = polygons.tested(at, polygons.cover(polys, cell, [code, ordinal], rings), cell, x, y).where("_in")
    return inside.groupBy(x, y).agg(F.min_by(code, ordinal).alias(code))


def within_radius(centers: DataFrame, places: DataFrame, radius: float, center_id: str, keep: list[str], grid: Grid = CITY) -> DataFrame:
    """Pairs of centers and places at most radius meters apart: center_id, keep..., d. Both have lat and lon.

    Cells have the radius' size; each center visits its cell and the eight around it."""
    cx, cy = local_xy(F.col("lat"), F.col("lon"), grid)
    mid = centers.select(center_id, cx.alias("_x"), cy.alias("_y"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    mid = mid.withColumn("_i", F.explode(around)).withColumn("_j", F.explode(around))
    mid = mid.select(center_id, "_x", "_y", (_cell(F.col("_x"), radius) + F.col("_i")).alias("_cx"), (_cell(F.col("_y"), radius) + F.col("_j")).alias("_cy"))
    there = places.select(*[F.col(k).alias(f"p_{k}") for k in keep], cx.alias("_px"), cy.alias("_py"))
    there = there.withColumns({"_cx": _cell(F.col("_px"), radius), "_cy": _cell(F.col("_py"), radius)})
    d = F.hypot(F.col("_x") - F.col("_px"), F.col("_y") - F.col("_py"))
    return mid.join(there, ["_cx", "_cy"]).withColumn("d", d).where(F.col("d") <= radius).select(center_id, *[F.col(f"p_{k}").alias(k) for k in keep], "d")


def radius_counts(centers: DataFrame, places: DataFrame, radius: float, center_id: str, weight: str) -> DataFrame:
    """Sum of weights within the radius of every center, zero where there is nothing. places: one row a location."""
    sums = within_radius(centers, places, radius, center_id, [weight]).groupBy(center_id).agg(F.sum(weight).alias("n"))
    return centers.select(center_id).join(sums, center_id, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def land_grid(box: tuple[float, float, float, float], step: float, polys: DataFrame, cell: float, grid: Grid = CITY, **names) -> DataFrame:
    """Points of a regular lattice (step in meters) that lie on a polygon: lat, lon."""
    south, north, west, east = box
    spark = polys.sparkSession
    rows, columns = int((north - south) * grid.ky // step), int((east - west) * grid.kx // step)
    lattice = spark.range(rows + 1).select((F.lit(south) + F.col("id") * step / grid.ky).alias("lat")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(columns))))
    lattice = lattice.select("lat", (F.lit(west) + F.col("k") * step / grid.kx).alias("lon"))
    return polygon_hits(lattice, polys, cell, **names).select("lat", "lon").distinct()


def _edge_rows(segments: DataFrame, grid: Grid) -> DataFrame:
    """segments (seg, street, points: array<struct<lat, lon>>) as straight edges in local meters."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("points") - 2), lambda i: F.struct(F.col("points")[i].alias("a"), F.col("points")[i + 1].alias("b")))
    rows = segments.select("seg", "street", F.explode(pairs).alias("e"))
    ax, ay = local_xy(F.col("e.a.lat"), F.col("e.a.lon"), grid)
    bx, by = local_xy(F.col("e.b.lat"), F.col("e.b.lon"), grid)
    return rows.select("seg", "street", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))


def _covered_edges(edges: DataFrame, pad: float, cell: float) -> DataFrame:
    """Edges cut into stretches of at most a cell, so that a long street covers a line of cells, not a square."""
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / cell))
    cut = edges.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")
    xs, ys = [at("ax", "bx", F.col("_k")), at("ax", "bx", F.col("_k") + 1)], [at("ay", "by", F.col("_k")), at("ay", "by", F.col("_k") + 1)]
    return _cover(cut, F.least(*xs) - pad, F.greatest(*xs) + pad, F.least(*ys) - pad, F.greatest(*ys) + pad, cell).drop("_n", "_k").distinct()


def network_candidates(points: DataFrame, segments: DataFrame, reach: float, point_id: str, grid: Grid = CITY, cell: float = 120.0) -> DataFrame:
    """point_id, seg, street and d for every segment within reach of a point."""
    x, y = local_xy(F.col("lat"), F.col("lon"), grid)
    at = points.select(point_id, x.alias("_x"), y.alias("_y")).withColumns({"_cx": _cell(F.col("_x"), cell), "_cy": _cell(F.col("_y"), cell)})
    near = at.join(_covered_edges(_edge_rows(segments, grid), reach, cell), ["_cx", "_cy"])
    d = segment_distance(F.col("_x"), F.col("_y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return near.withColumn("d", d).where(F.col("d") <= reach).groupBy(point_id, "seg", "street").agg(F.min("d").alias("d"))


def snap_to_network(points: DataFrame, segments: DataFrame, nodes: DataFrame, point_id: str, reach: float = 30.0, corner: float = 3.0, grid: Grid = CITY) -> DataFrame:
    """point_id, street, seg: the streets that each point counts for.

    Within ``corner`` meters of nodes where two streets or more meet, all of those streets that also have a segment in reach;
    elsewhere the street of the nearest segment. Segments with a negative street absorb points but give no row.
    nodes: lat, lon, streets (array)."""
    points = points.select(point_id, "lat", "lon")
    found = stored(network_candidates(points, segments, reach, point_id, grid), "candidates")  # read twice below
    per_street = found.where("street >= 0").groupBy(point_id, "street").agg(F.min(F.struct("d", "seg")).alias("b")).select(point_id, "street", F.col("b.seg").alias("seg"))
    nearest = found.groupBy(point_id).agg(F.min(F.struct("d", "seg", "street")).alias("b")).select(point_id, F.col("b.street").alias("street"), F.col("b.seg").alias("seg"))
    meets = within_radius(points, nodes, corner, point_id, ["streets"], grid).select(point_id, F.explode("streets").alias("street")).distinct()
    corners = meets.groupBy(point_id).agg(F.count("*").alias("k")).where("k >= 2").select(point_id)
    at_corner = meets.join(corners, point_id, "left_semi").join(per_street, [point_id, "street"])
    elsewhere = nearest.join(corners, point_id, "left_anti").where("street >= 0")
    return at_corner.select(point_id, "street", "seg").unionByName(elsewhere.select(point_id, "street", "seg"))


def network_nodes(segments: DataFrame, tolerance: float = 0.75, grid: Grid = CITY) -> DataFrame:
    """Ends of segments that meet (within the tolerance, on one level) and have two streets or more: lat, lon, streets.

    segments: seg, street, points, from_level, to_level."""
    last = F.element_at("points", -1)
    ends = segments.where("street >= 0").select("street", F.explode(F.array(F.struct(F.col("points")[0].alias("p"), F.col("from_level").alias("level")), F.struct(last.alias("p"), F.col("to_level").alias("level")))).alias("e"))
    x, y = local_xy(F.col("e.p.lat"), F.col("e.p.lon"), grid)
    keyed = ends.select("street", F.col("e.p.lat").alias("lat"), F.col("e.p.lon").alias("lon"), F.rint(x / tolerance).alias("qx"), F.rint(y / tolerance).alias("qy"), F.col("e.level").alias("level"))
    grouped = keyed.groupBy("qx", "qy", "level").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.sort_array(F.collect_set("street")).alias("streets"))
    return grouped.where(F.size("streets") >= 2).select("lat", "lon", "level", "streets")


def corner_pairs(nodes: DataFrame) -> DataFrame:
    """Every unordered pair of streets at a node: a < b, lat, lon."""
    pairs = F.flatten(F.transform("streets", lambda a: F.transform(F.filter("streets", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return nodes.select("lat", "lon", F.explode(pairs).alias("p")).select("p.a", "p.b", "lat", "lon").distinct()


def roadbed_weights(segments: DataFrame, near: float = 70.0, angle: float = 20.0, offset: float = 8.0) -> DataFrame:
    """Weight of each segment's length: 1 / (1 + k) for k (2 at most) parallel segments of its street beside it.

    segments: seg, street, x0, y0, x1, y1 (ends in meters), mx, my (mean vertex)."""
    heading = F.pmod(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")), F.lit(3.141592653589793))
    key = lambda x, y: F.concat_ws(",", F.round(x, 1), F.round(y, 1))
    base = segments.select("seg", "street", "mx", "my", heading.alias("h"), F.array(key(F.col("x0"), F.col("y0")), key(F.col("x1"), F.col("y1"))).alias("ends"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = base.withColumn("_i", F.explode(around)).withColumn("_j", F.explode(around)).withColumns({"_cx": _cell(F.col("mx"), near) + F.col("_i"), "_cy": _cell(F.col("my"), near) + F.col("_j")})
    right = base.select(*[F.col(c).alias(f"o_{c}") for c in base.columns], _cell(F.col("mx"), near).alias("o_cx"), _cell(F.col("my"), near).alias("o_cy"))
    dx, dy, da = F.col("o_mx") - F.col("mx"), F.col("o_my") - F.col("my"), F.abs(F.col("h") - F.col("o_h"))
    beside = (
        (F.col("street") == F.col("o_street")) & (F.col("_cx") == F.col("o_cx")) & (F.col("_cy") == F.col("o_cy")) & (F.col("seg") != F.col("o_seg")) & (F.hypot(dx, dy) <= near)
        & (F.least(da, 3.141592653589793 - da) < F.radians(F.lit(angle))) & (F.abs(F.cos("h") * dy - F.sin("h") * dx) > offset) & ~F.arrays_overlap("ends", "o_ends")
    )
    k = left.join(right, beside).groupBy("seg").agg(F.count("*").alias("k"))
    return segments.select("seg").join(k, "seg", "left").select("seg", (1.0 / (1 + F.least(F.lit(2), F.coalesce("k", F.lit(0))))).alias("weight"))


def representative(df: DataFrame, keys: list[str], value: str, top: int) -> DataFrame:
    """The top values of each key by weight w (ties: the smaller value), with how many values there are."""
    by = Window.partitionBy(*keys)
    ranked = df.withColumns({"rank": F.row_number().over(by.orderBy(F.desc("w"), value)), "n_values": F.count("*").over(by)})
    return ranked.where(F.col("rank") <= top)



"""Polygons covered by cells: whole cells need no test, cut cells keep the edges that pass through them and no others.

A point is inside if an odd number of edges cross its parallel to the x axis on its right (even-odd over all rings). Of the edges
in a row of cells, those through the point's own cell are tested one by one. Those further right count as a whole: an edge is
crossed if just one of its ends lies above the point, so the ends that two such edges share cancel. What is left is one number
for the cell, whether an odd number of these edges leaves the row at its top, and the few corners in the row at which the
boundary comes into the cell from the right. No geometry is cut or rounded, so the answers are those of a test of all edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.grid import segment_distance

EDGE = "struct<_ax: double, _ay: double, _bx: double, _by: double>"


def cell_of(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("bigint")


def edge_rows(polys: DataFrame, keep: list[str], rings: str = "rings") -> DataFrame:
    """keep..., _ring, _i, _corners (of the ring), _ax, _ay, _bx, _by: a row for each edge, rings closed. Equal keys are one polygon."""
    ring = polys.select(*keep, F.posexplode(rings).alias("_ring", "_r")).withColumn("_corners", F.size("_r")).where("_corners > 0")
    edges = F.transform("_r", lambda p, i: F.struct(p["x"].alias("_ax"), p["y"].alias("_ay"), F.coalesce(F.get(F.col("_r"), i + 1)["x"], F.col("_r")[0]["x"]).alias("_bx"), F.coalesce(F.get(F.col("_r"), i + 1)["y"], F.col("_r")[0]["y"]).alias("_by")))
    return ring.select(*keep, "_ring", "_corners", F.posexplode(edges).alias("_i", "_e")).select(*keep, "_ring", "_corners", "_i", "_e.*")


def edge_cells(edges: DataFrame, size: float, pad: float = 0.0) -> DataFrame:
    """edges with _cy, a row for each row of cells that an edge enters (padded), and _c0 and _c1, the first and last cell there."""
    low, high = F.least("_ay", "_by") - pad, F.greatest("_ay", "_by") + pad
    rows = edges.withColumn("_cy", F.explode(F.sequence(cell_of(low, size), cell_of(high, size))))
    bottom, top = F.col("_cy") * size - pad, (F.col("_cy") + 1) * size + pad

    def at(y: Column) -> Column:
        """Where the edge is at a height, which is cut to the edge's."""
        y = F.greatest(F.least("_ay", "_by"), F.least(F.greatest("_ay", "_by"), y))
        return F.col("_ax") + (F.col("_bx") - F.col("_ax")) * F.coalesce(F.try_divide(y - F.col("_ay"), F.col("_by") - F.col("_ay")), F.lit(0.0))

    flat = F.col("_ay") == F.col("_by")
    x0, x1 = at(bottom), at(top)
    room = (F.abs(F.col("_ax")) + F.abs(F.col("_bx")) + size) * 1e-9 + pad  # more than rounding
    first = F.when(flat, F.least("_ax", "_bx")).otherwise(F.least(x0, x1)) - room
    last = F.when(flat, F.greatest("_ax", "_bx")).otherwise(F.greatest(x0, x1)) + room
    return rows.withColumns({"_c0": cell_of(first, size), "_c1": cell_of(last, size)})


def cover(polys: DataFrame, size: float, keep: list[str], rings: str = "rings") -> DataFrame:
    """keep..., _cx, _cy, _odd, _corners (heights), _edges: the cells of each polygon; _edges is null for whole cells.

    The number of rows is that of the cells that polygons fill and of those that their boundaries pass."""
    passed = edge_cells(edge_rows(polys, keep, rings), size)
    up = lambda c: cell_of(F.col(c), size) > F.col("_cy")
    leaving = passed.where(up("_ay") != up("_by")).groupBy(*keep, "_cy").agg(F.sort_array(F.collect_list("_c0")).alias("_up"))
    edge = F.struct("_ax", "_ay", "_bx", "_by")
    through = passed.select(*keep, "_cy", F.explode(F.sequence("_c0", "_c1")).alias("_cx"), edge.alias("_edge"), F.lit(None).cast("double").alias("_corner"))
    # A corner in the row that two edges share counts for the cells between the first cells of both.
    ends = F.array(F.struct(F.col("_i").alias("_k"), F.col("_ay").alias("_y")), F.struct(((F.col("_i") + 1) % F.col("_corners")).alias("_k"), F.col("_by").alias("_y")))
    shared = passed.select(*keep, "_ring", "_cy", "_c0", F.explode(ends).alias("_p")).where(cell_of(F.col("_p._y"), size) == F.col("_cy"))
    shared = shared.groupBy(*keep, "_ring", "_cy", F.col("_p._k").alias("_k"), F.col("_p._y").alias("_y")).agg(F.min("_c0").alias("_low"), F.max("_c0").alias("_high")).where("_low < _high")
    turns = shared.select(*keep, "_cy", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_cx"), F.lit(None).cast(EDGE).alias("_edge"), F.col("_y").alias("_corner"))
    cut = through.unionByName(turns).groupBy(*keep, "_cy", "_cx").agg(F.collect_list("_edge").alias("_edges"), F.collect_list("_corner").alias("_corners"))
    odd = lambda cx: F.size(F.filter(F.coalesce("_up", F.array().cast("array<bigint>")), lambda c: c > cx)) % 2 == 1
    cut = cut.join(leaving, [*keep, "_cy"], "left").withColumn("_odd", odd(F.col("_cx")))
    # Between the cells of an odd and the next even edge at the top of a row the polygon fills cells whole, if no edge passes.
    pairs = F.transform(F.sequence(F.lit(0), (F.size("_up") / 2).cast("int") - 1), lambda j: F.struct(F.get("_up", j * 2).alias("_low"), (F.get("_up", j * 2 + 1) - 1).alias("_high")))
    spans = leaving.where("size(_up) >= 2").select(*keep, "_cy", F.explode(pairs).alias("s")).where("s._low <= s._high")
    filled = spans.select(*keep, "_cy", F.explode(F.sequence("s._low", "s._high")).alias("_cx"))
    whole = filled.join(cut.select(*keep, "_cy", "_cx"), [*keep, "_cy", "_cx"], "left_anti")
    columns = [*keep, "_cx", "_cy"]
    none = {"_odd": F.lit(True), "_corners": F.array().cast("array<double>"), "_edges": F.lit(None).cast(f"array<{EDGE}>")}
    return cut.select(*columns, "_odd", "_corners", "_edges").unionByName(whole.withColumns(none).select(*columns, "_odd", "_corners", "_edges"))


def tested(points: DataFrame, covered: DataFrame, size: float, x: str, y: str) -> DataFrame:
    """points joined with the cells that hold them: the cover's columns, _in (even-odd) and _on (whether an edge holds the point)."""
    at = points.withColumns({"_cx": cell_of(F.col(x), size), "_cy": cell_of(F.col(y), size)}).join(covered, ["_cx", "_cy"])
    px, py = F.col(x), F.col(y)

    def crossed(e: Column) -> Column:
        reach = (e["_bx"] - e["_ax"]) * (py - e["_ay"]) / F.nullif(e["_by"] - e["_ay"], F.lit(0.0)) + e["_ax"]
        return ((e["_ay"] > py) != (e["_by"] > py)) & (px < reach)

    def on(e: Column) -> Column:
        flat = (e["_bx"] - e["_ax"]) * (py - e["_ay"]) == (e["_by"] - e["_ay"]) * (px - e["_ax"])
        return flat & px.between(F.least(e["_ax"], e["_bx"]), F.greatest(e["_ax"], e["_bx"])) & py.between(F.least(e["_ay"], e["_by"]), F.greatest(e["_ay"], e["_by"]))

    number = F.col("_odd").cast("int") + F.size(F.filter("_corners", lambda v: v > py)) + F.size(F.filter("_edges", crossed))
    inside = F.when(F.col("_edges").isNull(), True).otherwise(number % 2 == 1)
    return at.withColumn("_in", inside).withColumn("_on", F.coalesce(F.exists("_edges", on), F.lit(False)))


def nearest(points: DataFrame, polys: DataFrame, size: float, cutoff: float, x: str, y: str, code: str, rings: str = "rings") -> DataFrame:
    """x, y, _d and code of the polygon whose boundary is nearest within the cutoff (ties: the lowest code); points that have one.

    Points meet the edges whose padded cells hold them, each edge on its own."""
    near = edge_cells(edge_rows(polys, [code], rings), size, cutoff)
    near = near.select(F.col(code).alias("_ncode"), "_cy", F.explode(F.sequence("_c0", "_c1")).alias("_cx"), "_ax", "_ay", "_bx", "_by")
    at = points.select(x, y, cell_of(F.col(x), size).alias("_cx"), cell_of(F.col(y), size).alias("_cy")).join(near, ["_cx", "_cy"])
    d = segment_distance(F.col(x), F.col(y), F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by"))
    best = at.withColumn("_d", d).where(F.col("_d") <= cutoff).groupBy(x, y).agg(F.min(F.struct("_d", "_ncode")).alias("_near"))
    return best.select(x, y, F.col("_near._d").alias("_d"), F.col("_near._ncode").alias(code))

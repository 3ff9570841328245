"""Areas merged into larger ones, and shapes with fewer corners whose borders still meet.

Neighbours have their common border as edges in opposite directions, so in a sum over a group of polygons these cancel. What is left is the
group's outline. Its edges are chained into rings by pointer jumping: in each round every edge looks twice as far ahead, first
for the smallest edge of its ring, then for its place in it. No outline is walked edge by edge and only a finished ring is gathered.

Borders must have the same corners on both sides, as areas of one survey do. Rings may turn either way; holes are rings inside
an odd number of others. Rings of results have the area on their left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import polygons
from tessera.sources.paths import stored
from tessera.sources.ship import ship


def _turned(polys: DataFrame, key: str, rings: str, cell: float) -> DataFrame:
    """key, ax, ay, bx, by: all edges, with the area on their left."""
    edges = polygons.edge_rows(polys, [key], rings).where("NOT (_ax = _bx AND _ay = _by)")
    area = F.sum(F.col("_ax") * F.col("_by") - F.col("_bx") * F.col("_ay"))
    each = edges.groupBy(key, "_ring").agg(area.alias("_area"), F.min_by(F.struct(((F.col("_ax") + F.col("_bx")) / 2).alias("x"), ((F.col("_ay") + F.col("_by")) / 2).alias("y")), "_i").alias("_mid"))
    several = polys.where(F.size(rings) > 1)
    inside = each.join(several.select(key), key, "left_semi").select(F.col(key).alias("_of"), F.col("_ring").alias("_own"), "_mid.x", "_mid.y")
    single = several.select(key, F.posexplode(rings).alias("_k", "_r")).select(F.struct(key, "_k").alias("_one"), F.array("_r").alias("_rings"))
    held = polygons.tested(inside, polygons.cover(single, cell, ["_one"], "_rings"), cell, "x", "y").where(F.col("_in") & (F.col(f"_one.{key}") == F.col("_of")) & (F.col("_one._k") != F.col("_own")))
    depth = held.groupBy(F.col("_of").alias(key), F.col("_own").alias("_ring")).agg(F.count("*").alias("_depth"))
    flips = each.join(depth, [key, "_ring"], "left").select(key, "_ring", ((F.col("_area") > 0) != (F.coalesce("_depth", F.lit(0)) % 2 == 0)).alias("_flip"))
    turn = lambda a, b: F.when(F.col("_flip"), F.col(b)).otherwise(F.col(a))
    return edges.join(flips, [key, "_ring"]).select(key, turn("_ax", "_bx").alias("ax"), turn("_ay", "_by").alias("ay"), turn("_bx", "_ax").alias("bx"), turn("_by", "_ay").alias("by"))


def outlines(polys: DataFrame, key: str, group: Column, cell: float, rings: str = "rings") -> DataFrame:
    """grp, ax, ay, bx, by: edges of the union of each group's polygons. polys: key (distinct) and rings; cell: as in covers."""
    grouped = polys.select(key, group.alias("grp"))
    edges = _turned(polys, key, rings, cell).join(grouped, key)
    ahead = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    ends = [F.when(ahead, F.col(a)).otherwise(F.col(b)) for a, b in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))]
    net = edges.groupBy("grp", *[e.alias(c) for e, c in zip(ends, ("px", "py", "qx", "qy"), strict=True)]).agg(F.sum(F.when(ahead, 1).otherwise(-1)).alias("net")).where("net <> 0")
    way = lambda a, b: F.when(F.col("net") > 0, F.col(a)).otherwise(F.col(b))
    return net.select("grp", way("px", "qx").alias("ax"), way("py", "qy").alias("ay"), way("qx", "px").alias("bx"), way("qy", "py").alias("by"))


def chained(edges: DataFrame) -> DataFrame:
    """grp, ring, pos (from 0), x, y: the corners of the rings that edges (grp, ax, ay, bx, by) make, in their order.

    Where several rings touch in a corner each goes on with the edge next to its area."""
    numbered = stored(edges.withColumn("id", F.monotonically_increasing_id()), "edges")
    out = numbered.select("grp", F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("id").alias("next"), F.col("bx").alias("cx"), F.col("by").alias("cy"))
    angle = lambda x, y: F.atan2(F.col(y) - F.col("by"), F.col(x) - F.col("bx"))
    turn = F.pmod(angle("ax", "ay") - angle("cx", "cy"), F.lit(2 * np.pi))
    turn = F.when(turn == 0, 2 * np.pi).otherwise(turn)
    follows = numbered.join(out, ["grp", "bx", "by"]).groupBy("id").agg(F.min_by("next", F.struct(turn.alias("t"), "next")).alias("next"))
    # the smallest edge of each ring
    now = stored(follows.select("id", "next", F.least("id", "next").alias("low")), "low")
    while True:
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("low").alias("low_"))
        moved = now.join(ahead, "next").select("id", F.col("far").alias("next"), F.least("low", "low_").alias("low"), (F.col("low_") != F.col("low")).alias("open"))
        now = stored(moved, "low")
        if not now.where("open").limit(1).count():
            break
    # how far each edge is from the end of its ring, which the smallest edge begins
    ring = now.select("id", "low")
    now = stored(follows.join(ring, "id").select("id", "low", F.when(F.col("next") != F.col("low"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("left")), "left")
    while now.where("next IS NOT NULL").limit(1).count():
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("left").alias("more"))
        now = stored(now.join(ahead, "next", "left").select("id", "low", F.col("far").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "left")
    size = now.groupBy("low").agg(F.max("left").alias("size"))
    placed = now.join(size, "low").select("id", F.col("low").alias("ring"), (F.col("size") - F.col("left")).alias("pos"))
    return placed.join(numbered, "id").select("grp", "ring", "pos", F.col("ax").alias("x"), F.col("ay").alias("y"))


def dissolve(polys: DataFrame, key: str, group: Column, cell: float, rings: str = "rings") -> DataFrame:
    """grp and rings (array<array<struct<x, y>>>) of the union of each group's polygons. A row is as long as one outline."""
    corners = chained(outlines(polys, key, group, cell, rings))
    each = corners.groupBy("grp", "ring").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("c"))
    points = each.select("grp", "ring", F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    return points.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("ring", "points"))).alias("r")).select("grp", F.transform("r", lambda r: r["points"]).alias("rings"))


def signed_area(rings: Column) -> Column:
    """Area of rings that have it on their left: holes count less."""
    ring = lambda r: F.aggregate(
        F.transform(r, lambda p, i: p["x"] * F.coalesce(F.get(r, i + 1)["y"], r[0]["y"]) - F.coalesce(F.get(r, i + 1)["x"], r[0]["x"]) * p["y"]), F.lit(0.0), lambda a, v: a + v
    )
    return F.aggregate(F.transform(rings, ring), F.lit(0.0), lambda a, v: a + v) / 2


def thin(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay: its ends, and wherever it leaves the straight line between two that stay by more than the
    tolerance, the farthest point. A stack instead of recursion: lines may be long."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    left = [(0, len(points) - 1)]
    while left:
        a, b = left.pop()
        if b - a < 2:
            continue
        p, d = points[a + 1 : b], points[b] - points[a]
        size = float(d @ d)
        t = np.clip((p - points[a]) @ d / size, 0, 1) if size else np.zeros(len(p))
        away = np.hypot(*(points[a] + t[:, None] * d - p).T)
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            left += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def _thin_ring(ring: np.ndarray, fixed: np.ndarray, tolerance: float) -> np.ndarray:
    """A ring's corners that stay. It is cut at its fixed corners (or its smallest one, and the one farthest from that); each arc is
    thinned from its smaller end, so both areas beside it get the same."""
    at = np.flatnonzero(fixed)
    if len(at) < 2:
        first = int(at[0]) if len(at) else min(range(len(ring)), key=lambda k: tuple(ring[k]))
        at = np.array(sorted({first, int(np.hypot(*(ring - ring[first]).T).argmax())}))
    ring, at = np.roll(ring, -at[0], axis=0), at - at[0]
    keep = np.zeros(len(ring), bool)
    for a, b in zip(at, [*at[1:], len(ring)], strict=True):
        arc = np.arange(a, b + 1) % len(ring)
        points = ring[arc]
        turned = tuple(points[-1]) < tuple(points[0]) or tuple(points[-1]) == tuple(points[0]) and tuple(points[-2]) < tuple(points[1])
        kept = thin(points[::-1] if turned else points, tolerance)
        keep[arc[kept[::-1] if turned else kept]] = True
    return ring[keep] if keep.sum() >= 3 else ring


def simplify(polys: DataFrame, key: str, tolerance: float, rings: str = "rings") -> DataFrame:
    """polys with fewer corners in their rings. Corners where three borders or more meet stay, and the border between two such
    corners becomes the same line for both its areas: no gaps. Rings that would have fewer than three corners stay whole."""
    ship(polys.sparkSession)
    edges = polygons.edge_rows(polys, [key], rings).where("NOT (_ax = _bx AND _ay = _by)")
    ends = edges.select(F.explode(F.array(*[F.struct(*[F.col(f"_{e}{c}").alias(f"{w}{c}") for e, w in zip(order, "pq", strict=True) for c in "xy"]) for order in ("ab", "ba")])).alias("e")).select("e.*").distinct()
    meet = ends.groupBy("px", "py").agg(F.count("*").alias("n")).where("n <> 2").select("px", "py", F.lit(True).alias("fixed"))
    corners = edges.select(key, "_ring", "_i", F.col("_ax").alias("px"), F.col("_ay").alias("py")).join(meet, ["px", "py"], "left")
    each = corners.groupBy(key, "_ring").agg(F.array_sort(F.collect_list(F.struct("_i", "px", "py", F.coalesce("fixed", F.lit(False)).alias("fixed")))).alias("c"))
    kind = dict(polys.dtypes)[key]

    def run(batches):
        for batch in batches:
            out = []
            for corners_ in batch["c"]:
                ring = np.array([(c["px"], c["py"]) for c in corners_], float)
                out.append([{"x": x, "y": y} for x, y in _thin_ring(ring, np.array([c["fixed"] for c in corners_], bool), tolerance).tolist()] if len(ring) > 3 else [{"x": x, "y": y} for x, y in ring.tolist()])
            yield pd.DataFrame({key: batch[key], "_ring": batch["_ring"], "points": out})

    thinned = each.mapInPandas(run, f"`{key}` {kind}, _ring int, points array<struct<x: double, y: double>>")
    whole = thinned.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_ring", "points"))).alias("_r")).select(key, F.transform("_r", lambda r: r["points"]).alias("_rings"))
    return polys.join(whole, key, "left").withColumn(rings, F.coalesce("_rings", F.col(rings))).drop("_rings")

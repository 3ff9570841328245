"""Hexagons, Hilbert keys and local meters as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


@dataclass(frozen=True)
class Grid:
    """A local plane in meters, and a pointy-top hexagon grid on it. Fixed values of the published grid."""

    lon0: float = -73.95
    lat0: float = 40.73
    ky: float = 110950.0
    side: float = 180.0

    @property
    def kx(self) -> float:
        return 111320.0 * math.cos(math.radians(self.lat0))


CITY = Grid()
#: The box that Hilbert keys and plausible coordinates refer to (south, north, west, east).
BOX = (40.49, 40.92, -74.27, -73.68)


def local_xy(lat: Column, lon: Column, grid: Grid = CITY) -> tuple[Column, Column]:
    return (lon - grid.lon0) * grid.kx, (lat - grid.lat0) * grid.ky


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, grid: Grid = CITY) -> Column:
    return F.hypot((lon2 - lon1) * grid.kx, (lat2 - lat1) * grid.ky)


def axial(lat: Column, lon: Column, grid: Grid = CITY) -> Column:
    """struct(q, r): the hexagon of a point; fractions are rounded half to even in all three cube axes."""
    x, y = local_xy(lat, lon, grid)
    fq, fr = (math.sqrt(3) / 3 * x - y / 3) / grid.side, (2.0 / 3 * y) / grid.side
    exact = F.array(fq, fr, -fq - fr)  # three axes that add up to nothing
    moved = F.transform(exact, lambda v, i: F.struct(F.abs(F.rint(v) - v).alias("by"), i.alias("axis"), F.rint(v).alias("to")))

    def hexagon(axes: Column) -> Column:
        """Rounded axes don't add up to nothing any more; the one that moved farthest, the last of equals, follows the others."""
        total = axes[0]["to"] + axes[1]["to"] + axes[2]["to"]

        def settled(farthest: Column) -> Column:
            axis = lambda k: (axes[k]["to"] - F.when(farthest["axis"] == k, total).otherwise(0.0)).cast("smallint")
            return F.struct(axis(0).alias("q"), axis(1).alias("r"))

        return let(F.array_max(axes), settled)

    return let(moved, hexagon)


def hex_center(q: Column, r: Column, grid: Grid = CITY) -> tuple[Column, Column]:
    """Latitude and longitude of a hexagon's center."""
    x = grid.side * math.sqrt(3) * (q + r / 2.0)
    y = grid.side * 1.5 * r
    return y / grid.ky + grid.lat0, x / grid.kx + grid.lon0


def hex_ring(q: Column, r: Column, grid: Grid = CITY) -> Column:
    """The seven corners (closed) of a hexagon: array<struct<lat, lon>>."""
    lat, lon = hex_center(q, r, grid)

    def corner(k: Column) -> Column:
        angle = F.radians(60.0 * k + 30.0)
        return F.struct((lat + grid.side * F.sin(angle) / grid.ky).alias("lat"), (lon + grid.side * F.cos(angle) / grid.kx).alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(6)), corner)


def hilbert_key(lat: Column, lon: Column, order: int = 16, box: tuple[float, float, float, float] = BOX) -> Column:
    """Place on a Hilbert curve over the box, by a fold over the bits of both coordinates."""
    top = (1 << order) - 1

    def scaled(v: Column, low: float, high: float) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(top), ((v - low) / (high - low) * top).cast("long"))).cast("long")

    start = F.struct(scaled(lon, box[2], box[3]).alias("x"), scaled(lat, box[0], box[1]).alias("y"), F.lit(0).cast("long").alias("d"))

    def step(a: Column, s: Column) -> Column:
        rx, ry = (a["x"].bitwiseAND(s) > 0).cast("long"), (a["y"].bitwiseAND(s) > 0).cast("long")
        flip = (ry == 0) & (rx == 1)
        x, y = F.when(flip, s - 1 - a["x"]).otherwise(a["x"]), F.when(flip, s - 1 - a["y"]).otherwise(a["y"])
        return F.struct(F.when(ry == 0, y).otherwise(x).alias("x"), F.when(ry == 0, x).otherwise(y).alias("y"), (a["d"] + s * s * (3 * rx).bitwiseXOR(ry)).alias("d"))

    bits = F.array(*[F.lit(1 << k).cast("long") for k in range(order - 1, -1, -1)])
    return F.aggregate(bits, start, step, lambda a: a["d"])


def _curve_cell(x: int, y: int, level: int) -> int:
    """The number along the curve of a cell among the 4^level of a level."""
    key = 0
    for k in range(level - 1, -1, -1):
        right, up = x >> k & 1, y >> k & 1
        key = key * 4 + (3 * right ^ up)
        if not up:
            flip = (1 << k) - 1 if right else 0
            x, y = (y ^ flip) & ((1 << k) - 1), (x ^ flip) & ((1 << k) - 1)
    return key


def hilbert_ranges(view: tuple[float, float, float, float], most: int = 48, order: int = 16, box: tuple[float, float, float, float] = BOX) -> list[tuple[int, int]]:
    """Ranges of Hilbert keys that hold every place of a view (south, north, west, east): cells inside it whole and, once there
    are about ``most`` of them, coarser ones that its edge cuts. Neighbouring ranges are one."""
    top = (1 << order) - 1
    scaled = lambda v, low, high: max(0, min(top, int((v - low) / (high - low) * top)))
    (y0, y1), (x0, x1) = ([scaled(v, *box[i : i + 2]) for v in view[i : i + 2]] for i in (0, 2))
    if x0 > x1 or y0 > y1:
        return []
    whole, cut = [], [(0, 0)]
    for level in range(order + 1):
        side, further = 1 << (order - level), []
        for x, y in cut:
            low_x, low_y = x * side, y * side
            if low_x > x1 or low_y > y1 or low_x + side <= x0 or low_y + side <= y0:
                continue
            if x0 <= low_x and low_x + side - 1 <= x1 and y0 <= low_y and low_y + side - 1 <= y1:
                whole.append((x, y, level))
            else:
                further.append((x, y))
        if not further or level == order or len(whole) + len(further) > most:
            whole += [(x, y, level) for x, y in further]
            break
        cut = [(2 * x + i, 2 * y + j) for x, y in further for i in (0, 1) for j in (0, 1)]
    out: list[tuple[int, int]] = []
    for key, level in sorted((_curve_cell(x, y, level) << 2 * (order - level), level) for x, y, level in whole):
        end = key + (1 << 2 * (order - level)) - 1
        if out and key <= out[-1][1] + 1:
            out[-1] = out[-1][0], end
        else:
            out.append((key, end))
    return out


def in_ranges(key: Column, ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for k, (low, high) in enumerate(ranges):
        out = key.between(low, high) if k == 0 else out | key.between(low, high)
    return out


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a straight segment, in the units of the plane."""
    return let(locate(px, py, ax, ay, bx, by), lambda t: F.hypot(ax + t * (bx - ax) - px, ay + t * (by - ay) - py))


def locate(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where a point falls on a segment: 0 at its start, 1 at its end."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, length2), F.lit(0.0))))


def polyline_length(points: Column) -> Column:
    """Length of array<struct<x, y>>."""
    zero = F.struct(points[0]["x"].alias("x"), points[0]["y"].alias("y"), F.lit(0.0).alias("n"))
    step = lambda a, p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (a["n"] + F.hypot(p["x"] - a["x"], p["y"] - a["y"])).alias("n"))
    return F.when(F.size(points) > 0, F.aggregate(points, zero, step, lambda a: a["n"])).otherwise(0.0)


def point_along(points: Column, t: Column) -> Column:
    """struct(x, y) at fraction t of the length of array<struct<x, y>>."""

    def walk(total: Column) -> Column:
        zero = F.struct(points[0]["x"].alias("x"), points[0]["y"].alias("y"), (total * F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))).alias("left"), F.lit(False).alias("done"))

        def step(a: Column, p: Column) -> Column:
            d = F.hypot(p["x"] - a["x"], p["y"] - a["y"])
            part = F.coalesce(F.try_divide(a["left"], d), F.lit(0.0))
            stop = a["left"] <= d
            moved = F.when(stop, F.struct((a["x"] + part * (p["x"] - a["x"])).alias("x"), (a["y"] + part * (p["y"] - a["y"])).alias("y"), F.lit(0.0).alias("left"), F.lit(True).alias("done")))
            return F.when(a["done"], a).otherwise(moved.otherwise(F.struct(p["x"].alias("x"), p["y"].alias("y"), (a["left"] - d).alias("left"), F.lit(False).alias("done"))))

        return F.aggregate(F.slice(points, 2, F.greatest(F.lit(0), F.size(points) - 1)), zero, step, lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y")))

    return let(polyline_length(points), walk)


def decode_xy(flat: Column, scale: float = 1e5) -> Column:
    """array<int> x0, y0, x1, y1, ... in units of 1/scale -> array<struct<x, y>>."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda i: F.struct((flat[i * 2] / scale).alias("x"), (flat[i * 2 + 1] / scale).alias("y")))


def quantize(v: Column, scale: float = 1e5) -> Column:
    return F.rint(v * scale).cast("int")


def circle_ring(lat: Column, lon: Column, radius: float, corners: int = 64, grid: Grid = CITY) -> Column:
    """A closed polygon around a point: array<struct<lat, lon>>."""
    at = lambda k: F.radians(k * (360.0 / corners))
    return F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda k: F.struct((lat + radius * F.sin(at(k)) / grid.ky).alias("lat"), (lon + radius * F.cos(at(k)) / grid.kx).alias("lon")))

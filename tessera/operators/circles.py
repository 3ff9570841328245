"""What lies in many circles at once, by type and year: a blocked sparse product.

Places are cut into cells much smaller than the circles. A cover says for each circle which cells lie inside it whole and which
its edge cuts; it depends on circles and radius alone, so it can be kept. Whole cells add the sum of their places, so only
places of cut cells are tested. Counts are sparse entries (type, year, n): one equi-join by cell, one sum by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.grid import CITY, Grid, local_xy
from tessera.operators.quantiles import quantiles
from tessera.sources.paths import stored

#: Meters by which a cell must clear the edge of a circle to count as whole: more than rounding, so that both ways agree.
CLEAR = 1e-6


def cover(centers: DataFrame, radius: float, center_id: str, cells: int = 4, grid: Grid = CITY) -> DataFrame:
    """center_id, cx, cy, whole, x, y: the cells (radius / cells wide) that each circle meets. centers: lat, lon."""
    size = radius / cells
    x, y = local_xy(F.col("lat"), F.col("lon"), grid)
    around = F.sequence(F.lit(-cells - 1), F.lit(cells + 1))
    at = centers.select(center_id, x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    near = at.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).withColumns({"cx": F.col("i") + F.floor(F.col("x") / size), "cy": F.col("j") + F.floor(F.col("y") / size)})

    def reach(c: str, v: str):
        low, high = F.col(c) * size - F.col(v), (F.col(c) + 1) * size - F.col(v)
        return F.greatest(low, -high, F.lit(0.0)), F.greatest(F.abs(low), F.abs(high))

    (x0, x1), (y0, y1) = reach("cx", "x"), reach("cy", "y")
    met = near.where(F.hypot(x0, y0) <= radius + CLEAR)
    return met.select(center_id, "cx", "cy", (F.hypot(x1, y1) <= radius - CLEAR).alias("whole"), "x", "y")


def counts(covered: DataFrame, places: DataFrame, radius: float, center_id: str, by: list[str], cells: int = 4, grid: Grid = CITY) -> DataFrame:
    """center_id, by..., n: what the places (lat, lon, by..., n) in each circle of a cover add up to; no row for nothing."""
    size = radius / cells
    x, y = local_xy(F.col("lat"), F.col("lon"), grid)
    entries = places.select(*by, "n", x.alias("px"), y.alias("py")).where("px IS NOT NULL AND py IS NOT NULL")
    entries = entries.withColumns({"cx": F.floor(F.col("px") / size), "cy": F.floor(F.col("py") / size), "whole": F.lit(False)})
    none = F.lit(None).cast("double")
    sums = entries.groupBy("cx", "cy", *by).agg(F.sum("n").alias("n")).withColumns({"px": none, "py": none, "whole": F.lit(True)})
    met = covered.join(entries.unionByName(sums), ["cx", "cy", "whole"])
    inside = F.col("whole") | (F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) <= radius)
    return met.where(inside).groupBy(center_id, *by).agg(F.sum("n").cast("bigint").alias("n"))


def vectors(centers: DataFrame, places: DataFrame, radius: float, center_id: str, types: list[int], years: list[int], cells: int = 4, covered: DataFrame | None = None) -> DataFrame:
    """center_id, type (a type's number, or all), counts (an entry a year) and mean (of the years) of every circle, zeros where
    there is nothing. places: lat, lon, cat, year, n. covered: a kept cover of these circles.

    Types and years that aren't named count for nothing. A circle has (types + 1) times years entries at most."""
    covered = cover(centers, radius, center_id, cells) if covered is None else covered
    known = places.where(F.col("cat").isin(*types) & F.col("year").isin(*years))
    n = counts(covered, known, radius, center_id, ["cat", "year"], cells)
    at = F.lit(0)
    for k, y in enumerate(years):
        at = F.when(F.col("year") == y, k).otherwise(at)
    by_type = n.withColumn("at", at).select(center_id, F.explode(F.array(F.col("cat").cast("string"), F.lit("all"))).alias("type"), "at", "n")
    held = by_type.groupBy(center_id, "type").agg(*[F.sum(F.when(F.col("at") == k, F.col("n")).otherwise(0)).alias(f"_{k}") for k in range(len(years))])
    every = centers.select(center_id).withColumn("type", F.explode(F.array(F.lit("all"), *[F.lit(str(t)) for t in types])))
    filled = every.join(held, [center_id, "type"], "left").select(center_id, "type", F.array(*[F.coalesce(f"_{k}", F.lit(0)).cast("bigint") for k in range(len(years))]).alias("counts"))
    return filled.withColumn("mean", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x) / F.lit(float(len(years))))


def percentiles(vectors_: DataFrame, years: list[int], digits: int = 3) -> DataFrame:
    """type, year (its number, or avg), p (0 to 100) and v: where a circle stands among all, for each type and each year."""
    columns = F.array(*[F.struct(F.lit(str(y)).alias("year"), F.col("counts")[k].cast("double").alias("x")) for k, y in enumerate(years)], F.struct(F.lit("avg").alias("year"), F.col("mean").alias("x")))
    flat = stored(vectors_, "vectors").select("type", F.inline(columns))  # read more than once
    found = quantiles(flat, ["type", "year"], F.col("x"), tuple(k / 100 for k in range(101)))
    return found.select("type", "year", F.rint(F.col("p") * 100).cast("int").alias("p"), F.round("v", digits).alias("v"))

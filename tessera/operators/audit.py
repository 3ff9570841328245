"""Shares, profiles, stacks and other audits of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.quantiles import quantiles


def share_of_total(df: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """key, n and pct of all rows. The window runs over the counts."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.select(key, "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), digits).alias("pct"))


def flag_percent(pred: Column, digits: int = 2) -> Column:
    """Percentage of rows for which pred holds, among those where it is known."""
    return F.round(100.0 * F.avg(pred.cast("int")), digits)


def profile_columns(df: DataFrame, placeholders: tuple[str, ...] = ("(null)", "UNKNOWN", "")) -> DataFrame:
    """column, null_pct, placeholder_pct and n_distinct of every column. For a stored table: each column is read by itself.

    The values of a column are counted first, map-side and then by value, and all figures follow from these counts. So
    no row is copied for each column, and what is shuffled is a column's distinct values, not its rows."""
    out = None
    for c in df.columns:
        counts = df.groupBy(df[c].cast("string").alias("v")).agg(F.count("*").alias("k"))
        known = F.sum(F.when(F.col("v").isNotNull(), F.col("k")))
        share = lambda n, of: F.round(F.try_divide(100.0 * n, of), 3)
        one = counts.agg(
            F.lit(c).alias("column"), share(F.sum(F.when(F.col("v").isNull(), F.col("k")).otherwise(0)), F.sum("k")).alias("null_pct"),
            F.coalesce(share(F.sum(F.when(F.trim("v").isin(*placeholders), F.col("k")).otherwise(0)), known), F.lit(0.0)).alias("placeholder_pct"), F.count("v").alias("n_distinct"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def lag_quantiles(df: DataFrame, start: Column, end: Column, probs: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Interpolated quantiles of whole days from start to end (midnights crossed): one row."""
    found = quantiles(df, [], F.datediff(end, start), probs)
    one = found.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[F.round(F.max(F.when(F.col("p") == p, F.col("v"))), 4).alias(f"p{round(p * 100)}") for p in probs])
    return one


def stack_sizes(df: DataFrame, keys: list[Column], steps: tuple[int, ...] = (2, 16, 100)) -> DataFrame:
    """How many rows share their place: number of stacks, largest, and share of rows in stacks of so many."""
    stacks = df.groupBy(*keys).agg(F.count("*").alias("k"))
    inside = [F.round(F.try_divide(100.0 * F.sum(F.when(F.col("k") >= s, F.col("k")).otherwise(0)), F.sum("k")), 2).alias(f"pct_in_{s}") for s in steps]
    return stacks.agg(F.count("*").alias("stacks"), F.max("k").alias("largest"), *inside)


def largest_stacks(df: DataFrame, keys: list[str], attribute: str, top: int = 40) -> DataFrame:
    """The largest stacks with their most frequent attribute and its share. Two partial aggregations, no window."""
    parts = df.groupBy(*keys, attribute).agg(F.count("*").alias("c"))
    known = F.col(attribute).isNotNull()
    best = parts.groupBy(*keys).agg(F.sum("c").alias("n"), F.min(F.when(known, F.struct((-F.col("c")).alias("c"), F.col(attribute).alias("v")))).alias("b"))
    rows = best.select(*keys, "n", F.col("b.v").alias("main"), F.round(-100.0 * F.col("b.c") / F.col("n"), 2).alias("main_pct"))
    return rows.orderBy(F.desc("n"), *keys).limit(top)


def mode_per_group(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent non-null value of each group, the smallest of those that tie."""
    return df.groupBy(*keys).agg(F.mode(value, True).alias("mode"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list[int] | None = None) -> DataFrame:
    """A count for each row key and column value, 0 where there is none. Without values: those that there are (years, types:
    a column each)."""
    if values is None:
        values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def labels_per_code(df: DataFrame, code: str, label: str, least: int = 2) -> DataFrame:
    """Codes with several labels: how many, and the labels in order. Rows are reduced to distinct pairs and codes with too few
    labels left out before any list is made."""
    pairs = df.select(code, label).where(F.col(label).isNotNull()).distinct()
    several = pairs.groupBy(code).agg(F.count("*").alias("labels")).where(F.col("labels") >= least)
    lists = pairs.join(several.withColumnRenamed(code, "_code"), F.col(code).eqNullSafe(F.col("_code"))).groupBy(code, "labels")
    return lists.agg(F.array_join(F.sort_array(F.collect_list(label)), " / ").alias("all_labels"))


def distinct_places(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Distinct pairs (nulls count as a value), latitudes and longitudes. Pairs are made distinct first, and the coordinates
    counted from those."""
    pairs = df.select(F.col(lat).alias("lat"), F.col(lon).alias("lon")).distinct()
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    one = count(pairs, "points")
    for c, name in (("lat", "lats"), ("lon", "lons")):
        one = one.crossJoin(F.broadcast(count(pairs.select(c).where(f"{c} IS NOT NULL").distinct(), name)))  # one row
    return one


def run_summary(df: DataFrame, by: dict[str, Column]) -> DataFrame:
    """Counts of rows by each breakdown and in total: what, value, n. One scan, one shuffle."""
    pairs = F.array(F.struct(F.lit("rows").alias("what"), F.lit("all").alias("value")), *[F.struct(F.lit(k).alias("what"), v.cast("string").alias("value")) for k, v in by.items()])
    return df.select(F.inline(pairs)).groupBy("what", "value").agg(F.count("*").alias("n"))

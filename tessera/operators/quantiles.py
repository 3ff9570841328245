"""Exact quantiles of many groups by distributed selection.

The wanted ranks of each group are narrowed by histograms: every round counts the rows of the ranges that still hold a wanted
rank in ``bins`` equal parts (partial sums map-side, so a group with most rows is no hot key), and keeps the part with the rank,
as wide as the values in it. Once few rows are left, equal values are counted and the ranks read off. No task and no buffer
holds the values of a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.paths import stored

BINS = 1024
#: A range of so many rows or fewer is read off; ranges of fewer than a task's rows need no further round.
FEW = 200_000


def _matched(names: list[str], other: str) -> Column:
    """Groups are equal where nulls count as a group of their own."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"{other}{n}"))
    return out


def _renamed(df: DataFrame, names: list[str], other: str) -> DataFrame:
    return df.withColumnsRenamed({n: f"{other}{n}" for n in names})


def select_ranks(rows: DataFrame, wanted: DataFrame, names: list[str], bins: int = BINS, few: int = FEW) -> DataFrame:
    """rows: names, v. wanted: names, rank, lo, hi (all values lie between), before (rows of the group below lo), inside (rows
    from lo to hi), still whole groups. names, rank and v of every wanted rank (from 0)."""
    range_ = [*names, "lo", "hi"]
    found, left = [], stored(wanted, "quantiles")
    while True:
        found.append(left.where("lo = hi").select(*names, "rank", F.col("lo").alias("v")))
        left = left.where("lo < hi")
        sizes = left.agg(F.max("inside"), F.sum("inside")).first()
        if sizes[0] is None or sizes[0] <= few:
            break
        ranges = _renamed(left.select(*range_, "before").distinct(), names, "_of")
        v, lo, hi = (F.col(c).cast("double") / 2 for c in ("v", "lo", "hi"))
        part = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(v - lo, hi - lo) * bins), F.lit(0)).cast("int"))
        inside = rows.join(ranges, _matched(names, "_of") & F.col("v").between(F.col("lo"), F.col("hi")))
        counted = inside.groupBy(*range_, "before", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo2"), F.max("v").alias("hi2"))
        upto = F.sum("n").over(Window.partitionBy(*range_).orderBy("part"))  # bins rows at most
        parts = _renamed(counted.withColumn("low", F.col("before") + upto - F.col("n")).drop("before", "part"), [*names, "lo", "hi"], "_in")
        rank = F.col("rank").between(F.col("low"), F.col("low") + F.col("n") - 1)
        narrowed = left.join(parts, _matched([*names, "lo", "hi"], "_in") & rank)
        now = stored(narrowed.select(*names, "rank", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("low").alias("before"), F.col("n").alias("inside")), "quantiles")
        if now.agg(F.sum("inside")).first()[0] == sizes[1]:  # values that differ by less than a double can tell
            break
        left = now
    ranges = _renamed(left.select(*range_, "before").distinct(), names, "_of")
    inside = rows.join(ranges, _matched(names, "_of") & F.col("v").between(F.col("lo"), F.col("hi")))
    counted = inside.groupBy(*range_, "before", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*range_).orderBy("v"))
    values = _renamed(counted.withColumn("low", F.col("before") + upto - F.col("n")).drop("before"), [*names, "lo", "hi"], "_in")
    last = left.join(values, _matched([*names, "lo", "hi"], "_in") & F.col("rank").between(F.col("low"), F.col("low") + F.col("n") - 1))
    found.append(last.select(*names, "rank", "v"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def quantiles(df: DataFrame, keys: list[str], value: Column, probs: tuple[float, ...], bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys, p (an entry of probs), n (values of the group) and v, interpolated between the two values around p (n - 1).

    Null and not-a-number values are left out; a group without values has no row, a null key is a group. Without keys: one
    group. probs lie between 0 and 1."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], value.alias("v")).where("v IS NOT NULL")
    if dict(rows.dtypes)["v"] in ("double", "float"):
        rows = rows.where(~F.isnan("v"))
    ends = stored(rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0"), "quantiles")
    asked = ends.select("*", F.explode(F.array(*[F.lit(float(p)) for p in dict.fromkeys(probs)])).alias("p")).withColumn("at", F.col("p") * (F.col("n") - 1))
    asked = asked.withColumns({"below": F.floor("at"), "above": F.ceil("at")})
    ranks = asked.select(*names, "lo", "hi", "n", F.explode(F.array("below", "above")).alias("rank")).distinct()
    wanted = ranks.select(*names, "rank", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"))
    at = stored(select_ranks(rows, wanted, names, bins, few), "quantiles")
    low, high = (_renamed(at, [*names, "rank", "v"], s) for s in ("_a", "_b"))
    both = asked.join(low, _matched(names, "_a") & (F.col("below") == F.col("_arank"))).join(high, _matched(names, "_b") & (F.col("above") == F.col("_brank")))
    a, b = F.col("_av").cast("double"), F.col("_bv").cast("double")
    return both.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "p", "n", (a + (b - a) * (F.col("at") - F.col("below"))).alias("v"))


def values_at(df: DataFrame, value: Column, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row: for each name the value at a rank (from 0) that follows from the number of values; null if there are none."""
    rows = df.select(value.alias("v")).where("v IS NOT NULL")
    ends = stored(rows.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0"), "quantiles")
    each = F.array(*[F.struct(F.lit(k).alias("name"), rank(F.col("n")).cast("bigint").alias("rank")) for k, rank in ranks.items()])
    asked = ends.select("lo", "hi", "n", F.inline(each))
    wanted = asked.select("rank", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")).distinct()
    found = asked.select("name", "rank").join(select_ranks(rows, wanted, []), "rank")
    return found.agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in ranks])

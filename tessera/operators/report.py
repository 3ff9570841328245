"""The figures of a report on one place: series, seasons, hours, changes, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.quantiles import values_at


def dense_series(counts: DataFrame, first: int, last: int, keys: list[str] = ()) -> DataFrame:
    """counts (keys..., m, n) with a row for every month, 0 where there is none."""
    spine = counts.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("m"))
    if keys:
        spine = counts.select(*keys).distinct().withColumn("m", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return spine.join(counts, [*keys, "m"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def trailing_mean(series: DataFrame, keys: list[str] = (), months: int = 12) -> DataFrame:
    """series with trailing: the mean of so many months up to each, null before there are as many. A series is short."""
    by = Window.partitionBy(*keys).orderBy("m")
    return series.withColumn("trailing", F.when(F.row_number().over(by) >= months, F.round(F.avg("n").over(by.rowsBetween(1 - months, 0)), 4)))


def year_earlier(series: DataFrame, keys: list[str] = ()) -> DataFrame:
    return series.withColumn("before", F.lag("n", 12).over(Window.partitionBy(*keys).orderBy("m")))


def index_series(yearly: DataFrame, base_year: int, keys: list[str]) -> DataFrame:
    """idx: each year's n as a percentage of the base year's, null without one."""
    base = F.max(F.when(F.col("year") == base_year, F.col("n"))).over(Window.partitionBy(*keys))
    return yearly.withColumn("idx", F.round(F.try_divide(100.0 * F.col("n"), F.nullif(base, F.lit(0))), 4))


def seasonal_share(counts: DataFrame) -> DataFrame:
    """Share of each calendar month (from 0) in all of counts (m, n)."""
    by = counts.groupBy((F.col("m") % 12).alias("month")).agg(F.sum("n").alias("n"))
    return by.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def dow_hour(events: DataFrame, ts: str) -> DataFrame:
    """n for all 168 cells of weekday (0: Monday) and hour."""
    grid = events.sparkSession.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    n = events.groupBy(F.weekday(ts).alias("dow"), F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    return grid.join(n, ["dow", "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def night_weekend(cells: DataFrame) -> DataFrame:
    """Shares at night (22 to 6) and on weekends, and the busiest cell (the first of those that tie)."""
    part = lambda p: F.round(F.try_divide(100.0 * F.sum(F.when(p, F.col("n")).otherwise(0)), F.sum("n")), 4)
    top = F.min(F.struct((-F.col("n")).alias("n"), F.col("dow"), F.col("hour")))
    one = cells.agg(part((F.col("hour") >= 22) | (F.col("hour") < 6)).alias("night_pct"), part(F.col("dow") >= 5).alias("weekend_pct"), top.alias("t"), F.sum("n").alias("total"))
    return one.select("total", "night_pct", "weekend_pct", F.col("t.dow").alias("top_dow"), F.col("t.hour").alias("top_hour"))


def type_share(yearly: DataFrame, of: Column) -> DataFrame:
    """Per year: n of a type, all, and its share."""
    by = yearly.groupBy("year").agg(F.sum(F.when(of, F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("total"))
    return by.withColumn("pct", F.round(F.try_divide(100.0 * F.col("n"), F.nullif(F.col("total"), F.lit(0))), 4))


def what_changed(pairs: DataFrame, key: str, scale: float = 1.0) -> DataFrame:
    """Biggest rise and drop: pairs has key, now, before (null: none)."""
    diff = F.coalesce(F.col("now"), F.lit(0)) * scale - F.coalesce(F.col("before"), F.lit(0))
    rows = pairs.select(key, F.round(diff, 4).alias("d"))
    one = rows.agg(F.min(F.struct((-F.col("d")).alias("d"), F.col(key))).alias("up"), F.min(F.struct("d", key)).alias("down"))
    return one.select(F.col(f"up.{key}").alias("rise"), (-F.col("up.d")).alias("rise_by"), F.col(f"down.{key}").alias("drop"), F.col("down.d").alias("drop_by"))


def top_then_change(pairs: DataFrame, key: str, top: int = 8) -> DataFrame:
    """The top keys by volume, ordered by how much they changed."""
    kept = pairs.orderBy(F.desc_nulls_last("now"), key).limit(top)
    return kept.withColumn("change", F.coalesce("now", F.lit(0)) - F.coalesce("before", F.lit(0))).orderBy(F.desc(F.abs("change")), key)


def top_then_prior(cube: DataFrame, keys: list[str], now: Column, before: Column, top: int) -> DataFrame:
    """The top keys of a period, and what the same keys had before it. The second look reads only those keys."""
    best = cube.where(now).groupBy(*keys).agg(F.sum("n").cast("bigint").alias("n")).orderBy(F.desc("n"), *keys).limit(top)
    prior = cube.where(before).join(best.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.sum("n").cast("bigint").alias("prior"))
    return best.join(prior, keys, "left").withColumn("prior", F.coalesce("prior", F.lit(0)))


def rank_by(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """One plus how many are larger. For the few units of a ranking."""
    return df.withColumn(name, F.rank().over(Window.orderBy(F.desc_nulls_last(value))))


def share_below(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """pct_below: rounded share of peers strictly below; pct_floor: the same, cut to a whole number of 99 at most.

    Counts of equal values are summed first, so the window sees a row a value."""
    peers = df.groupBy(*keys, value).agg(F.count("*").alias("k"))
    by = Window.partitionBy(*keys)
    below = F.coalesce(F.sum("k").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = peers.withColumns({"below": below, "of": F.sum("k").over(by)})
    out = ranked.select(*keys, value, F.round(100.0 * F.col("below") / F.col("of"), 0).cast("int").alias("pct_below"), F.least(F.lit(99), F.floor(100.0 * F.col("below") / F.col("of"))).cast("int").alias("pct_floor"))
    return df.join(out, [*keys, value])


def medians(df: DataFrame, value: str) -> DataFrame:
    """The upper middle value, and the interpolated median: one row."""
    at = values_at(df, F.col(value), {"lower": lambda n: F.floor((n - 1) / 2), "upper_median": lambda n: F.floor(n / 2)})
    return at.select("upper_median", ((F.col("lower").cast("double") + F.col("upper_median")) / 2).alias("median"))


def busiest_days(facts: DataFrame, day: str, top: int = 5) -> DataFrame:
    """The busiest days with their share of all, and whether a day looks like a batch (5 or more, and 5 %)."""
    days = facts.groupBy(day).agg(F.count("*").alias("n"))
    shares = days.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))
    return shares.withColumn("batch", (F.col("n") >= 5) & (F.col("pct") >= 5)).orderBy(F.desc("n"), day).limit(top)


def new_locations(points: DataFrame, keys: list[str], start: int, least: int = 12) -> DataFrame:
    """Places with fewer than ``least`` distinct months before start (when data reach back as far)."""
    before = F.count_distinct(F.when(F.col("m") < start, F.col("m")))
    return points.groupBy(*keys).agg(before.alias("months_before"), F.sum("n").cast("bigint").alias("n")).withColumn("is_new", (F.col("months_before") < least) & F.lit(start >= least))


def stack_index(facts: DataFrame, place: list[str], day: str, order: list[str]) -> DataFrame:
    """k: the rank of a fact among those of its place and day, from 0. What a place has on a day is what one drawing stacks."""
    return facts.withColumn("k", F.row_number().over(Window.partitionBy(*place, day).orderBy(*order)) - 1)


def bars_with_zeros(types: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Every type with its n, 0 where there is none."""
    return types.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def group_split(counts: DataFrame, key: str, groups: dict[str, list[int]]) -> DataFrame:
    """n by group of types, for groups that have any: group, n."""
    of = F.create_map(*[F.lit(x) for g, ts in groups.items() for t in ts for x in (t, g)])
    by = counts.withColumn("group", F.element_at(of, F.col(key))).where(F.col("group").isNotNull())
    return by.groupBy("group").agg(F.sum("n").cast("bigint").alias("n")).where("n > 0")


def known_years(yearly: DataFrame, value: str) -> DataFrame:
    """The first and the last year with a value, and the values there. One row."""
    known = F.col(value).isNotNull()
    at = lambda f: f(F.when(known, F.struct("year", value)))
    one = yearly.agg(at(F.min).alias("a"), at(F.max).alias("b"))
    return one.select(F.col("a.year").alias("first"), F.col(f"a.{value}").alias("then"), F.col("b.year").alias("last"), F.col(f"b.{value}").alias("now"))


def area_rates(pairs: DataFrame, years_now: float, years_before: float, least: int = 2000) -> DataFrame:
    """pairs (key, residents, now, before; null: none) with rate and rate_before, for 1,000 residents a year; null, and not
    rated, where fewer live. Areas without a count in both periods are left out."""
    rows = pairs.na.fill(0, ["now", "before"]).where("now + before > 0").withColumn("rated", F.coalesce(F.col("residents") >= least, F.lit(False)))
    rate = lambda n, years: F.when(F.col("rated"), F.col(n) * 1000.0 / F.col("residents") / years)
    return rows.withColumns({"rate": rate("now", years_now), "rate_before": rate("before", years_before)})


def area_changes(rates: DataFrame, key: str, least: int = 100) -> DataFrame:
    """Of rated areas with enough in both periods, those whose rate rose and dropped most (the first key of those that tie),
    by how many percent, and how many areas aren't rated. One row."""
    big = F.col("rated") & (F.col("now") >= least) & (F.col("before") >= least)
    times = F.col("rate") / F.col("rate_before")
    one = rates.agg(
        F.min(F.when(big, F.struct((-times).alias("t"), F.col(key).alias("k")))).alias("up"),
        F.min(F.when(big, F.struct(times.alias("t"), F.col(key).alias("k")))).alias("down"),
        F.count_if(~F.col("rated")).alias("unrated"),
    )
    pct = lambda t: F.round(100.0 * (t - 1), 4)
    return one.select(F.col("up.k").alias("rise"), pct(-F.col("up.t")).alias("rise_pct"), F.col("down.k").alias("drop"), pct(F.col("down.t")).alias("drop_pct"), "unrated")


def title(streets: Column, block: Column, name: Column) -> Column:
    """A spot's title: its corner, else its block of a street, else a general one."""
    return F.when(F.size(streets) >= 2, F.concat_ws(" & ", F.slice(F.sort_array(streets), 1, 2))).when(block >= 0, F.concat_ws(" ", block.cast("string"), F.lit("block of"), name)).otherwise("This location")


#: Least volumes for the parts of a report. Fixed values.
GATES = {"monthly": 30, "season": 120, "day_hour": 100, "hour_grid": 500, "type_share": 50, "what_changed": 40, "premises": 10, "busiest_days": 20, "area_change": 100}


def parts_shown(total: Column) -> Column:
    """Names of the report's parts that a total is enough for, in order of their thresholds."""
    ordered = sorted(GATES, key=lambda g: (GATES[g], g))
    return F.filter(F.array(*[F.when(total >= GATES[g], g) for g in ordered]), lambda g: g.isNotNull())

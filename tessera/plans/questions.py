"""The interactive questions and the figures of a report, answered from cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import compare, grid
from tessera.functions.period import Period, Span, baseline_of, comparison_of, days_of, fair_column, in_dates, in_months, months_of, resolved
from tessera.operators import audit, clean, cubes, report, spatial
from tessera.operators.quantiles import values_at
from tessera.plans.fixtures import BRIDGE, MONTHS, SPOTS, WITH, X_OF, Y_OF, all_stored, bridge, corners, facts, lines, locs, points_in, stored, table
from tessera.plans.registry import query

SPAN = Span(1995, 2001, 1997)
PERIOD = Period("year", 2000, 2000)
NOW = months_of(PERIOD, SPAN)
BEFORE, SCALE = baseline_of(PERIOD, SPAN)
TYPES = [0, 2, 3]
NOW_SQL, BEFORE_SQL, TYPES_SQL = "m BETWEEN 60 AND 71", "m BETWEEN 24 AND 35", "cat IN (0, 2, 3)"

# The same hexagons in SQL: fractions of the axial coordinates, rounded half to even.
_HEX = """hx AS (SELECT *, (sqrt(3.0) / 3 * x - y / 3) / 180.0 AS fq, (2.0 / 3 * y) / 180.0 AS fr FROM (SELECT *, (lon - (-73.95)) * (111320.0 * cos(radians(40.73))) AS x, (lat - 40.73) * 110950.0 AS y FROM facts WHERE lt = 0)),
hr AS (SELECT *, round_even(fq, 0) AS q0, round_even(fr, 0) AS r0, round_even(-fq - fr, 0) AS s0 FROM hx),
hd AS (SELECT *, abs(q0 - fq) AS dq, abs(r0 - fr) AS dr, abs(s0 - (-fq - fr)) AS ds FROM hr),
hex AS (SELECT *, CAST(CASE WHEN dq > dr AND dq > ds THEN -r0 - s0 ELSE q0 END AS SMALLINT) AS q, CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -q0 - s0 ELSE r0 END AS SMALLINT) AS r FROM hd)"""
HEX = f"{WITH}, {_HEX}"


@query(f"{HEX} SELECT q, r, count(*) AS n FROM hex WHERE {NOW_SQL} AND {TYPES_SQL} GROUP BY 1, 2")
def hex_counts(spark: SparkSession, d: str) -> DataFrame:
    return cubes.counts(stored(spark, d, "hex"), ["q", "r"], NOW, TYPES)


@query(f"{HEX} SELECT DISTINCT q, r FROM hex")
def hex_universe(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "hex").select("q", "r").distinct()


@query(f"{HEX} SELECT q, r, cat, sum(1) FILTER (WHERE {NOW_SQL})::BIGINT AS now, sum(1) FILTER (WHERE {BEFORE_SQL})::BIGINT AS before FROM hex GROUP BY 1, 2, 3 HAVING now > 0 OR before > 0")
def hex_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Every hexagon by type, of which a reader picks one by q and r."""
    return cubes.now_and_before(stored(spark, d, "hex"), ["q", "r", "cat"], NOW, BEFORE)


_KX = "(111320.0 * cos(radians(40.73)))"


@query(f"""{HEX}, c AS (SELECT DISTINCT CAST(q AS DOUBLE) AS q, CAST(r AS DOUBLE) AS r FROM hex), p AS (SELECT *, 180.0 * sqrt(3.0) * (q + r / 2.0) AS x, 180.0 * 1.5 * r AS y FROM c)
SELECT CAST(q AS SMALLINT) AS q, CAST(r AS SMALLINT) AS r, round(y / 110950.0 + 40.73, 9) AS lat, round(x / {_KX} + (-73.95), 9) AS lon,
  round(y / 110950.0 + 40.73 + 180.0 * sin(radians(30.0)) / 110950.0, 9) AS corner_lat, round(x / {_KX} + (-73.95) + 180.0 * cos(radians(30.0)) / {_KX}, 9) AS corner_lon FROM p""")
def hex_center(spark: SparkSession, d: str) -> DataFrame:
    cells = stored(spark, d, "hex").select("q", "r").distinct()
    lat, lon = grid.hex_center(F.col("q"), F.col("r"))
    ring = grid.hex_ring(F.col("q"), F.col("r"))
    return cells.select("q", "r", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"), F.round(ring[0]["lat"], 9).alias("corner_lat"), F.round(ring[0]["lon"], 9).alias("corner_lon"))


@query(f"{WITH} SELECT m, count(*) AS n FROM facts WHERE {TYPES_SQL} GROUP BY 1")
def city_by_month(spark: SparkSession, d: str) -> DataFrame:
    return cubes.counts(stored(spark, d, "areas"), ["m"], types=TYPES)


@query(f"{WITH} SELECT lt, count(*) AS n FROM facts WHERE {NOW_SQL} AND {TYPES_SQL} GROUP BY 1")
def by_location_type(spark: SparkSession, d: str) -> DataFrame:
    return cubes.counts(stored(spark, d, "areas"), ["lt"], NOW, TYPES)


@query(f"{WITH} SELECT cat, count(*) AS n FROM facts WHERE {NOW_SQL} GROUP BY 1")
def by_category(spark: SparkSession, d: str) -> DataFrame:
    return cubes.counts(stored(spark, d, "areas"), ["cat"], NOW)


@query(f"{WITH} SELECT count(*) AS n FROM facts WHERE {BEFORE_SQL} AND {TYPES_SQL}")
def baseline_total(spark: SparkSession, d: str) -> DataFrame:
    return cubes.counts(stored(spark, d, "areas"), [], BEFORE, TYPES)


@query(f"{WITH} SELECT pct, count(*) AS n FROM facts WHERE {NOW_SQL} AND {TYPES_SQL} GROUP BY 1")
def by_precinct(spark: SparkSession, d: str) -> DataFrame:
    return cubes.counts(stored(spark, d, "areas"), ["pct"], NOW, TYPES)


@query(f"{WITH} SELECT boro, count(*) AS n FROM facts WHERE {NOW_SQL} AND {TYPES_SQL} AND boro BETWEEN 1 AND 5 GROUP BY 1")
def by_borough(spark: SparkSession, d: str) -> DataFrame:
    return cubes.counts(stored(spark, d, "areas"), ["boro"], NOW, TYPES, F.col("boro").between(1, 5))


@query(f"{WITH} SELECT cat, count(*) FILTER (WHERE {NOW_SQL}) AS now, count(*) FILTER (WHERE {BEFORE_SQL}) AS before FROM facts WHERE boro = 2 AND ({NOW_SQL} OR {BEFORE_SQL}) GROUP BY 1")
def baseline_change(spark: SparkSession, d: str) -> DataFrame:
    return cubes.now_and_before(stored(spark, d, "areas").where("boro = 2"), ["cat"], NOW, BEFORE)


@query(f"{WITH}, t AS (SELECT pct, boro, count(*) AS n FROM facts GROUP BY 1, 2) SELECT pct, boro AS main FROM (SELECT *, row_number() OVER (PARTITION BY pct ORDER BY n DESC, boro) AS rn FROM t) WHERE rn = 1")
def argmax_per_group(spark: SparkSession, d: str) -> DataFrame:
    n = cubes.counts(stored(spark, d, "areas"), ["pct", "boro"])
    return n.groupBy("pct").agg(F.max_by("boro", F.struct("n", -F.col("boro"))).alias("main"))


@query(f"{WITH}, p AS (SELECT CAST(lat AS FLOAT) AS lat, CAST(lon AS FLOAT) AS lon, cat, count(*) AS n FROM facts WHERE lt = 0 AND {NOW_SQL} AND lat BETWEEN 40.55 AND 40.75 AND lon BETWEEN -74.2 AND -73.9 GROUP BY 1, 2, 3), "
       "r AS (SELECT *, sum(n) OVER (PARTITION BY lat, lon) AS total, row_number() OVER (PARTITION BY lat, lon ORDER BY n DESC, cat) AS rn FROM p) SELECT CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, total::BIGINT AS n, cat AS main FROM r WHERE rn = 1")  # fmt: skip
def locations_in_view(spark: SparkSession, d: str) -> DataFrame:
    by = cubes.counts(points_in(spark, d, (40.55, 40.75, -74.2, -73.9)), ["lat", "lon", "cat"], NOW)
    out = by.groupBy("lat", "lon").agg(F.sum("n").alias("n"), F.max_by("cat", F.struct("n", -F.col("cat"))).alias("main"))
    return out.select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "n", "main").orderBy(F.desc("n"), "lat", "lon").limit(250_000)


@query(f"{WITH} SELECT m, cat, count(*) AS n FROM facts WHERE pct = 7 GROUP BY 1, 2")
def entity_series(spark: SparkSession, d: str) -> DataFrame:
    return cubes.counts(stored(spark, d, "areas"), ["m", "cat"], where=F.col("pct") == 7)


@query(f"{WITH} SELECT pct AS street, m, cat, count(*) AS n FROM facts GROUP BY 1, 2, 3")
def street_series(spark: SparkSession, d: str) -> DataFrame:
    """Months and types of every street, of which a reader picks one."""
    return cubes.counts(stored(spark, d, "blocks"), ["street", "m", "cat"])


_SERIES = f"{WITH}, s AS (SELECT r.m AS m, coalesce(f.n, 0) AS n FROM (SELECT unnest(range({MONTHS})) AS m) r LEFT JOIN (SELECT m, count(*) AS n FROM facts WHERE pct = 7 GROUP BY 1) f ON r.m = f.m)"


def _series(spark: SparkSession, d: str) -> DataFrame:
    return report.dense_series(cubes.counts(stored(spark, d, "areas"), ["m"], where=F.col("pct") == 7), 0, MONTHS - 1)


@query(f"{_SERIES} SELECT CAST(m AS INT) AS m, n, CASE WHEN row_number() OVER (ORDER BY m) >= 12 THEN round(avg(n) OVER (ORDER BY m ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 4) END AS trailing FROM s")
def trailing_mean(spark: SparkSession, d: str) -> DataFrame:
    return report.trailing_mean(_series(spark, d))


@query(f"{_SERIES} SELECT CAST(m AS INT) AS m, n, lag(n, 12) OVER (ORDER BY m) AS before FROM s")
def year_earlier(spark: SparkSession, d: str) -> DataFrame:
    return report.year_earlier(_series(spark, d))


@query(f"{WITH}, y AS (SELECT pct, CAST(m // 12 + 1995 AS INT) AS year, count(*) AS n FROM facts GROUP BY 1, 2), b AS (SELECT pct, n AS base FROM y WHERE year = 1997) SELECT y.pct, year, n, round(100.0 * n / base, 4) AS idx FROM y LEFT JOIN b ON y.pct = b.pct")
def index_series(spark: SparkSession, d: str) -> DataFrame:
    yearly = facts(spark, d).groupBy("pct", F.expr("CAST(m DIV 12 + 1995 AS INT)").alias("year")).agg(F.count("*").alias("n"))
    return report.index_series(yearly, 1997, ["pct"])


@query(f"{WITH} SELECT CAST(m % 12 AS INT) AS month, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM facts WHERE m BETWEEN 0 AND 71 GROUP BY 1")
def seasonal_share(spark: SparkSession, d: str) -> DataFrame:
    return report.seasonal_share(cubes.counts(stored(spark, d, "areas"), ["m"], list(range(72))))


_CELLS = """WITH c AS (SELECT CAST(isodow(ts) - 1 AS INT) AS dow, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY 1, 2),
g AS (SELECT CAST(i // 24 AS INT) AS dow, CAST(i % 24 AS INT) AS hour FROM (SELECT unnest(range(168)) AS i)),
cells AS (SELECT g.dow, g.hour, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON g.dow = c.dow AND g.hour = c.hour)"""


@query(f"{_CELLS} SELECT dow, hour, n FROM cells")
def dow_hour(spark: SparkSession, d: str) -> DataFrame:
    return report.dow_hour(table(spark, d, "events"), "ts")


@query(f"""{_CELLS} SELECT CAST(sum(n) AS BIGINT) AS total, round(100.0 * sum(n) FILTER (WHERE hour >= 22 OR hour < 6) / sum(n), 4) AS night_pct, round(100.0 * sum(n) FILTER (WHERE dow >= 5) / sum(n), 4) AS weekend_pct,
  (SELECT dow FROM cells ORDER BY n DESC, dow, hour LIMIT 1) AS top_dow, (SELECT hour FROM cells ORDER BY n DESC, dow, hour LIMIT 1) AS top_hour FROM cells""")
def night_weekend_share(spark: SparkSession, d: str) -> DataFrame:
    return report.night_weekend(report.dow_hour(table(spark, d, "events"), "ts"))


@query("""WITH e AS (SELECT user_id % 25 AS pct, user_id % 5 AS boro, user_id % 40 AS nta, CAST(year(ts) AS INT) AS year, CAST(length(event_type) AS INT) AS cat, CAST(isodow(ts) - 1 AS INT) AS dow, CAST(hour(ts) AS INT) AS hour,
  CASE WHEN user_id % 3 = 0 THEN [user_id % 7, user_id % 7 + 10] ELSE [user_id % 7] END AS streets FROM events),
u AS (SELECT 0 AS kind, CAST(0 AS BIGINT) AS id, year, cat, dow, hour FROM e UNION ALL SELECT 1, boro, year, cat, dow, hour FROM e WHERE boro > 0 UNION ALL SELECT 2, pct, year, cat, dow, hour FROM e WHERE pct >= 3
  UNION ALL SELECT 3, nta, year, cat, dow, hour FROM e WHERE nta < 37 UNION ALL SELECT 4, unnest(streets), year, cat, dow, hour FROM e)
SELECT kind, id, year, cat, dow, hour, count(*) AS n FROM u GROUP BY ALL""")
def agg_time(spark: SparkSession, d: str) -> DataFrame:
    k, always = F.col("user_id"), F.lit(True)
    e = table(spark, d, "events").select("user_id", F.year("ts").alias("year"), F.length("event_type").alias("cat"), F.weekday("ts").alias("dow"), F.hour("ts").alias("hour"))
    streets = F.when(k % 3 == 0, F.array(k % 7, k % 7 + 10)).otherwise(F.array(k % 7))
    return cubes.time_cube(e, [(0, F.array(F.lit(0)), always), (1, F.array(k % 5), k % 5 > 0), (2, F.array(k % 25), k % 25 >= 3), (3, F.array(k % 40), k % 40 < 37), (4, streets, always)])


@query(f"{WITH}, y AS (SELECT pct, CAST(cat AS VARCHAR) AS type, CAST(m // 12 + 1995 AS INT) AS year FROM facts) SELECT pct, type, year, count(*) AS n FROM y GROUP BY ALL UNION ALL SELECT pct, 'all', year, count(*) FROM y GROUP BY ALL")
def type_year_totals(spark: SparkSession, d: str) -> DataFrame:
    return cubes.type_year_totals(facts(spark, d), "pct", F.expr("CAST(m DIV 12 + 1995 AS INT)"))


@query(f"{WITH}, n AS (SELECT pct, m // 12 AS y, count(*) AS n FROM facts GROUP BY 1, 2), a AS (SELECT pct, sum(n) / 7.0 AS v FROM n GROUP BY 1) SELECT CAST(i AS INT) AS p, round(q[i + 1], 3) AS v FROM (SELECT unnest(range(101)) AS i, (SELECT quantile_cont(v, list_transform(range(101), lambda k: k / 100.0)) FROM a) AS q)")
def percentile_vector_avg(spark: SparkSession, d: str) -> DataFrame:
    means = facts(spark, d).groupBy("pct").agg((F.count("*") / 7.0).alias("v"))
    return means.agg(compare.percentile_vector(F.col("v")).alias("q")).select(F.posexplode("q").alias("p", "v"))


@query(f"{WITH}, n AS (SELECT pct, count(*) AS n FROM facts WHERE {NOW_SQL} GROUP BY 1) SELECT pct, n, CAST(round(100.0 * (SELECT count(*) FROM n b WHERE b.n < a.n) / (SELECT count(*) FROM n)) AS INT) AS pct_below, CAST(least(99, floor(100.0 * (SELECT count(*) FROM n b WHERE b.n < a.n) / (SELECT count(*) FROM n))) AS INT) AS pct_floor FROM n a")
def pct_rank_below(spark: SparkSession, d: str) -> DataFrame:
    return report.share_below(cubes.counts(stored(spark, d, "areas"), ["pct"], NOW), "n").select("pct", "n", "pct_below", "pct_floor")


_RATES = f"""{WITH}, pop AS (SELECT c_nationkey AS pct, count(*) * 1000 AS residents FROM customer GROUP BY 1),
n AS (SELECT pct, count(*) AS n FROM facts WHERE {NOW_SQL} GROUP BY 1)"""
_DAYS = days_of(NOW, SPAN)


def _with_population(spark: SparkSession, d: str) -> DataFrame:
    pop = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("pct")).agg((F.count("*") * 1000).alias("residents"))
    return cubes.counts(stored(spark, d, "areas"), ["pct"], NOW).join(pop, "pct")


@query(f"{_RATES} SELECT pct, n, residents, CASE WHEN residents >= 50000 THEN round(n / residents * 1000.0 / ({_DAYS} / 365.25), 6) END AS rate FROM n JOIN pop USING (pct)")
def rate_per_1000(spark: SparkSession, d: str) -> DataFrame:
    return _with_population(spark, d).withColumn("rate", F.round(compare.rate_per_1000(F.col("n"), F.col("residents"), _DAYS, 50_000), 6))


@query(f"{_RATES} SELECT pct, round((CAST(n AS DOUBLE) / residents) / ((SELECT sum(n) FROM n)::DOUBLE / (SELECT sum(residents) FROM pop)), 6) AS lq FROM n JOIN pop USING (pct)")
def location_quotient(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_population(spark, d)
    city = rows.agg(F.sum("n").alias("city_n"), F.sum("residents").alias("city_residents"))
    return rows.crossJoin(F.broadcast(city)).select("pct", F.round(compare.quotient(F.col("n"), F.col("residents"), F.col("city_n"), F.col("city_residents")), 6).alias("lq"))  # one row


@query(f"{_RATES}, b AS (SELECT pct % 5 AS b, sum(n) / sum(residents) AS rate FROM n JOIN pop USING (pct) GROUP BY 1) SELECT b, CAST(1 + (SELECT count(*) FROM b y WHERE y.rate > x.rate) AS INT) AS rank FROM b x")
def borough_rank(spark: SparkSession, d: str) -> DataFrame:
    by = _with_population(spark, d).groupBy((F.col("pct") % 5).alias("b")).agg((F.sum("n") / F.sum("residents")).alias("rate"))
    return report.rank_by(by, "rate").select("b", "rank")


@query(f"{WITH}, n AS (SELECT pct, count(*) AS n FROM facts GROUP BY 1) SELECT (SELECT list_sort(list(n))[CAST(count(*) // 2 + 1 AS BIGINT)] FROM n) AS upper_median, (SELECT median(n) FROM n) AS median")
def median_variants(spark: SparkSession, d: str) -> DataFrame:
    return report.medians(cubes.counts(stored(spark, d, "areas"), ["pct"]), "n")


def _merged(months: list[int]):
    return lambda spark, d: facts(spark, d).where(in_months(F.col("m"), months)).groupBy(cubes.merge_units(F.col("pct"), months, (5, 13, 16), 5, 48).alias("unit")).agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT CASE WHEN pct IN (5, 13, 16) THEN 5 ELSE pct END AS unit, count(*) AS n FROM facts WHERE m BETWEEN 40 AND 55 GROUP BY 1")
def merged_units(spark: SparkSession, d: str) -> DataFrame:
    return _merged(list(range(40, 56)))(spark, d)


@query(f"{WITH} SELECT pct AS unit, count(*) AS n FROM facts WHERE m BETWEEN 48 AND 59 GROUP BY 1")
def merged_units_after(spark: SparkSession, d: str) -> DataFrame:
    return _merged(list(range(48, 60)))(spark, d)


@query(f"{WITH}, y AS (SELECT CAST(m // 12 + 1995 AS INT) AS year, count(*) FILTER (WHERE cat = 2) AS n, count(*) AS total FROM facts WHERE boro = 1 GROUP BY 1) SELECT year, n, total, round(100.0 * n / nullif(total, 0), 4) AS pct FROM y")
def type_share(spark: SparkSession, d: str) -> DataFrame:
    yearly = facts(spark, d).where("boro = 1").groupBy(F.expr("CAST(m DIV 12 + 1995 AS INT)").alias("year"), "cat").agg(F.count("*").alias("n"))
    return report.type_share(yearly, F.col("cat") == 2)


_PAIRS = f"{WITH}, p AS (SELECT {{key}} AS k, count(*) FILTER (WHERE {NOW_SQL}) AS now, count(*) FILTER (WHERE {BEFORE_SQL}) AS before FROM facts GROUP BY 1), d AS (SELECT k, now, before, round(now - before, 4) AS d FROM p)"


@query(_PAIRS.format(key="cat") + """ SELECT (SELECT k FROM d ORDER BY d DESC, k LIMIT 1) AS rise, (SELECT CAST(d AS DOUBLE) FROM d ORDER BY d DESC, k LIMIT 1) AS rise_by, (SELECT k FROM d ORDER BY d, k LIMIT 1) AS "drop", (SELECT CAST(d AS DOUBLE) FROM d ORDER BY d, k LIMIT 1) AS drop_by""")
def what_changed(spark: SparkSession, d: str) -> DataFrame:
    return report.what_changed(cubes.now_and_before(stored(spark, d, "areas"), ["cat"], NOW, BEFORE), "cat", SCALE)


@query(_PAIRS.format(key="pct") + " SELECT k AS pct, now, before, now - before AS change FROM (SELECT * FROM d ORDER BY now DESC, k LIMIT 8)")
def top_by_volume_change(spark: SparkSession, d: str) -> DataFrame:
    pairs = cubes.now_and_before(stored(spark, d, "areas"), ["pct"], NOW, BEFORE)
    return report.top_then_change(pairs.select("pct", F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("before", F.lit(0)).alias("before")), "pct")


@query(_PAIRS.format(key="pct") + ", r AS (SELECT c_nationkey AS pct, count(*) * 1000 AS residents FROM customer GROUP BY 1) SELECT pct, now, before, CASE WHEN residents >= 50000 THEN round(now / residents * 1000.0, 6) END AS rate, CASE WHEN now >= 10 AND before >= 10 THEN round(100.0 * (now - before) / before, 2) END AS pct_change FROM d JOIN r ON d.k = r.pct")
def area_ranking(spark: SparkSession, d: str) -> DataFrame:
    pairs = cubes.now_and_before(stored(spark, d, "areas"), ["pct"], NOW, BEFORE).na.fill(0, ["now", "before"])
    pop = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("pct")).agg((F.count("*") * 1000).alias("residents"))
    rate = F.round(F.when(F.col("residents") >= 50_000, F.col("now") / F.col("residents") * 1000.0), 6)
    change = F.when((F.col("now") >= 10) & (F.col("before") >= 10), compare.percent_change(F.col("now"), F.col("before")))
    return pairs.join(pop, "pct").select("pct", "now", "before", rate.alias("rate"), change.alias("pct_change"))


@query(f"{WITH} SELECT street, block, n FROM (SELECT pct AS street, CAST(loc_id // 100 * 100 AS BIGINT) AS block, count(*) AS n FROM facts WHERE {NOW_SQL} GROUP BY 1, 2) ORDER BY n DESC, street, block LIMIT 40")
def top_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = stored(spark, d, "blocks")
    return cubes.counts(blocks, ["street", "block"], NOW).orderBy(F.desc("n"), "street", "block").limit(40)


@query(f"{WITH}, b AS (SELECT pct AS street, CAST(loc_id // 100 * 100 AS BIGINT) AS block, m FROM facts), t AS (SELECT street, block, count(*) AS n FROM b WHERE {NOW_SQL} GROUP BY 1, 2 ORDER BY n DESC, street, block LIMIT 25) SELECT street, block, n, (SELECT count(*) FROM b WHERE b.street = t.street AND b.block = t.block AND {BEFORE_SQL}) AS prior FROM t")
def top_then_prior(spark: SparkSession, d: str) -> DataFrame:
    blocks = stored(spark, d, "blocks")
    return report.top_then_prior(blocks, ["street", "block"], in_months(F.col("m"), NOW), in_months(F.col("m"), BEFORE), 25)


@query(f"{WITH}, c AS (SELECT unnest(range(8)) AS cat), n AS (SELECT cat, count(*) AS n FROM facts WHERE pct = 7 AND m = 70 GROUP BY 1) SELECT CAST(c.cat AS INT) AS cat, coalesce(n, 0) AS n FROM c LEFT JOIN n ON c.cat = n.cat")
def type_bars_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    types = spark.range(8).select(F.col("id").cast("int").alias("cat"))
    return report.bars_with_zeros(types, cubes.counts(stored(spark, d, "areas"), ["cat"], [70], where=F.col("pct") == 7), "cat")


@query(f"{WITH} SELECT count(*) FILTER (WHERE lt IN (1, 2)) AS no_place, count(*) FILTER (WHERE lt = 1) AS precinct_only, count(*) FILTER (WHERE pct < 0) AS no_precinct, count(*) - count(*) FILTER (WHERE boro BETWEEN 1 AND 5) AS no_borough, count(*) AS total FROM facts WHERE {NOW_SQL}")
def undrawable_accounting(spark: SparkSession, d: str) -> DataFrame:
    return cubes.undrawable(facts(spark, d).where(in_months(F.col("m"), NOW)))


@query(f"{WITH} SELECT loc_id, count(DISTINCT m) FILTER (WHERE m < 60) AS months_before, count(*) AS n, count(DISTINCT m) FILTER (WHERE m < 60) < 8 AS is_new FROM facts GROUP BY 1")
def new_location_rule(spark: SparkSession, d: str) -> DataFrame:
    return report.new_locations(stored(spark, d, "places"), ["loc_id"], 60, 8)


@query(f"{WITH} SELECT id, CAST(report_date AS VARCHAR) AS day, cat, m FROM facts WHERE loc_id = 7 ORDER BY report_date DESC, id LIMIT 50")
def each_event(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d).where("loc_id = 7").orderBy(F.desc("report_date"), "id").limit(50)
    return rows.select("id", F.col("report_date").cast("string").alias("day"), "cat", "m")


@query(f"{WITH} SELECT CAST(report_date AS VARCHAR) AS day, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct, count(*) >= 5 AND round(100.0 * count(*) / sum(count(*)) OVER (), 4) >= 5 AS batch FROM facts WHERE pct = 3 GROUP BY report_date ORDER BY n DESC, report_date LIMIT 5")
def busiest_days(spark: SparkSession, d: str) -> DataFrame:
    return report.busiest_days(facts(spark, d).where("pct = 3").withColumn("day", F.col("report_date").cast("string")), "day")


@query(f"{WITH} SELECT premise, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM facts WHERE pct = 7 GROUP BY 1 ORDER BY n DESC, premise LIMIT 5")
def premise_share(spark: SparkSession, d: str) -> DataFrame:
    return audit.share_of_total(facts(spark, d).where("pct = 7"), "premise", 4).orderBy(F.desc("n"), "premise").limit(5)


_BREAKS = f"{HEX}, n AS (SELECT q, r, count(*) AS n FROM hex GROUP BY 1, 2), v AS (SELECT list_sort(list(n)) AS v, count(*) AS c FROM n)"
_PICK = ", ".join(f"v[CAST(least(c - 1, floor({p} * c)) + 1 AS BIGINT)] AS b{i}" for i, p in enumerate(compare.HEX_SHARES))


def _raw_breaks(n: DataFrame) -> DataFrame:
    """Values at the class shares, one row."""
    at = lambda p: lambda k: F.least(k - 1, F.floor(p * k))
    return values_at(n.where("n > 0"), F.col("n"), {f"b{i}": at(p) for i, p in enumerate(compare.HEX_SHARES)})


@query(f"{_BREAKS} SELECT {_PICK} FROM v")
def quantile_breaks(spark: SparkSession, d: str) -> DataFrame:
    return _raw_breaks(cubes.counts(stored(spark, d, "hex"), ["q", "r"]))


@query(f"{_BREAKS}, b AS (SELECT {_PICK} FROM v) SELECT q, r, n, CAST((n > b0)::INT + (n > b1)::INT + (n > b2)::INT + (n > b3)::INT + (n > b4)::INT AS INT) AS class FROM n, b")
def classify_value(spark: SparkSession, d: str) -> DataFrame:
    n = cubes.counts(stored(spark, d, "hex"), ["q", "r"])
    breaks = list(_raw_breaks(n).first())  # five numbers
    return n.withColumn("class", compare.classify(F.col("n"), breaks))


@query(f"{WITH} SELECT loc_id, round(sqrt(pow((lon - (-73.95)) * (111320.0 * cos(radians(40.73))), 2) + pow((lat - 40.73) * 110950.0, 2)), 4) AS d FROM locs")
def local_distance(spark: SparkSession, d: str) -> DataFrame:
    return locs(spark, d).select("loc_id", F.round(grid.distance_m(F.col("lat"), F.col("lon"), F.lit(40.73), F.lit(-73.95)), 4).alias("d"))


def _hilbert_sql() -> str:
    """The fold over 16 bits, a step a subquery."""
    sql = f"""{WITH}, h0 AS (SELECT loc_id, greatest(0, least(65535, CAST(trunc((lon + 74.27) / (74.27 - 73.68) * 65535) AS BIGINT))) AS x,
  greatest(0, least(65535, CAST(trunc((lat - 40.49) / (40.92 - 40.49) * 65535) AS BIGINT))) AS y, CAST(0 AS BIGINT) AS d FROM locs)"""
    for i, k in enumerate(range(15, -1, -1)):
        s = 1 << k
        sql += f""", r{i} AS (SELECT *, CAST((x & {s}) > 0 AS BIGINT) AS rx, CAST((y & {s}) > 0 AS BIGINT) AS ry FROM h{i}),
h{i + 1} AS (SELECT loc_id, CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN {s} - 1 - y ELSE y END) ELSE x END AS x,
  CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN {s} - 1 - x ELSE x END) ELSE y END AS y, d + {s * s} * xor(3 * rx, ry) AS d FROM r{i})"""
    return sql + " SELECT loc_id, d AS hk FROM h16"


@query(_hilbert_sql())
def hilbert_key(spark: SparkSession, d: str) -> DataFrame:
    return locs(spark, d).select("loc_id", grid.hilbert_key(F.col("lat"), F.col("lon")).alias("hk"))


_CIRCLE = f"{WITH}, near AS (SELECT * FROM facts WHERE lt = 0 AND sqrt(pow((lon + 74.0) * (111320.0 * cos(radians(40.73))), 2) + pow((lat - 40.7) * 110950.0, 2)) <= 5000)"


def _near(spark: SparkSession, d: str) -> DataFrame:
    return cubes.in_circle(points_in(spark, d, cubes.circle_view(40.7, -74.0, 5000.0)), 40.7, -74.0, 5000.0)


@query(f"{_CIRCLE} SELECT m, cat, count(*) AS n FROM near GROUP BY 1, 2")
def circle_series(spark: SparkSession, d: str) -> DataFrame:
    return cubes.counts(_near(spark, d), ["m", "cat"])


_SPOT = f"{WITH}, {BRIDGE}, s AS (SELECT lat, lon FROM facts WHERE lt = 0 ORDER BY id LIMIT 1)"


def _at_spot(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """The rows of the place that someone picked, as ranges of float coordinates."""
    first = table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy("o_orderkey").select(F.col("o_custkey").alias("loc_id")).limit(1)  # three narrow columns
    at = locs(spark, d).join(F.broadcast(first), "loc_id").select("lat", "lon").first()
    return rows.where(clean.same_place(F.col("lat"), F.col("lon"), at.lat, at.lon)) if at else rows.limit(0)


@query(f"{_SPOT} SELECT f.cat, count(*) AS n FROM facts f, s WHERE f.lat = s.lat AND f.lon = s.lon GROUP BY 1")
def spot_by_type(spark: SparkSession, d: str) -> DataFrame:
    return cubes.counts(_at_spot(spark, d, stored(spark, d, "points")), ["cat"])


@query(_hilbert_sql().replace(" SELECT loc_id, d AS hk FROM h16", ", p AS (SELECT CAST(f.lat AS FLOAT) AS lat, CAST(f.lon AS FLOAT) AS lon, m, cat, count(*) AS n, min(h.d) AS hk FROM facts f JOIN h16 h ON f.loc_id = h.loc_id WHERE lt = 0 GROUP BY 1, 2, 3, 4) SELECT CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, m, cat, n, hk FROM p"))
def clustered_points(spark: SparkSession, d: str) -> DataFrame:
    return cubes.clustered_points(facts(spark, d)).select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "m", "cat", "n", "hk")


@query(f"{WITH}, len AS (SELECT pct AS street, count(*) * 10.0::DOUBLE AS length_m FROM locs GROUP BY 1), n AS (SELECT pct AS street, count(*) AS n FROM facts WHERE {NOW_SQL} GROUP BY 1), j AS (SELECT len.street, coalesce(n, 0) AS n, length_m FROM len LEFT JOIN n ON len.street = n.street) SELECT street, n, length_m, round(n / length_m * 100, 6) AS rate, round(100.0 * (n / length_m * 100) / (SELECT sum(n) / sum(length_m) * 100 FROM j), 6) AS idx, length_m >= 600 AS ranked FROM j")
def street_index(spark: SparkSession, d: str) -> DataFrame:
    lengths = locs(spark, d).groupBy(F.col("pct").alias("street")).agg((F.count("*") * 10.0).alias("length_m"))
    n = cubes.counts(stored(spark, d, "blocks"), ["street"], NOW)
    return cubes.street_index(n, lengths, "street", 600.0).withColumns({"rate": F.round("rate", 6), "idx": F.round("idx", 6)})


@query(f"{WITH}, b AS (SELECT CAST(loc_id // 100 * 100 AS BIGINT) AS block, m, cat FROM facts WHERE pct = 7) SELECT block, count(*) FILTER (WHERE {NOW_SQL}) AS now, count(*) FILTER (WHERE {BEFORE_SQL}) AS before FROM b WHERE {NOW_SQL} OR {BEFORE_SQL} GROUP BY 1")
def blocks_along_street(spark: SparkSession, d: str) -> DataFrame:
    blocks = stored(spark, d, "blocks")
    return cubes.now_and_before(blocks.where("street = 7"), ["block"], NOW, BEFORE).na.fill(0, ["now", "before"])


@query(f"{WITH} SELECT pct, count(*) FILTER (WHERE {NOW_SQL}) AS now, count(*) FILTER (WHERE {BEFORE_SQL}) AS before FROM facts WHERE lt = 0 AND boro = 3 AND {TYPES_SQL} AND ({NOW_SQL} OR {BEFORE_SQL}) GROUP BY 1")
def areas_of_borough(spark: SparkSession, d: str) -> DataFrame:
    return cubes.now_and_before(stored(spark, d, "areas").where("lt = 0 AND boro = 3"), ["pct"], NOW, BEFORE, TYPES).na.fill(0, ["now", "before"])


@query(f"{_SPOT} SELECT m, f.cat, count(*) AS n FROM facts f, s WHERE f.lat = s.lat AND f.lon = s.lon GROUP BY 1, 2")
def spot_series(spark: SparkSession, d: str) -> DataFrame:
    return cubes.counts(_at_spot(spark, d, stored(spark, d, "points")), ["m", "cat"])


# What a picked place, circle or area shows beside its totals.

@query(f"{_SPOT} SELECT DISTINCT street, block FROM bridge b, s WHERE b.lat = CAST(s.lat AS FLOAT) AND b.lon = CAST(s.lon AS FLOAT)")
def spot_streets(spark: SparkSession, d: str) -> DataFrame:
    return _at_spot(spark, d, bridge(spark, d)).select("street", "block").distinct()


@query(f"{_SPOT} SELECT min(m) AS first, count(DISTINCT m) FILTER (WHERE m < 60) AS before FROM facts f, s WHERE f.lat = s.lat AND f.lon = s.lon")
def spot_history(spark: SparkSession, d: str) -> DataFrame:
    at = _at_spot(spark, d, stored(spark, d, "points"))
    return at.agg(F.min("m").alias("first"), F.count_distinct(F.when(F.col("m") < NOW[0], F.col("m"))).alias("before"))


@query(f"{_SPOT} SELECT premise, count(*) AS n FROM facts f, s WHERE f.lat = s.lat AND f.lon = s.lon GROUP BY 1 ORDER BY n DESC, premise LIMIT 1")
def spot_premise(spark: SparkSession, d: str) -> DataFrame:
    at = _at_spot(spark, d, facts(spark, d).where("lt = 0").select(F.col("lat").cast("float").alias("lat"), F.col("lon").cast("float").alias("lon"), "premise"))
    return at.groupBy("premise").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "premise").limit(1)


@query(f"{WITH}, t AS (SELECT lat, lon, count(*) AS n FROM facts WHERE lt = 0 AND {NOW_SQL} AND {TYPES_SQL} GROUP BY 1, 2) SELECT n, count(*) AS places FROM t GROUP BY 1")
def place_totals(spark: SparkSession, d: str) -> DataFrame:
    points = stored(spark, d, "points").where(in_months(F.col("m"), NOW) & F.col("cat").isin(*TYPES))
    return cubes.place_totals(points)


@query(f"{_CIRCLE} SELECT cat, count(*) FILTER (WHERE {NOW_SQL}) AS now, count(*) FILTER (WHERE {BEFORE_SQL}) AS before FROM near WHERE {NOW_SQL} OR {BEFORE_SQL} GROUP BY 1")
def circle_change(spark: SparkSession, d: str) -> DataFrame:
    near = _near(spark, d)
    return cubes.now_and_before(near, ["cat"], NOW, BEFORE).na.fill(0, ["now", "before"])


@query(f"{_CIRCLE}, {BRIDGE} SELECT street, block, count(*) AS n FROM near f JOIN bridge b ON CAST(f.lat AS FLOAT) = b.lat AND CAST(f.lon AS FLOAT) = b.lon WHERE block >= 0 AND {NOW_SQL} GROUP BY 1, 2")
def circle_blocks(spark: SparkSession, d: str) -> DataFrame:
    near = _near(spark, d)
    return cubes.blocks_of(near, bridge(spark, d), in_months(F.col("m"), NOW))


@query(f"""{WITH}, {BRIDGE}, j AS (SELECT street, block, m FROM facts f JOIN bridge b ON CAST(f.lat AS FLOAT) = b.lat AND CAST(f.lon AS FLOAT) = b.lon WHERE lt = 0 AND pct = 7 AND block >= 0),
t AS (SELECT street, block, count(*) AS n FROM j WHERE {NOW_SQL} GROUP BY 1, 2 ORDER BY n DESC, street, block LIMIT 40)
SELECT street, block, n, (SELECT count(*) FROM j WHERE j.street = t.street AND j.block = t.block AND {BEFORE_SQL}) AS prior FROM t""")
def area_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The busiest blocks of a precinct, and what exactly those had before."""
    points, b = stored(spark, d, "points").where("pct = 7"), bridge(spark, d)
    top = cubes.blocks_of(points, b, in_months(F.col("m"), NOW)).orderBy(F.desc("n"), "street", "block").limit(40)
    before = cubes.blocks_of(points, b.join(F.broadcast(top.select("street", "block")), ["street", "block"], "left_semi"), in_months(F.col("m"), BEFORE))  # 40 rows
    return top.join(before.withColumnRenamed("n", "prior"), ["street", "block"], "left").na.fill(0, ["prior"])


@query(f"{WITH} SELECT m, cat, count(*) AS n, count(*) FILTER (WHERE lt = 0) AS mapped FROM facts GROUP BY 1, 2")
def city_series(spark: SparkSession, d: str) -> DataFrame:
    n, mapped = F.sum("n").cast("bigint"), F.sum(F.when(F.col("lt") == 0, F.col("n")).otherwise(0)).cast("bigint")
    return stored(spark, d, "areas").groupBy("m", "cat").agg(n.alias("n"), mapped.alias("mapped"))


@query(f"{WITH} SELECT cat, count(*) FILTER (WHERE lt = 0) AS drawn FROM facts GROUP BY 1")
def drawn_per_category(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "areas").groupBy("cat").agg(F.sum(F.when(F.col("lt") == 0, F.col("n")).otherwise(0)).cast("bigint").alias("drawn"))


@query(f"WITH {SPOTS} SELECT seg, CAST(e AS INT) AS k, {X_OF.format(k='k + e')} AS x, {Y_OF.format(k='k + e')} AS y FROM spots, (SELECT unnest([0, 1]) AS e)")
def street_geometry(spark: SparkSession, d: str) -> DataFrame:
    """The shape of each line, point by point, in units of 1e-5 degree."""
    points = lines(spark, d).select("seg", F.posexplode("points").alias("k", "p"))
    return points.select("seg", "k", grid.quantize(F.col("p.lon")).alias("x"), grid.quantize(F.col("p.lat")).alias("y"))


@query(f"WITH {SPOTS} SELECT CASE WHEN a = 5 THEN b ELSE a END AS other, {X_OF.format(k='k')} AS x, {Y_OF.format(k='k')} AS y FROM met WHERE a = 5 OR b = 5")
def street_corners(spark: SparkSession, d: str) -> DataFrame:
    """The corners of a street by its id, each with the other street."""
    pairs = spatial.corner_pairs(corners(spark, d)).where("a = 5 OR b = 5")
    return pairs.select(F.when(F.col("a") == 5, F.col("b")).otherwise(F.col("a")).alias("other"), grid.quantize(F.col("lon")).alias("x"), grid.quantize(F.col("lat")).alias("y"))


# Rules of the panels: what is compared with what, and what is shown.

COMPARED = comparison_of(Period("month_range", 40, 50), SPAN)  # the eleven months before


@query(f"{WITH} SELECT pct, count(*) FILTER (WHERE m BETWEEN 40 AND 50) AS now, count(*) FILTER (WHERE m BETWEEN 29 AND 39) AS before FROM facts WHERE m BETWEEN 29 AND 50 GROUP BY 1")
def comparison_change(spark: SparkSession, d: str) -> DataFrame:
    return cubes.now_and_before(stored(spark, d, "areas"), ["pct"], list(range(40, 51)), COMPARED).na.fill(0, ["now", "before"])


@query(f"{WITH}, n AS (SELECT pct, count(*) AS n FROM facts WHERE cat = 2 AND {NOW_SQL} GROUP BY 1) SELECT '2' AS type, '2000' AS years, CAST(i AS INT) AS p, round(q[i + 1], 3) AS v FROM (SELECT unnest(range(101)) AS i, (SELECT quantile_cont(CAST(n AS DOUBLE), list_transform(range(101), lambda k: k / 100.0)) FROM n) AS q)")
def fair_vector(spark: SparkSession, d: str) -> DataFrame:
    """The stored vector that a fair comparison of one type in one year uses."""
    kind, years = fair_column([2], [0, 1, 2, 3, 4], NOW, SPAN)
    n = cubes.counts(stored(spark, d, "areas"), ["pct"], NOW, [int(kind)])
    return n.agg(compare.percentile_vector(F.col("n")).alias("q")).select(F.lit(kind).alias("type"), F.lit(years).alias("years"), F.posexplode("q").alias("p", "v"))


@query(f"{WITH} SELECT pct, count(*) AS n, CAST({' + '.join(f'(count(*) >= {least})::INT' for least in report.GATES.values())} AS INT) AS parts FROM facts GROUP BY 1")
def parts_shown(spark: SparkSession, d: str) -> DataFrame:
    n = cubes.counts(stored(spark, d, "areas"), ["pct"])
    return n.withColumn("parts", F.size(report.parts_shown(F.col("n"))))


GROUPS = {"person": [0, 1], "property": [2], "other": [3, 4]}


@query(f"{WITH} SELECT CASE WHEN cat IN (0, 1) THEN 'person' WHEN cat = 2 THEN 'property' ELSE 'other' END AS \"group\", count(*) AS n FROM facts WHERE pct = 7 AND {NOW_SQL} GROUP BY 1")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return report.group_split(cubes.counts(stored(spark, d, "areas"), ["cat"], NOW, where=F.col("pct") == 7), "cat", GROUPS)


@query(f"{WITH}, t AS (SELECT loc_id, list_sort(list(DISTINCT cat)) AS t FROM facts GROUP BY 1) SELECT loc_id, array_to_string(t, ',') AS types, CASE WHEN t = [0, 1, 2, 3, 4] THEN 'all' WHEN len(t) = 1 THEN 'type:' || t[1] WHEN t = [0, 1] THEN 'group:person' WHEN t = [3, 4] THEN 'group:other' END AS resolved FROM t")
def resolved_types(spark: SparkSession, d: str) -> DataFrame:
    """What the types that each place has are called together."""
    types = stored(spark, d, "places").groupBy("loc_id").agg(F.array_sort(F.collect_set("cat")).alias("t"))
    return types.select("loc_id", F.array_join(F.col("t").cast("array<string>"), ",").alias("types"), resolved(F.col("t"), GROUPS).alias("resolved"))


@query(f"{_BREAKS}, b AS (SELECT [{', '.join(f'v[CAST(least(c - 1, floor({p} * c)) + 1 AS BIGINT)]' for p in compare.HEX_SHARES)}] AS b FROM v) SELECT CAST(i AS INT) AS class, CASE WHEN i = 5 THEN (b[5] + 1) || '+' WHEN (CASE WHEN i = 0 THEN 1 ELSE b[i] + 1 END) = b[i + 1] THEN b[i + 1] || '' ELSE (CASE WHEN i = 0 THEN 1 ELSE b[i] + 1 END) || '-' || b[i + 1] END AS label FROM b, (SELECT unnest(range(6)) AS i)")
def class_range_labels(spark: SparkSession, d: str) -> DataFrame:
    breaks = list(_raw_breaks(cubes.counts(stored(spark, d, "hex"), ["q", "r"])).first())  # five numbers
    return spark.createDataFrame(list(enumerate(compare.class_labels(breaks))), "class int, label string")


@query(f"{WITH}, y AS (SELECT CAST(m // 12 + 1995 AS INT) AS year, count(*) FILTER (WHERE cat = 2) AS n, count(*) AS total FROM facts WHERE loc_id % 50 = 3 GROUP BY 1), p AS (SELECT year, round(100.0 * n / nullif(total, 0), 4) AS pct FROM y) SELECT min(year) AS first, arg_min(pct, year) AS \"then\", max(year) AS last, arg_max(pct, year) AS now FROM p WHERE pct IS NOT NULL")
def share_span(spark: SparkSession, d: str) -> DataFrame:
    yearly = stored(spark, d, "places").where("loc_id % 50 = 3").groupBy(F.expr("CAST(m DIV 12 + 1995 AS INT)").alias("year"), "cat").agg(F.sum("n").alias("n"))
    return report.known_years(report.type_share(yearly, F.col("cat") == 2), "pct")


_AREAS = _PAIRS.format(key="pct") + """, pop AS (SELECT c_nationkey AS pct, count(*) * 20 AS residents FROM customer GROUP BY 1),
r AS (SELECT k AS pct, residents, now, before, residents >= 100 AS rated, CASE WHEN residents >= 100 THEN now * 1000.0 / residents / 1.0 END AS rate, CASE WHEN residents >= 100 THEN before * 1000.0 / residents / 1.0 END AS rate_before FROM d JOIN pop ON d.k = pop.pct WHERE now + before > 0)"""


def _area_rates(spark: SparkSession, d: str) -> DataFrame:
    pop = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("pct")).agg((F.count("*") * 20).alias("residents"))
    pairs = cubes.now_and_before(stored(spark, d, "areas"), ["pct"], NOW, BEFORE)
    return report.area_rates(pairs.join(pop, "pct"), 1.0, 1.0, 100)


@query(f"{_AREAS} SELECT pct, residents, now, before, rated, round(rate, 6) AS rate, round(rate_before, 6) AS rate_before FROM r")
def area_rates(spark: SparkSession, d: str) -> DataFrame:
    return _area_rates(spark, d).withColumns({"rate": F.round("rate", 6), "rate_before": F.round("rate_before", 6)})


@query(f"""{_AREAS}, b AS (SELECT pct, rate / rate_before AS t FROM r WHERE rated AND now >= 5 AND before >= 5)
SELECT (SELECT pct FROM b ORDER BY t DESC, pct LIMIT 1) AS rise, (SELECT round(100.0 * (t - 1), 4) FROM b ORDER BY t DESC, pct LIMIT 1) AS rise_pct, (SELECT pct FROM b ORDER BY t, pct LIMIT 1) AS "drop", (SELECT round(100.0 * (t - 1), 4) FROM b ORDER BY t, pct LIMIT 1) AS drop_pct, (SELECT count(*) FROM r WHERE NOT rated) AS unrated""")
def area_changes(spark: SparkSession, d: str) -> DataFrame:
    return report.area_changes(_area_rates(spark, d), "pct", 5)


@query("SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE)::VARCHAR AS day FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01'")
def in_window(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a half-open range of days; the range is tested on the column, so it reaches the scan."""
    o = table(spark, d, "orders")
    return o.where(in_dates(F.col("o_orderdate"), "1996-01-01", "1998-01-01")).select("o_orderkey", "o_custkey", F.to_date("o_orderdate").cast("string").alias("day"))


@query(f"{HEX} SELECT * FROM (SELECT 'hex' AS cube, count(*) AS n FROM hex UNION ALL SELECT 'points', count(*) FROM hex UNION ALL SELECT 'areas', count(*) FROM facts UNION ALL SELECT 'blocks', count(*) FROM facts UNION ALL SELECT 'places', count(*) FROM facts)")
def accounting(spark: SparkSession, d: str) -> DataFrame:
    """What every cube adds up to: the facts, or those that have a place."""
    return cubes.totals(all_stored(spark, d))

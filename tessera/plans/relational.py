"""Queries over cleaning, auditing, dictionaries and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import compare
from tessera.operators import audit, clean, cubes, reconcile, report
from tessera.operators.quantiles import quantiles
from tessera.plans.fixtures import WITH, facts, locs, table
from tessera.plans.registry import query
from tessera.sources import files, paths, store


@query("""SELECT o_orderkey, nullif(nullif(trim(CASE o_orderkey % 4 WHEN 0 THEN '(null)' WHEN 1 THEN '  ' WHEN 2 THEN ' ' || o_orderpriority ELSE o_orderstatus END), '(null)'), '') AS v FROM orders""")
def null_normalize(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, "(null)").when(k == 1, "  ").when(k == 2, F.concat(F.lit(" "), "o_orderpriority")).otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", clean.null_normalize(raw).alias("v"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN ' ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' '
  WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.6' WHEN 2 THEN 'n/a' ELSE '' END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(round(try_cast(v AS DOUBLE)) AS INT) AS n FROM r""")
def lenient_cast(spark: SparkSession, d: str) -> DataFrame:
    q, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 4
    v = F.when(k == 0, F.concat(F.lit(" "), q, F.lit(" "))).when(k == 1, F.concat(q, F.lit(".6"))).when(k == 2, "n/a").otherwise("")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", clean.lenient_int(v).alias("n"))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE 'soon' END AS v FROM orders)
SELECT o_orderkey, coalesce(try_cast(replace(v, 'T', ' ') AS TIMESTAMP), try_strptime(v, '%m/%d/%Y')) AS ts FROM r""")
def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    v = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", clean.lenient_timestamp(v).alias("ts"))


@query("""SELECT event_id, coalesce(try_cast(substr(CASE event_id % 5 WHEN 0 THEN 'x' ELSE strftime(ts, '%H:%M:%S') END, 1, 2) AS TINYINT), -1) AS hour,
  CAST(isodow(ts) - 1 AS INT) AS dow, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS day FROM events""")
def event_time_parts(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.date_format("ts", "HH:mm:ss"))
    return table(spark, d, "events").select("event_id", clean.hour_of(text).alias("hour"), F.weekday("ts").alias("dow"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"))


@query("""SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts NULLS LAST, event_id) AS rn FROM events) WHERE rn = 1""")
def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return clean.first_per_key(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts")], ["event_id"])


@query(f"""{WITH}, raw AS (SELECT id, cat, l.loc_id, l.lat, l.lon FROM facts f JOIN locs l ON f.loc_id = l.loc_id),
wp AS (SELECT DISTINCT lat, lon FROM raw WHERE cat = 4 AND loc_id % 7 = 0),
t AS (SELECT id, CASE WHEN (cat = 4 AND loc_id % 7 = 0) OR wp.lat IS NOT NULL THEN 'precinct_only' WHEN raw.lat BETWEEN 40.49 AND 40.92 AND raw.lon BETWEEN -74.27 AND -73.80 THEN 'point' ELSE 'none' END AS location_type, raw.lat, raw.lon
  FROM raw LEFT JOIN wp ON raw.lat = wp.lat AND raw.lon = wp.lon)
SELECT id, location_type, CASE WHEN location_type = 'point' THEN lat END AS lat, CASE WHEN location_type = 'point' THEN lon END AS lon FROM t""")
def classify_location(spark: SparkSession, d: str) -> DataFrame:
    raw = facts(spark, d).select("id", "cat", "loc_id").join(locs(spark, d).select("loc_id", "lat", "lon"), "loc_id")
    code = F.when((F.col("cat") == 4) & (F.col("loc_id") % 7 == 0), clean.WITHHELD_CODES[0])
    hidden = clean.withheld_points(raw, code, F.col("lat"), F.col("lon"))
    return clean.classify_location(raw, code.isin(*clean.WITHHELD_CODES), "lat", "lon", hidden, (40.49, 40.92, -74.27, -73.80)).select("id", "location_type", "lat", "lon")


@query("""SELECT p_brand, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def dict_join_inner(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"), "l_quantity")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"))
    joined = clean.dictionary_join(lines, [(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey"), (table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey"), (nations, "s_nationkey")])
    return joined.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("qty"))


@query("""SELECT c_custkey, CAST(coalesce(k.code, -1) AS INT) AS code FROM customer LEFT JOIN (SELECT n_nationkey, CAST(n_regionkey * 10 AS INT) AS code FROM nation WHERE n_regionkey < 3) k ON c_nationkey = k.n_nationkey""")
def dict_join_left_default(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") * 10).alias("code"))
    return clean.left_default(table(spark, d, "customer"), codes, "c_nationkey", "code").select("c_custkey", "code")


@query("""SELECT DISTINCT o_custkey AS code FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal >= 0)""")
def anti_guard(spark: SparkSession, d: str) -> DataFrame:
    return clean.anti_guard(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").where("c_acctbal >= 0"), "c_custkey")


@query("""SELECT o_orderpriority, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM orders GROUP BY 1""")
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    return audit.share_of_total(table(spark, d, "orders"), "o_orderpriority")


@query("""SELECT round(100.0 * avg(CAST(l_discount > 0.05 AS INT)), 2) AS discounted, round(100.0 * avg(CAST(l_returnflag LIKE 'R%' AS INT)), 2) AS returned,
  round(100.0 * avg(CAST(l_quantity BETWEEN 10 AND 20 AS INT)), 2) AS mid, round(100.0 * avg(CAST(nullif(l_linestatus, 'O') = 'F' AS INT)), 2) AS known_f FROM lineitem""")
def flag_pct(spark: SparkSession, d: str) -> DataFrame:
    p = audit.flag_percent
    return table(spark, d, "lineitem").agg(
        p(F.col("l_discount") > 0.05).alias("discounted"), p(F.col("l_returnflag").like("R%")).alias("returned"), p(F.col("l_quantity").between(10, 20)).alias("mid"),
        p(F.nullif(F.col("l_linestatus"), F.lit("O")) == "F").alias("known_f"),
    )


_PROFILED = ("event_id", "user_id", "event_type", "value", "props")


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(100.0 * avg(CAST({c} IS NULL AS INT)), 3) AS null_pct, coalesce(round(100.0 * avg(CAST(trim(CAST({c} AS VARCHAR)) IN ('(null)', 'UNKNOWN', '') AS INT)), 3), 0.0) AS placeholder_pct,
  count(DISTINCT {c}) AS n_distinct FROM events""" for c in _PROFILED))  # fmt: skip
def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    return audit.profile_columns(table(spark, d, "events").select(*_PROFILED))


@query("""SELECT o_orderstatus, count(*) FILTER (WHERE year(o_orderdate) = 1995) AS "1995", count(*) FILTER (WHERE year(o_orderdate) = 1998) AS "1998", count(*) FILTER (WHERE year(o_orderdate) = 2001) AS "2001" FROM orders GROUP BY 1""")
def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.pivot_counts(table(spark, d, "orders").select("o_orderstatus", F.year("o_orderdate").alias("y")), "o_orderstatus", "y", [1995, 1998, 2001])


@query("""SELECT c_nationkey, mode(c_mktsegment ORDER BY c_mktsegment) AS mode FROM customer GROUP BY 1""")
def mode_per_group(spark: SparkSession, d: str) -> DataFrame:
    return audit.mode_per_group(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment")


@query(f"""{WITH}, s AS (SELECT lat, lon, count(*) AS k FROM facts WHERE lt = 0 GROUP BY 1, 2)
SELECT count(*) AS stacks, max(k) AS largest, round(100.0 * sum(k) FILTER (WHERE k >= 2) / sum(k), 2) AS pct_in_2, round(100.0 * coalesce(sum(k) FILTER (WHERE k >= 16), 0) / sum(k), 2) AS pct_in_16,
  round(100.0 * coalesce(sum(k) FILTER (WHERE k >= 100), 0) / sum(k), 2) AS pct_in_100 FROM s""")
def stack_sizes(spark: SparkSession, d: str) -> DataFrame:
    return audit.stack_sizes(facts(spark, d).where("lt = 0"), [F.col("lat"), F.col("lon")])


@query(f"""{WITH}, p AS (SELECT lat, lon, premise, count(*) AS c FROM facts WHERE lt = 0 GROUP BY 1, 2, 3),
r AS (SELECT lat, lon, premise, c, sum(c) OVER (PARTITION BY lat, lon) AS n, row_number() OVER (PARTITION BY lat, lon ORDER BY c DESC, premise) AS rn FROM p)
SELECT lat, lon, CAST(n AS BIGINT) AS n, premise AS main, round(100.0 * c / n, 2) AS main_pct FROM r WHERE rn = 1 ORDER BY n DESC, lat, lon LIMIT 40""")
def largest_stacks(spark: SparkSession, d: str) -> DataFrame:
    return audit.largest_stacks(facts(spark, d).where("lt = 0"), ["lat", "lon"], "premise", 40)


@query("""WITH x AS (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT count(d) AS n, round(quantile_cont(d, 0.5), 4) AS p50, round(quantile_cont(d, 0.9), 4) AS p90, round(quantile_cont(d, 0.99), 4) AS p99 FROM x""")
def lag_quantiles(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return audit.lag_quantiles(both, F.to_date("o_orderdate"), F.to_date("l_shipdate"))


@query("""SELECT p_size, count(DISTINCT p_brand) AS labels, string_agg(DISTINCT p_brand, ' / ' ORDER BY p_brand) AS all_labels FROM part GROUP BY 1 HAVING labels >= 2""")
def labels_per_code(spark: SparkSession, d: str) -> DataFrame:
    return audit.labels_per_code(table(spark, d, "part"), "p_size", "p_brand")


@query(f"""{WITH} SELECT count(DISTINCT (lat, lon)) AS points, count(DISTINCT lat) AS lats, count(DISTINCT lon) AS lons FROM locs""")
def distinct_points(spark: SparkSession, d: str) -> DataFrame:
    return audit.distinct_places(locs(spark, d), "lat", "lon")


@query("""SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(DISTINCT o_custkey) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent_customers, CAST(sum(o_orderkey) FILTER (WHERE o_totalprice < 0) AS BIGINT) AS none FROM orders GROUP BY 1""")
def filtered_aggs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.count_if(F.col("o_totalprice") > 100000).alias("big"), F.count_distinct(F.when(F.col("o_orderpriority").like("1%"), F.col("o_custkey"))).alias("urgent_customers"),
        F.sum(F.when(F.col("o_totalprice") < 0, F.col("o_orderkey"))).alias("none"),
    )


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 97 <> 0)
SELECT 'left' AS side, o_orderkey, o_orderstatus, count(*) AS times FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL
UNION ALL SELECT 'right', o_orderkey, o_orderstatus, count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL""")
def multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    b = a.where("o_orderkey % 97 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 100 == 0, "X").otherwise(F.col("o_orderstatus")))
    return reconcile.multiset_diff(a, b)


_RECONCILE = """a AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2),
b AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, count(*) AS n FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY 1, 2),
c AS (SELECT coalesce(a.p, b.p) AS p, CAST(coalesce(a.y, b.y) AS INT) AS y, a.n AS ours, b.n AS theirs, round(100.0 * (a.n - b.n) / b.n, 2) AS pct_diff FROM a FULL JOIN b ON a.p = b.p AND a.y = b.y)"""


def _compared(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    by = lambda df: df.groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return reconcile.compare_totals(by(o), by(o.where("o_orderkey % 50 <> 0")), ["p", "y"])


@query(f"WITH {_RECONCILE} SELECT p, y, ours, theirs, pct_diff FROM c")
def reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d)


@query(f"""WITH {_RECONCILE} SELECT count(*) AS cells, round(100.0 * avg(CAST(abs(pct_diff) <= 1 AS INT)), 2) AS within_1, round(100.0 * avg(CAST(abs(pct_diff) <= 2 AS INT)), 2) AS within_2,
  round(100.0 * avg(CAST(abs(pct_diff) <= 5 AS INT)), 2) AS within_5, max(abs(pct_diff)) AS worst FROM c WHERE theirs >= 20""")
def validation_score(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.score(_compared(spark, d), 20)


_PREFIXES = {"LARGE": 1, "LARGE P": 2, "SMALL": 3, "STANDARD": 4, "ECONOMY A": 5}


@query("""SELECT p_type, CAST(CASE WHEN upper(p_type) LIKE 'ECONOMY A%' THEN 5 WHEN upper(p_type) LIKE 'STANDARD%' THEN 4 WHEN upper(p_type) LIKE 'LARGE P%' THEN 2 WHEN upper(p_type) LIKE 'LARGE%' THEN 1 WHEN upper(p_type) LIKE 'SMALL%' THEN 3 END AS INT) AS code, count(*) AS n FROM part GROUP BY 1, 2""")
def prefix_classifier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("code", reconcile.by_prefix(F.col("p_type"), _PREFIXES)).groupBy("p_type", "code").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT c_mktsegment AS k, min(c_custkey) AS seen FROM customer GROUP BY 1) SELECT k AS c_mktsegment, row_number() OVER (ORDER BY seen, k) - 1 AS id FROM s""")
def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    return clean.dense_ids(table(spark, d, "customer"), "c_mktsegment", "c_custkey")


@query("""WITH o AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, o_orderstatus AS s, o_orderpriority AS p FROM orders)
SELECT 'rows' AS what, 'all' AS value, count(*) AS n FROM o UNION ALL SELECT 'year', y, count(*) FROM o GROUP BY y UNION ALL SELECT 'status', s, count(*) FROM o GROUP BY s UNION ALL SELECT 'priority', p, count(*) FROM o GROUP BY p""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.run_summary(table(spark, d, "orders"), {"year": F.year("o_orderdate"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")})


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0""")
def union_all_kinds(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.where("o_orderkey % 2 = 0").unionByName(o.where("o_orderkey % 3 = 0"))


@query(f"{WITH} SELECT DISTINCT CAST(floor((lat - 40.5) * 64) AS INT) AS q, CAST(floor((lon + 74.25) * 64) AS INT) AS r FROM locs")
def distinct_cells(spark: SparkSession, d: str) -> DataFrame:
    return locs(spark, d).select(F.floor((F.col("lat") - 40.5) * 64).cast("int").alias("q"), F.floor((F.col("lon") + 74.25) * 64).cast("int").alias("r")).distinct()


@query(f"""{WITH}, a AS (SELECT id, pct, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN pct + 1 ELSE pct END AS other FROM facts)
SELECT count(*) FILTER (WHERE pct = other) AS same, count(*) FILTER (WHERE pct <> other) AS different, count(*) FILTER (WHERE pct IS NULL OR other IS NULL) AS unknown,
  round(100.0 * count(*) FILTER (WHERE pct = other) / count(*) FILTER (WHERE pct = other OR pct <> other), 2) AS pct_same FROM a""")
def field_agreement(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    other = F.when(k % 11 == 0, None).when(k % 13 == 0, F.col("pct") + 1).otherwise(F.col("pct"))
    return reconcile.agreement(facts(spark, d), F.col("pct"), other)


@query("""WITH n AS (SELECT o_custkey AS k, count(*) AS now, count(*) FILTER (WHERE o_orderstatus = 'O') * 2 AS before FROM orders GROUP BY 1), p AS (SELECT *, 100.0 * (now - before) / nullif(before, 0) AS pct FROM n),
c AS (SELECT *, CASE WHEN now < 5 OR before < 5 THEN 'counts' WHEN abs(pct) < 1 THEN 'same' WHEN pct > 100 THEN 'large' ELSE 'change' END AS kind FROM p)
SELECT k, now, before, kind, CASE WHEN kind <> 'counts' THEN CASE WHEN abs(pct) >= 10 THEN round(pct, 0) ELSE round(pct, 1) END END AS pct FROM c""")
def guarded_change(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("now"), (F.count_if(F.col("o_orderstatus") == "O") * 2).alias("before"))
    return n.withColumn("_g", compare.guarded_change(F.col("now"), F.col("before"), least=5, most=100.0)).select("k", "now", "before", "_g.kind", "_g.pct")


@query(f"""{WITH} SELECT pct, CAST(report_date AS VARCHAR) AS day, id, row_number() OVER (PARTITION BY pct, report_date ORDER BY id) - 1 AS k FROM facts""")
def stack_index(spark: SparkSession, d: str) -> DataFrame:
    return report.stack_index(facts(spark, d), ["pct"], "report_date", ["id"]).select("pct", F.col("report_date").cast("string").alias("day"), "id", F.col("k").cast("bigint").alias("k"))


@query(f"""{WITH}, b AS (SELECT DISTINCT CAST(lat AS FLOAT) AS lat, CAST(lon AS FLOAT) AS lon, s.street FROM locs, (SELECT unnest([0, 1, 2]) AS street) s WHERE (loc_id + s.street) % 3 < 2)
SELECT b.street, f.cat, count(*) AS n FROM facts f JOIN b ON CAST(f.lat AS FLOAT) = b.lat AND CAST(f.lon AS FLOAT) = b.lon GROUP BY 1, 2""")
def fanout_join_float(spark: SparkSession, d: str) -> DataFrame:
    bridge = locs(spark, d).withColumn("street", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where((F.col("loc_id") + F.col("street")) % 3 < 2)
    bridge = bridge.select(F.col("lat").cast("float").alias("lat"), F.col("lon").cast("float").alias("lon"), "street").distinct()
    return cubes.fan_out(facts(spark, d).where("lat IS NOT NULL"), bridge).groupBy("street", "cat").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT DISTINCT c_custkey // 3 % 400 AS code, c_nationkey % 5 AS boro, c_name AS name FROM customer), g AS (SELECT code, boro, list_sort(list(name)) AS ns FROM r GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 4)
SELECT code, boro, name, array_to_string(list_filter(ns, lambda x: x <> name), ' | ') AS aliases FROM (SELECT code, boro, ns, unnest(ns) AS name FROM g)""")
def alias_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select((F.expr("c_custkey DIV 3") % 400).alias("code"), (F.col("c_nationkey") % 5).alias("boro"), F.col("c_name").alias("name"))
    return clean.alias_groups(rows, ["code", "boro"], "name")


@query("SELECT CAST(COLUMNS(*) AS VARCHAR) FROM (SELECT * FROM nation UNION ALL BY NAME SELECT * FROM region)")
def raw_union(spark: SparkSession, d: str) -> DataFrame:
    """Files with different columns, by name, all as text."""
    return files.read_raw(spark, f"{d}/nation.parquet", f"{d}/region.parquet")


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS n_regionkey FROM nation")
def dictionary(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary written as CSV and read back with types, blanks as null."""
    path = paths.fresh_path(spark, "dictionary")
    files.write_text_table(table(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("n_regionkey")), path)
    return files.read_dictionary(spark, path, "n_nationkey long, n_name string, n_regionkey long")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def dictionary_as_text(spark: SparkSession, d: str) -> DataFrame:
    path = paths.fresh_path(spark, "dictionary")
    files.write_text_table(table(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return files.read_dictionary(spark, path)


@query("SELECT * FROM region")
def rewritten(spark: SparkSession, d: str) -> DataFrame:
    """A table that was written anew, verified and put in the old one's place."""
    path = paths.fresh_path(spark, "region")
    table(spark, d, "region").write.parquet(path)
    if not files.rewrite_verified(spark, path, f"{path}.new", replace=True):
        raise ValueError("the rewritten table differs")
    return files.read_table(spark, path)


_REGIONS = "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey"


@query(_REGIONS)
def answers_kept(spark: SparkSession, d: str) -> DataFrame:
    """An answer that is computed once for a snapshot of its table."""
    files.read_table(spark, f"{d}/nation.parquet", "nation")
    answers = store.Answers(spark, f"{paths.own_dir(spark)}/answers", paths.snapshot(spark, f"{d}/nation.parquet"))
    return answers.get(_REGIONS)


@query(_REGIONS)
def answer_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same through JSON objects, as a thin service hands them on."""
    files.read_table(spark, f"{d}/nation.parquet", "nation")
    objects = files.as_json(spark.sql(_REGIONS))
    return objects.select(F.from_json("value", "n_regionkey int, n long").alias("x")).select("x.*")


@query("SELECT c_mktsegment, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS id FROM customer GROUP BY 1")
def premise_codes(spark: SparkSession, d: str) -> DataFrame:
    return clean.frequency_ids(table(spark, d, "customer"), "c_mktsegment")


@query("""SELECT o_orderkey, format('{:,}', CAST(round(o_totalprice * 10, 0) AS BIGINT)) AS grouped, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 40 > 20 THEN printf('+%.1f%%', (o_orderkey % 40 - 20) / 1.0) WHEN o_orderkey % 40 < 20 THEN printf('−%.1f%%', abs(o_orderkey % 40 - 20) / 1.0) ELSE '0.0%' END AS change,
  CASE o_orderkey % 3 WHEN 0 THEN 'Residence, apt. house' WHEN 1 THEN 'Bar / night club' ELSE 'Not recorded' END AS premise FROM orders""")
def number_formats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    pct = F.when(k % 4 != 0, (k % 40 - 20).cast("double"))
    label = F.when(k % 3 == 0, "RESIDENCE - APT. HOUSE").when(k % 3 == 1, "BAR/NIGHT CLUB").otherwise("")
    return table(spark, d, "orders").select("o_orderkey", compare.grouped_number(F.col("o_totalprice") * 10).alias("grouped"), compare.signed_change(pct).alias("change"), compare.sentence_case(label).alias("premise"))


@query(f"WITH {_RECONCILE} SELECT p, y, ours, theirs, pct_diff FROM c WHERE theirs >= 20 AND pct_diff IS NOT NULL AND NOT (p LIKE '1%' AND y < 1997) ORDER BY abs(pct_diff) DESC, p, y LIMIT 15")
def validation_worst(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.worst(_compared(spark, d), ["p", "y"], 20, 15, F.col("p").like("1%") & (F.col("y") < 1997))


_OFFENSES = {"MURDER": 0, "RAPE": 1, "ROBBERY": 2, "GRAND LARCENY": 3, "GRAND LARCENY OF MOTOR": 4}


@query(f"{WITH} SELECT CAST(boro AS VARCHAR) AS unit, CAST(cat AS VARCHAR) AS code, CAST(m // 12 + 1995 AS INT) AS year, CAST(count(*) AS DOUBLE) AS n FROM facts GROUP BY 1, 2, 3")
def published_sheet(spark: SparkSession, d: str) -> DataFrame:
    """A sheet of counts as agencies publish them (units named once, years above the columns), written and parsed."""
    labels = F.element_at(F.array(*[F.lit(f" {x.lower()}  felonies") for x in _OFFENSES]), F.col("cat") + 1)
    n = facts(spark, d).groupBy("boro", "cat", F.expr("m DIV 12 + 1995").alias("year")).agg(F.count("*").alias("n"))
    wide = n.groupBy("boro", "cat").pivot("year", list(range(1995, 2002))).agg(F.first("n"))
    first = F.row_number().over(Window.partitionBy("boro").orderBy("cat")) == 1  # a row for each type
    cells = [F.when(first, F.col("boro").cast("string")).otherwise(""), labels, *[F.coalesce(F.col(str(y)).cast("string"), F.lit("")) for y in range(1995, 2002)]]
    head = wide.select("boro").distinct().select("boro", F.lit(-1).alias("cat"), F.lit("PCT,OFFENSE," + ",".join(map(str, range(1995, 2002)))).alias("value"))
    sheets = head.unionByName(wide.select("boro", "cat", F.concat_ws(",", *cells).alias("value")))  # a sheet for each borough
    path = paths.fresh_path(spark, "sheets")
    sheets.repartition("boro").sortWithinPartitions("boro", "cat").drop("cat").write.partitionBy("boro").text(path)
    return files.read_sheets(spark, path, "PCT", _OFFENSES, range(1995, 2002), unit=True)


@query("SELECT l_returnflag, l_linestatus, CAST(round(p * 100, 0) AS INT) AS p, count(*) AS n, round(quantile_cont(l_extendedprice, p), 4) AS v FROM lineitem, (SELECT unnest([0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]) AS p) GROUP BY l_returnflag, l_linestatus, p".replace("quantile_cont(l_extendedprice, p)", "list_extract(quantile_cont(l_extendedprice, [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]), list_position([0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0], p))"))
def price_quantiles(spark: SparkSession, d: str) -> DataFrame:
    found = quantiles(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice"), (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0))
    return found.select("l_returnflag", "l_linestatus", F.rint(F.col("p") * 100).cast("int").alias("p"), "n", F.round("v", 4).alias("v"))


_CHANGED = "c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 997 = 5 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_shipdate FROM lineitem WHERE NOT (l_orderkey % 1009 = 7 AND l_linenumber = 1))"


@query(f"WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem), {_CHANGED} SELECT 'left' AS side, *, count(*) AS times FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM c) GROUP BY ALL UNION ALL SELECT 'right', *, count(*) FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM a) GROUP BY ALL")
def rows_changed(spark: SparkSession, d: str) -> DataFrame:
    """What a table lost and got in a rewrite, found by its digests."""
    k = F.col("l_orderkey")
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    c = a.where(~((k % 1009 == 7) & (F.col("l_linenumber") == 1))).withColumn("l_quantity", F.when(k % 997 == 5, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return reconcile.differing_rows(a, c)


@query(f"{WITH} SELECT '| ' || pct || ' | ' || format('{{:,}}', count(*) * 1000) || ' | ' || min(premise) || ' |' AS value FROM facts GROUP BY pct")
def markdown_rows(spark: SparkSession, d: str) -> DataFrame:
    """Totals of precincts as lines of a report in Markdown."""
    totals = facts(spark, d).groupBy("pct").agg((F.count("*") * 1000).alias("n"), F.min("premise").alias("premise"))
    return files.markdown_lines(totals)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders")
def text_table(spark: SparkSession, d: str) -> DataFrame:
    """A long table written as CSV, a file for each partition, and read back."""
    path = paths.fresh_path(spark, "text")
    files.write_text_table(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), path, one_file=False)
    return files.read_dictionary(spark, path)

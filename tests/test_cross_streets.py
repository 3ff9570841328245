"""Streets at a block's ends: against brute force, on a street of very many corners, and where places are taken again."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.plans.queries import ORACLES, QUERIES
from tests.test_queries import rows


@pytest.mark.parametrize("reach", [0, 1, 6, 25])
def test_ends_meet_all_corners_in_reach(spark, reach):
    rng = random.Random(reach)
    at = lambda: (rng.randint(-90, 90), rng.randint(-90, 90))
    corners = [(a, a + rng.randint(1, 2), *at()) for a in (rng.randint(0, 3) for _ in range(300))]
    ends = [(rng.randint(0, 5), *at()) for _ in range(150)] + [(a, x, y) for a, _, x, y in corners[:50]] + [(None, 1, 1), (1, None, 1)]
    either = [(a, b, x, y) for a, b, x, y in corners] + [(b, a, x, y) for a, b, x, y in corners]
    want = {(s, x, y, b) for s, x, y in ends if x is not None for a, b, cx, cy in either if a == s and (x - cx) ** 2 + (y - cy) ** 2 <= reach**2}
    got = search.cross_streets(spark.createDataFrame(ends, "street int, x int, y int"), spark.createDataFrame(corners, "a int, b int, x int, y int"), reach).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_street_of_many_corners_is_no_hot_key(spark):
    """200,000 corners and ends of one street: by street alone they would meet in 80 billion pairs."""
    n = F.col("id").cast("int")
    corners = spark.range(200_000).select((n % 1).alias("a"), (n % 7 + 2).alias("b"), (n % 500 * 20).alias("x"), (F.floor(n / 500) * 20).cast("int").alias("y"))
    found = search.cross_streets(corners.select(F.col("a").alias("street"), F.col("x") + 4, F.col("y") - 4).toDF("street", "x", "y"), corners)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_i#" in plan.split("SortMergeJoin ", 1)[1].split("]", 1)[0] and "Broadcast" not in plan
    assert found.count() == 200_000


def test_places_that_are_taken_again(spark, tmp_path):
    """Customers far apart share a place; SQL has them meet by k, not by place."""
    con = duckdb.connect()
    con.sql("CREATE VIEW customer AS SELECT CAST(t * 1048576 + i AS BIGINT) AS c_custkey, CAST((i * 5 + t * 3 + i // 4) % 11 AS INT) AS c_nationkey FROM range(40) a(i), range(3) b(t)")
    con.sql(f"COPY customer TO '{tmp_path}/customer.parquet'")
    got, want = QUERIES["cross_streets"](spark, str(tmp_path)), con.sql(ORACLES["cross_streets"])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())

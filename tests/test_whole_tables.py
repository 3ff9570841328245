"""Queries read their whole tables: the same rows as their SQL on tables larger than those of the other tests."""

from __future__ import annotations

import duckdb
import pytest

from tessera.plans.queries import ORACLES, QUERIES
from tests.test_queries import rows


@pytest.mark.parametrize(
    ("name", "sf", "tables"),
    [("roadbed_weight", "sf0.1", ["supplier"]), ("point_along_line", "sf0.01", ["customer"]), ("hex_by_type", "sf0.01", ["customer", "nation", "orders"]), ("area_blocks", "sf0.01", ["customer", "nation", "orders"])],
)
def test_query_is_whole(spark, name, sf, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, f"/root/testdata/{sf}"), con.sql(ORACLES[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_no_sql_cuts_its_tables():
    assert not [n for n, sql in ORACLES.items() if "left(text" in sql or "_suppkey <=" in sql or "_custkey <=" in sql or "% 10 = 0 GROUP" in sql]

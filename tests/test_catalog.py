"""Every registered SPARQL query against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from tessera import catalog

FOLDER = os.environ.get("TESSERA_TABLES", "/root/testdata/sf0.001")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    try:
        return f"{float(v):.9g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    rel = duck.sql(catalog.oracles()[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_filter_reaches_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # or the plan's text leaves out some filters
    plan = catalog.queries()["bgp_star_group"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(l_shipdate" in plan
    assert plan.count("Exchange") == 1
    assert "l_partkey" not in plan

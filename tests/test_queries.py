"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tessel.plans import registry


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def close(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return abs(a - b) <= 2e-6 * max(1.0, abs(a), abs(b))
    return a == b


def ordered(rows):
    return sorted(rows, key=lambda r: tuple("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_its_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    at = [names.index(c) for c in sorted(names)]
    want = ordered(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    have = ordered(tuple(plain(v) for v in r) for r in got.select(*sorted(names)).collect())
    assert len(have) == len(want)
    assert all(all(map(close, a, b)) for a, b in zip(have, want, strict=True))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rankings_by_sums_that_differ_by_rounding(spark, tmp_path):
    """0.1 + 0.2 + 0.3 is more than 0.6 if added up in this order, and not if the last two come first."""
    path = str(tmp_path / "events.parquet")
    rows = lambda x: spark.createDataFrame(x, "event_id long, user_id long, event_type string, value double").coalesce(1)
    rows([(0, u, "z", 0.1) for u in range(9)]).write.parquet(path)
    rows([(1 + k, u, "z", v) for u in range(9) for k, v in enumerate((0.2, 0.3))] + [(3, u, "c", 0.6) for u in range(9)] + [(4, u, "c", None) for u in range(9)]).write.mode("append").parquet(path)
    rows([(5, u, "far", 7.0) for u in range(9)]).write.mode("append").parquet(path)
    got = {r.event_type: r.score for r in registry.QUERIES["borda"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT * FROM read_parquet('{path}/*.parquet') ORDER BY event_id")
    assert got == dict(con.execute(registry.ORACLE_SQL["borda"]).fetchall()) == {"far": 18, "z": 9, "c": 0}

"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    if not Path(DIR).exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for path in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return None if math.isnan(value) else round(float(value), 6)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "metric_name"


def test_networks_of_more_users_than_two_bytes_count(spark, duck, tmp_path):
    # 65,536 users fill 10.0.0.0/16; the last of these stand beyond 10.0.0.0/8
    shifts = (0, 90_000, 300_000, 1 << 24, 3_000_000_000)
    many = " UNION ALL ".join(f"SELECT * REPLACE (user_id + {n} AS user_id) FROM '{DIR}/events.parquet'" for n in shifts)
    duck.execute(f"COPY ({many}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(ORACLES["geo_networks"])
    columns = [d[0] for d in want.description]
    df = QUERIES["geo_networks"](spark, str(tmp_path))
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())

"""Every query with SQL against DuckDB, as the driver compares them: same columns, same rows in any order."""

import os
from collections import Counter

import duckdb
import pytest

from treelake import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from read_parquet('{SF}/{name}')")
    return con


def plain(v):
    return str(v).lower() if isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    order = [want.columns.index(c) for c in cols]
    expected = Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == expected, (list((got - expected).items())[:3], list((expected - got).items())[:3])
    assert got, "no rows"


def test_every_query_is_listed():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_expiry_counts_fractions_of_seconds(spark, tmp_path):
    """Ten days and 0.8 seconds are more than ten days; ten days to the microsecond, and a null, as SQL has them."""
    con = duckdb.connect()
    times = ["2024-01-30 00:00:00.900", "2024-01-20 00:00:00.100", "2024-01-20 00:00:00.900", "2024-01-20 00:00:00.899999", "2024-01-20 00:00:01", "2023-07-01 12:00:00.000001"]
    rows = ", ".join(f"({i}, TIMESTAMP '{t}', {i % 2}, 'click')" for i, t in enumerate(times))
    con.sql(f"copy (select event_id::bigint as event_id, ts, user_id::bigint as user_id, event_type from (values {rows}, (6, NULL, 0, 'click')) t(event_id, ts, user_id, event_type)) to '{tmp_path}/events.parquet'")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["t06_expiry"](spark, str(tmp_path)).select("ref", "expired", "kept").collect()))
    assert got == sorted(con.sql(catalog.ORACLE_SQL["t06_expiry"]).select("ref", "expired", "kept").fetchall()) == [("u/0", 0, 3), ("u/1", 3, 0)]

"""Every registered query of the change log against its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from tideline.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    value = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x
    return columns, sorted((tuple(map(value, r)) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got = plain(catalog.QUERIES[name](spark, sf_dir).toPandas())
    assert got == plain(duck.execute(catalog.ORACLE_SQL[name]).df())
    assert got[1]


def test_display_formats_past_the_range_of_a_long(spark, tmp_path):
    """The unchanged SQL over the same ids as 128-bit integers, as its own sizes leave a BIGINT as well."""
    ids = [*range(12), 90_740, 90_741, 90_742, 99_999, 600_000, 5_999_999, 36_000_000, 2_000_000_003]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT event_id::HUGEINT AS event_id FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    expected = con.execute(f"SELECT * REPLACE (event_id::BIGINT AS event_id) FROM ({catalog.ORACLE_SQL['display_formats']})").df()
    assert plain(catalog.QUERIES["display_formats"](spark, str(tmp_path)).toPandas()) == plain(expected)

"""Every registered query outside the llm subpackage, against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from tallgrass.plans import all_queries, all_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(frame: pd.DataFrame) -> list:
    def value(x):
        if isinstance(x, float):
            return None if x != x else round(x, 6)
        return None if x is pd.NaT or x is pd.NA else x

    columns = sorted(frame.columns)
    return [columns, sorted((tuple(value(x) for x in row) for row in frame[columns].astype(object).itertuples(index=False)), key=repr)]


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    found = all_queries()[name](spark, SF).toPandas()
    if name in all_sql():
        assert plain(found) == plain(con.sql(all_sql()[name]).df())
    else:
        assert len(found)


def test_fleet_rollup_of_large_windows(spark, con, tmp_path):
    """Windows of tens of thousands of values, beyond what a sketch holds whole; and one without any."""
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i % 3) DAY AS ts, i % 50 AS user_id, 'e' || i % 2 AS event_type, CASE WHEN i % 6 = 0 THEN NULL ELSE (i * 7919 % 1000003) / 1000 END AS value, NULL::VARCHAR AS props
      FROM range(180001) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    sql = all_sql()["metric_fleet_rollup"].replace("FROM events", f"FROM read_parquet('{tmp_path}/events.parquet')")
    assert plain(all_queries()["metric_fleet_rollup"](spark, str(tmp_path)).toPandas()) == plain(con.sql(sql).df())

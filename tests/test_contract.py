"""The driver contract on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from stopwise.driver.views import TABLES
from tools.check_oracle import compare

SF = "/root/testdata/sf0.001"
CHEAP = (
    "date_spine service_dates rt_full_outer_resolve rt_delay_from_schedule nearest_schedule "
    "route_day_reliability stop_hour_reliability weather_by_date weather_impacts crash_proximity "
    "access_score vulnerability mart_query_filtered filter_options dq_contract qa_missing_windows "
    "load_plan export_state_latest dedup_latest_weather qualify_first trip_update_flatten "
    "coord_resolve tract_normalize weather_pivot_spine ratio_guard service_clock"
).split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return con


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "pct_on_time" in df.columns


def test_every_query_has_sql():
    assert set(contract.QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, con, name):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    cursor = con.execute(contract.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(at) == columns
    assert got
    assert compare(got, [tuple(r[at[c]] for c in columns) for r in cursor.fetchall()]) == ""


def test_stream_reads_a_table_that_is_a_folder(spark, folder):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(4).write.parquet(f"{folder}/events.parquet")
    run = contract.queries()["stop_hour_stream"]
    assert sorted(map(tuple, run(spark, folder).collect())) == sorted(map(tuple, run(spark, SF).collect()))

"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.plans import admin, analytics, messages, scalars, state, streams  # noqa: F401
from tidemark.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, datetime.date | bytes | list):
        return v
    return None if math.isnan(v) else round(float(v), 6)


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, small):
    df = QUERIES[name](spark, small)
    cur = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want


def test_polls_of_a_busy_queue_are_not_in_vain(spark, tmp_path):
    """More messages than one read takes get claimable within the five seconds, up to their last moment."""
    start = datetime.datetime(2024, 1, 30, 23, 59, 30)
    rows = [(i, str(start + datetime.timedelta(milliseconds=ms)), 7, "signup" if i != 3 else "click", 1.0, '{"k": 7}') for i, ms in enumerate((-100, 0, 1, 100, 100, 101, 900, 2000, 2001, 4900, 4999, 5000, 5001))]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = sorted(con.execute(ORACLE_SQL["read_with_poll_in_vain"]).fetchall())
    assert [i for (i,) in want] == [2, 4, 5, 6, 7, 8, 9, 10, 11]
    assert sorted(tuple(r) for r in QUERIES["read_with_poll_in_vain"](spark, str(tmp_path)).collect()) == want

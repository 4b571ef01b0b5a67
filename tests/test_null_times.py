"""Events without a time, against the SQL of the suite."""

from __future__ import annotations

import datetime as dt

import duckdb
from conftest import as_set

from ebbtide.operators import events
from ebbtide.suite.oracle import ORACLE

STEPS = ["view", "click", "purchase"]
T = dt.datetime(2024, 1, 1)
ROWS = [
    (1, 1, None, "error", 1.0), (2, 1, None, "error", 2.0), (3, 1, T, "view", 3.0),
    (4, 1, T + dt.timedelta(hours=1), "error", 4.0), (5, 1, None, "purchase", 5.0),
    (6, 1, T + dt.timedelta(hours=2), "purchase", 6.0), (7, 1, T + dt.timedelta(hours=3), "click", 7.0),
    (8, 2, None, "view", 8.0), (9, 3, None, "click", 9.0), (10, 3, T, "purchase", 1.0), (11, 4, None, "view", 2.0),
    (12, 4, None, "error", 2.0),
]


def by_sql(name):
    with duckdb.connect() as con:
        con.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, ts TIMESTAMP, event_type VARCHAR, value DOUBLE)")
        con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?)", ROWS)
        return set(con.execute(ORACLE[name]).fetchall())


def test_events_without_a_time_stay(spark):
    df = spark.createDataFrame(ROWS, "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string, value double")
    rolling = {(r[0], r[1], r[3]) for r in events.rolling_errors(df).collect()}
    assert rolling == {(r[0], r[1], r[3]) for r in by_sql("rolling_errors")}
    last = {(r[0], r[1], r[4]) for r in events.last_before(df, "purchase").collect()}
    assert last == {(r[0], r[1], r[4]) for r in by_sql("last_before")}
    assert as_set(events.funnel(df, STEPS)) == by_sql("funnel")

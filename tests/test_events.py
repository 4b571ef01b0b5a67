"""Event operators against brute force. Times are drawn from few values, so ties and waits
exactly equal to the gap occur; user 0 has a third of all events."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import TESTDATA, as_set

from ebbtide.operators import events
from ebbtide.sources import SCHEMAS, load

START = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)
TYPES = ["view", "click", "purchase", "error"]


def make(spark, rows):
    """rows: (event_id, hours after START, user, type) or with a value at the end."""
    full = [(r[0], START + r[1] * HOUR, r[2], r[3], float(r[4]) if len(r) > 4 else 0.0, "{}") for r in rows]
    return spark.createDataFrame(full, SCHEMAS["events"])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [
        (i, rng.randrange(0, 24 * 40), 0 if rng.random() < 0.34 else rng.randrange(1, 15), rng.choice(TYPES), i)
        for i in range(700)
    ]


@pytest.fixture(scope="module")
def df(spark, rows):
    frame = make(spark, rows).repartition(6).cache()
    yield frame
    frame.unpersist()


def by_user(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        out.setdefault(r[2], []).append(r)
    return out


@pytest.mark.parametrize("gap", [1, 6, 30])
def test_sessions(df, rows, gap):
    want = set()
    for user, line in by_user(rows).items():
        runs = [[line[0]]]
        for r in line[1:]:
            if r[1] - runs[-1][-1][1] >= gap:
                runs.append([])
            runs[-1].append(r)
        want |= {(user, START + s[0][1] * HOUR, START + s[-1][1] * HOUR, len(s)) for s in runs}
    assert as_set(events.sessions(df, gap * events.HOUR)) == want


@pytest.mark.parametrize("hours", [1, 24, 50])
def test_quiet_periods(df, rows, hours):
    want = set()
    for user, line in by_user(rows).items():
        want |= {
            (user, a[0], a[3], START + a[1] * HOUR, START + b[1] * HOUR, float((b[1] - a[1]) * 3600))
            for a, b in zip(line, line[1:])
            if b[1] - a[1] >= hours
        }
    assert as_set(events.quiet_periods(df, hours)) == want


def test_funnel(df, rows):
    want = set()
    for user, line in by_user(rows).items():
        best, known = 0, False
        for a in line:
            known |= a[3] in TYPES[:3]
            if a[3] != "view":
                continue
            best = max(best, 1)
            for b in line:
                if b[3] == "click" and 0 < b[1] - a[1] <= 24:
                    best = max(best, 2)
                    if any(c[3] == "purchase" and c[1] > b[1] and c[1] - a[1] <= 24 for c in line):
                        best = 3
        if known:
            want.add((user, best))
    got = events.funnel(df, TYPES[:3])
    assert as_set(got) == want


@pytest.mark.parametrize("slices", ["1", "50"])
def test_the_number_of_slices_does_not_matter(spark, df, slices):
    def all_of_them():
        return [
            as_set(events.sessions(df, events.HOUR)),
            as_set(events.sessions(df)),
            as_set(events.funnel(df, TYPES[:3])),
            as_set(events.rolling_errors(df)),
            as_set(events.last_before(df, "click")),
        ]

    usual = all_of_them()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        assert all_of_them() == usual
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_funnel_boundaries(spark):
    df = make(spark, [
        (1, 0, 1, "view"), (2, 1, 1, "click"), (3, 24, 1, "purchase"),  # exactly within
        (4, 0, 2, "view"), (5, 1, 2, "click"), (6, 24.001, 2, "purchase"),  # just late
        (7, 5, 3, "view"), (8, 5, 3, "click"), (9, 6, 3, "purchase"),  # not strictly later
        (10, 0, 4, "click"), (11, 1, 4, "error"), (12, 1, 5, "error"),
        (13, 0, 6, "view"), (14, 20, 6, "view"), (15, 30, 6, "click"), (16, 40, 6, "purchase"),
    ])
    assert as_set(events.funnel(df, TYPES[:3])) == {(1, 3), (2, 2), (3, 1), (4, 0), (6, 3)}
    assert as_set(events.funnel(df, ["view"])) == {(1, 1), (2, 1), (3, 1), (6, 1)}


def test_a_step_may_repeat(spark):
    df = make(spark, [(1, 0, 1, "view"), (2, 1, 1, "view"), (3, 2, 2, "view")])
    assert as_set(events.funnel(df, ["view", "view"])) == {(1, 2), (2, 1)}


def test_rolling_errors(df, rows):
    got = {r.event_id: r.errors for r in events.rolling_errors(df, 2).collect()}
    want = {
        r[0]: sum(e[3] == "error" and e[2] == r[2] and r[1] - 48 <= e[1] <= r[1] for e in rows) for r in rows
    }
    assert got == want


def test_last_before(df, rows):
    got = as_set(events.last_before(df, "purchase"), "event_id", "last_value")
    want = set()
    for r in rows:
        earlier = [e for e in rows if e[3] == "purchase" and e[2] == r[2] and e[1] < r[1]]
        want.add((r[0], float(max(earlier, key=lambda e: (e[1], e[0]))[4]) if earlier else None))
    assert got == want


def test_times_survive_exactly(spark):
    at = dt.datetime(2024, 1, 1, 3, 30, 4, 729045)
    df = spark.createDataFrame([(1, at, 1, "error", 1.0, "{}")], SCHEMAS["events"])
    assert as_set(events.rolling_errors(df), "ts", "errors") == {(at, 1)}
    assert as_set(events.sessions(df), "session_start") == {(at,)}


def test_events_before_1970(spark):
    df = spark.createDataFrame(
        [(i, dt.datetime(1969, 12, 31, 20) + i * 3 * HOUR, 1, "error", 1.0, "{}") for i in range(4)],
        SCHEMAS["events"],
    )
    assert as_set(events.sessions(df, 4 * events.HOUR), "events") == {(4,)}
    assert events.quiet_periods(df, 3).count() == 3


def test_retention_leaves_out_unobservable_users(spark):
    df = make(spark, [(1, 0, 1, "view"), (2, 24, 1, "view"), (3, 0, 2, "view"), (4, 48, 3, "view"), (5, 50, 2, "view")])
    got = events.event_retention(df, [1, 2, 9])
    assert as_set(got) == {(1, 2, 1, 0.5), (2, 2, 1, 0.5), (9, 0, 0, None)}


def test_empty_inputs(spark):
    none = make(spark, [(1, 0, 1, "view")]).limit(0)
    for result in (
        events.sessions(none), events.funnel(none, TYPES[:3]), events.quiet_periods(none),
        events.rolling_errors(none), events.last_before(none, "view"),
    ):
        assert result.count() == 0


def test_a_busy_user_with_a_short_gap_is_spread_over_all_tasks(spark):
    """One user with most events, seconds apart, half of them alone and half in one long run."""
    from pyspark.sql import functions as F

    n, slices = 40_000, 8
    at = F.when(F.col("id") % 2 == 0, F.col("id") * 10).otherwise(1_000_000 + F.floor(F.col("id") / 2))
    df = spark.range(n).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(1_704_067_200 + at).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(7).alias("user_id"),
        F.lit("view").alias("event_type"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = events.sessions(df, 2 * events.SECOND)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        runs = found.filter("user_id = 7").groupBy("events").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == slices and max(sizes) < 2 * sum(sizes) / slices
    # The long run crosses slices and is one session.
    assert {r["events"]: r["count"] for r in runs} == {1: n // 2 - n // 50, n // 2: 1}


def plain_funnel(line, steps, within):
    """Furthest step of one user's (time, type) rows, trying every chain."""
    best = 0
    for t, kind in line:
        if kind != steps[0]:
            continue
        now, reached = t, 1
        for step in steps[1:]:
            later = [x for x, k in line if k == step and now < x <= t + within]
            if not later:
                break
            now, reached = min(later), reached + 1
        best = max(best, reached)
    return best


@pytest.mark.parametrize("slices", ["1", "3", "40"])
@pytest.mark.parametrize("steps", [["a"], ["a", "b"], ["a", "b", "c", "d"], ["a", "a", "b", "a"]])
def test_funnels_of_any_length_over_any_slices(spark, slices, steps):
    rng = random.Random(len(steps))
    rows = [(i, rng.randrange(90), rng.choice([0, 0, 1, 2, 3]), rng.choice("abcde")) for i in range(400)]
    want = {}
    for user in {r[2] for r in rows}:
        line = sorted({(r[1], r[3]) for r in rows if r[2] == user})
        if any(k in steps for _, k in line):
            want[user] = plain_funnel(line, steps, 12)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        got = events.funnel(make(spark, rows), steps, 12 * events.HOUR).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.user_id: r.furthest for r in got} == want and len(got) == len(want)


def test_funnel_has_one_range_partitioning_and_no_written_copy(spark):
    given = load(spark, str(TESTDATA / "sf0.001"), "events")
    plan = events.funnel(given, TYPES[:4])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and plan.count("FileScan") == 1
    assert "Join" not in plan and "ExistingRDD" not in plan


@pytest.mark.parametrize("slices", ["1", "2", "7", "40"])
@pytest.mark.parametrize("times", [1, 3, 25])
def test_running_results_where_few_times_fill_many_slices(spark, slices, times):
    """Many rows at equal times, so that one time is in several slices; some rows without one."""
    rng = random.Random(times)
    rows = [(i, rng.randrange(times), rng.choice([0, 0, 0, 1, 2]), rng.choice(["error", "purchase", "x"]), i) for i in range(300)]
    from pyspark.sql import functions as F

    df = make(spark, rows).withColumn("ts", F.when(F.col("event_id") % 17 > 0, F.col("ts"))).repartition(5)
    timed = {r[0]: None if r[0] % 17 == 0 else r[1] for r in rows}
    errors, last = {}, {}
    for i, _, user, kind, _ in rows:
        peers = [r for r in rows if r[2] == user]
        if timed[i] is None:
            errors[i] = sum(timed[r[0]] is None and r[3] == "error" for r in peers)
            last[i] = None
        else:
            known = [r for r in peers if timed[r[0]] is not None]
            errors[i] = sum(timed[i] - 24 <= r[1] <= timed[i] and r[3] == "error" for r in known)
            last[i] = max(((r[1], r[0]) for r in known if r[1] < timed[i] and r[3] == "purchase"), default=(0, None))[1]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        got = {r.event_id: r.errors for r in events.rolling_errors(df, days=1).collect()}
        found = {r.event_id: r.last_value for r in events.last_before(df, "purchase").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == errors
    assert found == {i: None if v is None else float(v) for i, v in last.items()}


def test_one_time_with_all_rows_is_spread(spark):
    from pyspark.sql import functions as F

    df = spark.range(8000).select(
        F.col("id").alias("event_id"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"),
        F.lit(1).cast("bigint").alias("user_id"),
        F.lit("error").alias("event_type"),
    )
    found = events.rolling_errors(df)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    # An error is a row at its time and one where it leaves the window, in eight slices.
    assert max(sizes) <= 1.5 * 2 * 8000 / 8 and {r.errors for r in found.select("errors").distinct().collect()} == {8000}
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Rows are read where they were written, dealt to tasks by slice, and joined to a broadcast.
    assert "SortMergeJoin" not in plan.split("BroadcastExchange")[0]

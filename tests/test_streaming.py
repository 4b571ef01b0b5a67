"""Streams give the batch result for whatever the watermark has closed, however files arrive."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from conftest import TESTDATA, as_set
from pyspark.sql import functions as F

from ebbtide import streaming
from ebbtide.operators import events as batch
from ebbtide.sources import SCHEMAS, load

START = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


class Files:
    """Event files that a stream reads one per batch, in the order written."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0

    def add(self, rows):
        full = [(r[0], START + r[1] * HOUR, r[2], r[3] if len(r) > 3 else "view", 1.0, "{}") for r in rows]
        self.add_frame(self.spark.createDataFrame(full, SCHEMAS["events"]))

    def add_frame(self, df):
        part = self.folder / f"part{self.n}"
        df.coalesce(1).write.parquet(str(part))
        (source,) = part.glob("*.parquet")
        target = self.folder / "in" / f"{self.n:03d}.parquet"
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(source.read_bytes())
        os.utime(target, (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        self.n += 1

    def stream(self):
        return streaming.read_events(self.spark, str(self.folder / "in"), files_per_batch=1)


@pytest.fixture
def files(spark, tmp_path):
    return Files(spark, tmp_path)


FAR = 24 * 400  # hours; a row this late closes everything before it


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_results_do_not_depend_on_files(spark, tmp_path, parts):
    """Rows shuffled within 50 minutes, so some files hold earlier rows than the file before."""
    sample = load(spark, str(TESTDATA / "sf0.001"), "events")
    rows = [tuple(r) for r in sample.collect()]
    rng = random.Random(parts)
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(50)))
    last = (10**6, START + FAR * HOUR, 10**6, "view", 0.0, "{}")
    files = Files(spark, tmp_path)
    size = -(-len(rows) // parts)
    for i in range(parts):
        chunk = rows[i * size : (i + 1) * size] + ([last] if i == parts - 1 else [])
        files.add_frame(spark.createDataFrame(chunk, SCHEMAS["events"]))

    activity = streaming.run_to_end(streaming.stream_activity(files.stream()), "a")
    daily = sample.groupBy(F.to_date("ts").alias("d"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("v")
    )
    got = activity.select(F.to_date("window_start"), "event_type", "events", F.round("total", 2))
    assert as_set(got) == as_set(daily)

    sessions = streaming.run_to_end(streaming.stream_sessions(files.stream()), "s")
    ntz = [F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")]
    assert as_set(sessions.select("user_id", *ntz, "events")) == as_set(batch.sessions(sample))

    alerts = streaming.run_to_end(streaming.stream_idle_alerts(files.stream()), "i")
    quiet = batch.quiet_periods(sample).select("user_id", "last_event_id")
    users = sample.groupBy("user_id").agg(F.max_by("event_id", "ts"))  # never seen again
    assert as_set(alerts, "user_id", "last_event_id") == as_set(quiet) | as_set(users)
    assert alerts.count() == quiet.count() + users.count()


def test_late_rows(files):
    files.add([(1, 10, 1)])
    files.add([(2, 30, 1), (3, 29.5, 1)])  # disorder within the delay
    files.add([(4, 29.2, 1)])  # late, but not by more than an hour
    files.add([(5, 5, 1)])  # too late: the first day is closed
    files.add([(6, FAR, 1)])
    got = streaming.run_to_end(streaming.stream_activity(files.stream()), "late")
    days = got.select(F.to_date("window_start").alias("d"), "events")
    assert as_set(days) == {(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 3)}


def test_sliding_windows_count_rows_twice(files):
    files.add([(1, 30, 1), (2, FAR, 1)])
    got = streaming.run_to_end(streaming.stream_activity(files.stream(), "2 days", "1 day"), "slide")
    assert as_set(got.select(F.to_date("window_start"))) == {(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),)}


def test_wait_equal_to_the_gap_splits_sessions(files):
    files.add([(1, 0, 1), (2, 6, 1), (3, 11.99, 1), (4, FAR, 2)])
    got = streaming.run_to_end(streaming.stream_sessions(files.stream()), "gap")
    assert as_set(got, "events") == {(1,), (2,)}


def test_replays_within_and_across_files(files):
    files.add([(1, 0, 1), (1, 0, 1), (2, 0.1, 1)])
    files.add([(1, 0, 1), (2, 0.5, 1), (3, 0.6, 1)])  # id 2 again with another time
    files.add([(3, 0.6, 1), (4, FAR, 1)])
    got = streaming.run_to_end(streaming.stream_dedup(files.stream()), "dedup")
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3, 4]  # each as it is first seen


def test_one_event_replayed_in_a_third_of_the_rows(files):
    files.add([(0, 0, 1)] * 500 + [(i, i / 1000, 1) for i in range(1, 1000)] + [(5000, FAR, 1)])
    got = streaming.run_to_end(streaming.stream_dedup(files.stream()), "hot")
    assert got.count() == 1001 and got.select("event_id").distinct().count() == 1001


def test_replays_meet_once_per_salt(spark, tmp_path):
    """A batch of four files, each with the hot id in a third of its rows, then the same again."""
    from ebbtide.sources import write_result

    files, salts = Files(spark, tmp_path), 3
    for part in range(8):
        files.add([(0, 0.5, 1)] * 100 + [(1000 * (part % 4) + i, i / 1000, 1) for i in range(1, 201)])
    stream = streaming.read_events(spark, str(tmp_path / "in"), files_per_batch=4)
    query = write_result(
        streaming.stream_dedup(stream, salts=salts), str(tmp_path / "out"), checkpoint=str(tmp_path / "progress")
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 801
    by_batch = {}
    for p in query.recentProgress:
        # The operator nearest to the result comes first.
        ids, salted = [op.customMetrics["numDroppedDuplicateRows"] for op in p.stateOperators]
        if p.numInputRows:
            by_batch[p.batchId] = (p.numInputRows, p.numInputRows - salted, ids)
    first, again = (by_batch[i] for i in sorted(by_batch))
    assert first[0] == again[0] == 1200
    # Of 400 rows with the hot id, as many go on as there are salts in use, three at most.
    assert 802 <= first[1] <= 800 + salts and first[2] == first[1] - 801
    assert again[1] <= 800 + salts and again[2] == again[1]


def test_clashing_names_in_a_stream(files):
    files.add([(1, 0, 1), (1, 0, 1), (2, FAR, 1)])
    named = files.stream().withColumn("salt", F.lit("x"))
    got = streaming.run_to_end(streaming.stream_dedup(named), "clash")
    assert got.columns == named.columns and as_set(got, "event_id", "salt") == {(1, "x"), (2, "x")}


def test_alerts_per_silence_even_within_one_batch(files):
    files.add([(1, 0, 7), (2, 24, 7), (3, 30, 7), (4, 80, 7), (5, FAR, 8)])
    got = streaming.run_to_end(streaming.stream_idle_alerts(files.stream()), "idle")
    rows = {(r.last_event_id, r.alert_at) for r in got.collect()}
    assert rows == {(i, START + (h + 24) * HOUR) for i, h in ((1, 0), (3, 30), (4, 80))}


def test_enriching_keeps_unknown_customers(spark, files):
    files.add([(1, 0, 7), (2, 0, 9), (3, FAR, 8)])
    dims = spark.createDataFrame([(7, "S", "N", "R")], "k bigint, segment string, nation string, region string")
    alerts = streaming.stream_enrich(streaming.stream_idle_alerts(files.stream()), dims)
    got = streaming.run_to_end(alerts, "enrich")
    assert as_set(got, "user_id", "segment", "region") == {(7, "S", "R"), (9, None, None)}


def test_a_restarted_write_neither_loses_nor_repeats(spark, files, tmp_path):
    from ebbtide.sources import write_result

    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    files.add([(1, 0, 1), (2, 30, 1)])
    write_result(streaming.stream_sessions(files.stream()), out, checkpoint=progress).awaitTermination()
    files.add([(3, 31, 1), (4, FAR, 1)])
    write_result(streaming.stream_sessions(files.stream()), out, checkpoint=progress).awaitTermination()
    assert sorted(r.events for r in spark.read.parquet(out).collect()) == [1, 2]

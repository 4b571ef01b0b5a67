"""Event operators as streams. All are append mode: a row comes out once. Windows, sessions and
silences come out when the watermark has closed them, so those results do not depend on how
files are batched; `stream_dedup` says where its own do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions import unused
from ebbtide.plans import shared_folder
from ebbtide.sources import SCHEMAS, write_result


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Event files as a stream, with `ts` as the timestamp type watermarks need.

    `path` is a folder or a pattern; a pattern may also match single files.
    """
    reader = spark.readStream.schema(SCHEMAS["events"])
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything its source has and return what it wrote.

    Output and progress go to a new folder beside the session's checkpoints.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    query = write_result(stream, f"{folder}/rows", checkpoint=f"{folder}/progress")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def stream_activity(
    events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour"
) -> DataFrame:
    """window_start, window_end, event_type, events, total: closed tumbling or sliding windows.

    Rows more than `late` behind the newest are dropped. Counts combine before the shuffle,
    so a common type costs no more than a rare one.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        events.withWatermark("ts", late)
        .groupBy(window.alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "event_type",
            "events",
            "total",
        )
    )


def _closed_sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    # Spark joins sessions that only touch; a microsecond less makes a wait of `gap` split.
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", f"{gap} -1 microseconds").alias("w"), "user_id")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.max(F.struct("ts", "event_id", "event_type")).alias("last"),
        )
    )


def stream_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, session_end, events: sessions once no event can extend them.
    As in batch, a wait of `gap` or more starts a new one.

    The package's session settings merge sessions before the shuffle, so a very busy user
    sends one row per session and input partition.
    """
    return _closed_sessions(events, gap, late).select(
        "user_id",
        F.col("w.start").alias("session_start"),
        F.col("last.ts").alias("session_end"),
        "events",
    )


def stream_dedup(events: DataFrame, late: str = "1 hour", salts: int | None = None) -> DataFrame:
    """Events with replays of an `event_id` removed, as long as they come within `late`.

    Each event comes out when it is first seen. If replays of one id differ in time or payload,
    which of them that is depends on the order of arrival.

    Two keyed states follow each other. The first knows ids per salt, which is the number of the
    input's partition modulo `salts` (shuffle partitions unless given), so an id that is replayed
    in a third of the rows is spread over as many tasks; the second knows ids. A batch sends at
    most one row per id and salt to the second, and an id that an earlier batch has had in every
    salt sends none.
    """
    salts = salts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = unused(events, "salt")
    return (
        events.withWatermark("ts", late)
        .withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(salts)))
        .dropDuplicatesWithinWatermark(["event_id", salt])
        .drop(salt)
        .dropDuplicatesWithinWatermark(["event_id"])
    )


def stream_idle_alerts(events: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """user_id, last_event_id, last_type, quiet_from, alert_at: one alert per silence of at
    least `hours`, when the watermark passes the last event by that much.

    Such a silence is exactly what ends a session with that gap, so Spark's session state
    does the work and no user code or per-user buffer is needed.
    """
    closed = _closed_sessions(events, f"{hours} hours", late)
    return closed.select(
        "user_id",
        F.col("last.event_id").alias("last_event_id"),
        F.col("last.event_type").alias("last_type"),
        F.col("last.ts").alias("quiet_from"),
        (F.col("last.ts") + F.make_interval(hours=F.lit(hours))).alias("alert_at"),
    )


def stream_enrich(alerts: DataFrame, dims: DataFrame) -> DataFrame:
    """Alerts plus the customer's segment, nation and region; unknown customers get nulls."""
    known = dims.select(F.col("k").alias("user_id"), "segment", "nation", "region")
    return alerts.join(known, "user_id", "left")

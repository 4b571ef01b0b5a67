"""Session settings the package relies on."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    # Event times are naive in the files and are read as UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Open windows, sessions and seen ids stay on the executors' disks, not in their heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Merge sessions before the shuffle, so a user with very many events sends few rows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

# Read when a session starts, so only a session built here has them.
AT_START = {
    # Checkpoint files go when the driver has dropped the frame.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "ebbtide", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the package settings; `master` and sizing stay with the cluster if unset."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **AT_START, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the package settings on a session somebody else built, where they stay.

    Every query of the suite does this, as its results depend on the time zone.
    """
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def reach_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    For a checkout at the same place on all machines; otherwise install the package or hand it
    to spark-submit with --py-files.
    """
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
    return spark

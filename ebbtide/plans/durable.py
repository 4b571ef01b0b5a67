"""Cutting lineage in storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LEAVING: set[str] = set()  # folders to be removed when the process ends


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _checkpoint_dir(spark: SparkSession) -> str:
    """The session's own folder for checkpoints, removed when the session's process ends."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="ebbtide-")
        context.setCheckpointDir(named)
    own = context.getCheckpointDir()
    if own not in _LEAVING:
        files, at = _file_system(spark, own)
        files.deleteOnExit(at)
        _LEAVING.add(own)
    return own


def durable(df: DataFrame) -> DataFrame:
    """`df` written to the session's checkpoint folder and read from there afterwards.

    Needed where recomputing could place rows differently, as after a range repartition whose
    bounds come from a sample. With `spark.cleaner.referenceTracking.cleanCheckpoints` on (a
    setting of the session's start) its files go when the driver has dropped the frame, and in
    any case when the session's process ends.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder, for output that later steps read."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made with `shared_folder` once nothing reads it any more."""
    if not path.startswith(_checkpoint_dir(spark)):
        raise ValueError(f"{path} is not in the session's folder")
    files, at = _file_system(spark, path)
    files.delete(at, True)

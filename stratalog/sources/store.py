"""The shared folder of a session, for tables that outlive a task, and removal of what is no longer needed there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Whether the end of an execution removes its shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a session of one machine, as in tests, may go without it and gets a temporary one; on a cluster that would be another
    disk for every executor, so it is an error.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="shared")


def swept(df: DataFrame) -> DataFrame:
    """df, whose shuffle files are removed as soon as it was computed; else they stay until the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return df.select("*")
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the session's shared checkpoint folder, so that it outlives its executors.

    The folder comes from spark.checkpoint.dir; only a session of one machine may go without it. Spark removes a table there when
    nothing refers to it any more, if spark.cleaner.referenceTracking.cleanCheckpoints is set. The shuffle files it was made of
    are removed at once.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return swept(df).checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in its own store, if it is there."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)

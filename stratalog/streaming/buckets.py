"""Buckets of an unbounded event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators import buckets as B
from stratalog.functions.timing import bucket_end, bucket_id

WARN_SHARE, ERROR_SHARE = 0.005, 0.10


def bucket_stream(events: DataFrame, minutes: int = 5, watermark: str | None = None) -> DataFrame:
    """Counts by bucket of a stream (ts timestamp, level). Late events update their bucket; without a watermark always."""
    own = events.withWatermark("ts", watermark) if watermark else events
    told = own.groupBy(F.window("ts", f"{minutes} minutes")).agg(*B.level_counts(F.col("level")))
    start = F.col("window.start").cast("timestamp_ntz")
    return told.select(bucket_id(start).alias("bucket_id"), start.alias("start_time"), bucket_end(start, minutes).alias("end_time"), *B.COUNTS)


def upsert_stream(events: DataFrame, path: str, checkpoint: str, minutes: int = 5, trigger: dict | None = None):
    """A started query that keeps the table at path equal to the buckets of all events so far.

    A bucket's row comes whole with each change, so a batch that is run again writes the same rows: its buckets replace the
    table's of the same id. Only days with a change are written.
    """

    def write(batch: DataFrame, _: int) -> None:
        new = batch.withColumn("bucket_date", F.to_date("start_time"))
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            merged = new
        else:
            kept = old.join(new.select("bucket_date").distinct(), "bucket_date", "left_semi").join(new.select("bucket_id"), "bucket_id", "left_anti")
            merged = kept.unionByName(new).checkpoint()
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_date").parquet(path)

    query = bucket_stream(events, minutes).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def late_share(events: DataFrame, window_hours: float = 4, order: str = "ord") -> DataFrame:
    """(late, events, share, level) of events that lie before the processing window that the largest time so far had reached."""
    from stratalog.streaming.windows import routed

    told = routed(events, window_hours, order).agg(F.count_if(F.col("route") == "late").alias("late"), F.count(F.lit(1)).alias("events"))
    share = F.when(F.col("events") > 0, F.col("late") / F.col("events")).otherwise(0.0)
    return told.withColumn("share", share).withColumn("level", F.when(share > ERROR_SHARE, "error").when(share > WARN_SHARE, "warning").otherwise("ok"))

"""Processing windows: what a reader that goes forward in time does with each event, and a live view of the latest buckets.

A batch or a stream needs none of this for right results, since late and early events simply go to their buckets. It tells how
an input is ordered: how much of it comes late, and how many buckets would have to wait.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.display import sparkline
from stratalog.functions.timing import aligned, seconds_of
from stratalog.operators import ordered as O
from stratalog.streaming.buckets import bucket_stream

HOURS = 4
#: Waiting buckets from which on a reader warns; again at ten times as many, and so on.
WAITING = 1000


def processing_windows(spark: SparkSession, first: dt.datetime, last: dt.datetime, hours: float = HOURS, minutes: int = 5) -> DataFrame:
    """(window, window_start, window_end): slices of time from the bucket of the first time on, until the last time lies in one."""
    n = (F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600).cast("decimal(18,6)"))
    starts = spark.range(1).select(F.posexplode(F.sequence(aligned(n[0], minutes), n[1], step)).alias("window", "window_start"))
    return starts.withColumn("window_end", F.col("window_start") + step)


def routed(events: DataFrame, hours: float = HOURS, order: str = "ord", span_rows: int = 100_000) -> DataFrame:
    """events with `reached`, the window that the largest time read before has reached (null for the first), `window`, their own,
    and `route`: window, future, or late."""
    own = events.withColumn("window", F.floor(seconds_of(F.col("ts")) / (hours * 3600)))
    read = O.running(own, F.col("window"), F.floor(F.col(order) / span_rows), [F.col(order)], "reached", kind="max", own=False)
    return read.withColumn("route", F.when(F.col("window") < F.col("reached"), "late").when(F.col("window") > F.col("reached"), "future").otherwise("window"))


def waiting(routes: DataFrame, minutes: int = 5) -> DataFrame:
    """(window, buckets, level): the buckets of future events that wait when a window ends, and whether that is many."""
    early = routes.where("route = 'future'").withColumn("start", aligned(F.col("ts"), minutes)).select("start", "reached", "window").distinct()
    # An event that was read in one window and belongs to another waits through all those before its own.
    held = early.select("start", F.explode(F.sequence(F.col("reached"), F.col("window") - 1)).alias("window"))
    told = held.groupBy("window").agg(F.count_distinct("start").alias("buckets"))
    steps = F.floor(F.log10(F.greatest(F.col("buckets"), F.lit(1)) / WAITING) + 1e-9)
    return told.withColumn("level", F.when(F.col("buckets") < WAITING, "ok").otherwise(F.concat(F.lit("warning at "), (F.pow(F.lit(10.0), steps) * WAITING).cast("long").cast("string"))))


def live(buckets: DataFrame, n: int = 10, minutes: int = 5) -> DataFrame:
    """The latest n buckets, the last one first, with events a minute and the share of errors."""
    rate = F.when(F.col("total_events") > 0, 100.0 * F.col("error_count") / F.col("total_events")).otherwise(0.0)
    return buckets.orderBy(F.desc("start_time")).limit(n).select("bucket_id", "start_time", "total_events", (F.col("total_events") / minutes).alias("events_per_minute"), rate.alias("error_rate"))


def live_text(rows: list) -> str:
    """A view of what live() gives, in order of time, with a curve of events a minute."""
    shown = sorted(rows, key=lambda r: r["start_time"])
    lines = [f"{r['bucket_id']}  {r['total_events']:>8}  {r['events_per_minute']:>8.1f}/min  {r['error_rate']:>5.1f} %" for r in shown]
    return "\n".join([*lines, sparkline([r["events_per_minute"] for r in shown])])


def monitor(events: DataFrame, checkpoint: str, show: Callable[[str], None] = print, n: int = 10, minutes: int = 5, trigger: dict | None = None):
    """A started query that shows the latest buckets of a stream (ts timestamp, level) after every batch of it."""
    seen: dict[str, dict] = {}

    def step(batch: DataFrame, _: int) -> None:
        for r in live(batch, n, minutes).collect():
            seen[r["bucket_id"]] = r.asDict()
        for old in sorted(seen)[:-n]:
            del seen[old]
        show(live_text(list(seen.values())))

    query = bucket_stream(events, minutes).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()



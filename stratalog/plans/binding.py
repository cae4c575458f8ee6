"""The event table of the driver's data as a log: levels, templates, components, variables, latency and system records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.timing import aligned, bucket_end, bucket_id
from stratalog.operators import buckets as B

LEVEL_OF = {"error": "error", "purchase": "warning", "signup": "information", "view": "verbose", "click": "debug"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.element_at(F.create_map(*(F.lit(x) for kv in LEVEL_OF.items() for x in kv)), F.col("event_type"))
    return raw.select(
        F.col("event_id").alias("ord"), "ts", level.alias("level"), F.concat(F.lit("c"), F.col("user_id") % 8).alias("component"), F.col("event_type").alias("template_id"),
        F.concat("event_type", F.lit(" by user <*>")).alias("template_str"), F.create_map(F.lit("var1"), F.get_json_object("props", "$.k")).alias("params"), "value", "user_id",
    )


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("ord", "ts", F.col("value").alias("write_latency_ms"), (F.col("value") / 2).alias("read_latency_ms"))


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("ord % 50 = 0").select("ord", F.col("ts").alias("timestamp"), F.col("value").alias("cpu_util"))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exploded table of template instances, one row for each event."""
    ev = events(spark, sf_dir)
    start = aligned(F.col("ts"), 5)
    return ev.select(bucket_id(start).alias("bucket_id"), start.alias("start_time"), bucket_end(start, 5).alias("end_time"), "template_id", "template_str", F.col("ord").alias("instance_index"), "ts", F.col("params").alias("vars"))


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bucket table: counts, latency, spikes."""
    own = B.count_levels(B.assign(events(spark, sf_dir)))
    out = own.join(B.latency(latencies(spark, sf_dir)), "start_time", "left")
    return out.select(bucket_id(F.col("start_time")).alias("bucket_id"), "start_time", bucket_end(F.col("start_time")).alias("end_time"), *B.COUNTS, "write_latency_ms", "read_latency_ms", "has_spike")


#: SQL of the same tables, as common table expressions.
SQL_EV = """
ev AS (
  SELECT event_id AS ord, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'information' WHEN 'view' THEN 'verbose' WHEN 'click' THEN 'debug' END AS level,
         'c' || CAST(user_id % 8 AS VARCHAR) AS component, event_type AS template_id, event_type || ' by user <*>' AS template_str, json_extract_string(props, '$.k') AS var1, value, user_id,
         time_bucket(INTERVAL 5 MINUTE, ts) AS start_time, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS end_time, 'b_' || strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y%m%d_%H%M') AS bucket_id
  FROM events
)"""
SQL_BUCKETS = SQL_EV + """,
bk AS (
  SELECT bucket_id, start_time, end_time, count(*) AS total_events, count(*) FILTER (WHERE level = 'error') AS error_count, count(*) FILTER (WHERE level = 'warning') AS warning_count,
         count(*) FILTER (WHERE level = 'information') AS info_count, count(*) FILTER (WHERE level = 'verbose') AS verbose_count, count(*) FILTER (WHERE level = 'debug') AS debug_count,
         arg_max(value, ord) FILTER (WHERE value IS NOT NULL) AS write_latency_ms, arg_max(value / 2, ord) FILTER (WHERE value IS NOT NULL) AS read_latency_ms,
         coalesce(arg_max(value > 100, ord) FILTER (WHERE value <> 0), false) AS has_spike
  FROM ev GROUP BY bucket_id, start_time, end_time
)"""

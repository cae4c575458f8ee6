"""Snapshots of look-back windows: three tables that hold what an analysis of windows needs, without the bucket table.

window_buckets (window_id, bucket_index, bucket_id, start_time, end_time, features map), window_events (window_id, bucket_id,
template_id, ts), window_index (window_id, bucket_id, label, window_start, window_end). A window's id is its bucket and its
place among all windows of the snapshot in time, so equal input gives equal ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.operators import ordered as O
from stratalog.operators.features import METRIC_FIELDS

TABLES = ("window_buckets", "window_events", "window_index")


def window_ids(labels: DataFrame) -> DataFrame:
    """labels (bucket_id, label, window_end) with window_id: the bucket and a counter of six digits in order of time."""
    rows = O.row_numbers(labels, O.hours(F.col("window_end")), [F.col("window_end"), F.col("bucket_id")], "place")
    return rows.withColumn("window_id", F.concat_ws("_", "bucket_id", F.lpad((F.col("place") - 1).cast("string"), 6, "0"))).drop("place")


def take(labels: DataFrame, members: DataFrame, buckets: DataFrame, instances: DataFrame, lookback_minutes: int) -> dict[str, DataFrame]:
    """The three tables of the labels' windows.

    labels: (bucket_id, label, window_end), positives and chosen negatives; members: window_members of them, keyed by the
    bucket of the label; instances: with a time, those of a window's buckets before its end.
    """
    ids = window_ids(labels.select("bucket_id", "label", "window_end").dropDuplicates(["bucket_id"]))
    named = ids.select(F.col("bucket_id").alias("of_bucket"), F.col("window_id").alias("name"), "label", "window_end")
    own = members.select(F.col("window_id").alias("of_bucket"), "bucket_id", "start_time", "end_time").join(named, "of_bucket")
    place = F.row_number().over(Window.partitionBy("name").orderBy("start_time")) - 1
    fields = [f for f in METRIC_FIELDS if f in buckets.columns]
    features = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f).cast("double") for f in fields))).alias("features")
    placed = own.select(F.col("name").alias("window_id"), place.cast("int").alias("bucket_index"), "bucket_id", "start_time", "end_time")
    events = own.select("name", "bucket_id", "window_end").join(instances.where(F.col("ts").isNotNull()).select("bucket_id", "template_id", "ts", "instance_index"), "bucket_id").where(F.col("ts") < F.col("window_end"))
    start = F.col("window_end") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lookback_minutes))
    return {
        "window_buckets": placed.join(buckets.select("bucket_id", features), "bucket_id").select("window_id", "bucket_index", "bucket_id", "start_time", "end_time", "features"),
        "window_events": events.select(F.col("name").alias("window_id"), "bucket_id", "template_id", "ts", "instance_index"),
        "window_index": ids.select("window_id", "bucket_id", "label", start.alias("window_start"), "window_end"),
    }


def write(tables: dict[str, DataFrame], folder: str) -> None:
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}


def sequences(tables: dict[str, DataFrame]) -> DataFrame:
    """(window_id, template_id, pos): the events of each window in order of bucket, time and place."""
    at = tables["window_buckets"].select("window_id", "bucket_id", "bucket_index")
    return tables["window_events"].join(at, ["window_id", "bucket_id"]).select("window_id", "template_id", F.struct("bucket_index", "ts", "instance_index").alias("pos"))


def with_contributions(tables: dict[str, DataFrame], contributions: DataFrame) -> DataFrame:
    """window_buckets with `contributions`, the map of each bucket's Shapley values (bucket_id, feature, shap); null without any."""
    maps = contributions.groupBy("bucket_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "shap")))).alias("contributions"))
    return tables["window_buckets"].join(maps, "bucket_id", "left")


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each window: its label, range, buckets, events, and number of templates."""
    events = tables["window_events"].groupBy("window_id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("template_id").alias("templates"))
    buckets = tables["window_buckets"].groupBy("window_id").agg(F.count(F.lit(1)).alias("buckets"), F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end"))
    zero: Column = F.lit(0).cast("long")
    out = tables["window_index"].join(buckets, "window_id", "left").join(events, "window_id", "left")
    return out.select("window_id", "bucket_id", "label", "window_end", "first_start", "last_end", F.coalesce("buckets", zero).alias("buckets"), F.coalesce("events", zero).alias("events"), F.coalesce("templates", zero).alias("templates"))

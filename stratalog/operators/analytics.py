"""Template analytics over the exploded table of instances.

instances: (bucket_id, start_time, end_time, template_id string, template_str, instance_index, ts, vars map).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.timing import seconds_of
from stratalog.operators.buckets import TEMPLATES_TYPE

METRICS = ("read_latency_ms", "write_latency_ms", "read_iops", "write_iops", "cpu_util", "memory_util", "disk_util", "has_spike", "total_events", "error_count", "warning_count", "info_count", "verbose_count", "debug_count")


def explode_templates(buckets: DataFrame) -> DataFrame:
    """The instances of a bucket table's JSON column; JSON that cannot be read counts as empty."""
    read = F.explode(F.from_json("templates", TEMPLATES_TYPE))
    rows = buckets.select("bucket_id", "start_time", "end_time", read.alias("template_id", "t"))
    return rows.select("bucket_id", "start_time", "end_time", "template_id", "t.template_str", F.posexplode("t.instances").alias("instance_index", "vars"))


def instance_time(variables: Column, default: Column | None = None) -> Column:
    """Naive UTC time of an instance: its `timestamp` or `ts`, else the default."""
    from stratalog.functions.text import parse_time

    found = F.coalesce(parse_time(variables["timestamp"]), parse_time(variables["ts"]))
    return found if default is None else F.coalesce(found, default)


def template_instances(instances: DataFrame, template_ids: list[str] | None = None, substring: str | None = None, start=None, end=None, bucket_filters: Column | None = None, variables: dict[str, str] | None = None, flatten: list[str] | None = None) -> DataFrame:
    """Instances by id, case-insensitive substring, overlap with an open or closed range, bucket predicate and variables.

    flatten: variables that become columns; null where an instance has none.
    """
    out = instances
    if template_ids:
        out = out.where(F.col("template_id").isin([str(t) for t in template_ids]))
    if substring:
        out = out.where(F.contains(F.lower("template_str"), F.lit(substring.lower())))
    if end is not None:
        out = out.where(F.col("start_time") < F.lit(end))
    if start is not None:
        out = out.where(F.col("end_time") > F.lit(start))
    if bucket_filters is not None:
        out = out.where(bucket_filters)
    out = reduce(lambda d, kv: d.where(F.col("vars")[kv[0]] == F.lit(str(kv[1]))), (variables or {}).items(), out)
    return out.select("*", *(F.col("vars")[v].alias(v) for v in flatten)) if flatten else out


def template_frequency(instances: DataFrame, top_n: int | None = None) -> DataFrame:
    out = instances.groupBy("template_id").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "template_id").limit(top_n) if top_n else out


def cohorts(instances: DataFrame, named: dict[str, Column]) -> DataFrame:
    """Frequency of each template in each cohort of buckets, in one pass."""
    return instances.groupBy("template_id").agg(*(F.count_if(F.coalesce(p, F.lit(False))).alias(name) for name, p in named.items()))


def timeline(instances: DataFrame, buckets: DataFrame) -> DataFrame:
    """Instances with their bucket's metrics."""
    return instances.join(buckets.select("bucket_id", *(c for c in METRICS if c in buckets.columns)), "bucket_id")


def precursors(instances: DataFrame, anchor: str, lookback_minutes: int, bucket_minutes: int = 5) -> DataFrame:
    """Templates in the buckets that overlap the time before an anchor instance's bucket, counted once for each instance.

    All instances of a bucket see the same time, so the sum goes over distinct (bucket, template) pairs with the number of
    anchor instances as weight; the join is by equal time bins, each anchor bucket repeated for the few bins it looks back on.
    """
    width = max(bucket_minutes, lookback_minutes) * 60
    at = seconds_of(F.col("start_time"))
    anchors = instances.where(F.col("template_id") == anchor).groupBy(at.alias("anchor_at")).agg(F.count(F.lit(1)).alias("weight"))
    low = F.col("anchor_at") - lookback_minutes * 60
    spread = anchors.withColumn("bin", F.explode(F.sequence(F.floor((low - bucket_minutes * 60) / width), F.floor(F.col("anchor_at") / width))))
    others = instances.where(F.col("template_id") != anchor).select("template_id", at.alias("at"), seconds_of(F.col("end_time")).alias("until")).distinct().withColumn("bin", F.floor(F.col("at") / width))
    met = others.join(spread, "bin").where((F.col("at") < F.col("anchor_at")) & (F.col("until") > F.col("anchor_at") - lookback_minutes * 60))
    return met.select("template_id", "anchor_at", "weight").distinct().groupBy("template_id").agg(F.sum("weight").alias("n"))


def family(instances: DataFrame, substring: str) -> DataFrame:
    """Templates whose text has the substring, numbers first: the first is the incident, the others its equivalents."""
    found = instances.where(F.contains(F.lower("template_str"), F.lit(substring.lower()))).groupBy("template_id").agg(F.min_by("template_str", "start_time").alias("template_str"))
    numeric = F.col("template_id").try_cast("bigint")
    order = Window.orderBy(F.asc_nulls_last(numeric), "template_id")
    return found.withColumn("rank", F.row_number().over(order))


def template_strings(instances: DataFrame) -> DataFrame:
    """The first text of each template."""
    return instances.groupBy("template_id").agg(F.min_by("template_str", F.struct("start_time", "instance_index")).alias("template_str"))


def bucket_templates(instances: DataFrame) -> DataFrame:
    """(bucket_id, template_id, n): instances with a time in the bucket or with none."""
    inside = F.col("ts").isNull() | ((F.col("ts") >= F.col("start_time")) & (F.col("ts") < F.col("end_time")))
    return instances.where(inside).groupBy("bucket_id", "template_id").agg(F.count(F.lit(1)).alias("n"))

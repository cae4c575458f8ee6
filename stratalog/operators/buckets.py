"""Five-minute buckets of log events: deduplication, counts, latency, system state, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.text import parse_time
from stratalog.functions.timing import aligned, bucket_end, bucket_id
from stratalog.operators.joins import asof_last

#: Levels that are counted by name; others count in the total only.
LEVELS = {"error_count": ("error",), "warning_count": ("warning",), "info_count": ("information", "info"), "verbose_count": ("verbose",), "debug_count": ("debug",)}
COUNTS = ("total_events", *LEVELS)
LATENCY = ("read_latency_ms", "write_latency_ms", "read_iops", "write_iops", "read_throughput_bps", "write_throughput_bps")
SYSTEM = ("cpu_util", "memory_util", "disk_util", "total_pools", "pools_json", "hdd_count", "ssd_count", "total_volumes", "volumes_json", "ha_state", "is_leader", "peer_available", "ip_addresses_json", "degraded_volumes", "rebuild_active")
SPIKE_MS = 100.0
#: The JSON column's type, and the types of columns that are no counts.
TEMPLATES_TYPE = "map<string,struct<template_str:string,instances:array<map<string,string>>>>"
TYPES = (
    {c: "double" for c in ("read_latency_ms", "write_latency_ms", "read_iops", "write_iops", "cpu_util", "memory_util", "disk_util")}
    | {c: "string" for c in ("pools_json", "volumes_json", "ha_state", "ip_addresses_json", "component_counts_json", "templates")}
    | {c: "boolean" for c in ("has_spike", "is_leader", "peer_available", "rebuild_active")}
)


def valid(events: DataFrame, column: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(events with a timestamp, those without one): a text that is no time counts as none."""
    text = dict(events.dtypes)[column] == "string"
    own = events.withColumn(column, parse_time(F.col(column))) if text else events
    return own.where(F.col(column).isNotNull()), events.where((parse_time(F.col(column)) if text else F.col(column)).isNull())


def require_valid(events: DataFrame, column: str = "ts") -> DataFrame:
    """events; the job that reads them fails at one without a timestamp."""
    return events.where(F.coalesce(F.assert_true(F.col(column).isNotNull(), F.lit("an event has no timestamp")).isNull(), F.lit(True)))


def within(buckets: DataFrame, start, end, strict: bool = True) -> DataFrame:
    """Buckets that lie in [start, end); if strict, the job that reads them fails at one that does not."""
    inside = (F.col("start_time") >= F.lit(start)) & (F.col("end_time") <= F.lit(end))
    if not strict:
        return buckets.where(inside)
    return buckets.where(F.coalesce(F.assert_true(inside, F.lit("a bucket lies beyond its window")).isNull(), F.lit(True)))


def assign(events: DataFrame, minutes: int = 5) -> DataFrame:
    """events (ts, ...) with start_time; rows without a timestamp are invalid and go (valid() has them)."""
    return events.where(F.col("ts").isNotNull()).withColumn("start_time", aligned(F.col("ts"), minutes))


def dedupe(events: DataFrame) -> DataFrame:
    """One event of each bucket, template, time and parameters; events without a template all stay."""
    key = F.to_json(F.array_sort(F.map_entries("params")))
    named = events.where(F.col("template_id").isNotNull()).withColumn("params_key", key)
    return named.dropDuplicates(["start_time", "template_id", "ts", "params_key"]).drop("params_key").unionByName(events.where(F.col("template_id").isNull()))


def level_counts(level: Column) -> list[Column]:
    low = F.lower(level)
    return [F.count(F.lit(1)).alias("total_events"), *(F.count_if(low.isin(*names)).alias(c) for c, names in LEVELS.items())]


def count_levels(events: DataFrame) -> DataFrame:
    return events.groupBy("start_time").agg(*level_counts(F.col("level")))


def component_counts(events: DataFrame) -> DataFrame:
    """(start_time, component, n); a missing component is `unknown`."""
    return events.groupBy("start_time", F.coalesce(F.nullif("component", F.lit("")), F.lit("unknown")).alias("component")).agg(F.count(F.lit(1)).alias("n"))


def component_json(events: DataFrame) -> DataFrame:
    return component_counts(events).groupBy("start_time").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "n"))))).alias("component_counts_json"))


def template_instances(events: DataFrame, order: str = "ord") -> DataFrame:
    """(start_time, template_id, template_str, instances) with the first template text and the instances in order."""
    return events.where("template_id IS NOT NULL").groupBy("start_time", "template_id").agg(F.min_by("template_str", order).alias("template_str"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "ts", F.map_entries("params").alias("e")))), lambda s: F.struct(s["ts"].alias("ts"), F.map_from_entries(s["e"]).alias("params"))).alias("instances"))


def template_json(events: DataFrame, order: str = "ord") -> DataFrame:
    """(start_time, templates): the templates of a bucket as one JSON map."""
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    one = events.where("template_id IS NOT NULL").withColumn("inst", F.map_concat(F.col("params"), F.create_map(F.lit("timestamp"), when)))
    grouped = one.groupBy("start_time", F.col("template_id").cast("string").alias("tid")).agg(F.min_by("template_str", order).alias("template_str"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.map_entries("inst").alias("e")))), lambda s: F.map_from_entries(s["e"])).alias("instances"))
    return grouped.groupBy("start_time").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("tid", F.struct("template_str", "instances"))))).alias("templates"))


def latency(records: DataFrame, threshold: float = SPIKE_MS, order: str = "ord", minutes: int = 5) -> DataFrame:
    """Last value of each latency column in each bucket by input order, and the spike flag of the last non-zero write."""
    rows = records.withColumn("start_time", aligned(F.col("ts"), minutes))
    last = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in LATENCY if c in records.columns]
    write = F.col("write_latency_ms")
    spike = F.coalesce(F.max_by(F.when(write != 0, write > threshold), F.when(write != 0, F.col(order))), F.lit(False)).alias("has_spike")
    return rows.groupBy("start_time").agg(*last, spike)


def fill_system(buckets: DataFrame, records: DataFrame, columns: list[str], minutes: int = 5, order: list[str] | None = None) -> DataFrame:
    """buckets with the columns of the latest system record at or before the bucket's end."""
    own = buckets.withColumn("asof_end", bucket_end(F.col("start_time"), minutes))
    return asof_last(own, "asof_end", records, "timestamp", columns, order).drop("asof_end")


def build(events: DataFrame, latencies: DataFrame | None = None, systems: DataFrame | None = None, minutes: int = 5, threshold: float = SPIKE_MS, dense: bool = False) -> DataFrame:
    """The bucket table of events (ts, level, component, template_id, template_str, params, ord).

    Buckets without an event exist only if dense, which fills the range from the first to the last.
    """
    own = dedupe(assign(events, minutes))
    out = count_levels(own).join(component_json(own), "start_time").join(template_json(own), "start_time", "left")
    if dense:
        out = all_starts(out, minutes).join(out, "start_time", "left").fillna(0, list(COUNTS))
    if latencies is not None:
        out = out.join(latency(latencies, threshold, minutes=minutes), "start_time", "left")
        out = out.withColumn("has_spike", F.coalesce("has_spike", F.lit(False)))
    if systems is not None:
        out = fill_system(out, systems, [c for c in SYSTEM if c in systems.columns], minutes)
    return out.withColumn("bucket_id", bucket_id(F.col("start_time"))).withColumn("end_time", bucket_end(F.col("start_time"), minutes))


def all_starts(buckets: DataFrame, minutes: int = 5) -> DataFrame:
    """Every bucket start from the table's first to its last."""
    return buckets.agg(F.min("start_time").alias("a"), F.max("start_time").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))).alias("start_time"))


def rows_to_write(buckets: DataFrame) -> DataFrame:
    """The bucket table's columns in their fixed order, those that are missing as nulls, sorted by start within the partitions."""
    have = set(buckets.columns)
    columns = ["bucket_id", "start_time", "end_time", *LATENCY, "has_spike", *SYSTEM, *COUNTS, "component_counts_json", "templates"]
    more = [c for c in buckets.columns if c not in columns]
    return buckets.select(*(F.col(c) if c in have else F.lit(None).cast(TYPES.get(c, "bigint")).alias(c) for c in columns), *more).sortWithinPartitions("start_time")


def _merged_templates(every: DataFrame, order: str) -> DataFrame:
    """(bucket_id, templates): equal instances count once; they are ordered by their time's text, then by all they hold."""
    read = F.explode(F.from_json("templates", TEMPLATES_TYPE))
    one = every.where("templates IS NOT NULL").select("bucket_id", order, read.alias("tid", "t")).select("bucket_id", order, "tid", F.nullif("t.template_str", F.lit("")).alias("text"), F.explode_outer("t.instances").alias("inst"))
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("inst"))))
    texts = one.groupBy("bucket_id", "tid").agg(F.min_by("text", F.when(F.col("text").isNotNull(), F.col(order))).alias("template_str"))
    found = one.where("inst IS NOT NULL").select("bucket_id", "tid", key.alias("key")).distinct()
    at = F.coalesce(F.get_json_object("key", "$.timestamp"), F.lit(""))
    listed = found.groupBy("bucket_id", "tid").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "key"))).alias("found"))
    whole = texts.join(listed, ["bucket_id", "tid"], "left").select("bucket_id", F.struct("tid", "template_str", F.coalesce(F.col("found.key"), F.array().cast("array<string>")).alias("keys")).alias("t"))
    instances = lambda t: F.transform(t["keys"], lambda k: F.from_json(k, "map<string,string>"))
    entries = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["tid"].alias("key"), F.struct(t["template_str"].alias("template_str"), instances(t).alias("instances")).alias("value")))
    return whole.groupBy("bucket_id").agg(F.to_json(F.map_from_entries(entries)).alias("templates"))


def _merged_components(every: DataFrame) -> DataFrame:
    """(bucket_id, component_counts_json): sums by component."""
    counts = every.select("bucket_id", F.explode(F.from_json("component_counts_json", "map<string,string>")).alias("component", "n")).withColumn("n", F.col("n").try_cast("bigint")).where("n IS NOT NULL").groupBy("bucket_id", "component").agg(F.sum("n").alias("n"))
    return counts.groupBy("bucket_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "n"))))).alias("component_counts_json"))


def merge(parts: list[DataFrame], order: str = "part") -> DataFrame:
    """One row for each bucket of several tables: counts and component counts add, times widen, templates unite, snapshots are
    the first that is not null, spikes or. `batches`, if there is such a column, is the set of all."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.withColumn(order, F.lit(i)) for i, p in enumerate(parts)))
    have = set(every.columns)
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in (*LATENCY, *SYSTEM) if c in have]
    more = [F.coalesce(F.bool_or("has_spike"), F.lit(False)).alias("has_spike")] * ("has_spike" in have)
    more += [F.array_sort(F.array_distinct(F.flatten(F.collect_list("batches")))).alias("batches")] * ("batches" in have)
    out = every.groupBy("bucket_id").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), *(F.sum(c).alias(c) for c in COUNTS if c in have), *first, *more)
    if "component_counts_json" in have:
        out = out.join(_merged_components(every), "bucket_id", "left")
    return out.join(_merged_templates(every, order), "bucket_id", "left") if "templates" in have else out


def merge_components(parts: list[DataFrame]) -> DataFrame:
    """Sums of component counts (start_time, component, n) over several tables."""
    return reduce(DataFrame.unionByName, parts).groupBy("start_time", "component").agg(F.sum("n").alias("n"))


def existing(spark, path: str) -> DataFrame | None:
    """The table at path; None if there is none."""
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None


def upsert(spark, path: str, new: DataFrame, batch: str | None = None) -> None:
    """Merge new buckets into the table at path, which is partitioned by day; only days that change are written.

    batch: a name of what is merged. Each bucket remembers its batches, and one that it has is not merged again, so a
    batch that is run again gives the same table.
    """
    own = new.withColumn("batches", F.array(F.lit(batch)) if batch is not None else F.array().cast("array<string>"))
    old = existing(spark, path)
    if old is None:
        merged = merge([own])
    else:
        days = own.select(F.to_date("start_time").alias("bucket_date")).distinct()
        kept = old.join(days, "bucket_date", "left_semi").drop("bucket_date")
        kept = kept if "batches" in kept.columns else kept.withColumn("batches", F.array().cast("array<string>"))
        if batch is not None:
            own = own.join(kept.where(F.array_contains("batches", F.lit(batch))).select("bucket_id"), "bucket_id", "left_anti")
        merged = merge([kept, own]).checkpoint()
    rows_to_write(merged).withColumn("bucket_date", F.to_date("start_time")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_date").parquet(path)

"""Look-back planning around an incident's first anchor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.functions.timing import minutes_before, seconds_of
from stratalog.sources.discovery import load_json, save_json

SLICE_COUNTS = ("total_events", "error_count", "warning_count", "info_count")


def anchor_id(incident: str) -> str:
    """The digits that end an incident's id."""
    import re

    found = re.search(r"(\d+)$", incident)
    return found[1] if found else incident


def anchors(instances: DataFrame, anchor: str, equivalents: list[str] = ()) -> DataFrame:
    """Buckets with the anchor template, and the first time of it or its equivalents there, else the bucket's start."""
    own = instances.where(F.col("template_id").isin([anchor, *equivalents]))
    found = own.groupBy("bucket_id", "start_time", "end_time").agg(F.coalesce(F.min("ts"), F.first("start_time")).alias("t_symptom"), F.bool_or(F.col("template_id") == anchor).alias("has"))
    return found.where("has").drop("has")


def first_anchor(instances: DataFrame, anchor: str, equivalents: list[str] = ()) -> DataFrame:
    return anchors(instances, anchor, equivalents).orderBy("start_time", "bucket_id").limit(1)


def window_buckets(buckets: DataFrame, t_symptom, lead_minutes: int, filters: Column | None = None) -> DataFrame:
    """Buckets that end after the window's start and begin at or before the symptom."""
    at = F.lit(t_symptom)
    out = buckets.where((F.col("end_time") > minutes_before(at, lead_minutes)) & (F.col("start_time") <= at))
    return out if filters is None else out.where(filters)


def classified(instances: DataFrame, t_symptom, anchor: str, equivalents: list[str] = ()) -> DataFrame:
    """Instances with their phase: before or after the symptom (those at it are none of both), and candidates among those before."""
    at, ts = F.lit(t_symptom), F.coalesce("ts", "start_time")
    phase = F.when(ts < at, "pre_incident").when(ts > at, "post_incident")
    out = instances.withColumn("event_time", ts).withColumn("phase", phase).where("phase IS NOT NULL")
    return out.withColumn("candidate", (F.col("phase") == "pre_incident") & ~F.col("template_id").isin([anchor, *equivalents]))


def lead_used(instances: DataFrame, t_symptom, anchor: str, equivalents: list[str], lead: int, most: int, until_found: bool = True) -> tuple[int, int]:
    """(minutes, doublings): the lead doubles up to the most while no candidate is in the window.

    One query gives the latest candidate's bucket end. until_found=False doubles to the most once no candidate is in the first window.
    """
    rows = classified(window_buckets(instances, t_symptom, most), t_symptom, anchor, equivalents).where("candidate")
    nearest = rows.agg((seconds_of(F.lit(t_symptom).cast("timestamp_ntz")) - F.max(seconds_of(F.col("end_time")))).alias("s")).first()["s"]
    used, steps = lead, 0
    while used < most and not (nearest is not None and nearest < (used if until_found or not steps else -1) * 60):
        used, steps = min(used * 2, most), steps + 1
    return used, steps


def slice_metrics(buckets: DataFrame) -> DataFrame:
    """Counts of each bucket of a window and their changes from the one before; the first changes by 0."""
    order = Window.orderBy("start_time")
    return buckets.select(F.col("start_time").alias("slice_start"), F.col("end_time").alias("slice_end"), *SLICE_COUNTS, *(F.coalesce(F.col(c) - F.lag(c).over(order), F.lit(0)).cast("long").alias(f"delta_{c}") for c in SLICE_COUNTS))


def controls(window: DataFrame, anchor_bucket: str) -> DataFrame:
    """The same window without the anchor's bucket."""
    return window.where(F.col("bucket_id") != anchor_bucket)


def build_windows(buckets: DataFrame, instances: DataFrame, anchor: str, equivalents: list[str] = (), lead: int = 15, most: int = 60, filters: Column | None = None, manual: int | None = None) -> dict | None:
    """Events, metrics, events after the incident and a summary of the window before the first anchor; None without one.

    manual: minutes of look-back that are taken as they are, whatever the window holds.
    """
    row = first_anchor(instances, anchor, list(equivalents)).first()
    if row is None:
        return None
    at = row["t_symptom"]
    used, steps = lead_used(instances, at, anchor, list(equivalents), lead, most) if manual is None else (manual, 0)
    window = window_buckets(buckets, at, used, filters)
    own = instances.join(window.select("bucket_id").distinct(), "bucket_id", "left_semi")
    events = classified(own, at, anchor, list(equivalents))
    kept = ["bucket_id", "template_id", "template_str", "event_time", "instance_index", "vars"]
    positive = events.where("phase = 'pre_incident'").select(*kept, "phase").withColumn("window_type", F.lit("positive"))
    control = controls(own, row["bucket_id"]).withColumn("event_time", F.coalesce("ts", "start_time")).select(*kept, F.lit("control").alias("phase")).withColumn("window_type", F.lit("control"))
    metrics = reduce(DataFrame.unionByName, (slice_metrics(d).withColumn("window_type", F.lit(t)) for d, t in ((window, "positive"), (controls(window, row["bucket_id"]), "control"))))
    told = events.agg(F.count_distinct(F.when(F.col("candidate"), F.col("template_id"))).alias("n")).first()["n"]
    first, covered = window.agg(F.min("start_time"), F.sum(seconds_of(F.col("end_time")) - seconds_of(F.col("start_time")))).first()
    summary = {
        "incident_id": anchor, "lead_time_minutes": lead, "lead_time_used_minutes": used, "expansion_count": steps, "manual_expansion_override": manual, "t_symptom": str(at), "templates_seen": told,
        "anchors_analyzed": 1, "coverage_minutes": (covered or 0) / 60, "actual_lead_time_minutes": max(0, int((at - first).total_seconds() // 60)) if first else 0,
    }
    return {"events": positive.unionByName(control), "metrics": metrics, "post_incident": events.where("phase = 'post_incident'").select(*kept, "phase"), "summary": summary}


ARTIFACTS = ("events", "metrics", "post_incident")


def write_artifacts(spark: SparkSession, found: dict, folder: str) -> None:
    """Parquet tables of a window's events, metrics and later events, and its summary as JSON; empty tables keep their columns."""
    for name in ARTIFACTS:
        found[name].write.mode("overwrite").parquet(f"{folder}/window_{name}")
    save_json(spark, f"{folder}/window_summary.json", found["summary"])


def read_artifacts(spark: SparkSession, folder: str) -> dict:
    """What write_artifacts wrote, so that a later run need not look for the window again."""
    return {name: spark.read.parquet(f"{folder}/window_{name}") for name in ARTIFACTS} | {"summary": load_json(spark, f"{folder}/window_summary.json")}

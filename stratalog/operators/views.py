"""Views of buckets for a person: details, a comparison of two, their events by level, component and template."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.display import CRITICAL, HIGH, bar, panel, range_text, table, tree
from stratalog.functions.text import severity
from stratalog.operators.buckets import LEVELS
from stratalog.operators.select import displayable

PERFORMANCE = ("read_latency_ms", "write_latency_ms", "read_iops", "write_iops", "read_throughput_bps", "write_throughput_bps")
RESOURCES = ("cpu_util", "memory_util", "disk_util")
COMPARED = ("total_events", *LEVELS, *PERFORMANCE[:4], *RESOURCES)
TOP_COMPONENTS = 10


def details(buckets: DataFrame) -> DataFrame:
    """Buckets with the share of each level in percent, events a minute, minutes, severity, and the state of each resource."""
    out = displayable(buckets)
    share = lambda c: F.when(F.col("total_events") > 0, 100.0 * F.col(c) / F.col("total_events")).otherwise(0.0)
    state = lambda c: F.when(F.col(c) >= CRITICAL, "critical").when(F.col(c) >= HIGH, "high").when(F.col(c).isNotNull(), "normal")
    return out.withColumns({f"{c.removesuffix('_count')}_share": share(c) for c in LEVELS} | {f"{c}_state": state(c) for c in RESOURCES if c in buckets.columns} | {"severity": severity(F.col("error_rate"))})


def compare(buckets: DataFrame, first: str, second: str) -> DataFrame:
    """(metric, first, second, change, change_percent) of two buckets by their ids; a metric that neither has is left out."""
    have = [c for c in COMPARED if c in buckets.columns]
    own = buckets.where(F.col("bucket_id").isin(first, second)).select("bucket_id", *(F.col(c).cast("double").alias(c) for c in have)).unpivot("bucket_id", have, "metric", "value")
    value = lambda b: F.max(F.when(F.col("bucket_id") == b, F.col("value")))
    both = own.groupBy("metric").agg(value(first).alias("first"), value(second).alias("second")).where("first IS NOT NULL OR second IS NOT NULL")
    change = F.col("second") - F.col("first")
    return both.select("metric", "first", "second", change.alias("change"), F.when(F.col("first") != 0, 100.0 * change / F.col("first")).alias("change_percent"))


def components(buckets: DataFrame, top: int = TOP_COMPONENTS) -> DataFrame:
    """(bucket_id, component, n, rank): the components with most events of each bucket."""
    rows = buckets.select("bucket_id", F.explode(F.from_json("component_counts_json", "map<string,bigint>")).alias("component", "n"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("bucket_id").orderBy(F.desc("n"), "component"))).where(F.col("rank") <= top)


def bucket_text(row: dict, parts: list[tuple[str, int]] = ()) -> str:
    """Panels of one bucket of details(): its range, events by level, performance, resources, and its components."""
    levels = [(c.removesuffix("_count"), row.get(c) or 0, f"{row.get(f'{c.removesuffix('_count')}_share') or 0.0:.1f} %") for c in LEVELS]
    shown = [
        panel(row["bucket_id"], [range_text(row["start_time"], row["end_time"]), f"{row['total_events']} events, {row['events_per_minute']:.1f} a minute", f"errors {row['error_rate']:.1f} % ({row['severity']})"]),
        panel("events", [table(("level", "events", "share"), levels)]),
    ]
    if any(row.get(c) is not None for c in PERFORMANCE):
        shown.append(panel("performance", [table(("", "read", "write"), [(what, row.get(f"read_{what}"), row.get(f"write_{what}")) for what in ("latency_ms", "iops", "throughput_bps")]), *(["latency spike"] if row.get("has_spike") else [])]))
    if any(row.get(c) is not None for c in RESOURCES):
        shown.append(panel("resources", [f"{c.removesuffix('_util'):<8}{bar(row.get(c))}" for c in RESOURCES]))
    return "\n".join([*shown, tree("components", parts)] if parts else shown)


def compare_text(rows: list) -> str:
    return table(("metric", "first", "second", "change", "percent"), [(r["metric"], r["first"], r["second"], r["change"], r["change_percent"]) for r in rows])


def bucket_texts(buckets: DataFrame, limit: int = 100) -> list[str]:
    """The panels of the first buckets in time, at most `limit` of them, as a console shows."""
    rows = details(buckets).orderBy("start_time").limit(limit)
    parts: dict[str, list] = {}
    if "component_counts_json" in buckets.columns:
        for r in components(buckets.join(rows.select("bucket_id"), "bucket_id", "left_semi")).orderBy("bucket_id", "rank").collect():
            parts.setdefault(r["bucket_id"], []).append((r["component"], r["n"]))
    return [bucket_text(r.asDict(), parts.get(r["bucket_id"], [])) for r in rows.collect()]

"""Features of look-back windows, kept long (window_id, feature, value) until they are assembled."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.text import number, value_kind
from stratalog.functions.timing import seconds_of

METRIC_FIELDS = ("read_latency_ms", "write_latency_ms", "read_iops", "write_iops", "cpu_util", "memory_util", "disk_util", "total_events", "error_count")
TOP_TEMPLATES, TOP_VARIABLES, TOP_VALUES, ONE_HOT = 200, 20, 10, 5
_TIME_KEYS = ("timestamp", "ts")


def variable_values(instances: DataFrame) -> DataFrame:
    """(window_id, template_id, var, value, order) of each variable that is no time."""
    rows = instances.select("window_id", "template_id", F.struct("start_time", "instance_index").alias("order"), F.explode("vars").alias("var", "value"))
    return rows.where(~F.col("var").isin(*_TIME_KEYS))


def inventory(instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(templates, variables): total instances; kind, observations and rank of each template's 20 most observed variables."""
    templates = instances.groupBy("template_id").agg(F.count(F.lit(1)).alias("total_instances"))
    kinds = variable_values(instances).groupBy("template_id", "var").agg(F.count(F.lit(1)).alias("n"), value_kind("value").alias("kind"))
    rank = F.row_number().over(Window.partitionBy("template_id").orderBy(F.desc("n"), "var"))
    return templates, kinds.withColumn("rank", rank).where(F.col("rank") <= TOP_VARIABLES)


def top_values(instances: DataFrame, n: int = TOP_VALUES) -> DataFrame:
    """The n most frequent values of each variable, ties by value."""
    counts = variable_values(instances).where("value IS NOT NULL").groupBy("template_id", "var", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("template_id", "var").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def top_templates(templates: DataFrame, n: int = TOP_TEMPLATES) -> DataFrame:
    return templates.orderBy(F.desc("total_instances"), "template_id").limit(n)


def metric_features(members: DataFrame, buckets: DataFrame, fields: tuple[str, ...] = METRIC_FIELDS) -> DataFrame:
    """Current (last bucket), mean and delta (last two values) of each metric over a window's buckets, nulls left out of the last two."""
    have = [f for f in fields if f in buckets.columns]
    rows = members.select("window_id", "bucket_id", "start_time").join(buckets.select("bucket_id", *have), "bucket_id")
    told = rows.groupBy("window_id").agg(
        *(F.max_by(F.struct(F.col(f).cast("double").alias("v")), "start_time")["v"].alias(f"metric_current_{f}") for f in have),
        *(F.avg(F.col(f).cast("double")).alias(f"metric_mean_{f}") for f in have),
        *(F.array_sort(F.collect_list(F.when(F.col(f).isNotNull(), F.struct("start_time", F.col(f).cast("double").alias("v"))))).alias(f"seq_{f}") for f in have),
    )
    told = told.withColumns({f"metric_delta_{f}": F.when(F.size(f"seq_{f}") > 1, F.element_at(f"seq_{f}", -1)["v"] - F.get(f"seq_{f}", F.size(f"seq_{f}") - 2)["v"]) for f in have}).drop(*(f"seq_{f}" for f in have))
    return told.unpivot("window_id", [c for c in told.columns if c != "window_id"], "feature", "value").where("value IS NOT NULL")


def template_features(instances: DataFrame) -> DataFrame:
    """Presence, count and minutes from the earliest instance to the window's end, of each template in a window."""
    lead = (seconds_of(F.first("window_end")) - seconds_of(F.min("ts"))) / 60
    told = instances.groupBy("window_id", "template_id").agg(F.count(F.lit(1)).cast("double").alias("count"), lead.alias("lead_minutes")).withColumn("present", F.lit(1.0))
    return told.unpivot(["window_id", "template_id"], ["present", "count", "lead_minutes"], "kind", "value").where("value IS NOT NULL").select("window_id", F.concat(F.lit("template_"), "kind", F.lit("_"), "template_id").alias("feature"), "value")


def numeric_features(instances: DataFrame, kinds: DataFrame) -> DataFrame:
    """Mean and last value of numeric variables; values that are no numbers are left out."""
    rows = variable_values(instances).join(kinds.where("kind = 'numeric'").select("template_id", "var"), ["template_id", "var"]).withColumn("x", number(F.col("value"))).where("x IS NOT NULL")
    told = rows.groupBy("window_id", "template_id", "var").agg(F.avg("x").alias("mean"), F.max_by("x", "order").alias("last"))
    return told.unpivot(["window_id", "template_id", "var"], ["mean", "last"], "kind", "value").select("window_id", F.concat_ws("_", F.lit("template"), "template_id", "var", "kind").alias("feature"), "value")


def categorical_features(instances: DataFrame, kinds: DataFrame, n: int = ONE_HOT) -> DataFrame:
    """1 for each of a variable's most frequent values that a window has."""
    allowed = top_values(instances, n).join(kinds.where("kind <> 'numeric'").select("template_id", "var"), ["template_id", "var"]).select("template_id", "var", "value")
    rows = variable_values(instances).join(allowed, ["template_id", "var", "value"]).select("window_id", "template_id", "var", "value").distinct()
    return rows.select("window_id", F.concat(F.lit("template_"), "template_id", F.lit("_"), "var", F.lit("="), "value").alias("feature"), F.lit(1.0).alias("value"))


def rows_of(members: DataFrame) -> DataFrame:
    """(window_id, label, bucket_id, timestamp): the last bucket of each window stands for it."""
    return members.groupBy("window_id", "label").agg(F.max_by("bucket_id", "start_time").alias("bucket_id"), F.max("start_time").alias("timestamp"))


def build(members: DataFrame, buckets: DataFrame, instances: DataFrame, fields: tuple[str, ...] = METRIC_FIELDS, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All features of all windows, long. Templates beyond the 200 with most instances are left out.

    keep: computes a table once; without it the inventory is planned anew within each kind of feature, and all kinds in one plan.
    """
    templates, kinds = inventory(instances)
    top, kinds = keep(top_templates(templates).select("template_id")), keep(kinds)
    kept = instances.join(top, "template_id", "left_semi")
    kinds_of = (metric_features(members, buckets, fields), template_features(kept), numeric_features(kept, kinds), categorical_features(kept, kinds))
    return reduce(DataFrame.unionByName, map(keep, kinds_of))


def assemble(rows: DataFrame, features: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """rows with a vector column `features`: the named features in order, 0 where a window has none."""
    from pyspark.ml.functions import array_to_vector

    names = names or [r[0] for r in features.select("feature").distinct().orderBy("feature").collect()]
    maps = features.groupBy("window_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    order = F.split(F.lit("\x00".join(names)), "\x00")
    vector = array_to_vector(F.transform(order, lambda n: F.coalesce(F.col("m")[n], F.lit(0.0))))
    return rows.join(maps, "window_id", "left").withColumn("features", vector).drop("m"), names

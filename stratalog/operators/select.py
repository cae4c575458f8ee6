"""Selections over the bucket table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__", "eq": "__eq__", "ne": "__ne__"}


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def by_flags(buckets: DataFrame, limit: int | None = None, **flags: bool) -> DataFrame:
    if not flags:
        raise ValueError("at least one flag is needed")
    return _limited(buckets.where(reduce(and_, (F.col(k) == F.lit(bool(v)) for k, v in flags.items()))), limit)


def threshold(name: str, value) -> Column:
    """The predicate of `field_gt` and the like."""
    field, _, operator = name.rpartition("_")
    if operator not in OPERATORS or not field:
        raise ValueError(f"{name} does not end in one of {', '.join(OPERATORS)}")
    return getattr(F.col(field), OPERATORS[operator])(F.lit(value))


def by_thresholds(buckets: DataFrame, limit: int | None = None, **thresholds: float) -> DataFrame:
    if not thresholds:
        raise ValueError("at least one threshold is needed")
    return _limited(buckets.where(reduce(and_, (threshold(k, v) for k, v in thresholds.items()))), limit)


def by_time_range(buckets: DataFrame, start, end) -> DataFrame:
    """Buckets that overlap [start, end)."""
    if not start < end:
        raise ValueError("start must be before end")
    return buckets.where((F.col("start_time") < F.lit(end)) & (F.col("end_time") > F.lit(start)))


def top_n(buckets: DataFrame, field: str, n: int = 5) -> DataFrame:
    return buckets.orderBy(F.desc_nulls_last(field), "bucket_id").limit(n)


def bottom_n(buckets: DataFrame, field: str, n: int = 5) -> DataFrame:
    return buckets.orderBy(F.asc_nulls_last(field), "bucket_id").limit(n)


def get_random(buckets: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    have = buckets.count()
    if n < 1 or n > have:
        raise ValueError(f"{n} rows cannot be drawn from {have}")
    return buckets.orderBy(F.rand(seed)).limit(n)


def where_equal(buckets: DataFrame, columns: list[str] | None = None, **filters) -> DataFrame:
    """Rows whose columns equal the given values (None: are null), and their columns of interest. Values have the columns' types."""
    out = reduce(lambda d, kv: d.where(F.col(kv[0]).isNull() if kv[1] is None else F.col(kv[0]) == F.lit(kv[1])), filters.items(), buckets)
    return out.select(*columns) if columns else out


def by_ids(buckets: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    return buckets.join(ids.select("bucket_id").distinct(), "bucket_id", "left_semi").select("bucket_id", *columns)


def event_count(buckets: DataFrame) -> DataFrame:
    return buckets.agg(F.coalesce(F.sum("total_events"), F.lit(0)).alias("events"))


def info(buckets: DataFrame) -> DataFrame:
    """Number of buckets, first start and last end; nulls for an empty table."""
    return buckets.agg(F.count(F.lit(1)).alias("buckets"), F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end"))


def displayable(buckets: DataFrame) -> DataFrame:
    """NaN as null in double columns, null as false in boolean ones, and the derived columns of a display."""
    kinds = dict(buckets.dtypes)
    out = buckets.withColumns({c: F.when(~F.isnan(c), F.col(c)) if k == "double" else F.coalesce(c, F.lit(False)) for c, k in kinds.items() if k in ("double", "boolean")})
    rate = F.when(F.col("total_events") > 0, 100.0 * F.col("error_count") / F.col("total_events")).otherwise(0.0)
    minutes = (F.unix_timestamp(F.col("end_time").cast("timestamp")) - F.unix_timestamp(F.col("start_time").cast("timestamp"))) / 60
    return out.withColumns({"duration_minutes": minutes, "error_rate": rate, "events_per_minute": F.when(minutes > 0, F.col("total_events") / minutes).otherwise(0.0)})

"""As-of and interval joins that do not compare all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.timing import seconds_of


def asof_last(left: DataFrame, left_time: str, right: DataFrame, right_time: str, right_columns: list[str], order: list[str] | None = None, by: list[str] | None = None, span_hours: int | None = None) -> DataFrame:
    """left with the columns of the latest right row whose time is not after left's.

    Both sides go into one ordered stream in which the last right row is carried forward. Without keys `by` the stream is
    cut into spans of time that are filled on their own, and each span then takes over the last row of the spans before
    it: one row for each span is all that a single task ever sees.
    """
    hours = span_hours or 1
    own = F.struct(*(F.col(c) for c in right_columns))
    rest = F.struct(*(F.col(c) for c in left.columns))
    tie = F.struct(*(F.col(c) for c in order)) if order else F.lit(0)
    stream = right.select(F.col(right_time).alias("at"), F.lit(0).alias("kind"), tie.alias("tie"), own.alias("found"), *(F.col(b).alias(f"by_{b}") for b in by or []))
    ask = left.select(F.col(left_time).alias("at"), F.lit(1).alias("kind"), rest.alias("row"), *(F.col(b).alias(f"by_{b}") for b in by or []))
    both = stream.unionByName(ask, allowMissingColumns=True).withColumn("span", F.floor(seconds_of(F.col("at")) / (3600 * hours)))
    keys = [f"by_{b}" for b in by or []]
    inside = Window.partitionBy(*keys, "span").orderBy("at", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("here", F.last("found", ignorenulls=True).over(inside))
    ends = both.where("kind = 0").groupBy(*keys, "span").agg(F.max_by("found", F.struct("at", "tie")).alias("end"))
    spans = both.groupBy(*keys, "span").agg(F.lit(0).alias("z")).join(ends, [*keys, "span"], "left")
    before = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*keys, "span", F.last("end", ignorenulls=True).over(before).alias("earlier"))
    out = filled.where("kind = 1").join(carried, [*keys, "span"], "left").withColumn("got", F.coalesce("here", "earlier"))
    return out.select("row.*", *(F.col(f"got.{c}").alias(c) for c in right_columns))


def interval_join(points: DataFrame, point_time: str, intervals: DataFrame, start: str, end: str, bin_minutes: int) -> DataFrame:
    """Pairs of a point and an interval with start <= point < end, by equality of time bins.

    An interval is repeated for each bin that it touches, so bin_minutes should be near to its length.
    """
    width = bin_minutes * 60
    cells = F.sequence(F.floor(seconds_of(F.col(start)) / width), F.floor(seconds_of(F.col(end)) / width))
    spread = intervals.withColumn("bin", F.explode(cells))
    placed = points.withColumn("bin", F.floor(seconds_of(F.col(point_time)) / width))
    return placed.join(spread, "bin").where((F.col(point_time) >= F.col(start)) & (F.col(point_time) < F.col(end))).drop("bin")

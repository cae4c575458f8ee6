"""Ranks, neighbours and running values over a whole table in order, without one task that sorts all of it.

A span is a number that does not fall in the order, such as the hour of a time or a slice of a score. Rows are ordered
within their span, and what a span takes over from those before it comes from a table with one small row for each span.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.timing import seconds_of

#: Columns that the functions add on the way.
_SPAN, _TAKEN = "ordered_span", "ordered_taken"


def hours(ts: Column, n: float = 24) -> Column:
    """The span of a time: its n hours since the epoch; null times lie before all."""
    return F.coalesce(F.floor(seconds_of(ts) / (3600 * n)), F.lit(-(1 << 60)))


def slices(score: Column, n: int = 1024) -> Column:
    """The span of a score between 0 and 1; others lie in the first or last one, nulls before all."""
    return F.coalesce(F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score.cast("double"))) * n), F.lit(-1))


def _inside(by: tuple[str, ...], order: list[Column]) -> Window:
    return Window.partitionBy(*by, _SPAN).orderBy(*order)


def _before(by: tuple[str, ...]) -> Window:
    return Window.partitionBy(*by).orderBy(_SPAN).rowsBetween(Window.unboundedPreceding, -1)


def _with_taken(rows: DataFrame, taken: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """rows with what their span takes over; groups whose key is null are groups too."""
    own = taken.select(F.col(_SPAN).alias("taken_span"), *(F.col(b).alias(f"taken_{b}") for b in by), _TAKEN)
    same = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"taken_{b}")) for b in by), F.col(_SPAN) == F.col("taken_span"))
    return rows.join(own, same, "left").drop("taken_span", *(f"taken_{b}" for b in by))


def row_numbers(df: DataFrame, span: Column, order: list[Column], name: str, total: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `name`, the place of each row in the order from 1, and `total`, the number of rows; by: for each of these on its own."""
    rows = df.withColumn(_SPAN, span)
    sizes = rows.groupBy(*by, _SPAN).agg(F.count(F.lit(1)).alias("n"))
    taken = sizes.select(*by, _SPAN, F.struct(F.coalesce(F.sum("n").over(_before(by)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(*by)).alias("all")).alias(_TAKEN))
    out = _with_taken(rows.withColumn(name, F.row_number().over(_inside(by, order)).cast("long")), taken, by)
    out = out.withColumn(name, F.col(name) + F.col(f"{_TAKEN}.before"))
    return (out.withColumn(total, F.col(f"{_TAKEN}.all")) if total else out).drop(_SPAN, _TAKEN)


def previous(df: DataFrame, value: Column, span: Column, order: list[Column], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `name`, the value of the row before; null for the first."""
    rows = df.withColumn(_SPAN, span).withColumn("ordered_value", F.struct(value.alias("v")))
    at = F.struct(*(F.struct(c.alias("c")) for c in order))
    ends = rows.groupBy(*by, _SPAN).agg(F.max_by("ordered_value", at).alias("end"))
    taken = ends.select(*by, _SPAN, F.last("end", ignorenulls=True).over(_before(by)).alias(_TAKEN))
    out = _with_taken(rows.withColumn(name, F.lag("ordered_value").over(_inside(by, order))), taken, by)
    return out.withColumn(name, F.coalesce(F.col(name), F.col(_TAKEN))["v"]).drop(_SPAN, _TAKEN, "ordered_value")


def following(df: DataFrame, value: Column, span: Column, order: list[Column], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `name`, the value of the row after; null for the last."""
    rows = df.withColumn(_SPAN, span).withColumn("ordered_value", F.struct(value.alias("v")))
    at = F.struct(*(F.struct(c.alias("c")) for c in order))
    begins = rows.groupBy(*by, _SPAN).agg(F.min_by("ordered_value", at).alias("begin"))
    after = Window.partitionBy(*by).orderBy(F.desc(_SPAN)).rowsBetween(Window.unboundedPreceding, -1)
    taken = begins.select(*by, _SPAN, F.last("begin", ignorenulls=True).over(after).alias(_TAKEN))
    out = _with_taken(rows.withColumn(name, F.lead("ordered_value").over(_inside(by, order))), taken, by)
    return out.withColumn(name, F.coalesce(F.col(name), F.col(_TAKEN))["v"]).drop(_SPAN, _TAKEN, "ordered_value")


def running(df: DataFrame, value: Column, span: Column, order: list[Column], name: str, kind: str = "sum", own: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `name`, the sum or the maximum (kind) of the values up to each row, the row's own among them or not."""
    rows = df.withColumn(_SPAN, span).withColumn("ordered_value", value)
    fold = {"sum": F.sum, "max": F.max}[kind]
    frame = _inside(by, order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    sums = rows.groupBy(*by, _SPAN).agg(fold("ordered_value").alias("all"))
    taken = sums.select(*by, _SPAN, fold("all").over(_before(by)).alias(_TAKEN))
    out = _with_taken(rows.withColumn(name, fold("ordered_value").over(frame)), taken, by)
    if kind == "sum":
        both = F.coalesce(F.col(name) + F.col(_TAKEN), F.col(name), F.col(_TAKEN))
    else:
        both = F.greatest(name, _TAKEN)
    return out.withColumn(name, both).drop(_SPAN, _TAKEN, "ordered_value")

"""Labels, episodes and look-back windows of buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.timing import minutes_before, seconds_of
from stratalog.operators import ordered as O


def symptoms(instances: DataFrame, template_ids: list[str], substring: str | None = None, variables: dict[str, str] | None = None) -> DataFrame:
    """Timed instances of the templates; the substring may lie in any variable's value, and variables must be equal."""
    out = instances.where(F.col("template_id").isin(list(template_ids)) & F.col("ts").isNotNull())
    if substring:
        out = out.where(F.exists(F.map_values("vars"), lambda v: F.contains(F.lower(v), F.lit(substring.lower()))))
    for key, value in (variables or {}).items():
        out = out.where(F.col("vars")[key] == F.lit(str(value)))
    return out


def label_buckets(buckets: DataFrame, symptom_instances: DataFrame) -> DataFrame:
    """(bucket_id, start_time, label, symptom_time, window_end).

    Positive buckets have a symptom, and their window ends at the first. Negative are all others but the last bucket and
    those whose next bucket is positive; their window ends with them.
    """
    first = symptom_instances.groupBy("bucket_id").agg(F.min("ts").alias("symptom_time"))
    rows = buckets.select("bucket_id", "start_time", "end_time").join(first, "bucket_id", "left").withColumn("label", F.col("symptom_time").isNotNull().cast("int"))
    rows = O.following(rows, F.col("label"), O.hours(F.col("start_time")), [F.col("start_time")], "following").where("label = 1 OR following = 0")
    return rows.select("bucket_id", "start_time", "label", "symptom_time", F.coalesce("symptom_time", "end_time").alias("window_end"))


def symptom_times(symptom_instances: DataFrame) -> DataFrame:
    """(ts): the distinct times of symptoms."""
    return symptom_instances.select("ts").where(F.col("ts").isNotNull()).distinct()


def episodes(times: DataFrame, gap_minutes: float, column: str = "ts") -> DataFrame:
    """(episode, first time, last time, n): times further than the gap behind the one before begin an episode."""
    order, span = [F.col(column)], O.hours(F.col(column))
    rows = O.previous(times.select(column), seconds_of(F.col(column)), span, order, "before")
    new = F.coalesce((seconds_of(F.col(column)) - F.col("before") > gap_minutes * 60).cast("int"), F.lit(1))
    numbered = O.running(rows.withColumn("new", new), F.col("new"), span, order, "episode")
    return numbered.groupBy("episode").agg(F.min(column).alias("first_ts"), F.max(column).alias("last_ts"), F.count(F.lit(1)).alias("n"))


def gaps(times: DataFrame, column: str = "ts") -> DataFrame:
    """Positive minutes between distinct times in order."""
    rows = times.select(column).where(F.col(column).isNotNull()).distinct()
    told = O.previous(rows, seconds_of(F.col(column)), O.hours(F.col(column)), [F.col(column)], "before")
    return told.select(((seconds_of(F.col(column)) - F.col("before")) / 60).alias("minutes")).where("minutes > 0")


def gap_stats(gap_rows: DataFrame) -> DataFrame:
    return gap_rows.agg(F.count(F.lit(1)).alias("n"), *(F.percentile("minutes", q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)))


def otsu(gap_rows: DataFrame, bins: int = 64) -> DataFrame:
    """(threshold_minutes): the split of the log1p histogram with the largest variance between its sides; the first on a tie."""
    logs = gap_rows.select(F.log1p("minutes").alias("x"))
    # Two numbers on the driver, in place of a join with a row of bounds.
    lo, hi = logs.agg(F.min("x"), F.max("x")).first()
    if lo is None or hi <= lo:
        return gap_rows.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold_minutes"))
    width = (hi - lo) / bins
    hist = logs.groupBy(F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = gap_rows.sparkSession.range(bins).toDF("bin")
    full = grid.join(hist, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), (F.lit(lo) + (F.col("bin") + 0.5) * F.lit(width)).alias("center"))
    upto, all_ = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    w0, s0 = F.sum("n").over(upto), F.sum(F.col("n") * F.col("center")).over(upto)
    w, s = F.sum("n").over(all_), F.sum(F.col("n") * F.col("center")).over(all_)
    told = full.select("bin", "center", w0.alias("w0"), s0.alias("s0"), w.alias("w"), s.alias("s"))
    between = F.when((F.col("w0") > 0) & (F.col("w") > F.col("w0")), F.col("w0") * (F.col("w") - F.col("w0")) * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0")), 2))
    best = told.select("center", between.alias("v"), "bin").where("v IS NOT NULL").agg(F.max_by("center", F.struct(F.round("v", 9), -F.col("bin"))).alias("c"))
    return best.select(F.expm1("c").alias("threshold_minutes"))


def learn_gap(times: DataFrame, column: str = "ts", least_intervals: int = 20, low: int = 1, high: int = 120) -> dict:
    """The gap between episodes in whole minutes, None for too few intervals, and how it came about."""
    rows = gaps(times, column)
    stats = gap_stats(rows).first().asDict()
    found = stats | {"method": "too-few", "gap_minutes": None}
    if stats["n"] >= least_intervals:
        cut = otsu(rows).first()["threshold_minutes"]
        value = max(cut, stats["p50"]) if cut is not None else stats["p50"]
        found |= {"method": "otsu" if cut is not None else "degenerate-median", "gap_minutes": int(min(high, max(low, -(-value // 1))))}
    return found


def one_per_episode(positives: DataFrame, gap_minutes: float) -> DataFrame:
    """The positive buckets that begin an episode by their start times."""
    starts = episodes(positives.select("start_time"), gap_minutes, "start_time")
    return positives.join(starts.select(F.col("first_ts").alias("start_time")), "start_time", "left_semi")


def window_members(labels: DataFrame, buckets: DataFrame, lookback_minutes: int, inclusive: bool = False, bucket_minutes: int = 5) -> DataFrame:
    """(window_id, label, window_end, bucket_id, start_time, end_time): the buckets of each label's look-back window.

    A bucket belongs if it ends after the window's start and begins before its end (at it, too, if inclusive). The join is
    by equal time bins, so no label is compared with all buckets.
    """
    width = max(lookback_minutes, bucket_minutes) * 60
    end = seconds_of(F.col("window_end"))
    own = labels.select(F.col("bucket_id").alias("window_id"), "label", "window_end").dropDuplicates(["window_id"])
    spread = own.withColumn("bin", F.explode(F.sequence(F.floor((end - (lookback_minutes + bucket_minutes) * 60) / width), F.floor(end / width))))
    placed = buckets.select("bucket_id", "start_time", "end_time").withColumn("bin", F.floor(seconds_of(F.col("start_time")) / width))
    before = F.col("start_time") <= F.col("window_end") if inclusive else F.col("start_time") < F.col("window_end")
    return spread.join(placed, "bin").where(before & (F.col("end_time") > minutes_before(F.col("window_end"), lookback_minutes))).drop("bin")


def excluded(template_id: Column, ids: list[str] = (), patterns: list[str] = ()) -> Column:
    """Whether a template is excluded by id, or by a pattern that matches from its start."""
    out = template_id.isin(list(ids)) if ids else F.lit(False)
    for p in patterns:
        out = out | template_id.rlike(f"^(?:{p})")
    return out


def window_instances(members: DataFrame, instances: DataFrame, ids: list[str] = (), patterns: list[str] = ()) -> DataFrame:
    """Instances of each window's buckets that lie before its end or have no time, without the excluded templates."""
    own = instances.drop("start_time", "end_time")
    out = members.join(own, "bucket_id").where(F.col("ts").isNull() | (F.col("ts") < F.col("window_end")))
    return out.where(~excluded(F.col("template_id"), ids, patterns))

"""Mining of explained windows: clusters, rules, sequences, interactions, and the choice of negative windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.timing import seconds_of
from stratalog.operators import ordered as O


def window_means(members: DataFrame, contributions: DataFrame) -> DataFrame:
    """(window_id, feature, mean): sums over a window's buckets by the number of its buckets; buckets without values count as 0."""
    sizes = members.groupBy("window_id").agg(F.count_distinct("bucket_id").alias("size"))
    sums = members.select("window_id", "bucket_id").distinct().join(contributions, "bucket_id").groupBy("window_id", "feature").agg(F.sum("shap").alias("s"))
    return sums.join(sizes, "window_id").select("window_id", "feature", (F.col("s") / F.col("size")).alias("mean"))


def itemsets(means: DataFrame, threshold: float = 1.0) -> DataFrame:
    return means.where(F.col("mean") >= threshold).select("window_id", "feature").distinct()


def association_rules(items: DataFrame, total: int, support: float = 0.2, confidence: float = 0.5) -> DataFrame:
    """Pair rules in both directions. Pairs are made of features that reach the support alone, since no pair exceeds its parts."""
    counts = items.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support * total)
    own = items.join(counts, "feature", "left_semi")
    pairs = own.alias("x").join(own.alias("y"), (F.col("x.window_id") == F.col("y.window_id")) & (F.col("x.feature") != F.col("y.feature"))).groupBy(F.col("x.feature").alias("antecedent"), F.col("y.feature").alias("consequent")).agg(F.count(F.lit(1)).alias("pair"))
    out = pairs.join(counts.toDF("antecedent", "n"), "antecedent").select("antecedent", "consequent", (F.col("pair") / total).alias("support"), (F.col("pair") / F.col("n")).alias("confidence"))
    return out.where((F.col("support") >= support) & (F.col("confidence") >= confidence))


def ordered_pairs(events: DataFrame, total: int, support: float = 0.2) -> DataFrame:
    """(before, after, n, support): in how many windows a comes before b. Exactly if a's first place is before b's last.

    events: (window_id, template_id, pos). Templates in fewer windows than the support needs are left out first.
    """
    ends = events.groupBy("window_id", "template_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    often = ends.groupBy("template_id").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") >= support * total)
    own = ends.join(often, "template_id", "left_semi")
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, (F.col("a.window_id") == F.col("b.window_id")) & (F.col("a.lo") < F.col("b.hi"))).groupBy(F.col("a.template_id").alias("before"), F.col("b.template_id").alias("after")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("support", F.col("n") / total).where(F.col("support") >= support)


def dominant_features(means: DataFrame) -> DataFrame:
    """(window_id, dominant): each window's feature of largest absolute mean; names break ties."""
    return means.groupBy("window_id").agg(F.min_by("feature", F.struct(-F.abs("mean"), F.col("feature"))).alias("dominant"))


def clusters(means: DataFrame, top: int = 5, features: int = 5) -> DataFrame:
    """(dominant, windows, weight, rank, feature, mean): windows by the feature of largest absolute mean; names break ties."""
    first = Window.partitionBy("window_id").orderBy(F.desc(F.abs("mean")), "feature")
    dominant = means.withColumn("r", F.row_number().over(first)).where("r = 1").select("window_id", F.col("feature").alias("dominant"), F.abs("mean").alias("w"))
    sizes = dominant.groupBy("dominant").agg(F.count(F.lit(1)).alias("windows"), F.sum("w").alias("weight")).orderBy(F.desc("weight"), "dominant").limit(top)
    inside = means.join(dominant.select("window_id", "dominant"), "window_id").join(sizes, "dominant")
    told = inside.groupBy("dominant", "windows", "weight", "feature").agg((F.sum("mean") / F.first("windows")).alias("mean"))
    rank = F.row_number().over(Window.partitionBy("dominant").orderBy(F.desc(F.abs("mean")), "feature"))
    return told.withColumn("rank", rank).where(F.col("rank") <= features)


def interaction_summaries(members: DataFrame, interactions: DataFrame) -> DataFrame:
    """Mean, mean absolute value and count of each feature pair (a < b) over a window's buckets."""
    rows = members.select("window_id", "bucket_id").distinct().join(interactions.where("feature_a < feature_b"), "bucket_id")
    return rows.groupBy("window_id", "feature_a", "feature_b").agg(F.avg("value").alias("mean"), F.avg(F.abs("value")).alias("mean_abs"), F.count(F.lit(1)).alias("n"))


def top_interactions(summaries: DataFrame, top: int = 10) -> DataFrame:
    weighted = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    out = summaries.groupBy("feature_a", "feature_b").agg(weighted("mean").alias("mean"), weighted("mean_abs").alias("mean_abs"), F.count_distinct("window_id").alias("windows_with_interaction"))
    return out.orderBy(F.desc("mean_abs"), "feature_a", "feature_b").limit(top)


def cluster_interactions(summaries: DataFrame, membership: DataFrame, top: int = 10) -> DataFrame:
    """The top interactions of each cluster (window_id, dominant)."""
    weighted = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    out = summaries.join(membership, "window_id").groupBy("dominant", "feature_a", "feature_b").agg(weighted("mean").alias("mean"), weighted("mean_abs").alias("mean_abs"), F.count_distinct("window_id").alias("windows_with_interaction"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("dominant").orderBy(F.desc("mean_abs"), "feature_a", "feature_b"))).where(F.col("rank") <= top)


def negative_candidates(labels: DataFrame, lookback_minutes: int, tolerance_minutes: int = 60) -> DataFrame:
    """(positive, negative, delta seconds) within the tolerance, of negatives that no positive's look-back overlaps."""
    width = max(tolerance_minutes, lookback_minutes) * 60
    end = seconds_of(F.col("window_end"))
    positive = labels.where("label = 1").select(F.col("bucket_id").alias("positive"), end.alias("p_end"))
    spread = positive.withColumn("bin", F.explode(F.sequence(F.floor((F.col("p_end") - width) / width), F.floor((F.col("p_end") + width) / width))))
    negative = labels.where("label = 0").select(F.col("bucket_id").alias("negative"), end.alias("n_end")).withColumn("bin", F.floor(F.col("n_end") / width))
    near = negative.join(spread, "bin").withColumn("delta", F.col("n_end") - F.col("p_end"))
    hit = near.where(F.abs("delta") <= lookback_minutes * 60).select("negative").distinct()
    return near.where(F.abs("delta") <= tolerance_minutes * 60).join(hit, "negative", "left_anti").select("positive", "p_end", "negative", "delta")


def pick_negatives(candidates: DataFrame, per_positive: int = 1, cap: int | None = None) -> DataFrame:
    """(positive, negative): positives in time order take unused negatives, those after them first, then the nearest.

    Only the candidates of positives that are near in time compete, so runs of positives further apart than the tolerance
    are picked on their own. A cap takes the first picks in time order.
    """
    rows = candidates.select("positive", "p_end", "negative", "delta")
    order, span = [F.col("p_end"), F.col("positive")], F.floor(F.col("p_end") / 86400)
    reach = rows.agg(F.max(F.abs("delta"))).first()[0] or 0.0
    runs = O.previous(rows.select("positive", "p_end").distinct(), F.col("p_end"), span, order, "before")
    runs = O.running(runs.withColumn("gap", F.coalesce((F.col("p_end") - F.col("before") > 2 * reach).cast("int"), F.lit(0))), F.col("gap"), span, order, "run")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for (_, positive), own in pdf.groupby(["p_end", "positive"], sort=True):
            ranked = own.assign(late=own.delta < 0, far=own.delta.abs()).sort_values(["late", "far", "negative"])
            free = [n for n in ranked.negative if n not in used][:per_positive]
            used.update(free)
            out += [(positive, n, float(own.p_end.iloc[0])) for n in free]
        return pd.DataFrame(out, columns=["positive", "negative", "p_end"])

    picked = rows.join(runs.select("positive", "run"), "positive").groupBy("run").applyInPandas(greedy, "positive string, negative string, p_end double")
    return (picked.orderBy("p_end", "positive", "negative").limit(cap) if cap else picked).select("positive", "negative")


def template_matched(labels: DataFrame, instances: DataFrame, required: list[str], lookback_minutes: int, cap: int | None = None) -> DataFrame:
    """Negatives in time order that hold a required template and that no positive's look-back overlaps."""
    width = lookback_minutes * 60
    end = seconds_of(F.col("window_end"))
    negative = labels.where("label = 0").select("bucket_id", "window_end", end.alias("e")).withColumn("bin", F.floor(F.col("e") / width))
    spread = labels.where("label = 1").select(end.alias("p")).withColumn("bin", F.explode(F.sequence(F.floor((F.col("p") - width) / width), F.floor((F.col("p") + width) / width))))
    hit = negative.join(spread, "bin").where(F.abs(F.col("e") - F.col("p")) <= width).select("bucket_id").distinct()
    have = instances.where(F.col("template_id").isin(list(required))).select("bucket_id").distinct()
    out = negative.join(hit, "bucket_id", "left_anti").join(have, "bucket_id", "left_semi").orderBy("window_end", "bucket_id")
    return (out.limit(cap) if cap else out).select("bucket_id", "window_end")


def select_negatives(labels: DataFrame, mode: str, lookback_minutes: int, instances: DataFrame | None = None, required: list[str] = (), tolerance_minutes: int = 60, per_positive: int = 1, cap: int | None = None) -> DataFrame:
    """(bucket_id, window_end): negatives by mode: none, time-matched, or template-matched (which hold a template of `required`).

    No bucket is chosen twice. An unknown mode is an error.
    """
    if mode == "none" or per_positive <= 0:
        return labels.select("bucket_id", "window_end").limit(0)
    if mode == "time-matched":
        picked = pick_negatives(negative_candidates(labels, lookback_minutes, tolerance_minutes), per_positive, cap)
        return labels.where("label = 0").join(picked.select(F.col("negative").alias("bucket_id")), "bucket_id", "left_semi").select("bucket_id", "window_end").dropDuplicates(["bucket_id"])
    if mode == "template-matched":
        positives = labels.where("label = 1").count()
        return template_matched(labels, instances, list(required), lookback_minutes, min(cap, positives * per_positive) if cap else positives * per_positive).dropDuplicates(["bucket_id"])
    raise ValueError(f"negatives are none, time-matched or template-matched, not {mode}")


def shap_aggregate(contributions: DataFrame, rows: DataFrame) -> DataFrame:
    """Per feature: means over all rows, mean absolute value, share of positive among non-zero, and means by class.

    contributions: (bucket_id, feature, shap); rows: (bucket_id, label). Denominators count rows, not occurrences.
    """
    n, p, q = rows.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    told = contributions.join(rows.select("bucket_id", "label"), "bucket_id").groupBy("feature").agg(
        F.sum("shap").alias("s"), F.sum(F.abs("shap")).alias("a"), F.count_if(F.col("shap") > 0).alias("up"), F.count_if(F.col("shap") < 0).alias("down"),
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("shap"))), F.lit(0.0)).alias("sp"), F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("shap"))), F.lit(0.0)).alias("sn"),
    )
    ratio = lambda x, d: F.col(x) / F.lit(float(max(1, d)))
    return told.select("feature", ratio("s", n).alias("mean_shap"), ratio("a", n).alias("mean_abs_shap"), F.when(F.col("up") + F.col("down") > 0, F.col("up") / (F.col("up") + F.col("down"))).otherwise(0.0).alias("frac_positive"), ratio("sp", p).alias("mean_positive_class"), ratio("sn", q).alias("mean_negative_class"))


def template_rollup(aggregated: DataFrame) -> DataFrame:
    """Sums of the features' means by template, from their names."""
    tid = F.regexp_extract("feature", r"^template_(?:present_|count_|lead_minutes_)?([^_=]+)", 1)
    return aggregated.where(F.col("feature").startswith("template_")).groupBy(tid.alias("template_id")).agg(F.sum("mean_shap").alias("mean_shap"), F.sum("mean_abs_shap").alias("mean_abs_shap"))


def feature_info(name) -> object:
    """struct(kind, stat, template_id, var, value) of a feature's name."""
    metric = F.regexp_extract(name, r"^metric_(current|mean|delta)_(.+)$", 0) != ""
    plain = F.regexp_extract(name, r"^template_(present|count|lead_minutes)_(.+)$", 0) != ""
    one_hot = F.instr(name, "=") > 0
    return F.struct(
        F.when(metric, "metric").when(plain, "template").when(name.startswith("template_"), "variable").otherwise("other").alias("kind"),
        F.when(metric, F.regexp_extract(name, r"^metric_(current|mean|delta)_", 1)).when(plain, F.regexp_extract(name, r"^template_(present|count|lead_minutes)_", 1)).when(one_hot, "value").when(name.startswith("template_"), F.regexp_extract(name, r"_(mean|last)$", 1)).alias("stat"),
        F.when(plain, F.regexp_extract(name, r"^template_(?:present|count|lead_minutes)_(.+)$", 1)).when(name.startswith("template_"), F.regexp_extract(name, r"^template_([^_]+)_", 1)).alias("template_id"),
        F.when(~plain & name.startswith("template_"), F.regexp_extract(name, r"^template_[^_]+_(.+?)(?:_(?:mean|last)|=.*)$", 1)).alias("var"),
        F.when(one_hot, F.regexp_extract(name, r"=(.*)$", 1)).alias("value"),
    )

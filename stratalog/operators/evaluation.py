"""Splits, scores and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators import ordered as O


def _span(order: tuple[str, ...]):
    """The spans of an order whose first column is a time."""
    return O.hours(F.col(order[0]))


def split_balanced(rows: DataFrame, share: float = 0.8, order: tuple[str, ...] = ("timestamp", "bucket_id")) -> DataFrame:
    """rows with `split`: of each label the first share is train and the rest test; with two rows or more, one at least is test.

    The first column of the order is a time.
    """
    placed = O.row_numbers(rows, _span(order), [F.col(c) for c in order], "split_k", "split_n", by=("label",))
    n = F.col("split_n")
    cut = F.when(n > 1, F.least(n - 1, F.greatest(F.lit(1), F.floor(n * share)))).otherwise(n)
    return placed.withColumn("split", F.when(F.col("split_k") <= cut, "train").otherwise("test")).drop("split_k", "split_n")


def split_chronological(rows: DataFrame, train: float = 0.7, validation: float = 0.15, order: tuple[str, ...] = ("timestamp", "bucket_id")) -> DataFrame:
    placed = O.row_numbers(rows, _span(order), [F.col(c) for c in order], "split_k", "split_n")
    k, n = F.col("split_k"), F.col("split_n")
    return placed.withColumn("split", F.when(k <= F.floor(n * train), "train").when(k <= F.floor(n * (train + validation)), "validation").otherwise("test")).drop("split_k", "split_n")


def time_series_folds(rows: DataFrame, folds: int = 5, test_size: int | None = None, order: tuple[str, ...] = ("timestamp", "bucket_id")) -> DataFrame:
    """(fold, split, ...): the last folds * size rows are tests, one after the other; each is trained on all before it."""
    if folds < 1:
        raise ValueError("at least one fold is needed")
    placed = O.row_numbers(rows, _span(order), [F.col(c) for c in order], "fold_k", "fold_n")
    size = F.floor(F.col("fold_n") / (folds + 1)) if test_size is None else F.lit(test_size)
    placed = placed.withColumn("fold_size", size).withColumn("fold_first", F.col("fold_n") - F.col("fold_size") * folds)
    each = placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = F.col("fold_first") + F.col("fold") * F.col("fold_size")
    split = F.when(F.col("fold_k") <= start, "train").when(F.col("fold_k") <= start + F.col("fold_size"), "test")
    return each.withColumn("split", split).where("split IS NOT NULL").drop("fold_k", "fold_n", "fold_size", "fold_first")


def auc(scored: DataFrame, score: str = "probability", label: str = "label", tie: str = "bucket_id") -> DataFrame:
    """Rank sum without averaging of ties; 0.5 with one class only. Equal scores rank by `tie`."""
    narrow = scored.select(F.col(score).alias("s"), F.col(tie).alias("t"), F.col(label).alias("y"))
    ranked = O.row_numbers(narrow, O.slices(F.col("s")), [F.col("s"), F.col("t")], "r")
    told = ranked.agg(F.sum(F.when(F.col("y") == 1, F.col("r"))).alias("s"), F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("n"))
    value = (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))
    return told.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))).otherwise(0.5).alias("auc"))


def negative_quantile(scored: DataFrame, rate: float = 0.001, score: str = "probability", label: str = "label") -> DataFrame:
    """(threshold): the k-th largest negative score, k = max(1, ceil(rate * negatives)); no row without negatives."""
    negative = scored.where(F.col(label) == 0).select(F.col(score).alias("threshold"))
    ranked = O.row_numbers(negative, -O.slices(F.col("threshold")), [F.desc("threshold")], "r", "n")
    return ranked.where(F.col("r") == F.greatest(F.lit(1), F.ceil(F.lit(rate) * F.col("n")))).select("threshold")


def confusion(scored: DataFrame, threshold: float, score: str = "probability", label: str = "label") -> DataFrame:
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    told = scored.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return told.select("tp", "fp", "tn", "fn", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("false_positive_rate"))


def histogram(scored: DataFrame, bins: int = 20, score: str = "probability") -> DataFrame:
    """(bin, n) of scores in [0, 1]; 1 lies in the last bin."""
    return scored.groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def log_odds(scored: DataFrame, score: str = "probability", label: str = "label", clip: float = 1e-12) -> DataFrame:
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col(score)))
    odds = F.ln(p / (1 - p))
    return scored.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_probability"), F.avg(odds).alias("mean_log_odds"), F.percentile(odds, 0.5).alias("median_log_odds"))

"""Rows of an explained model: contributions by bucket, and the ones worth a look."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.operators.mining import feature_info


def shap_rows(scored: DataFrame, values: DataFrame, expected: float, key: str = "window_id") -> DataFrame:
    """(bucket_id, probability, label, expected_value, contributions): one row for each scored row, its non-zero values as JSON.

    scored: (key, label, probability); values: (key, feature, value).
    """
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "value"))))
    maps = values.groupBy(key).agg(F.to_json(entries).alias("contributions"))
    out = scored.select(key, "probability", F.col("label").cast("int").alias("label")).join(maps, key, "left")
    return out.select(F.col(key).alias("bucket_id"), "probability", "label", F.lit(float(expected)).alias("expected_value"), F.coalesce("contributions", F.lit("{}")).alias("contributions"))


def contributions_of(rows: DataFrame) -> DataFrame:
    """(bucket_id, feature, shap) of shap_rows."""
    return rows.select("bucket_id", F.explode(F.from_json("contributions", "map<string,double>")).alias("feature", "shap"))


def highlights(scored: DataFrame, values: DataFrame, top: int = 5, fallback: int = 3, key: str = "window_id") -> DataFrame:
    """(bucket_id, label, probability, rank, feature, shap): the positives' features of largest size, ties by name.

    Without a positive, those of the `fallback` rows of largest probability.
    """
    rows = scored.select(F.col(key).alias("bucket_id"), "label", "probability")
    positive = rows.where("label = 1")
    if not positive.take(1):
        positive = rows.orderBy(F.desc("probability"), "bucket_id").limit(fallback)
    own = values.select(F.col(key).alias("bucket_id"), "feature", F.col("value").alias("shap")).join(positive, "bucket_id")
    rank = F.row_number().over(Window.partitionBy("bucket_id").orderBy(F.desc(F.abs("shap")), "feature"))
    return own.withColumn("rank", rank).where(F.col("rank") <= top).select("bucket_id", "label", "probability", "rank", "feature", "shap")


def enriched(rows: DataFrame, texts: DataFrame, kinds: DataFrame, name: str = "feature") -> DataFrame:
    """rows with what their feature's name says, its template's text and its variable's kind, numeric or other.

    texts: (template_id, template_str); kinds: (template_id, var, kind).
    """
    told = rows.withColumn("info", feature_info(F.col(name))).select("*", F.nullif("info.template_id", F.lit("")).alias("template_id"), F.nullif("info.var", F.lit("")).alias("var")).withColumns({"kind": F.col("info.kind"), "stat": F.col("info.stat"), "var_value": F.col("info.value")}).drop("info")
    out = told.join(texts.select("template_id", "template_str"), "template_id", "left").join(kinds.select("template_id", "var", F.col("kind").alias("var_type")), ["template_id", "var"], "left")
    return out.withColumn("var_type_coarse", F.when(F.col("var_type") == "numeric", "numeric").when(F.col("var").isNotNull(), "other"))

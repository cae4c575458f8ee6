"""Reports of an evaluation: JSON texts in the store, and what a console shows of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.display import panel, table
from stratalog.operators import explained as X
from stratalog.operators import mining as M
from stratalog.sources.discovery import save_json


def top_features(aggregated: DataFrame, n: int = 10) -> DataFrame:
    """The features with the largest mean size, ties by name."""
    return aggregated.orderBy(F.desc("mean_abs_shap"), "feature").limit(n)


def aggregate(contributions: DataFrame, rows: DataFrame, texts: DataFrame, kinds: DataFrame, n: int = 10) -> dict:
    """The top features with what their names say, the top templates, and the number of rows, as a JSON value.

    contributions: (bucket_id, feature, shap); rows: (bucket_id, label).
    """
    told = M.shap_aggregate(contributions, rows).checkpoint()
    features = X.enriched(top_features(told, n), texts, kinds).orderBy(F.desc("mean_abs_shap"), "feature")
    templates = M.template_rollup(told).join(texts.select("template_id", "template_str"), "template_id", "left").orderBy(F.desc("mean_abs_shap"), "template_id").limit(n)
    labels = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1).alias("positives")).first().asDict()
    return labels | {"features": [r.asDict() for r in features.collect()], "templates": [r.asDict() for r in templates.collect()]}


def per_bucket(highlights: DataFrame, texts: DataFrame, kinds: DataFrame, limit: int = 10) -> list[dict]:
    """The highlights of the `limit` buckets of largest probability, as JSON values."""
    chosen = highlights.select("bucket_id", "probability").distinct().orderBy(F.desc("probability"), "bucket_id").limit(limit)
    rows = X.enriched(highlights.join(chosen.select("bucket_id"), "bucket_id", "left_semi"), texts, kinds)
    out: dict[str, dict] = {}
    for r in rows.orderBy(F.desc("probability"), "bucket_id", "rank").collect():
        own = r.asDict()
        head = out.setdefault(own["bucket_id"], {"bucket_id": own["bucket_id"], "label": own["label"], "probability": own["probability"], "rows": []})
        head["rows"].append({k: v for k, v in own.items() if k not in ("bucket_id", "label", "probability")})
    return list(out.values())


def per_bucket_text(buckets: list[dict]) -> str:
    lines = ["Largest contributions by bucket, in log-odds: positive ones raise the probability."]
    for b in buckets:
        rows = [(f"{r['shap']:+.3f}", r["feature"], r["kind"], r["template_id"], (r["template_str"] or "")[:80], r["var"], r["var_type_coarse"]) for r in b["rows"]]
        lines += ["", f"Bucket {b['bucket_id']} (label {b['label']}, probability {b['probability']:.3f})", table(("shap", "feature", "kind", "template", "text", "variable", "type"), rows)]
    return "\n".join(lines)


def aggregate_text(told: dict) -> str:
    features = [(r["feature"], r["mean_shap"], r["mean_abs_shap"], r["frac_positive"], (r["template_str"] or "")[:60]) for r in told["features"]]
    templates = [(r["template_id"], r["mean_shap"], r["mean_abs_shap"], (r["template_str"] or "")[:60]) for r in told["templates"]]
    return "\n".join([
        panel("features", [table(("feature", "mean", "mean size", "share up", "text"), features)]),
        panel("templates", [table(("template", "mean", "mean size", "text"), templates)]),
    ])


def summary_text(metrics: dict, compact: bool = True) -> str:
    """Metrics on one line each; in compact form only those that most look at."""
    keys = ("test_auc", "accuracy", "precision", "recall", "false_positive_rate", "threshold") if compact else tuple(k for k in metrics if isinstance(metrics[k], (int, float)))
    return panel("evaluation", [f"{k:<22}{metrics[k]:.4g}" for k in keys if metrics.get(k) is not None])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write(spark: SparkSession, folder: str, told: dict, buckets: list[dict], summary: dict) -> None:
    """summary, aggregate and per-bucket reports, as JSON and as text."""
    save_json(spark, f"{folder}/summary.json", summary)
    save_json(spark, f"{folder}/shap_aggregate.json", told)
    save_json(spark, f"{folder}/shap_buckets.json", {"buckets": buckets})
    write_text(spark, f"{folder}/shap_aggregate.txt", aggregate_text(told))
    write_text(spark, f"{folder}/shap_buckets.txt", per_bucket_text(buckets))

"""Training and evaluation of an incident's surrogate over a bucket table and its instances."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product
from statistics import fmean, pstdev

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators import analytics as A
from stratalog.operators import evaluation as E
from stratalog.operators import explained as X
from stratalog.operators import features as G
from stratalog.operators import labels as L
from stratalog.operators import lookback as K
from stratalog.operators import mining as M
from stratalog.operators import model as T
from stratalog.operators import select as Q
from stratalog.operators import snapshots as W
from stratalog.plans import reports as R
from stratalog.sources.config import exclusions, load, selection
from stratalog.sources.discovery import save_json


@dataclass
class Config:
    incident: str
    equivalents: list[str] = field(default_factory=list)
    lead_minutes: int = 15
    max_minutes: int = 60
    lookback_minutes: int = 30
    exclude_ids: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    exclude_metrics: list[str] = field(default_factory=list)
    substring: str | None = None
    variables: dict[str, str] = field(default_factory=dict)
    threshold_policy: str = "negative-quantile"
    threshold_rate: float = 0.001
    fixed_threshold: float = 0.5
    collapse_episodes: bool = False
    least_intervals: int = 20
    folds: int = 0
    balance: bool = True
    itemset_threshold: float = 1.0
    support: float = 0.2
    confidence: float = 0.5
    rounds: int = 100
    interactions: int = 0
    window_analysis: bool = False
    negative_mode: str = "time-matched"
    negative_tolerance: int = 60
    negatives_per_positive: int = 1
    required_templates: list[str] = field(default_factory=list)
    shap_top_k: int = 5
    shap_bucket_limit: int = 10
    shap_report_top_n: int = 10


def matrix(buckets: DataFrame, instances: DataFrame, c: Config) -> tuple[DataFrame, list[str], DataFrame, DataFrame]:
    """(rows, feature names, labels, members)."""
    unknown = set(c.exclude_metrics) - set(G.METRIC_FIELDS)
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(sorted(unknown))}")
    ids = [c.incident, *c.equivalents]
    labels = L.label_buckets(buckets, L.symptoms(instances, ids, c.substring, c.variables))
    if c.collapse_episodes:
        positive = labels.where("label = 1")
        gap = L.learn_gap(positive, "start_time", c.least_intervals)["gap_minutes"]
        if gap is not None:
            labels = labels.where("label = 0").unionByName(L.one_per_episode(positive, gap).select(*labels.columns))
    # All that follows starts from these two; they have a row for each bucket, and for each bucket of a window.
    labels = labels.checkpoint()
    members = L.window_members(labels, buckets, c.lookback_minutes).checkpoint()
    own = L.window_instances(members, instances, [*ids, *c.exclude_ids], c.exclude_patterns)
    long = G.build(members, buckets, own, tuple(f for f in G.METRIC_FIELDS if f not in c.exclude_metrics))
    rows, names = G.assemble(G.rows_of(members), long)
    return rows, names, labels, members


def threshold(scored: DataFrame, c: Config) -> float:
    if c.threshold_policy == "fixed":
        return c.fixed_threshold
    found = E.negative_quantile(scored, c.threshold_rate).first()
    if found is None:
        raise ValueError("the negative quantile needs negatives")
    return found["threshold"]


def train_and_test(train: DataFrame, test: DataFrame, c: Config) -> tuple[object, DataFrame, dict]:
    model = T.train(train, c.balance, maxIter=c.rounds)
    scored = T.score(model, test).persist()
    cut = threshold(scored, c)
    return model, scored, E.confusion(scored, cut).first().asDict() | {"threshold": cut, "test_auc": E.auc(scored, tie="window_id").first()["auc"]}


def cross_validate(rows: DataFrame, c: Config) -> dict:
    """Metrics of each fold, and their mean and population deviation."""
    folds = E.time_series_folds(rows, c.folds, order=("timestamp", "window_id")).persist()
    each = []
    for k in range(c.folds):
        own = folds.where(F.col("fold") == k)
        each.append(train_and_test(own.where("split = 'train'"), own.where("split = 'test'"), c)[2])
    keys = ("accuracy", "precision", "recall", "false_positive_rate", "test_auc")
    return {"folds": each, "mean": {m: fmean(f[m] for f in each) for m in keys}, "std": {m: pstdev([f[m] for f in each]) for m in keys}}


def auto_lookback(buckets: DataFrame, instances: DataFrame, c: Config, metric: str = "recall", cap: int = 120) -> dict:
    """The (lead, most) of a small grid with the best mean metric; ties go to the smaller lead, then the smaller most."""
    tried, errors = [], {}
    leads = sorted({c.lead_minutes, 5, 10, 15, 30})
    for lead, most in sorted({(a, b) for a, m in product(leads, (1, 2, None)) for b in [cap if m is None else min(a * m, cap)]}):
        own = Config(**{**c.__dict__, "lead_minutes": lead, "max_minutes": most, "lookback_minutes": most, "folds": c.folds or 3})
        try:
            value = cross_validate(matrix(buckets, instances, own)[0], own)["mean"][metric]
            tried.append((value if metric == "false_positive_rate" else -value, lead, most))
        except ValueError as error:
            errors[f"{lead}/{most}"] = str(error)
    best = min(tried, default=None)
    return {"lead_minutes": best and best[1], "max_minutes": best and best[2], "value": best and abs(best[0]), "errors": errors}


def fitted_for_shap(spark: SparkSession, rows: DataFrame, split: DataFrame, model, scored: DataFrame, c: Config) -> tuple[object, DataFrame, DataFrame, str]:
    """(model, rows to explain, their scores, scope): with folds, a model of all rows explains all of them; else the test rows."""
    if not c.folds:
        return model, split.where("split = 'test'"), scored, "test"
    whole = T.train(rows, c.balance, maxIter=c.rounds)
    return whole, rows, T.score(whole, rows).persist(), "full-data"


def snapshot(buckets: DataFrame, instances: DataFrame, labels: DataFrame, c: Config) -> dict[str, DataFrame]:
    """Snapshot tables of the positives and the chosen negatives."""
    ids = [c.incident, *c.equivalents]
    chosen = M.select_negatives(labels, c.negative_mode, c.lookback_minutes, instances, c.required_templates, c.negative_tolerance, c.negatives_per_positive)
    own = labels.where("label = 1").unionByName(labels.where("label = 0").join(chosen.select("bucket_id"), "bucket_id", "left_semi"))
    members = L.window_members(own, buckets, c.lookback_minutes)
    kept = instances.where(~L.excluded(F.col("template_id"), [*ids, *c.exclude_ids], c.exclude_patterns))
    return W.take(own, members, buckets, kept, c.lookback_minutes)


def run(spark: SparkSession, buckets: DataFrame, instances: DataFrame, c: Config, folder: str) -> dict:
    """Metrics, Shapley values of the test rows, clusters, rules and sequences. The tables among them are DataFrames.

    folder: in the shared store, for the model's nodes.
    """
    rows, names, labels, members = matrix(buckets, instances, c)
    rows = rows.persist()
    split = E.split_balanced(rows, order=("timestamp", "window_id"))
    model, scored, metrics = train_and_test(split.where("split = 'train'"), split.where("split = 'test'"), c)
    tested = scored
    model, explained, scored, scope = fitted_for_shap(spark, rows, split, model, scored, c)
    found = T.leaves(spark, model, folder)
    values = T.explain(explained, found, names)
    if c.interactions:
        chosen = [r["feature"] for r in T.top_by_variance(values, explained.count(), c.interactions).collect()]
        values = T.explain(explained, found, names, interactions=chosen)
    values = values.checkpoint()
    plain = values.where("other IS NULL")
    expected = T.expected_value(found)
    shap = plain.select(F.col("window_id").alias("bucket_id"), "feature", F.col("value").alias("shap"))
    means = M.window_means(members, shap).checkpoint()
    total = members.select("window_id").distinct().count()
    own = L.window_instances(members, instances, [c.incident, *c.equivalents]).select("window_id", "template_id", F.struct("start_time", "instance_index").alias("pos"))
    out = {
        "metrics": metrics, "features": names, "expected_value": expected, "model": model, "scored": scored, "shap": values, "shap_rows": X.shap_rows(scored, plain, expected), "shap_scope": scope,
        "highlights": X.highlights(scored, plain, c.shap_top_k), "shap_aggregate": M.shap_aggregate(shap, scored.select(F.col("window_id").alias("bucket_id"), "label")), "contributions": shap, "labels": labels, "members": members,
        "clusters": M.clusters(means), "rules": M.association_rules(M.itemsets(means, c.itemset_threshold), total, c.support, c.confidence), "sequences": M.ordered_pairs(own, total, c.support),
        "negatives": M.select_negatives(labels, c.negative_mode, c.lookback_minutes, instances, c.required_templates, c.negative_tolerance, c.negatives_per_positive), "data_summary": E.log_odds(tested), "histogram": E.histogram(tested),
    }
    if c.window_analysis:
        out["snapshot"] = snapshot(buckets, instances, labels, c)
    if c.interactions:
        cubes = values.where("other IS NOT NULL").select(F.col("window_id").alias("bucket_id"), F.col("feature").alias("feature_a"), F.col("other").alias("feature_b"), "value")
        summaries = M.interaction_summaries(members, cubes)
        dominant = M.dominant_features(means)
        out |= {"interactions": M.top_interactions(summaries), "cluster_interactions": M.cluster_interactions(summaries, dominant)}
    if c.folds:
        out["cross_validation"] = cross_validate(rows, c)
    return out


def save(spark: SparkSession, found: dict, instances: DataFrame, c: Config, folder: str) -> dict:
    """Write what run() found: SHAP rows as Parquet and as JSON lines, the mined tables as JSON, snapshots, model and reports; returns the summary."""
    found["shap_rows"].write.mode("overwrite").parquet(f"{folder}/shap")
    spark.read.parquet(f"{folder}/shap").write.mode("overwrite").json(f"{folder}/shap_json")
    for name in ("clusters", "rules", "sequences", "negatives", "histogram", "data_summary", "interactions", "cluster_interactions"):
        if name in found:
            found[name].write.mode("overwrite").json(f"{folder}/{name}")
    if "snapshot" in found:
        W.write(found["snapshot"], f"{folder}/snapshot")
    T.save(spark, found["model"], found["features"], f"{folder}/surrogate")
    texts = A.template_strings(instances)
    kinds = G.inventory(L.window_instances(found["members"], instances, [c.incident, *c.equivalents]))[1].select("template_id", "var", "kind").checkpoint()
    told = R.aggregate(found["contributions"], found["scored"].select(F.col("window_id").alias("bucket_id"), "label"), texts, kinds, c.shap_report_top_n)
    each = R.per_bucket(found["highlights"], texts, kinds, c.shap_bucket_limit)
    summary = {
        "incident": c.incident, "equivalents": c.equivalents, "metrics": found["metrics"], "features": len(found["features"]), "expected_value": found["expected_value"], "shap_scope": found["shap_scope"],
        "cross_validation": found.get("cross_validation"), "episode_gap": found.get("episode_gap"), "settings": {k: v for k, v in c.__dict__.items() if v not in (None, [], {})},
    }
    R.write(spark, folder, told, each, summary)
    if found.get("episode_gap"):
        save_json(spark, f"{folder}/episode_gap.json", found["episode_gap"])
    return summary | {"text": R.summary_text(found["metrics"]) + "\n" + R.aggregate_text(told)}


def read_config(own: dict) -> Config:
    """The Config of settings as sources.config has them; an exclusion file adds to the ids and patterns."""
    ids, patterns = exclusions(load(own["exclude_file"])) if own.get("exclude_file") else ([], [])
    if not own.get("incident"):
        raise ValueError("an incident is needed: its template's id, or incident_substring")
    known = {k: own[k] for k in ("threshold_policy", "threshold_rate", "fixed_threshold", "balance", "rounds", "itemset_threshold", "support", "confidence", "interactions", "window_analysis", "negative_mode", "negative_tolerance", "negatives_per_positive", "shap_top_k", "shap_bucket_limit", "shap_report_top_n", "lead_minutes", "max_minutes", "lookback_minutes")}
    return Config(
        incident=str(own["incident"]), equivalents=[str(e) for e in own["equivalents"]], exclude_ids=[*map(str, own["exclude_ids"]), *ids], exclude_patterns=[*own["exclude_patterns"], *patterns], exclude_metrics=list(own["exclude_metrics"]),
        substring=own["symptom_substring"], variables=dict(own["symptom_variables"]), collapse_episodes=own["episode_collapse"], least_intervals=own["episode_gap_min_intervals"], folds=own["cv_folds"] if own["cv_strategy"] == "time-series" else 0, **known,
    )


def run_settings(spark: SparkSession, own: dict, ask=None) -> dict:
    """An evaluation from settings: reads the bucket table (with typed filters on its columns), resolves a family of templates by
    substring, looks for the best look-back if wanted, writes all to output_root, and returns the summary."""
    table = Q.where_equal(spark.read.parquet(own["bucket_path"]), None, **own["bucket_filters"])
    instances = A.explode_templates(table).withColumn("ts", A.instance_time(F.col("vars"))).checkpoint()
    if not own.get("incident") and own.get("incident_substring"):
        family = A.family(instances, own["incident_substring"]).orderBy("rank").collect()
        if not family:
            raise ValueError(f"no template has {own['incident_substring']!r}")
        picked = selection(ask("\n".join(f"{r['rank']}. {r['template_id']} {r['template_str']}" for r in family) + "\nwhich? ") if ask else "all", len(family))
        own = own | {"incident": family[picked[0]]["template_id"], "equivalents": [family[i]["template_id"] for i in picked[1:]]}
    c = read_config(own)
    root = own["output_root"]
    if own["auto_lookback"]:
        best = auto_lookback(table, instances, c, own["auto_lookback_metric"])
        if best["lead_minutes"] is not None:
            c.lead_minutes, c.max_minutes, c.lookback_minutes = best["lead_minutes"], best["max_minutes"], best["max_minutes"]
    if own["artifacts"]:
        found_windows = K.read_artifacts(spark, own["artifacts"])
    else:
        found_windows = K.build_windows(table, instances, c.incident, c.equivalents, c.lead_minutes, c.max_minutes)
        if found_windows:
            K.write_artifacts(spark, found_windows, f"{root}/windows")
    found = run(spark, table, instances, c, f"{root}/work")
    if c.collapse_episodes:
        found["episode_gap"] = episode_gap(table, instances, c)
    return save(spark, found, instances, c, root) | {"windows": found_windows and found_windows["summary"]}


def episode_gap(buckets: DataFrame, instances: DataFrame, c: Config) -> dict:
    """What learn_gap says of the incident's positive buckets."""
    labels = L.label_buckets(buckets, L.symptoms(instances, [c.incident, *c.equivalents], c.substring, c.variables))
    return L.learn_gap(labels.where("label = 1"), "start_time", c.least_intervals)

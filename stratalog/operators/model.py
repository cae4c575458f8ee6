"""The gradient-boosted surrogate: training, scoring, and its exact explanation by Shapley values of trees.

A leaf gives its value where all splits on its path hold. Without knowledge of a feature, a row follows a split with the
share of training rows that did. For one leaf and a set of known features that is a product over the path's features, so the
leaf's Shapley values are sums over the coefficients of a polynomial of degree (features on the path - 1), and those of all
leaves add up. Everything is in log-odds: Spark's probability is 1 / (1 + exp(-2 * margin)).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMETERS = {"stepSize": 0.1, "maxIter": 100, "maxDepth": 5, "featureSubsetStrategy": "0.9", "subsamplingRate": 0.8, "minInstancesPerNode": 1, "seed": 2025}


class OneLabel(ValueError):
    """There are positives only; `train_one_label` fits them."""


def train(rows: DataFrame, balance: bool = True, **parameters):
    """A classifier of rows (features vector, label 0/1); positives weigh negatives / positives if balanced."""
    n, p = rows.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 1)).first()
    if not p or p == n:
        raise (OneLabel if p else ValueError)("training needs rows of both labels")
    return _fitted(rows, (n - p) / p if balance else 1.0, **parameters)


def train_one_label(rows: DataFrame, **parameters):
    """A classifier of rows of one label: all rows get one probability, and no feature has a Shapley value.

    No split gains anything there, so the trees are one leaf; at a greater depth, rounding would make splits of 1e-17.
    """
    return _fitted(rows, 1.0, **(parameters | {"maxDepth": 0}))


def _fitted(rows: DataFrame, weight: float, **parameters):
    from pyspark.ml.classification import GBTClassifier

    own = rows.select("features", F.col("label").cast("double").alias("label"), F.when(F.col("label") == 1, weight).otherwise(1.0).alias("weight"))
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", **(PARAMETERS | parameters)).fit(own)


def score(model, rows: DataFrame) -> DataFrame:
    """rows with `probability` of label 1."""
    from pyspark.ml.functions import vector_to_array

    kept = [c for c in rows.columns if c != "probability"]
    return model.setProbabilityCol("p_vector").setRawPredictionCol("r_vector").setPredictionCol("p_label").transform(rows).withColumn("probability", F.element_at(vector_to_array("p_vector"), 2)).select(*kept, "probability")


def save(spark: SparkSession, model, names: list[str], path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps({"feature_columns": names}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(spark: SparkSession, path: str):
    from pyspark.ml.classification import GBTClassificationModel

    names = json.loads(spark.read.text(f"{path}/metadata").first()[0])["feature_columns"]
    return GBTClassificationModel.load(f"{path}/model"), names


def leaves(spark: SparkSession, model, folder: str) -> list[tuple[float, list[tuple[int, float, list[tuple[float, bool]]]]]]:
    """(value in log-odds, [(feature, share of rows, [(threshold, goes left)])]) of each leaf of all trees.

    The model has a fixed number of trees of bounded depth; its saved nodes are read on the driver.
    """
    path = f"{folder}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes: dict[int, dict] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        nodes.setdefault(r["treeID"], {})[r["id"]] = r
    out = []
    for tree, weight in enumerate(model.treeWeights):
        own = nodes[tree]
        stack: list[tuple[int, list]] = [(0, [])]
        while stack:
            at, way = stack.pop()
            node = own[at]
            if node["leftChild"] < 0:
                by: dict[int, tuple[float, list]] = {}
                for feature, share, test in way:
                    z, tests = by.get(feature, (1.0, []))
                    by[feature] = (z * share, [*tests, test])
                out.append((2.0 * weight * node["prediction"], [(f, z, t) for f, (z, t) in by.items()]))
                continue
            cover = [max(1e-12, float(own[node[c]]["rawCount"])) for c in ("leftChild", "rightChild")]
            for c, child in enumerate(("leftChild", "rightChild")):
                test = (node["split"]["leftCategoriesOrThreshold"][0], c == 0)
                stack.append((node[child], [*way, (node["split"]["featureIndex"], cover[c] / sum(cover), test)]))
    return out


def expected_value(found) -> float:
    return float(sum(v * np.prod([z for _, z, _ in path]) for v, path in found))


def _known(x: np.ndarray, path) -> np.ndarray:
    """Rows by path features: 1 where a row passes all splits on the feature."""
    return np.stack([np.all([(x[:, f] <= t) == left for t, left in tests], 0) for f, _, tests in path], 1).astype(np.float64)


def _weighted(o: np.ndarray, z: np.ndarray, without: tuple[int, ...], size: int) -> np.ndarray:
    """Sum over k of k! (size - 1 - k)! / size! times the coefficient of t^k in the product of z + o t over the other features."""
    poly = np.zeros((len(o), size))
    poly[:, 0] = 1.0
    for j in range(o.shape[1]):
        if j not in without:
            poly = poly * z[j] + np.concatenate((np.zeros((len(o), 1)), poly[:, :-1]), 1) * o[:, j : j + 1]
    return poly @ np.array([factorial(k) * factorial(size - 1 - k) / factorial(size) for k in range(size)])


def shap_values(found, x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape)
    for value, path in found:
        if path:
            o, z = _known(x, path), np.array([s for _, s, _ in path])
            for i, (f, *_) in enumerate(path):
                out[:, f] += value * (o[:, i] - z[i]) * _weighted(o, z, (i,), len(path))
    return out


def interaction_values(found, x: np.ndarray) -> np.ndarray:
    """(rows, features, features): symmetric; rows of the matrix add up to the Shapley values."""
    n, k = x.shape
    out = np.zeros((n, k, k))
    for value, path in found:
        if len(path) > 1:
            o, z = _known(x, path), np.array([s for _, s, _ in path])
            for i in range(len(path)):
                for j in range(i):
                    own = value * (o[:, i] - z[i]) * (o[:, j] - z[j]) * _weighted(o, z, (i, j), len(path) - 1) / 2
                    out[:, path[i][0], path[j][0]] += own
                    out[:, path[j][0], path[i][0]] += own
    at = np.arange(k)
    out[:, at, at] = shap_values(found, x) - out.sum(2)
    return out


def explain(rows: DataFrame, found, names: list[str], key: str = "window_id", interactions: list[str] | None = None) -> DataFrame:
    """(key, feature, other, value) long: Shapley values (other null), and interactions among the named features, in batches."""
    from pyspark.ml.functions import vector_to_array

    chosen = [names.index(f) for f in interactions or []]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                x = np.stack(part["x"].to_numpy())
                values = shap_values(found, x)
                r, f = np.nonzero(values)
                yield pd.DataFrame({"k": part["k"].to_numpy()[r], "feature": np.array(names, object)[f], "other": None, "value": values[r, f]})
                if chosen:
                    cube = interaction_values(found, x)[:, chosen][:, :, chosen]
                    for a in range(len(chosen)):
                        for b in range(a + 1, len(chosen)):
                            yield pd.DataFrame({"k": part["k"].to_numpy(), "feature": names[chosen[a]], "other": names[chosen[b]], "value": cube[:, a, b]})

    out = rows.select(F.col(key).alias("k"), vector_to_array("features").alias("x")).mapInPandas(run, "k string, feature string, other string, value double")
    return out.withColumnRenamed("k", key)


def top_by_variance(values: DataFrame, rows: int, top: int = 30) -> DataFrame:
    """Features by the population variance of their Shapley values over all rows, those without a value counting 0."""
    told = values.where("other IS NULL").groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    return told.select("feature", (F.col("q") / rows - F.pow(F.col("s") / rows, 2)).alias("variance")).orderBy(F.desc("variance"), "feature").limit(top)

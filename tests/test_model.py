from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from stratalog.operators import model as T
from stratalog.operators import templates as D


def plain_shapley(found, x):
    """By all subsets of features."""
    k = len(x)

    def value(known):
        total = 0.0
        for v, path in found:
            p = 1.0
            for f, z, tests in path:
                p *= float(all((x[f] <= t) == left for t, left in tests)) if f in known else z
            total += v * p
        return total

    out = np.zeros(k)
    for i in range(k):
        rest = [j for j in range(k) if j != i]
        for n in range(k):
            for s in combinations(rest, n):
                out[i] += factorial(n) * factorial(k - n - 1) / factorial(k) * (value({*s, i}) - value(set(s)))
    return out


def test_shapley_values_equal_all_subsets_and_add_up(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (160, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3) | (x[:, 2] > 0.85)).astype(int)
    rows = spark.createDataFrame([(str(i), int(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y))], ["window_id", "label", "features"])
    model = T.train(rows, maxIter=4, maxDepth=3)
    found = T.leaves(spark, model, str(tmp_path))
    values = T.shap_values(found, x[:12])
    for i in range(6):
        assert np.allclose(values[i], plain_shapley(found, x[i]), atol=1e-9)
    probability = {r.window_id: r.probability for r in T.score(model, rows).collect()}
    margin = values.sum(1) + T.expected_value(found)
    assert np.allclose([np.log(probability[str(i)] / (1 - probability[str(i)])) for i in range(12)], margin, atol=1e-6)
    cube = T.interaction_values(found, x[:12])
    assert np.allclose(cube.sum(2), values) and np.allclose(cube, cube.transpose(0, 2, 1))
    long = T.explain(rows.limit(5), found, list("abcd"), interactions=["a", "b"])
    assert long.where("other IS NOT NULL").count() == 5
    T.save(spark, model, list("abcd"), f"{tmp_path}/m")
    assert T.load(spark, f"{tmp_path}/m")[1] == list("abcd")


def test_training_needs_both_labels(spark):
    rows = spark.createDataFrame([("1", 1, Vectors.dense([0.0]))], ["window_id", "label", "features"])
    with pytest.raises(ValueError):
        T.train(rows)


def test_drain(spark):
    lines = ["Disk 12 slow", "Disk 7 slow", "Disk 7 fast now", "user bob logged in", "user eve logged in", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "ord long, message_clean string")
    fitted = D.fit(df)
    assert {r.template_str for r in fitted.collect()} == {"Disk <*> slow", "Disk 7 fast now", "user <*> logged in"}
    got = {r.ord: (r.template_str, r.params) for r in D.match(df, fitted).collect()}
    assert got[0] == ("Disk <*> slow", {"var1": "12"}) and got[4] == ("user <*> logged in", {"var1": "eve"}) and got[5] == (None, {}) and got[6] == (None, {})
    again = {r.template_str: r.template_id for r in D.fit(spark.createDataFrame([(9, "user joe logged in"), (10, "brand new line")], "ord long, message_clean string"), known=fitted).collect()}
    before = {r.template_str: r.template_id for r in fitted.collect()}
    assert again["user <*> logged in"] == before["user <*> logged in"] and again["brand new line"] > max(before.values())


def test_the_queries_take_every_error_as_a_symptom(spark):
    from stratalog.plans import binding, catalog_more

    rows, _ = catalog_more._matrix(spark, "/root/testdata/sf0.001")
    errors = binding.instances(spark, "/root/testdata/sf0.001").where("template_id = 'error'")
    positive = rows.where("label = 1")
    assert positive.count() == errors.select("bucket_id").distinct().count() > 100


def test_the_queries_train_as_many_rounds_as_the_operator(spark):
    from stratalog.plans import catalog_more

    model, _, _ = catalog_more._trained(spark, "/root/testdata/sf0.001")
    assert model.getNumTrees == T.PARAMETERS["maxIter"] == 100


def test_gbt_score_trains_on_rows_that_are_computed_once(spark, monkeypatch):
    from stratalog.plans import catalog_more

    seen = []
    monkeypatch.setattr(T, "train", lambda rows: seen.append(rows))
    monkeypatch.setattr(T, "score", lambda model, rows: (seen.append(rows), rows.withColumn("probability", rows["label"] * 1.0))[1])
    assert catalog_more.gbt_score(spark, "/root/testdata/sf0.001").count() > 10
    for rows in seen:
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "RDD" in plan and "Exchange" not in plan and "Join" not in plan


def test_tree_shap_explains_rows_that_are_computed_once(spark, monkeypatch):
    from stratalog.plans import catalog_more

    seen = []
    monkeypatch.setattr(T, "train", lambda rows: seen.append(rows))
    monkeypatch.setattr(T, "leaves", lambda spark, model, folder: [(1.0, [(0, 0.5, [(0.0, True)])])])
    explain = T.explain
    monkeypatch.setattr(T, "explain", lambda rows, found, names: (seen.append(rows), explain(rows, found, names))[1])
    assert catalog_more.tree_shap(spark, "/root/testdata/sf0.001").count() > 10
    assert len(seen) == 2
    for rows in seen:
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "RDD" in plan and "Exchange" not in plan and "Join" not in plan


def test_no_step_of_the_matrix_plans_all_kinds_of_features(spark, monkeypatch):
    from stratalog.plans import catalog_more

    sizes, cut = [], catalog_more.cut
    monkeypatch.setattr(catalog_more, "cut", lambda df: (sizes.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange ")), cut(df))[1])
    rows, names = catalog_more._matrix(spark, "/root/testdata/sf0.001")
    assert max(sizes) <= 12 and len(names) == len(rows.first().features) > 30


@pytest.fixture
def dense(spark, tmp_path, monkeypatch):
    """Events with an error in every bucket, as in large tables: no bucket is negative."""
    from stratalog.plans import binding

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.unionByName(events.selectExpr("event_id + 100000 AS event_id", "ts", "user_id", "'error' AS event_type", "value", "props")).write.parquet(f"{tmp_path}/events.parquet")
    assert binding.buckets(spark, str(tmp_path)).where("error_count = 0").isEmpty()
    monkeypatch.setitem(T.PARAMETERS, "maxIter", 3)
    return str(tmp_path)


def test_gbt_score_without_negatives_gives_every_test_row_one_probability(spark, dense):
    from stratalog.plans import catalog_more

    rows = catalog_more.gbt_score(spark, dense).collect()
    assert len(rows) > 100 and {r.label for r in rows} == {1}
    assert len({r.probability for r in rows}) == 1 and 0.5 < rows[0].probability < 1


def test_tree_shap_without_negatives_has_no_values(spark, dense, monkeypatch):
    from stratalog.plans import catalog_more

    found, explain = [], T.explain
    monkeypatch.setattr(T, "explain", lambda rows, leaves, names: (found.append((leaves, rows.count())), explain(rows, leaves, names))[1])
    out = catalog_more.tree_shap(spark, dense)
    assert out.columns == ["window_id", "feature", "other", "value"] and out.isEmpty()
    (leaves, n), = found
    assert n > 100 and len(leaves) == 3 and all(path == [] for _, path in leaves) and T.expected_value(leaves) > 0

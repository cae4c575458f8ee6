import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stratalog.functions.timing import bucket_end, bucket_id
from stratalog.operators import buckets as B
from stratalog.operators import evaluation as E
from stratalog.operators import labels as L
from stratalog.operators import mining as M
from stratalog.operators import select as Q
from stratalog.plans import catalog

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 3, 1, 10, 0)
MIN = dt.timedelta(minutes=1)


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else value


@pytest.mark.parametrize("name", ["bucket_agg", "bucket_dedupe", "bucket_asof_system", "bucket_templates", "sel_bottom_n", "tpl_precursors", "labels", "episodes", "windows", "feat_numeric_var", "ts_folds", "seq_pairs", "log_parse"])
def test_sql_twins(spark, name):
    out = catalog.queries()[name](spark, SF)
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(map(plain, r)) for r in out.collect()))) == sorted(map(str, (tuple(map(plain, r)) for r in want)))


def test_registry_is_whole(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 10


def events(spark, rows):
    return spark.createDataFrame(rows, "ord long, ts timestamp_ntz, level string, component string, template_id string, template_str string, params map<string,string>")


def test_bucket_edges(spark):
    rows = [
        (1, T0, "Error", "a", "1", "t", {"var1": "x"}), (2, T0, "error", "a", "1", "t", {"var1": "x"}), (3, T0, "weird", None, None, None, {}), (4, T0, "weird", "", None, None, {}),
        (5, T0 + 5 * MIN, "INFO", "b", "1", "t", {"var1": "y"}), (6, None, "info", "b", "1", "t", {}),
    ]
    lat = spark.createDataFrame([(1, T0, 150.0), (2, T0 + MIN, 0.0), (3, T0 + 5 * MIN, 100.0), (4, T0 + 60 * MIN, 900.0)], "ord long, ts timestamp_ntz, write_latency_ms double")
    sysi = spark.createDataFrame([(T0 + 5 * MIN, 1.0), (T0 + 9 * MIN, 2.0), (T0 + 11 * MIN, 3.0)], "timestamp timestamp_ntz, cpu_util double")
    out = {r.start_time: r for r in B.build(events(spark, rows), lat, sysi).collect()}
    a, b = out[T0], out[T0 + 5 * MIN]
    assert len(out) == 2
    assert (a.total_events, a.error_count, a.has_spike, a.write_latency_ms, a.cpu_util) == (3, 1, True, 0.0, 1.0)
    assert (b.info_count, b.has_spike, b.cpu_util) == (1, False, 2.0)
    assert a.component_counts_json == '{"a":1,"unknown":2}'
    dense = B.build(events(spark, [rows[0], (9, T0 + 20 * MIN, "error", "a", "1", "t", {"var1": "z"})]), dense=True)
    assert dense.count() == 5 and dense.agg(F.sum("total_events")).first()[0] == 2


def test_merge_is_order_free_and_upsert_idempotent_by_day(spark, tmp_path):
    def table(n, start=T0):
        own = spark.createDataFrame([(start, n, 1, 0, 0, 0, 0, n > 1)], "start_time timestamp_ntz, total_events long, error_count long, warning_count long, info_count long, verbose_count long, debug_count long, has_spike boolean")
        return own.withColumn("bucket_id", bucket_id(F.col("start_time"))).withColumn("end_time", bucket_end(F.col("start_time")))

    one, two = B.merge([table(1), table(2)]).first(), B.merge([table(2), table(1)]).first()
    assert one.total_events == two.total_events == 3 and one.has_spike and two.has_spike
    path = str(tmp_path / "b")
    B.upsert(spark, path, table(1))
    B.upsert(spark, path, table(5, T0 + dt.timedelta(days=1)))
    B.upsert(spark, path, table(2))
    assert sorted(r.total_events for r in spark.read.parquet(path).collect()) == [3, 5]


def test_selection_errors_and_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("c", 2.0)], "bucket_id string, x double")
    assert [r.bucket_id for r in Q.bottom_n(df, "x", 3).collect()] == ["b", "c", "a"]
    for bad in (lambda: Q.by_flags(df), lambda: Q.by_thresholds(df, x_zz=1), lambda: Q.get_random(df, 9), lambda: Q.by_time_range(df, 2, 1)):
        with pytest.raises(ValueError):
            bad()


def test_episode_edges_and_gap(spark):
    times = spark.createDataFrame([(T0 + m * MIN,) for m in (0, 10, 21)], "ts timestamp_ntz")
    assert [r.n for r in L.episodes(times, 10).orderBy("episode").collect()] == [2, 1]
    assert L.learn_gap(times)["gap_minutes"] is None
    many = spark.createDataFrame([(T0 + m * MIN,) for e in range(12) for m in (e * 500, e * 500 + 1, e * 500 + 3)], "ts timestamp_ntz")
    assert 2 <= L.learn_gap(many)["gap_minutes"] <= 120
    even = spark.createDataFrame([(T0 + 7 * m * MIN,) for m in range(30)], "ts timestamp_ntz")
    assert L.learn_gap(even)["gap_minutes"] == 7 and L.learn_gap(even)["method"] == "degenerate-median"


def test_splits_and_scores(spark):
    rows = spark.createDataFrame([(str(i), i, int(i % 3 == 0)) for i in range(12)] + [("z", 99, 7)], "bucket_id string, timestamp int, label int")
    split = {(r.bucket_id): r.split for r in E.split_balanced(rows).collect()}
    assert split["z"] == "train" and split["9"] == "test"
    single = spark.createDataFrame([("a", 1, 0.5)], "bucket_id string, label int, probability double")
    assert E.auc(single).first().auc == 0.5 and E.negative_quantile(single).count() == 0
    folds = E.time_series_folds(rows, 3).collect()
    for k in range(3):
        assert max(r.timestamp for r in folds if r.fold == k and r.split == "train") < min(r.timestamp for r in folds if r.fold == k and r.split == "test")


def test_greedy_negatives(spark):
    rows = [("p1", 0.0, "n1", 60.0), ("p1", 0.0, "n2", -10.0), ("p2", 30.0, "n1", 30.0), ("p2", 30.0, "n3", -90.0), ("p3", 90000.0, "n9", 5.0)]
    df = spark.createDataFrame(rows, "positive string, p_end double, negative string, delta double")
    assert {tuple(r) for r in M.pick_negatives(df).collect()} == {("p1", "n1"), ("p2", "n3"), ("p3", "n9")}

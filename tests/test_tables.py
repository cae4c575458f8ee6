"""Merging, routing, views, snapshots, highlights, reports, the incident catalog, CSV models and the commands."""

import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from stratalog import cli
from stratalog.functions import display
from stratalog.operators import analytics as A
from stratalog.operators import buckets as B
from stratalog.operators import explained as X
from stratalog.operators import mining as M
from stratalog.operators import snapshots as W
from stratalog.operators import views as V
from stratalog.plans import catalog, catalog_extra, reports
from stratalog.sources import config, discovery, incidents, tables
from stratalog.streaming import windows as S

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 3, 1, 10, 0)
MIN = dt.timedelta(minutes=1)


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else value


def test_sql_twins_of_further_queries(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    for name in ("bucket_merge_templates", "bucket_merge_components", "event_routes", "event_waiting", "processing_windows", "file_ranges", "bucket_compare", "bucket_top_components", "feature_names"):
        out = catalog_extra.QUERIES[name](spark, SF)
        columns = ", ".join(f'"{c}"' for c in out.columns)
        want = con.execute(f"SELECT {columns} FROM ({catalog.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, (tuple(map(plain, r)) for r in out.collect()))) == sorted(map(str, (tuple(map(plain, r)) for r in want))), name


def events(spark, rows):
    return spark.createDataFrame(rows, "ord long, ts timestamp_ntz, level string, component string, template_id string, template_str string, params map<string,string>")


def batch(spark, first, n):
    return B.build(events(spark, [(i, T0 + i * MIN, "error", f"c{i % 2}", "1", "t <*>", {"var1": str(i)}) for i in range(first, first + n)]))


def test_upsert_keeps_templates_and_components_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    for name, first in (("a", 0), ("b", 6), ("a", 0), ("b", 6), ("b", 6)):
        B.upsert(spark, path, batch(spark, first, 6), name)
    table = spark.read.parquet(path)
    assert {r.start_time: r.total_events for r in table.collect()} == {T0: 5, T0 + 5 * MIN: 5, T0 + 10 * MIN: 2}
    assert sorted(int(r.vars["var1"]) for r in A.explode_templates(table).collect()) == list(range(12))
    assert json.loads(table.where(F.col("start_time") == T0 + 5 * MIN).first().component_counts_json) == {"c0": 2, "c1": 3}
    assert table.where(F.col("start_time") == T0 + 5 * MIN).first().batches == ["a", "b"]
    assert [c for c in table.columns[:3]] == ["bucket_id", "start_time", "end_time"] and set(B.SYSTEM) <= set(table.columns)


def test_merge_unites_templates(spark):
    schema = "bucket_id string, start_time timestamp_ntz, end_time timestamp_ntz, templates string, component_counts_json string, has_spike boolean"
    one = {"7": {"template_str": "", "instances": [{"var1": "b", "timestamp": "2024-03-01T10:02:00"}, {"timestamp": "2024-03-01T10:01:00", "var1": "a"}]}}
    two = {"7": {"template_str": "x <*>", "instances": [{"var1": "a", "timestamp": "2024-03-01T10:01:00"}, {"var1": "c"}]}, "8": {"template_str": "y", "instances": []}}
    parts = [spark.createDataFrame([("b", T0, T0 + 5 * MIN, t, c, s)], schema) for t, c, s in ((json.dumps(one), '{"a":1}', False), (json.dumps(two), '{"a":2,"b":"x"}', None), (None, None, True), ("{broken", "{", None))]
    (r,) = B.merge(parts).collect()
    got = json.loads(r.templates)
    assert got["7"]["template_str"] == "x <*>" and [i["var1"] for i in got["7"]["instances"]] == ["c", "a", "b"] and got["8"] == {"template_str": "y", "instances": []}
    assert json.loads(r.component_counts_json) == {"a": 3} and r.has_spike


def test_bounds_and_invalid_events(spark):
    table = spark.createDataFrame([("a", T0, T0 + 5 * MIN), ("b", T0 + 5 * MIN, T0 + 10 * MIN)], "bucket_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    assert [r.bucket_id for r in B.within(table, T0, T0 + 7 * MIN, strict=False).collect()] == ["a"] and B.within(table, T0, T0 + 10 * MIN).count() == 2
    with pytest.raises(Exception, match="beyond its window"):
        B.within(table, T0, T0 + 7 * MIN).collect()
    texts = spark.createDataFrame([("2024-03-01 10:00:00",), ("soon",), (None,)], "ts string")
    good, bad = B.valid(texts)
    assert [r.ts for r in good.collect()] == [T0] and {r.ts for r in bad.collect()} == {"soon", None}
    with pytest.raises(Exception, match="no timestamp"):
        B.require_valid(events(spark, [(1, None, "error", "a", None, None, {})])).collect()


def test_routes_windows_and_waiting(spark):
    hours = dt.timedelta(hours=1)
    rows = [(0, T0), (1, T0 + 9 * hours), (2, T0), (3, T0 + 9 * hours), (4, T0 + 17 * hours)]
    routes = S.routed(spark.createDataFrame(rows, "ord long, ts timestamp_ntz"), span_rows=2)
    assert [r.route for r in routes.orderBy("ord").collect()] == ["window", "future", "late", "window", "future"]
    assert sum(r.buckets for r in S.waiting(routes).collect()) == 4 and {r.level for r in S.waiting(routes).collect()} == {"ok"}
    got = S.processing_windows(spark, T0 + 2 * MIN, T0 + 9 * hours).collect()
    assert [(r.window, r.window_start) for r in got] == [(i, T0 + 4 * i * hours) for i in range(3)] and got[0].window_end == got[1].window_start


def test_live_view_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(T0 + i * MIN, "error" if i % 4 == 0 else "info") for i in range(100)], "ts timestamp_ntz, level string")
    df.select(F.col("ts").cast("timestamp").alias("ts"), "level").write.parquet(str(tmp_path / "in"))
    shown = []
    S.monitor(spark.readStream.schema("ts timestamp, level string").parquet(str(tmp_path / "in")), str(tmp_path / "check"), shown.append).awaitTermination()
    assert shown[-1].count("/min") == 10 and "b_20240301_1135" in shown[-1] and shown[-1].splitlines()[-1] == "▁" * 10


def test_display_texts():
    assert display.sparkline([1, 2, 8]) == "▁▂█" and display.sparkline([]) == ""
    assert display.size_text(1536) == "1.5 KB" and display.size_text(5) == "5 B" and display.time_text(90) == "1.5 min"
    assert display.range_text(T0, T0 + 5 * MIN) == "2024-03-01 10:00 - 10:05" and display.range_text(None, T0) == "-"
    assert display.bar(25.0, 4) == "[#...] 25.0 %" and display.bar(95.0, 2).endswith("!!") and display.bar(None) == "-"
    assert display.tree("t", [("a", 1), ("b", 2)]).splitlines() == ["t", "├─ a: 1", "└─ b: 2"]
    lines = display.panel("x", ["one", "a longer line"]).splitlines()
    assert len({len(x) for x in lines}) == 1 and lines[1].startswith("│ one ")
    assert display.table(("n", "v"), [("a", 1.5), ("bb", None)]).splitlines() == ["n   v", "a   1.5", "bb  -"]


def test_views_of_buckets(spark):
    table = batch(spark, 0, 12).withColumn("cpu_util", F.lit(95.0)).withColumn("write_latency_ms", F.lit(7.0)).withColumn("has_spike", F.lit(None).cast("boolean"))
    r = V.details(table).where("bucket_id = 'b_20240301_1000'").first()
    assert (r.error_share, r.severity, r.cpu_util_state, r.duration_minutes, r.has_spike) == (100.0, "red", "critical", 5.0, False)
    got = {x.metric: (x.first, x.second, x.change, x.change_percent) for x in V.compare(table, "b_20240301_1000", "b_20240301_1010").collect()}
    assert got["total_events"] == (5.0, 2.0, -3.0, -60.0) and got["debug_count"] == (0.0, 0.0, 0.0, None) and "disk_util" not in got
    (first, *_) = V.bucket_texts(table, 1)
    assert "b_20240301_1000" in first and "!!" in first and "components" in first and "c0: 3" in first
    assert "-60" in V.compare_text(V.compare(table, "b_20240301_1000", "b_20240301_1010").collect())


def labelled(spark):
    labels = spark.createDataFrame([("b_20240301_1005", 1, T0 + 7 * MIN), ("b_20240301_1010", 0, T0 + 15 * MIN)], "bucket_id string, label int, window_end timestamp_ntz")
    table = batch(spark, 0, 12)
    members = spark.createDataFrame([("b_20240301_1005", "b_20240301_1000", T0, T0 + 5 * MIN), ("b_20240301_1005", "b_20240301_1005", T0 + 5 * MIN, T0 + 10 * MIN), ("b_20240301_1010", "b_20240301_1010", T0 + 10 * MIN, T0 + 15 * MIN)], "window_id string, bucket_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    return labels, table, members, cli.instances_of(table)


def test_snapshots_are_written_read_and_summed_up(spark, tmp_path):
    labels, table, members, instances = labelled(spark)
    W.write(W.take(labels, members, table, instances, 10), str(tmp_path / "s"))
    found = W.read(spark, str(tmp_path / "s"))
    assert [r.window_id for r in found["window_index"].orderBy("window_id").collect()] == ["b_20240301_1005_000000", "b_20240301_1010_000001"]
    told = {r.label: (r.buckets, r.events, r.templates) for r in W.summary(found).collect()}
    assert told == {1: (2, 7, 1), 0: (1, 2, 1)}
    assert [r.template_id for r in W.sequences(found).orderBy("window_id", "pos").collect()] == ["1"] * 9
    shap = spark.createDataFrame([("b_20240301_1000", "f", 0.5)], "bucket_id string, feature string, shap double")
    got = {r.bucket_id: r.contributions for r in W.with_contributions(found, shap).collect()}
    assert got["b_20240301_1000"] == {"f": 0.5} and got["b_20240301_1010"] is None


def test_rows_highlights_and_reports(spark, tmp_path):
    scored = spark.createDataFrame([("a", 1, 0.9), ("b", 0, 0.2), ("c", 0, 0.4)], "window_id string, label int, probability double")
    values = spark.createDataFrame([("a", "template_7_var1_mean", -2.0), ("a", "template_count_8", 1.0), ("a", "metric_mean_cpu_util", 0.5), ("b", "template_count_8", 3.0)], "window_id string, feature string, value double")
    rows = {r.bucket_id: r for r in X.shap_rows(scored, values, 0.1).collect()}
    assert json.loads(rows["a"].contributions)["template_count_8"] == 1.0 and rows["c"].contributions == "{}" and rows["b"].expected_value == 0.1
    assert {(r.bucket_id, r.feature, r.shap) for r in X.contributions_of(X.shap_rows(scored, values, 0.1)).where("bucket_id = 'b'").collect()} == {("b", "template_count_8", 3.0)}
    top = X.highlights(scored, values, 2)
    assert [(r.rank, r.feature) for r in top.orderBy("rank").collect()] == [(1, "template_7_var1_mean"), (2, "template_count_8")]
    assert {r.bucket_id for r in X.highlights(scored.where("label = 0"), values, 2, 1).collect()} == set() and {r.bucket_id for r in X.highlights(scored.where("label = 0"), values).collect()} == {"b"}
    texts = spark.createDataFrame([("7", "slow <*>"), ("8", "failed")], "template_id string, template_str string")
    kinds = spark.createDataFrame([("7", "var1", "datetime")], "template_id string, var string, kind string")
    each = reports.per_bucket(top, texts, kinds)
    assert [(r["template_str"], r["var_type"], r["var_type_coarse"]) for r in each[0]["rows"]] == [("slow <*>", "datetime", "other"), ("failed", None, None)]
    told = reports.aggregate(values.withColumnRenamed("window_id", "bucket_id").withColumnRenamed("value", "shap"), scored.withColumnRenamed("window_id", "bucket_id"), texts, kinds, 2)
    assert (told["rows"], told["positives"], [f["feature"] for f in told["features"]], told["templates"][0]["template_id"]) == (3, 1, ["template_count_8", "template_7_var1_mean"], "8")
    reports.write(spark, str(tmp_path / "r"), told, each, {"metrics": {"recall": 1.0}})
    assert discovery.load_json(spark, str(tmp_path / "r/summary.json")) == {"metrics": {"recall": 1.0}}
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r/shap_buckets.txt")).collect())
    assert "Bucket a (label 1, probability 0.900)" in text and "-2.000" in text and "failed" in reports.aggregate_text(told)
    assert "recall" in reports.summary_text({"recall": 1.0, "tp": 3}) and "tp" in reports.summary_text({"recall": 1.0, "tp": 3}, compact=False)


def test_negatives_by_mode(spark):
    labels, _, _, instances = labelled(spark)
    assert M.select_negatives(labels, "none", 1).count() == 0 and M.select_negatives(labels, "time-matched", 1, per_positive=0).count() == 0
    assert [r.bucket_id for r in M.select_negatives(labels, "time-matched", 1).collect()] == ["b_20240301_1010"]
    assert [r.bucket_id for r in M.select_negatives(labels, "template-matched", 1, instances, ["1"]).collect()] == ["b_20240301_1010"]
    with pytest.raises(ValueError, match="not x"):
        M.select_negatives(labels, "x", 1)


def test_incident_catalog(spark, tmp_path):
    path = str(tmp_path / "catalog")
    own = incidents.Catalog(spark, path)
    assert own.names() == []
    own.put(incidents.Incident("stuck", [7, 8], 5, 30))
    own.put(incidents.Incident("full", ["9"]))
    own.put(incidents.Incident("full", ["10"]))
    again = incidents.Catalog(spark, path)
    assert again.names() == ["full", "stuck"] and again.get("stuck").templates == ["7", "8"] and again.get("full").anchor == "10"
    again.remove("stuck")
    assert incidents.Catalog(spark, path).names() == ["full"]
    with pytest.raises(KeyError):
        again.get("stuck")
    for bad in ({"templates": []}, {"templates": ["1"], "lookback_minutes": 90}):
        with pytest.raises(ValueError):
            incidents.Incident("x", **bad)


def test_csv_train_and_score(spark, tmp_path, capsys):
    rows = [(f"b{i}", i % 2, str(i % 2 * 10 + i % 3), "x" if i % 5 else "1e1") for i in range(60)]
    spark.createDataFrame(rows, "bucket_id string, y int, `f 1` string, g string").write.option("header", "true").csv(str(tmp_path / "in"))
    common = ["--data", str(tmp_path / "in"), "--feature-columns", "f 1", "--feature-columns", "g"]
    assert cli.main(["train", *common, "--label-column", "y", "--model-output", str(tmp_path / "m"), "--rounds", "2"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["names"] == {"f 1": "f_1", "g": "g"}
    assert cli.main(["score", *common, "--model", str(tmp_path / "m"), "--predictions", str(tmp_path / "p")]) == 0
    got = {r.bucket_id: float(r.probability) for r in tables.read_csv(spark, str(tmp_path / "p")).collect()}
    assert len(got) == 60 and all((got[b] > 0.5) == (y == 1) for b, y, *_ in rows)
    with pytest.raises(ValueError, match="missing: h"):
        tables.feature_rows(spark.createDataFrame(rows, "bucket_id string, y int, f string, g string"), ["h"], [])
    assert tables.safe_names(["a b", "a_b", "a-b"]) == {"a b": "a_b", "a_b": "a_b_2", "a-b": "a_b_3"}


def test_settings_files(tmp_path):
    path = str(tmp_path / "create.yaml")
    assert cli.main(["create", "--init-config", path]) == 0
    assert config.load(path) == config.CREATE
    own = tmp_path / "own.yaml"
    own.write_text("file_limit: 0\nforce: true\noutput_root: null\nyes: true\n")
    got = config.settings(config.CREATE, str(own), {"file_limit": None, "bucket_duration": 15, "command": "create"})
    assert (got["file_limit"], got["force"], got["output_root"], got["bucket_duration"], got["yes"]) == (0, True, "out", 15, True)
    own.write_text("file_limits: 3\n")
    with pytest.raises(ValueError, match="file_limits"):
        config.settings(config.CREATE, str(own), {})
    with pytest.raises(FileExistsError):
        config.write_default(path, config.CREATE)


def test_confirmation():
    checked = {"is_valid": True, "missing_categories": ["latency"], "warnings": ["no latency files"], "estimated_seconds": 2.4}
    discovery.confirm(checked, lambda q: "yes")
    discovery.confirm(checked, None, yes=True)
    for answer in ("", "n", "no"):
        with pytest.raises(discovery.Aborted):
            discovery.confirm(checked, lambda q, a=answer: a)
    with pytest.raises(ValueError):
        discovery.confirm(checked, None, strict=True)
    text = discovery.summary_text(discovery.Discovery({"event": ["a"], "latency": []}, 1, 2048), checked)
    assert "event: 1 files" in text and "2.0 KB" in text and "no latency files" in text


def test_read_queue(spark):
    ranges = spark.createDataFrame([("a", T0 + 3 * MIN, T0 + 9 * MIN), ("b", T0, T0 + MIN), ("c", T0 + 5 * MIN, T0 + 6 * MIN), ("d", T0 + 60 * MIN, T0 + 61 * MIN)], "source_file string, start_time timestamp_ntz, end_time timestamp_ntz")
    assert [(r.source_file, r.place) for r in discovery.read_queue(ranges, T0 + 30 * MIN, ["c"]).orderBy("place").collect()] == [("c", 1), ("b", 2), ("a", 3)]

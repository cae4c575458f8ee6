import datetime as dt
import json
import os

from pyspark.sql import functions as F

from stratalog import cli
from stratalog.operators import lookback as K
from stratalog.plans import evaluate, ingest
from stratalog.sources import config, discovery

T0 = dt.datetime(2024, 3, 1, 10, 0)


def write(folder):
    folder.mkdir()
    lines = []
    for i in range(240):
        at = T0 + dt.timedelta(minutes=2 * i)
        lines.append(f"{at:%Y-%m-%d %H:%M:%S}.000 +00:00 [Warning] [Disk] [T=1,ET=] Disk {i % 7} slow")
        if i % 40 >= 36:
            lines.append(f"{at + dt.timedelta(seconds=30):%Y-%m-%d %H:%M:%S}.000 +00:00 [Error] [Pool] [T=2,ET=] pool failed code {i}")
        lines.append("\t[+] continuation")
    (folder / "x_NAS_1.log").write_text("\n".join(lines))
    (folder / "latency.txt").write_text("\n".join(f"{T0 + dt.timedelta(minutes=5 * i):%Y-%m-%d %H:%M:%S}  1.5  {90 + i}  10  20  1  2" for i in range(90)))
    frame = "=" * 44
    (folder / "Information.txt").write_text("".join(f"{frame}\n[3/1/2024 {10 + h % 2}:00:00 AM] Periodic Information\n{frame}\nCPU Utilization: {10 + h}%\n" for h in range(2)))
    (folder / "other.bin").write_text("x")


def test_files_to_buckets_and_queries(spark, tmp_path, capsys):
    write(tmp_path / "data")
    told = ingest.create(spark, str(tmp_path / "data"), str(tmp_path / "out"))
    table = spark.read.parquet(str(tmp_path / "out/buckets"))
    assert told["events"] == 264 and told["buckets"] == 96 == table.count() and told["is_valid"]
    r = table.where(F.col("start_time") == T0 + dt.timedelta(hours=1)).first()
    assert r.cpu_util == 11.0 and r.write_latency_ms == 102.0 and r.has_spike
    files = discovery.categorize(discovery.listing(spark, str(tmp_path / "data")))
    manifest = discovery.load_json(spark, str(tmp_path / "out/manifest"))
    assert {x.state for x in discovery.manifest_changes(files, manifest).collect()} == {"cached"} and manifest["totals"]["files"] == 3
    rows = cli.instances_of(table)
    (failed,) = [x.template_id for x in rows.where("template_str LIKE 'pool failed%'").select("template_id").distinct().collect()]
    window = K.build_windows(table, rows, failed, lead=15)
    assert window["summary"]["lead_time_used_minutes"] == 15 and window["events"].where("phase = 'pre_incident'").count() > 0
    found = evaluate.run(spark, table, rows, evaluate.Config(incident=failed, rounds=3, lookback_minutes=20, threshold_rate=0.1), str(tmp_path))
    assert {"tp", "fp", "test_auc"} <= set(found["metrics"]) and found["shap_aggregate"].count() > 0
    assert cli.main(["select", "info", "--file", str(tmp_path / "out/buckets"), "--format", "json"]) == 0
    assert '"buckets":96' in capsys.readouterr().out


def test_a_second_run_reads_only_new_files_and_a_changed_one_builds_anew(spark, tmp_path):
    write(tmp_path / "data")
    data, out = str(tmp_path / "data"), str(tmp_path / "out")
    first = ingest.create(spark, data, out)
    again = ingest.create(spark, data, out)
    assert (first["files"], again["files"]) == ({"new": 3, "cached": 0}, {"new": 0, "cached": 3}) and again["events"] == first["events"] == 264
    (tmp_path / "data/y_NAS_2.log").write_text(f"{T0:%Y-%m-%d %H:%M:%S}.000 +00:00 [Error] [Disk] [T=1] Disk 9 slow\n")
    more = ingest.create(spark, data, out)
    table = spark.read.parquet(f"{out}/buckets")
    assert more["files"] == {"new": 1, "cached": 3} and more["events"] == 265 and more["buckets"] == first["buckets"]
    r = table.where(F.col("start_time") == T0).first()
    assert r.error_count == 1 and r.write_latency_ms == 90.0 and cli.instances_of(table).where("vars['var1'] = '9'").count() == 1
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/template_snapshots").count() >= spark.read.parquet(f"{out}/templates").count()
    (tmp_path / "data/y_NAS_2.log").write_text(f"{T0:%Y-%m-%d %H:%M:%S}.000 +00:00 [Error] [Disk] [T=1] Disk 77 slow\n")
    os.utime(tmp_path / "data/y_NAS_2.log", (1, 1))
    assert ingest.create(spark, data, out)["events"] == 265
    assert {r.v for r in cli.instances_of(spark.read.parquet(f"{out}/buckets")).select(F.col("vars")["var1"].alias("v")).collect()} >= {"77"} and cli.instances_of(spark.read.parquet(f"{out}/buckets")).where("vars['var1'] = '9'").count() == 0


def test_an_evaluation_from_settings_writes_reports_and_snapshots(spark, tmp_path, capsys):
    write(tmp_path / "data")
    own = config.CREATE | {"data_dir": str(tmp_path / "data"), "output_root": str(tmp_path / "out"), "save_summary": True, "yes": True}
    assert "96 buckets" in ingest.verification_text(ingest.create_from(spark, own))
    root = str(tmp_path / "artifacts")
    (tmp_path / "exclude.yaml").write_text("templates: [999]\npatterns: ['x.*']\n")
    (tmp_path / "shap.json").write_text(json.dumps({"incident_substring": "pool failed", "bucket_path": str(tmp_path / "out/buckets"), "output_root": root, "lookback_minutes": 20, "threshold_rate": 0.1, "rounds": 2, "exclude_file": str(tmp_path / "exclude.yaml"), "details": "full", "negative_tolerance": 240}))
    told = evaluate.run_settings(spark, config.settings(config.SHAP, str(tmp_path / "shap.json"), {}), lambda question: "all" if "pool failed" in question else "")
    assert told["metrics"]["test_auc"] >= 0 and told["shap_scope"] == "test" and "features" in told["text"] and told["windows"]["coverage_minutes"] > 0
    assert told["episode_gap"]["method"] in ("too-few", "otsu", "degenerate-median")
    assert spark.read.parquet(f"{root}/shap").columns == ["bucket_id", "probability", "label", "expected_value", "contributions"]
    index = spark.read.parquet(f"{root}/snapshot/window_index")
    assert index.where("label = 1").count() > 0
    assert discovery.load_json(spark, f"{root}/shap_aggregate.json")["rows"] > 0 and K.read_artifacts(spark, f"{root}/windows")["events"].count() > 0
    assert cli.main(["select", "top", "--file", str(tmp_path / "out/buckets"), "--format", "detailed", "-n", "1"]) == 0
    assert "┌ b_2024" in capsys.readouterr().out


def test_discovery_errors_and_finder(spark, tmp_path):
    write(tmp_path / "data")
    files = discovery.listing(spark, str(tmp_path / "data"))
    assert [r.name for r in discovery.find(files, ["NAS", "zzz"]).collect()] == ["x_NAS_1.log"]
    assert discovery.find(files, ["nas", "zzz"], "all").count() == 0 and discovery.find(files, [], extensions=["txt"]).count() == 2
    for limit, root in ((1, "data"), (50, "none")):
        (tmp_path / "none").mkdir(exist_ok=True)
        try:
            discovery.discover(spark, str(tmp_path / root), file_limit=limit)
        except (ValueError, FileNotFoundError):
            continue
        raise AssertionError


def test_coercions():
    assert config.variable("none") is None and config.variable("3") == 3 and config.variable("x") == "x" and config.flag("Yes")
    assert config.merged({"a": 1, "b": 2}, {"a": 0}, {"b": None}) == {"a": 0, "b": 2}
    assert config.selection("all", 2) == [0, 1] and config.pairs(["a=b=c"]) == {"a": "b=c"}
    assert config.exclusions({"templates": [1], "regex": ["x.*"]}) == (["1"], ["x.*"])

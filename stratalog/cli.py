"""Command line: bucket tables, selections, template analytics, windows, evaluation, training and scoring."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators import analytics as A
from stratalog.operators import lookback as K
from stratalog.operators import model as T
from stratalog.operators import select as Q
from stratalog.operators import views as V
from stratalog.plans import evaluate, ingest
from stratalog.sources import config, incidents, tables

ROW_CAP = 100
DEFAULTS = {"create": config.CREATE, "evaluate": config.EVALUATE, "shap": config.SHAP, "window-analysis": config.WINDOW_ANALYSIS}


def show(df: DataFrame, form: str, output: str | None) -> None:
    """Rows to a folder of the store as JSON, CSV or Parquet, or the first hundred to the console."""
    if output:
        flat = df.select(*(F.to_json(c).alias(c) if form == "csv" and isinstance_of(df, c) else F.col(c) for c in df.columns))
        getattr(flat.write.mode("overwrite").options(**({"header": "true"} if form == "csv" else {})), "json" if form in ("compact", "normal", "detailed") else form)(output)
    elif form == "json":
        print("\n".join(df.limit(ROW_CAP).toJSON().collect()))
    elif form == "detailed" and {"bucket_id", "start_time", "end_time", "total_events", "error_count"} <= set(df.columns):
        print("\n\n".join(V.bucket_texts(df, ROW_CAP)))
    else:
        df.show(ROW_CAP, truncate=False if form == "normal" else 60)


def isinstance_of(df: DataFrame, column: str) -> bool:
    """Whether a column is an array, a map or a struct, which CSV has no form for."""
    return df.schema[column].dataType.typeName() in ("array", "map", "struct")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratalog")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("create", help="raw files to a bucket table; a second run reads what is new")
    c.add_argument("--data-dir")
    c.add_argument("--output-root")
    c.add_argument("--file-limit", type=int)
    c.add_argument("--bucket-duration", type=int)
    c.add_argument("--spike-threshold", type=float)
    c.add_argument("--pattern", dest="event_patterns", action="append")
    c.add_argument("--latency-pattern", action="append")
    c.add_argument("--system-pattern", action="append")
    c.add_argument("--extension", dest="extensions", action="append")
    for flag in ("force", "save-summary", "skip-validation", "strict-mode", "yes", "quiet"):
        c.add_argument(f"--{flag}", action="store_const", const=True)
    c.add_argument("--no-verify", dest="verify", action="store_const", const=False)
    s = sub.add_parser("select", help="buckets and counts")
    s.add_argument("what", choices=["count", "event-count", "random", "top", "bottom", "by-flags", "by-thresholds", "by-time", "info", "compare"])
    t = sub.add_parser("templates", help="instances of templates")
    t.add_argument("what", choices=["instances", "frequency", "timeline", "precursors"])
    w = sub.add_parser("windows", help="the window before an incident's first anchor")
    for q in (s, t, w):
        q.add_argument("--file", required=True)
        q.add_argument("--format", default="compact", choices=["compact", "normal", "detailed", "json", "csv", "parquet"])
        q.add_argument("--output")
        q.add_argument("--limit", type=int)
    for q in (s, t):
        q.add_argument("-n", type=int, default=3)
        q.add_argument("--field", default="total_events")
        q.add_argument("--start", type=dt.datetime.fromisoformat)
        q.add_argument("--end", type=dt.datetime.fromisoformat)
        q.add_argument("--filter", action="append", default=[])
    s.add_argument("--bucket", action="append", default=[], help="an id; two of them to compare")
    t.add_argument("--template-id", action="append", default=[])
    t.add_argument("--substring")
    t.add_argument("--var", action="append", default=[])
    t.add_argument("--include-vars", action="append", default=[])
    t.add_argument("--compare-cohort", action="append", default=[], help="name:field=value, buckets to count apart")
    t.add_argument("--anchor")
    t.add_argument("--lookback", type=int, default=30)
    w.add_argument("--incident", required=True)
    w.add_argument("--equivalent", action="append", default=[])
    w.add_argument("--lead", type=int, default=15)
    w.add_argument("--max", type=int, default=60)
    w.add_argument("--manual-expansion", type=int)
    w.add_argument("--filter", action="append", default=[])
    w.add_argument("--output-root")
    for name in ("evaluate", "shap", "window-analysis"):
        e = sub.add_parser(name, help="train and explain an incident's surrogate")
        e.add_argument("--file", dest="bucket_path")
        e.add_argument("--incident")
        e.add_argument("--incident-substring")
        e.add_argument("--equivalent", dest="equivalents", action="append")
        e.add_argument("--lead", dest="lead_minutes", type=int)
        e.add_argument("--max", dest="max_minutes", type=int)
        e.add_argument("--lookback", dest="lookback_minutes", type=int)
        e.add_argument("--folds", dest="cv_folds", type=int)
        e.add_argument("--rounds", type=int)
        e.add_argument("--interactions", type=int)
        e.add_argument("--artifacts")
        e.add_argument("--exclude-file")
        e.add_argument("--negative-mode", choices=["none", "time-matched", "template-matched"])
        e.add_argument("--auto-lookback", action="store_const", const=True)
        e.add_argument("--output-root")
        e.add_argument("--details", choices=["compact", "full"])
    for name in DEFAULTS:
        q = sub.choices[name]
        q.add_argument("--config", help="a YAML or JSON file of settings; the command line comes before it")
        q.add_argument("--init-config", help="write a file of all settings with their defaults, and do no more")
    r = sub.add_parser("train", help="a model from a CSV table")
    r.add_argument("--label-column", required=True)
    r.add_argument("--model-output", required=True)
    r.add_argument("--target-name", default="target")
    r.add_argument("--rounds", type=int, default=100)
    o = sub.add_parser("score", help="probabilities of a CSV table's rows")
    o.add_argument("--model", required=True)
    o.add_argument("--predictions", required=True)
    for q in (r, o):
        q.add_argument("--data", required=True)
        q.add_argument("--feature-columns", action="append", required=True)
    i = sub.add_parser("incidents", help="the catalog of incidents")
    i.add_argument("what", choices=["list", "show", "put", "remove"])
    i.add_argument("--catalog", required=True)
    i.add_argument("--name")
    i.add_argument("--template", action="append", default=[])
    i.add_argument("--lead", type=int, default=15)
    i.add_argument("--max", type=int, default=60)
    return p


def selected(table: DataFrame, a: argparse.Namespace) -> DataFrame:
    given = {k: config.flag(v) if a.what == "by-flags" else config.variable(v) for k, v in config.pairs(a.filter).items()}
    return {
        "count": lambda: table.agg(F.count(F.lit(1)).alias("buckets")), "event-count": lambda: Q.event_count(table), "random": lambda: Q.get_random(table, a.n), "top": lambda: Q.top_n(table, a.field, a.n), "bottom": lambda: Q.bottom_n(table, a.field, a.n),
        "by-flags": lambda: Q.by_flags(table, a.limit, **given), "by-thresholds": lambda: Q.by_thresholds(table, a.limit, **given), "by-time": lambda: Q.by_time_range(table, a.start, a.end), "info": lambda: Q.info(table),
        "compare": lambda: V.compare(table, *a.bucket),
    }[a.what]()


def typed_filter(table: DataFrame, items: list[str]):
    """The predicate of field=value items; values are read by their column's type, none or null is no value."""
    from functools import reduce

    found = [F.col(k).isNull() if config.variable(v) is None else F.col(k) == F.lit(v).cast(table.schema[k].dataType) for k, v in config.pairs(items).items()]
    return reduce(lambda x, y: x & y, found) if found else None


def instances_of(table: DataFrame) -> DataFrame:
    return A.explode_templates(table).withColumn("ts", A.instance_time(F.col("vars")))


def templates(table: DataFrame, a: argparse.Namespace) -> DataFrame:
    rows = instances_of(table)
    if a.what == "precursors":
        return A.precursors(rows, a.anchor, a.lookback).orderBy(F.desc("n"), "template_id")
    if a.what == "frequency" and a.compare_cohort:
        named = dict(c.split(":", 1) for c in a.compare_cohort)
        return A.cohorts(rows.join(table.drop("start_time", "end_time", "templates"), "bucket_id"), {name: typed_filter(table, rest.split(",")) for name, rest in named.items()})
    if (chosen := typed_filter(table, a.filter)) is not None:
        rows = rows.join(table.where(chosen).select("bucket_id"), "bucket_id", "left_semi")
    rows = A.template_instances(rows, a.template_id, a.substring, a.start, a.end, None, config.pairs(a.var), a.include_vars)
    return A.template_frequency(rows, a.n) if a.what == "frequency" else A.timeline(rows, table) if a.what == "timeline" else rows.orderBy("start_time", "instance_index")


def csv_model(spark: SparkSession, a: argparse.Namespace) -> dict:
    """train or score on a CSV table."""
    rows = tables.read_csv(spark, a.data)
    if a.command == "train":
        own = tables.feature_rows(rows, a.feature_columns, [a.label_column]).withColumn("label", F.col(f"`{a.label_column}`").try_cast("double").cast("int")).where("label IN (0, 1)")
        T.save(spark, T.train(own, False, maxIter=a.rounds), a.feature_columns, a.model_output)
        return {"target": a.target_name, "rows": own.count(), "feature_columns": a.feature_columns, "names": tables.safe_names(a.feature_columns)}
    model, names = T.load(spark, a.model)
    if names != a.feature_columns:
        raise ValueError(f"the model has the features {', '.join(names)}")
    key = ["bucket_id"] if "bucket_id" in rows.columns else []
    T.score(model, tables.feature_rows(rows, names, key)).select(*key, "probability").write.mode("overwrite").option("header", "true").csv(a.predictions)
    return {"predictions": a.predictions}


def catalog(spark: SparkSession, a: argparse.Namespace) -> dict:
    own = incidents.Catalog(spark, a.catalog)
    if a.what == "put":
        own.put(incidents.Incident(a.name, a.template, a.lead, a.max))
    elif a.what == "remove":
        own.remove(a.name)
    return {"incidents": own.names()} if a.what != "show" else own.get(a.name).__dict__


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if getattr(a, "init_config", None):
        config.write_default(a.init_config, DEFAULTS[a.command])
        return 0
    spark = SparkSession.builder.appName("stratalog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command in DEFAULTS:
        own = config.settings(DEFAULTS[a.command], a.config, vars(a))
        if a.command == "create":
            told = ingest.create_from(spark, own)
            print(json.dumps(told, default=str) if own["quiet"] else ingest.verification_text(told))
        else:
            if a.cv_folds:
                own["cv_strategy"] = "time-series"
            told = evaluate.run_settings(spark, own, input if own["incident_substring"] and not own["incident"] else None)
            print(told["text"] if own["details"] == "full" else json.dumps({k: told[k] for k in ("metrics", "features", "shap_scope")}, default=str))
        return 0
    if a.command in ("train", "score"):
        print(json.dumps(csv_model(spark, a), default=str))
        return 0
    if a.command == "incidents":
        print(json.dumps(catalog(spark, a), default=str))
        return 0
    table = spark.read.parquet(a.file)
    if a.command == "select":
        out = selected(table, a)
    elif a.command == "templates":
        out = templates(table, a)
    else:
        found = K.build_windows(table, instances_of(table), K.anchor_id(a.incident), a.equivalent, a.lead, a.max, typed_filter(table, a.filter), a.manual_expansion)
        if found is None:
            print("no anchor", file=sys.stderr)
            return 1
        if a.output_root:
            K.write_artifacts(spark, found, a.output_root)
        print(json.dumps(found["summary"], default=str))
        out = found["events"]
    show(out if a.limit is None else out.limit(a.limit), a.format, a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())

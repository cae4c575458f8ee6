"""Queries of merging, routing, snapshots, highlights and views, each with its SQL twin."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stratalog.functions.text import split_value_unit
from stratalog.functions.timing import bucket_end, bucket_id
from stratalog.operators import analytics as A
from stratalog.operators import buckets as B
from stratalog.operators import evaluation as E
from stratalog.operators import explained as X
from stratalog.operators import labels as L
from stratalog.operators import mining as M
from stratalog.operators import snapshots as W
from stratalog.operators import views as V
from stratalog.plans import binding as P
from stratalog.plans import catalog as C
from stratalog.plans.binding import SQL_BUCKETS, SQL_EV
from stratalog.plans.catalog_more import log_lines
from stratalog.sources import logs
from stratalog.streaming import windows as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(run):
        QUERIES[run.__name__] = run
        SQL[run.__name__] = sql
        return run

    return keep


def _halves(spark, d):
    """The tables of the even events, of the odd ones, and of every third, which lie in the others too."""
    ev = B.assign(P.events(spark, d))
    for where in ("ord % 2 = 0", "ord % 2 = 1", "ord % 3 = 0"):
        own = ev.where(where)
        out = B.count_levels(own).join(B.template_json(own), "start_time").join(B.component_json(own), "start_time")
        yield out.withColumn("bucket_id", bucket_id(F.col("start_time"))).withColumn("end_time", bucket_end(F.col("start_time")))


@query(f"WITH {SQL_EV} SELECT bucket_id, template_id, any_value(template_str) AS template_str, count(DISTINCT (var1, ts)) AS n, min(ts) AS first_ts FROM ev GROUP BY 1, 2")
def bucket_merge_templates(spark, d):
    """Templates of three tables that overlap: equal instances count once."""
    merged = A.explode_templates(B.merge(list(_halves(spark, d)))).withColumn("ts", A.instance_time(F.col("vars")))
    return merged.groupBy("bucket_id", "template_id").agg(F.first("template_str").alias("template_str"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query(f"WITH {SQL_EV} SELECT bucket_id, component, CAST(count(*) + count(*) FILTER (WHERE ord % 3 = 0) AS BIGINT) AS n FROM ev GROUP BY 1, 2")
def bucket_merge_components(spark, d):
    merged = B.merge(list(_halves(spark, d)))
    return merged.select("bucket_id", F.explode(F.from_json("component_counts_json", "map<string,bigint>")).alias("component", "n"))


@query(f"WITH {SQL_BUCKETS} SELECT bucket_id FROM bk WHERE start_time >= TIMESTAMP '2024-01-05' AND end_time <= TIMESTAMP '2024-01-09 12:03:00'")
def bucket_bounds(spark, d):
    return B.within(P.buckets(spark, d), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9, 12, 3), strict=False).select("bucket_id")


def _read_out_of_order(spark, d):
    """Events of which every ninth is read some 400 places later."""
    return P.events(spark, d).withColumn("place", F.when(F.col("ord") % 9 == 0, F.col("ord") + 400).otherwise(F.col("ord")) * 2 + (F.col("ord") % 9 == 0).cast("int"))


_ROUTES = f"WITH {SQL_EV}, r AS (SELECT ord, ts, CAST(floor(epoch(ts) / 14400) AS BIGINT) AS w, max(CAST(floor(epoch(ts) / 14400) AS BIGINT)) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM (SELECT ts, ord, CASE WHEN ord % 9 = 0 THEN (ord + 400) * 2 + 1 ELSE ord * 2 END AS place FROM ev))"


@query(f"{_ROUTES} SELECT CASE WHEN w < reached THEN 'late' WHEN w > reached THEN 'future' ELSE 'window' END AS route, count(*) AS n FROM r GROUP BY 1")
def event_routes(spark, d):
    return S.routed(_read_out_of_order(spark, d), order="place", span_rows=5000).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_ROUTES}, e AS (SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, ts) AS st, reached, w FROM r WHERE w > reached), h AS (SELECT st, unnest(generate_series(reached, w - 1)) AS wnd FROM e) SELECT wnd AS \"window\", count(DISTINCT st) AS buckets, 'ok' AS level FROM h GROUP BY 1")
def event_waiting(spark, d):
    return S.waiting(S.routed(_read_out_of_order(spark, d), order="place", span_rows=5000))


@query(f"WITH {SQL_EV}, b AS (SELECT min(start_time) AS lo, max(ts) AS hi FROM ev), g AS (SELECT unnest(generate_series(lo, hi, INTERVAL 4 HOUR)) AS window_start FROM b) SELECT CAST(row_number() OVER (ORDER BY window_start) - 1 AS INT) AS \"window\", window_start, window_start + INTERVAL 4 HOUR AS window_end FROM g")
def processing_windows(spark, d):
    return S.processing_windows(spark, *P.events(spark, d).agg(F.min("ts"), F.max("ts")).first())


@query(f"WITH {SQL_BUCKETS} SELECT bucket_id, start_time, total_events, total_events / 5.0::DOUBLE AS events_per_minute, round(100.0::DOUBLE * error_count / total_events, 6) AS error_rate FROM bk ORDER BY start_time DESC LIMIT 10")
def live_buckets(spark, d):
    return S.live(P.buckets(spark, d)).withColumn("error_rate", F.round("error_rate", 6))


@query(f"WITH {C._SYM} SELECT DISTINCT ts FROM sy")
def symptom_times(spark, d):
    return L.symptom_times(C._symptoms(spark, d))


@query(f"WITH {SQL_EV}, t AS (SELECT ord % 7 AS f, date_trunc('second', ts) - CASE WHEN ord % 10 = 1 THEN INTERVAL 0 HOUR ELSE INTERVAL 2 HOUR END AS ts FROM ev WHERE ord % 10 <> 0) SELECT 'f' || CAST(f AS VARCHAR) AS source_file, min(ts) AS start_time, max(ts) AS end_time, count(*) AS events FROM t GROUP BY 1")
def file_ranges(spark, d):
    lines = log_lines(spark, d).withColumn("source_file", F.concat(F.lit("f"), F.col("ord") % 7))
    return logs.time_ranges(logs.parse_events(lines))


@query(f"WITH {SQL_EV} SELECT template_id, arg_min(template_str, (start_time, ord)) AS template_str FROM ev GROUP BY 1")
def tpl_strings(spark, d):
    return A.template_strings(P.instances(spark, d))


@query(f"WITH {SQL_BUCKETS} SELECT bucket_id, round(100.0::DOUBLE * error_count / total_events, 6) AS error_share, round(100.0::DOUBLE * debug_count / total_events, 6) AS debug_share, 5.0::DOUBLE AS duration_minutes, CASE WHEN 100.0 * error_count / total_events > 10 THEN 'red' WHEN 100.0 * error_count / total_events > 1 THEN 'yellow' ELSE 'green' END AS severity FROM bk")
def bucket_details(spark, d):
    return V.details(P.buckets(spark, d)).select("bucket_id", F.round("error_share", 6).alias("error_share"), F.round("debug_share", 6).alias("debug_share"), F.col("duration_minutes").cast("double").alias("duration_minutes"), "severity")


_TWO = "lo AS (SELECT * FROM bk ORDER BY start_time LIMIT 1), hi AS (SELECT * FROM bk ORDER BY start_time DESC LIMIT 1)"
_SAME = " UNION ALL ".join(f"SELECT '{c}' AS metric, CAST(lo.{c} AS DOUBLE) AS first, CAST(hi.{c} AS DOUBLE) AS second FROM lo, hi" for c in ("total_events", *B.LEVELS, "read_latency_ms", "write_latency_ms"))


@query(f"WITH {SQL_BUCKETS}, {_TWO}, m AS ({_SAME}) SELECT metric, first, second, second - first AS change, round(CASE WHEN first <> 0 THEN 100.0::DOUBLE * (second - first) / first END, 6) AS change_percent FROM m WHERE first IS NOT NULL OR second IS NOT NULL")
def bucket_compare(spark, d):
    """The first and the last bucket."""
    table = P.buckets(spark, d)
    ends = table.agg(F.min_by("bucket_id", "start_time"), F.max_by("bucket_id", "start_time")).first()
    return V.compare(table, *ends).withColumn("change_percent", F.round("change_percent", 6))


@query(f"WITH {SQL_EV}, c AS (SELECT bucket_id, component, count(*) AS n FROM ev GROUP BY 1, 2) SELECT bucket_id, component, n, CAST(row_number() OVER (PARTITION BY bucket_id ORDER BY n DESC, component) AS INT) AS rank FROM c QUALIFY rank <= 10")
def bucket_top_components(spark, d):
    own = B.component_json(B.assign(P.events(spark, d))).withColumn("bucket_id", bucket_id(F.col("start_time")))
    return V.components(own)


@query(f"WITH {SQL_EV} SELECT ord, CASE WHEN ord % 4 < 3 THEN ord + 0.5::DOUBLE END AS value, CASE ord % 4 WHEN 0 THEN 'KB' WHEN 1 THEN 'MB' WHEN 2 THEN '' END AS unit FROM ev")
def value_units(spark, d):
    number = F.concat(F.col("ord").cast("string"), F.lit(".5"))
    text = F.when(F.col("ord") % 4 == 0, F.concat(number, F.lit(" kb"))).when(F.col("ord") % 4 == 1, F.concat(number, F.lit("MB/s"))).when(F.col("ord") % 4 == 2, number).otherwise("none")
    return P.events(spark, d).select("ord", split_value_unit(text).alias("s")).select("ord", "s.value", "s.unit")


@query(f"WITH {C._SCORED}, n AS (SELECT window_id, row_number() OVER (ORDER BY timestamp, window_id) AS k, count(*) OVER () AS n FROM sc) SELECT window_id, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM n")
def split_chronological(spark, d):
    return E.split_chronological(C._scored(spark, d), order=("timestamp", "window_id")).select("window_id", "split")


_HIGH = f"WITH {C._CON}, rw AS (SELECT window_id, label, arg_max(bucket_id, start_time) AS bucket_id FROM wm GROUP BY 1, 2), sc AS (SELECT rw.window_id, label, least(1.0::DOUBLE, bk.write_latency_ms / 600) AS probability FROM rw JOIN bk ON rw.bucket_id = bk.bucket_id WHERE bk.write_latency_ms IS NOT NULL)"


@query(f"{_HIGH}, h AS (SELECT sc.window_id AS bucket_id, label, probability, feature, round(mean, 9) AS shap, row_number() OVER (PARTITION BY sc.window_id ORDER BY abs(mean) DESC, feature) AS rank FROM sc JOIN mn USING (window_id) WHERE label = 1) SELECT bucket_id, label, probability, CAST(rank AS INT) AS rank, feature, shap FROM h WHERE rank <= 3")
def shap_highlights(spark, d):
    values = C._means(spark, d).withColumnRenamed("mean", "value")
    return X.highlights(C._scored(spark, d), values, 3).withColumn("shap", F.round("shap", 9))


@query(f"{_HIGH} SELECT sc.window_id AS bucket_id, label, probability, 0.25::DOUBLE AS expected_value, CAST(count(mn.feature) AS INT) AS features, round(coalesce(sum(mn.mean), 0), 6) AS total FROM sc LEFT JOIN mn USING (window_id) GROUP BY 1, 2, 3")
def shap_rows(spark, d):
    """The rows with their contributions read again from JSON."""
    rows = X.shap_rows(C._scored(spark, d), C._means(spark, d).withColumnRenamed("mean", "value"), 0.25)
    values = F.map_values(F.from_json("contributions", "map<string,double>"))
    return rows.select("bucket_id", "label", "probability", "expected_value", F.size(values).alias("features"), F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _snapshot(spark, d):
    labels = C._labels(spark, d)
    return W.take(labels, L.window_members(labels, P.buckets(spark, d), 30), P.buckets(spark, d), P.instances(spark, d).where("template_id <> 'error'"), 30)


_IDS = f"WITH {C._WIN}, ix AS (SELECT bucket_id AS own, label, window_end, bucket_id || '_' || lpad(CAST(row_number() OVER (ORDER BY window_end, bucket_id) - 1 AS VARCHAR), 6, '0') AS window_id FROM lb)"


@query(f"{_IDS} SELECT window_id, own AS bucket_id, label, window_end - INTERVAL 30 MINUTE AS window_start, window_end FROM ix")
def snapshot_index(spark, d):
    return _snapshot(spark, d)["window_index"]


@query(f"{_IDS} SELECT ix.window_id, CAST(row_number() OVER (PARTITION BY ix.window_id ORDER BY wm.start_time) - 1 AS INT) AS bucket_index, wm.bucket_id, CAST(bk.total_events AS DOUBLE) AS total_events FROM ix JOIN wm ON wm.window_id = ix.own JOIN bk ON bk.bucket_id = wm.bucket_id")
def snapshot_buckets(spark, d):
    return _snapshot(spark, d)["window_buckets"].select("window_id", "bucket_index", "bucket_id", F.col("features")["total_events"].alias("total_events"))


@query(f"{_IDS}, b AS (SELECT window_id AS own, count(*) AS buckets FROM wm GROUP BY 1), e AS (SELECT window_id AS own, count(*) AS events, count(DISTINCT template_id) AS templates FROM wi GROUP BY 1) SELECT ix.window_id, ix.label, coalesce(buckets, 0) AS buckets, coalesce(events, 0) AS events, coalesce(templates, 0) AS templates FROM ix LEFT JOIN b USING (own) LEFT JOIN e USING (own)")
def snapshot_summary(spark, d):
    return W.summary(_snapshot(spark, d)).select("window_id", "label", "buckets", "events", "templates")


@query(f"WITH {C._SYM}, p AS (SELECT window_end FROM lb WHERE label = 1), h AS (SELECT DISTINCT lb.bucket_id FROM lb JOIN p ON abs(epoch_us(lb.window_end) - epoch_us(p.window_end)) <= 300 * 1000000 WHERE label = 0) SELECT bucket_id, window_end FROM lb WHERE label = 0 AND bucket_id NOT IN (SELECT bucket_id FROM h) AND bucket_id IN (SELECT bucket_id FROM ev WHERE template_id = 'purchase') ORDER BY window_end, bucket_id LIMIT (SELECT count(*) FROM p)")
def neg_selected(spark, d):
    return M.select_negatives(C._labels(spark, d), "template-matched", 5, P.instances(spark, d), ["purchase"])


@query(f"WITH {C._INT}, dm AS (SELECT window_id, feature AS dominant FROM mn QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY abs(mean) DESC, feature) = 1), t AS (SELECT dominant, feature_a, feature_b, round(sum(mean * n) / sum(n), 6) + 0.0::DOUBLE AS mean, count(DISTINCT window_id) AS windows_with_interaction FROM su JOIN dm USING (window_id) GROUP BY 1, 2, 3) SELECT * FROM t")
def cluster_interactions(spark, d):
    out = M.cluster_interactions(C._summaries(spark, d), M.dominant_features(C._means(spark, d)), 1000)
    return out.select("dominant", "feature_a", "feature_b", (F.round("mean", 6) + F.lit(0.0)).alias("mean"), "windows_with_interaction")


_NAMES = {
    "metric_current_cpu_util": ("metric", "current", None, None, None), "metric_delta_total_events": ("metric", "delta", None, None, None), "template_present_12": ("template", "present", "12", None, None),
    "template_lead_minutes_7": ("template", "lead_minutes", "7", None, None), "template_7_var1_mean": ("variable", "mean", "7", "var1", None), "template_7_var1=a b": ("variable", "value", "7", "var1", "a b"), "other": ("other", None, None, None, None),
}


def _value(x) -> str:
    return "NULL" if x is None else f"'{x}'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_value, (name, *told)))})" for name, told in _NAMES.items()) + ") t(name, kind, stat, template_id, var, value)")
def feature_names(spark, d):
    own = spark.range(1).select(F.explode(F.array(*map(F.lit, _NAMES))).alias("name"))
    none = lambda c: F.nullif(F.col(f"i.{c}"), F.lit("")).alias(c)
    return own.withColumn("i", M.feature_info(F.col("name"))).select("name", "i.kind", none("stat"), none("template_id"), none("var"), none("value"))

"""The registry of named queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.timing import bucket_end, bucket_id
from stratalog.operators import analytics as A
from stratalog.operators import buckets as B
from stratalog.operators import evaluation as E
from stratalog.operators import features as G
from stratalog.operators import labels as L
from stratalog.operators import lookback as K
from stratalog.operators import mining as M
from stratalog.operators import select as Q
from stratalog.plans import binding as P
from stratalog.plans.binding import SQL_BUCKETS, SQL_EV

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
COUNTS = ", ".join(B.COUNTS)
NTZ_MINUTE = dt.timedelta(minutes=1)


def query(name: str, sql: str | None = None):
    def keep(run: Query) -> Query:
        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return run

    return keep


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten buckets with the most events."""
    return Q.top_n(P.buckets(spark, sf_dir), "total_events", 10)


# Buckets -------------------------------------------------------------------------------------------------------------


@query("bucket_agg", f"WITH {SQL_BUCKETS} SELECT bucket_id, start_time, end_time, {COUNTS} FROM bk")
def bucket_agg(spark, d):
    own = B.count_levels(B.assign(P.events(spark, d)))
    return own.select(bucket_id(F.col("start_time")).alias("bucket_id"), "start_time", bucket_end(F.col("start_time")).alias("end_time"), *B.COUNTS)


@query("bucket_dedupe", f"WITH {SQL_EV} SELECT start_time, count(DISTINCT (template_id, ts_s, var1)) AS n FROM (SELECT *, date_trunc('hour', ts) AS ts_s FROM ev) GROUP BY start_time")
def bucket_dedupe(spark, d):
    """Times cut to the hour, so that there are events to drop."""
    ev = B.assign(P.events(spark, d)).withColumn("ts", F.date_trunc("HOUR", "ts").cast("timestamp_ntz"))
    return B.dedupe(ev).groupBy("start_time").agg(F.count(F.lit(1)).alias("n"))


@query("bucket_components", f"WITH {SQL_EV} SELECT start_time, component, count(*) AS n FROM ev GROUP BY ALL")
def bucket_components(spark, d):
    return B.component_counts(B.assign(P.events(spark, d)))


@query("bucket_templates", f"WITH {SQL_EV} SELECT start_time, template_id, arg_min(template_str, ord) AS template_str, count(*) AS n, min(ts) AS first_ts, arg_max(var1, ord) AS last_var FROM ev GROUP BY start_time, template_id")
def bucket_templates(spark, d):
    own = B.template_instances(B.assign(P.events(spark, d)))
    return own.select("start_time", "template_id", "template_str", F.size("instances").cast("long").alias("n"), F.array_min("instances.ts").alias("first_ts"), F.element_at("instances", -1)["params"]["var1"].alias("last_var"))


@query("bucket_latency_spike", f"WITH {SQL_BUCKETS} SELECT start_time, write_latency_ms, read_latency_ms, has_spike FROM bk")
def bucket_latency_spike(spark, d):
    return B.latency(P.latencies(spark, d)).select("start_time", "write_latency_ms", "read_latency_ms", "has_spike")


@query("bucket_asof_system", f"""WITH {SQL_BUCKETS}, s AS (SELECT ts, arg_max(value, ord) AS cpu_util FROM ev WHERE ord % 50 = 0 GROUP BY ts)
SELECT bk.start_time, s.cpu_util FROM bk ASOF LEFT JOIN s ON bk.end_time >= s.ts""")
def bucket_asof_system(spark, d):
    own = B.count_levels(B.assign(P.events(spark, d))).select("start_time")
    return B.fill_system(own, P.systems(spark, d), ["cpu_util"], order=["ord"])


@query("bucket_merge", f"WITH {SQL_BUCKETS} SELECT bucket_id, start_time, end_time, {COUNTS} FROM bk")
def bucket_merge(spark, d):
    """Two tables of the even and the odd events, merged."""
    ev = B.assign(P.events(spark, d))
    parts = [B.count_levels(ev.where(f"ord % 2 = {i}")).withColumn("bucket_id", bucket_id(F.col("start_time"))).withColumn("end_time", bucket_end(F.col("start_time"))) for i in (0, 1)]
    return B.merge(parts).select("bucket_id", "start_time", "end_time", *B.COUNTS)


@query("bucket_dense", f"""WITH {SQL_BUCKETS}, a AS (SELECT unnest(generate_series(min(start_time), max(start_time), INTERVAL 5 MINUTE)) AS start_time FROM bk)
SELECT a.start_time, coalesce(total_events, 0) AS total_events FROM a LEFT JOIN bk USING (start_time)""")
def bucket_dense(spark, d):
    own = B.count_levels(B.assign(P.events(spark, d)))
    return B.all_starts(own).join(own, "start_time", "left").select("start_time", F.coalesce("total_events", F.lit(0)).alias("total_events"))


@query("bucket_hours", "SELECT epoch_ms(CAST(floor(epoch(ts) / 10800) AS BIGINT) * 10800000) AS start_time, count(*) AS n FROM events GROUP BY 1")
def bucket_hours(spark, d):
    return B.assign(P.events(spark, d), 180).groupBy("start_time").agg(F.count(F.lit(1)).alias("n"))


# Selections ----------------------------------------------------------------------------------------------------------


@query("sel_flags", f"WITH {SQL_BUCKETS} SELECT bucket_id FROM bk WHERE has_spike = TRUE")
def sel_flags(spark, d):
    return Q.by_flags(P.buckets(spark, d), has_spike=True).select("bucket_id")


@query("sel_thresholds", f"WITH {SQL_BUCKETS} SELECT bucket_id, total_events FROM bk WHERE total_events >= 2 AND write_latency_ms > 40 AND error_count <> 1")
def sel_thresholds(spark, d):
    return Q.by_thresholds(P.buckets(spark, d), total_events_gte=2, write_latency_ms_gt=40, error_count_ne=1).select("bucket_id", "total_events")


@query("sel_time_range", f"WITH {SQL_BUCKETS} SELECT bucket_id FROM bk WHERE start_time < TIMESTAMP '2024-01-10 06:00:00' AND end_time > TIMESTAMP '2024-01-09 06:02:00'")
def sel_time_range(spark, d):
    return Q.by_time_range(P.buckets(spark, d), dt.datetime(2024, 1, 9, 6, 2), dt.datetime(2024, 1, 10, 6, 0)).select("bucket_id")


@query("sel_top_n", f"WITH {SQL_BUCKETS} SELECT bucket_id, total_events FROM bk ORDER BY total_events DESC NULLS LAST, bucket_id LIMIT 5")
def sel_top_n(spark, d):
    return Q.top_n(P.buckets(spark, d), "total_events").select("bucket_id", "total_events")


@query("sel_bottom_n", f"WITH {SQL_BUCKETS} SELECT bucket_id, write_latency_ms FROM bk ORDER BY write_latency_ms ASC NULLS LAST, bucket_id LIMIT 5")
def sel_bottom_n(spark, d):
    return Q.bottom_n(P.buckets(spark, d), "write_latency_ms").select("bucket_id", "write_latency_ms")


@query("sel_random")
def sel_random(spark, d):
    return Q.get_random(P.buckets(spark, d), 3, seed=7)


@query("sel_fetch", f"WITH {SQL_BUCKETS} SELECT bucket_id, error_count FROM bk WHERE error_count = 2 AND has_spike = FALSE")
def sel_fetch(spark, d):
    return Q.where_equal(P.buckets(spark, d), ["bucket_id", "error_count"], error_count=2, has_spike=False)


@query("sel_metrics_by_id", f"WITH {SQL_BUCKETS} SELECT bucket_id, total_events, write_latency_ms FROM bk WHERE bucket_id IN (SELECT bucket_id FROM ev WHERE user_id = 3)")
def sel_metrics_by_id(spark, d):
    ids = B.assign(P.events(spark, d)).where("user_id = 3").select(bucket_id(F.col("start_time")).alias("bucket_id"))
    return Q.by_ids(P.buckets(spark, d), ids, ["total_events", "write_latency_ms"])


@query("sel_event_count", "SELECT count(*) AS events FROM events")
def sel_event_count(spark, d):
    return Q.event_count(P.buckets(spark, d))


@query("sel_info", f"WITH {SQL_BUCKETS} SELECT count(*) AS buckets, min(start_time) AS first_start, max(end_time) AS last_end FROM bk")
def sel_info(spark, d):
    return Q.info(P.buckets(spark, d))


@query("sel_display", f"WITH {SQL_BUCKETS} SELECT bucket_id, round(100.0 * error_count / total_events, 6) AS error_rate, CASE WHEN 100.0 * error_count / total_events > 10 THEN 'red' WHEN 100.0 * error_count / total_events > 1 THEN 'yellow' ELSE 'green' END AS severity, total_events / 5.0::DOUBLE AS events_per_minute FROM bk")
def sel_display(spark, d):
    from stratalog.functions.text import severity

    return Q.displayable(P.buckets(spark, d)).select("bucket_id", F.round("error_rate", 6).alias("error_rate"), severity(F.col("error_rate")).alias("severity"), "events_per_minute")


# Template analytics --------------------------------------------------------------------------------------------------


@query("tpl_instances", f"WITH {SQL_EV} SELECT bucket_id, template_id, instance, var1 FROM (SELECT *, ord AS instance FROM ev) WHERE template_id IN ('error', 'purchase') AND start_time < TIMESTAMP '2024-01-20' AND end_time > TIMESTAMP '2024-01-05'")
def tpl_instances(spark, d):
    out = A.template_instances(P.instances(spark, d), ["error", "purchase"], start=dt.datetime(2024, 1, 5), end=dt.datetime(2024, 1, 20), flatten=["var1"])
    return out.select("bucket_id", "template_id", F.col("instance_index").alias("instance"), "var1")


@query("tpl_substring", f"WITH {SQL_EV} SELECT bucket_id, template_id FROM ev WHERE contains(lower(template_str), 'up by')")
def tpl_substring(spark, d):
    return A.template_instances(P.instances(spark, d), substring="UP by").select("bucket_id", "template_id")


@query("tpl_var_filter", f"WITH {SQL_EV} SELECT ord AS instance, template_id FROM ev WHERE var1 = '7'")
def tpl_var_filter(spark, d):
    return A.template_instances(P.instances(spark, d), variables={"var1": 7}).select(F.col("instance_index").alias("instance"), "template_id")


@query("tpl_frequency", f"WITH {SQL_EV} SELECT template_id, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def tpl_frequency(spark, d):
    return A.template_frequency(P.instances(spark, d), 3)


@query("tpl_cohorts", f"WITH {SQL_BUCKETS} SELECT ev.template_id, count(*) FILTER (WHERE has_spike) AS spiky, count(*) FILTER (WHERE NOT has_spike) AS calm, count(*) FILTER (WHERE total_events > 2) AS busy FROM ev JOIN bk USING (bucket_id) GROUP BY 1")
def tpl_cohorts(spark, d):
    rows = A.timeline(P.instances(spark, d), P.buckets(spark, d))
    return A.cohorts(rows, {"spiky": F.col("has_spike"), "calm": ~F.col("has_spike"), "busy": F.col("total_events") > 2})


@query("tpl_timeline", f"WITH {SQL_BUCKETS} SELECT ord AS instance, ev.template_id, total_events, error_count, write_latency_ms, has_spike FROM ev JOIN bk USING (bucket_id) WHERE ev.template_id = 'error'")
def tpl_timeline(spark, d):
    rows = A.template_instances(P.instances(spark, d), ["error"])
    return A.timeline(rows, P.buckets(spark, d)).select(F.col("instance_index").alias("instance"), "template_id", "total_events", "error_count", "write_latency_ms", "has_spike")


@query("tpl_precursors", f"""WITH {SQL_EV}, a AS (SELECT ord, start_time AS at FROM ev WHERE template_id = 'error'), o AS (SELECT DISTINCT template_id, start_time, end_time FROM ev WHERE template_id <> 'error')
SELECT template_id, count(*) AS n FROM (SELECT DISTINCT a.ord, o.template_id FROM a JOIN o ON o.start_time < a.at AND o.end_time > a.at - INTERVAL 30 MINUTE) GROUP BY 1""")
def tpl_precursors(spark, d):
    return A.precursors(P.instances(spark, d), "error", 30)


@query("tpl_family", f"WITH {SQL_EV}, t AS (SELECT template_id, arg_min(template_str, start_time) AS template_str FROM ev WHERE contains(lower(template_str), 'i') GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY try_cast(template_id AS BIGINT) NULLS LAST, template_id) AS INT) AS rank FROM t")
def tpl_family(spark, d):
    return A.family(P.instances(spark, d), "i")


@query("tpl_per_bucket", f"WITH {SQL_EV} SELECT bucket_id, template_id, count(*) AS n FROM ev GROUP BY 1, 2")
def tpl_per_bucket(spark, d):
    return A.bucket_templates(P.instances(spark, d))


@query("tpl_roundtrip", f"WITH {SQL_EV} SELECT bucket_id, template_id, CAST(row_number() OVER (PARTITION BY bucket_id, template_id ORDER BY ord) - 1 AS INT) AS instance_index, var1, ts FROM ev")
def tpl_roundtrip(spark, d):
    """Instances written into the JSON column of buckets and exploded again."""
    own = B.template_json(B.assign(P.events(spark, d))).withColumn("bucket_id", bucket_id(F.col("start_time"))).withColumn("end_time", bucket_end(F.col("start_time")))
    return A.explode_templates(own).select("bucket_id", "template_id", "instance_index", F.col("vars")["var1"].alias("var1"), A.instance_time(F.col("vars")).alias("ts"))


# Look-back -----------------------------------------------------------------------------------------------------------

_ANCHOR = f"{SQL_BUCKETS}, an AS (SELECT bucket_id, start_time, end_time, min(ts) AS t_symptom FROM ev WHERE template_id IN ('error', 'purchase') GROUP BY ALL HAVING bool_or(template_id = 'error')), f AS (SELECT * FROM an ORDER BY start_time LIMIT 1)"


def _symptom(spark, d):
    return K.first_anchor(P.instances(spark, d), "error", ["purchase"]).first()


@query("lb_anchors", f"WITH {_ANCHOR} SELECT bucket_id, start_time, end_time, t_symptom FROM an")
def lb_anchors(spark, d):
    return K.anchors(P.instances(spark, d), "error", ["purchase"])


@query("lb_events", f"WITH {_ANCHOR}, w AS (SELECT bk.bucket_id, f.t_symptom FROM bk, f WHERE bk.end_time > f.t_symptom - INTERVAL 60 MINUTE AND bk.start_time <= f.t_symptom) SELECT ev.ord AS instance, CASE WHEN ev.ts < w.t_symptom THEN 'pre_incident' ELSE 'post_incident' END AS phase, ev.ts < w.t_symptom AND ev.template_id NOT IN ('error', 'purchase') AS candidate FROM ev JOIN w USING (bucket_id) WHERE ev.ts <> w.t_symptom")
def lb_events(spark, d):
    row = _symptom(spark, d)
    own = K.window_buckets(P.instances(spark, d), row["t_symptom"], 60)
    return K.classified(own, row["t_symptom"], "error", ["purchase"]).select(F.col("instance_index").alias("instance"), "phase", "candidate")


@query("lb_slice_metrics", f"WITH {_ANCHOR}, w AS (SELECT bk.* FROM bk, f WHERE bk.end_time > f.t_symptom - INTERVAL 60 MINUTE AND bk.start_time <= f.t_symptom) SELECT start_time AS slice_start, total_events, error_count, CAST(coalesce(total_events - lag(total_events) OVER (ORDER BY start_time), 0) AS BIGINT) AS delta_total_events, CAST(coalesce(error_count - lag(error_count) OVER (ORDER BY start_time), 0) AS BIGINT) AS delta_error_count FROM w")
def lb_slice_metrics(spark, d):
    own = K.window_buckets(P.buckets(spark, d), _symptom(spark, d)["t_symptom"], 60)
    return K.slice_metrics(own).select("slice_start", "total_events", "error_count", "delta_total_events", "delta_error_count")


@query("lb_controls", f"WITH {_ANCHOR} SELECT bk.bucket_id FROM bk, f WHERE bk.end_time > f.t_symptom - INTERVAL 60 MINUTE AND bk.start_time <= f.t_symptom AND bk.bucket_id <> f.bucket_id")
def lb_controls(spark, d):
    row = _symptom(spark, d)
    return K.controls(K.window_buckets(P.buckets(spark, d), row["t_symptom"], 60), row["bucket_id"]).select("bucket_id")


# Labels and windows --------------------------------------------------------------------------------------------------

_SYM = f"{SQL_BUCKETS}, sy AS (SELECT * FROM ev WHERE template_id = 'error'), lb AS (SELECT * FROM (SELECT *, lead(label) OVER (ORDER BY start_time) AS nxt FROM (SELECT bk.bucket_id, bk.start_time, bk.end_time, CASE WHEN s.t IS NULL THEN 0 ELSE 1 END AS label, s.t AS symptom_time, coalesce(s.t, bk.end_time) AS window_end FROM bk LEFT JOIN (SELECT bucket_id, min(ts) AS t FROM sy GROUP BY 1) s USING (bucket_id))) WHERE label = 1 OR nxt = 0)"
_WIN = f"{_SYM}, wm AS (SELECT lb.bucket_id AS window_id, lb.label, lb.window_end, bk.bucket_id, bk.start_time, bk.end_time FROM lb JOIN bk ON bk.start_time < lb.window_end AND bk.end_time > lb.window_end - INTERVAL 30 MINUTE), wi AS (SELECT wm.window_id, wm.label, wm.window_end, wm.bucket_id, wm.start_time, ev.ord, ev.ts, ev.template_id, ev.var1 FROM wm JOIN ev USING (bucket_id) WHERE ev.ts < wm.window_end AND ev.template_id <> 'error')"


def _symptoms(spark, d):
    return L.symptoms(P.instances(spark, d), ["error"])


def _labels(spark, d):
    return L.label_buckets(P.buckets(spark, d), _symptoms(spark, d))


def _members(spark, d):
    return L.window_members(_labels(spark, d), P.buckets(spark, d), 30)


def _window_instances(spark, d):
    return L.window_instances(_members(spark, d), P.instances(spark, d), ids=["error"])


@query("labels", f"WITH {_SYM} SELECT bucket_id, start_time, label, symptom_time, window_end FROM lb")
def labels(spark, d):
    return _labels(spark, d)


@query("symptoms_filtered", f"WITH {SQL_EV} SELECT ord AS instance FROM ev WHERE template_id IN ('error', 'view') AND contains(var1, '3') AND var1 = '13'")
def symptoms_filtered(spark, d):
    return L.symptoms(P.instances(spark, d), ["error", "view"], "3", {"var1": 13}).select(F.col("instance_index").alias("instance"))


_EPI = f"{_SYM}, g AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) > INTERVAL 45 MINUTE OR lag(ts) OVER (ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS nw FROM sy), e AS (SELECT ts, sum(nw) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS episode FROM g)"


@query("episodes", f"WITH {_EPI} SELECT CAST(episode AS BIGINT) AS episode, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM e GROUP BY 1")
def episodes(spark, d):
    return L.episodes(_symptoms(spark, d), 45)


_GAPS = f"{_SYM}, gp AS (SELECT (epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (ORDER BY ts)) / 60 AS minutes FROM (SELECT DISTINCT ts FROM sy)), gq AS (SELECT minutes FROM gp WHERE minutes > 0)"


@query("episode_gap_stats", f"WITH {_GAPS} SELECT count(*) AS n, round(quantile_cont(minutes, 0.5), 6) AS p50, round(quantile_cont(minutes, 0.9), 6) AS p90, round(quantile_cont(minutes, 0.99), 6) AS p99 FROM gq")
def episode_gap_stats(spark, d):
    return L.gap_stats(L.gaps(_symptoms(spark, d))).select("n", *(F.round(p, 6).alias(p) for p in ("p50", "p90", "p99")))


@query("episode_gap_otsu", f"""WITH {_GAPS}, x AS (SELECT ln(1 + minutes) AS x FROM gq), b AS (SELECT min(x) AS lo, max(x) AS hi FROM x), h AS (SELECT least(CAST(floor((x - lo) / ((hi - lo) / 64)) AS BIGINT), 63) AS bin, count(*) AS n FROM x, b GROUP BY 1),
f AS (SELECT r.bin, coalesce(h.n, 0) AS n, lo + (r.bin + 0.5) * ((hi - lo) / 64) AS center FROM (SELECT unnest(range(64)) AS bin) r CROSS JOIN b LEFT JOIN h ON h.bin = r.bin),
c AS (SELECT bin, center, sum(n) OVER o AS w0, sum(n * center) OVER o AS s0, sum(n) OVER () AS w, sum(n * center) OVER () AS s FROM f WINDOW o AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)),
v AS (SELECT bin, center, w0 * (w - w0) * power(s0 / w0 - (s - s0) / (w - w0), 2) AS v FROM c WHERE w0 > 0 AND w > w0)
SELECT round(exp(center) - 1, 6) AS threshold_minutes FROM v ORDER BY round(v, 9) DESC, bin LIMIT 1""")
def episode_gap_otsu(spark, d):
    return L.otsu(L.gaps(_symptoms(spark, d))).select(F.round("threshold_minutes", 6).alias("threshold_minutes"))


@query("windows", f"WITH {_WIN} SELECT window_id, label, bucket_id FROM wm")
def windows(spark, d):
    return _members(spark, d).select("window_id", "label", "bucket_id")


@query("window_instances", f"WITH {_WIN} SELECT window_id, ord AS instance FROM wi")
def window_instances(spark, d):
    return _window_instances(spark, d).select("window_id", F.col("instance_index").alias("instance"))


@query("window_rows", f"WITH {_WIN} SELECT window_id, label, arg_max(bucket_id, start_time) AS bucket_id, max(start_time) AS timestamp FROM wm GROUP BY 1, 2")
def window_rows(spark, d):
    return G.rows_of(_members(spark, d))


# Features ------------------------------------------------------------------------------------------------------------


@query("inv_templates", f"WITH {_WIN} SELECT template_id, count(*) AS total_instances FROM wi GROUP BY 1")
def inv_templates(spark, d):
    return G.inventory(_window_instances(spark, d))[0]


@query("inv_types", f"WITH {_WIN} SELECT template_id, 'var1' AS var, count(*) AS n, CASE WHEN bool_and(try_cast(var1 AS DOUBLE) IS NOT NULL) THEN 'numeric' ELSE 'categorical' END AS kind FROM wi GROUP BY 1")
def inv_types(spark, d):
    return G.inventory(_window_instances(spark, d))[1].drop("rank")


@query("inv_top_values", f"WITH {_WIN}, c AS (SELECT template_id, var1 AS value, count(*) AS n FROM wi GROUP BY ALL) SELECT template_id, value, n, CAST(row_number() OVER (PARTITION BY template_id ORDER BY n DESC, value) AS INT) AS rank FROM c QUALIFY rank <= 10")
def inv_top_values(spark, d):
    return G.top_values(_window_instances(spark, d)).select("template_id", "value", "n", "rank")


#: The metrics that the driver's bucket table has.
_METRICS = ("read_latency_ms", "write_latency_ms", "total_events", "error_count")
_METRIC_SQL = " UNION ALL ".join(
    f"SELECT window_id, 'metric_current_{f}' AS feature, s0[-1] AS value FROM a_{f} WHERE s0[-1] IS NOT NULL UNION ALL SELECT window_id, 'metric_mean_{f}', round(mean, 6) FROM a_{f} WHERE mean IS NOT NULL UNION ALL SELECT window_id, 'metric_delta_{f}', round(s[-1] - s[-2], 6) FROM a_{f} WHERE len(s) > 1"
    for f in _METRICS
)
_METRIC_CTES = ", ".join(
    f"a_{f} AS (SELECT window_id, list(CAST({f} AS DOUBLE) ORDER BY start_time) AS s0, avg(CAST({f} AS DOUBLE)) AS mean, list(CAST({f} AS DOUBLE) ORDER BY start_time) FILTER (WHERE {f} IS NOT NULL) AS s FROM mb GROUP BY 1)" for f in _METRICS
)


@query("feat_metric", f"WITH {_WIN}, mb AS (SELECT wm.window_id, bk.* FROM wm JOIN bk USING (bucket_id)), {_METRIC_CTES} SELECT window_id, feature, round(value, 6) AS value FROM ({_METRIC_SQL})")
def feat_metric(spark, d):
    return G.metric_features(_members(spark, d), P.buckets(spark, d)).select("window_id", "feature", F.round("value", 6).alias("value"))


@query("feat_template", f"WITH {_WIN}, t AS (SELECT window_id, template_id, count(*)::DOUBLE AS c, (epoch_us(any_value(window_end)) / 1e6 - epoch_us(min(ts)) / 1e6) / 60 AS l FROM wi GROUP BY ALL) SELECT window_id, 'template_present_' || template_id AS feature, 1.0::DOUBLE AS value FROM t UNION ALL SELECT window_id, 'template_count_' || template_id, c FROM t UNION ALL SELECT window_id, 'template_lead_minutes_' || template_id, l FROM t")
def feat_template(spark, d):
    return G.template_features(_window_instances(spark, d))


@query("feat_numeric_var", f"WITH {_WIN}, t AS (SELECT window_id, template_id, round(avg(var1::DOUBLE), 6) AS m, arg_max(var1::DOUBLE, (start_time, ord)) AS l FROM wi GROUP BY ALL) SELECT window_id, 'template_' || template_id || '_var1_mean' AS feature, m AS value FROM t UNION ALL SELECT window_id, 'template_' || template_id || '_var1_last', l FROM t")
def feat_numeric_var(spark, d):
    rows = _window_instances(spark, d)
    return G.numeric_features(rows, G.inventory(rows)[1]).select("window_id", "feature", F.round("value", 6).alias("value"))


@query("feat_categorical_var", f"WITH {_WIN}, w2 AS (SELECT *, 'v' || (var1::INT % 9) AS cat FROM wi), c AS (SELECT template_id, cat, count(*) AS n FROM w2 GROUP BY ALL), k AS (SELECT template_id, cat FROM c QUALIFY row_number() OVER (PARTITION BY template_id ORDER BY n DESC, cat) <= 5) SELECT DISTINCT window_id, 'template_' || template_id || '_var1=' || cat AS feature, 1.0::DOUBLE AS value FROM w2 JOIN k USING (template_id, cat)")
def feat_categorical_var(spark, d):
    """The variable as one of nine words, so that it is categorical."""
    rows = _window_instances(spark, d).withColumn("vars", F.transform_values("vars", lambda k, v: F.concat(F.lit("v"), (v.cast("int") % 9).cast("string"))))
    return G.categorical_features(rows, G.inventory(rows)[1])


# Evaluation ----------------------------------------------------------------------------------------------------------

_SCORED = f"{_WIN}, rw AS (SELECT window_id, label, arg_max(bucket_id, start_time) AS bucket_id, max(start_time) AS timestamp FROM wm GROUP BY 1, 2), sc AS (SELECT rw.*, least(1.0::DOUBLE, bk.write_latency_ms / 600) AS probability FROM rw JOIN bk ON rw.bucket_id = bk.bucket_id WHERE bk.write_latency_ms IS NOT NULL)"


def _scored(spark, d):
    score = P.buckets(spark, d).select("bucket_id", F.least(F.lit(1.0), F.col("write_latency_ms") / 600).alias("probability"))
    return G.rows_of(_members(spark, d)).join(score, "bucket_id").where("probability IS NOT NULL")


@query("split_balanced", f"WITH {_SCORED}, k AS (SELECT window_id, label, row_number() OVER (PARTITION BY label ORDER BY timestamp, window_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM sc) SELECT window_id, label, CASE WHEN k <= CASE WHEN n > 1 THEN least(n - 1, greatest(1, CAST(floor(n * 0.8) AS BIGINT))) ELSE n END THEN 'train' ELSE 'test' END AS split FROM k")
def split_balanced(spark, d):
    return E.split_balanced(_scored(spark, d), order=("timestamp", "window_id")).select("window_id", "label", "split")


@query("ts_folds", f"WITH {_SCORED}, k AS (SELECT window_id, row_number() OVER (ORDER BY timestamp, window_id) AS k, count(*) OVER () AS n FROM sc), z AS (SELECT *, n // 6 AS size, unnest(range(5)) AS fold FROM k) SELECT window_id, CAST(fold AS INT) AS fold, CASE WHEN k <= n - size * 5 + fold * size THEN 'train' ELSE 'test' END AS split FROM z WHERE k <= n - size * 5 + fold * size + size")
def ts_folds(spark, d):
    return E.time_series_folds(_scored(spark, d), 5, order=("timestamp", "window_id")).select("window_id", "fold", "split")


@query("auc", f"WITH {_SCORED}, r AS (SELECT label, row_number() OVER (ORDER BY probability, window_id) AS r FROM sc), t AS (SELECT sum(r) FILTER (WHERE label = 1) AS s, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM r) SELECT CASE WHEN p > 0 AND n > 0 THEN round((s - p * (p + 1) / 2) / (p * n), 9)::DOUBLE ELSE 0.5 END AS auc FROM t")
def auc(spark, d):
    return E.auc(_scored(spark, d), tie="window_id").select(F.round("auc", 9).alias("auc"))


@query("threshold_negq", f"WITH {_SCORED} SELECT probability AS threshold FROM (SELECT probability, row_number() OVER (ORDER BY probability DESC) AS r, count(*) OVER () AS n FROM sc WHERE label = 0) WHERE r = greatest(1, CAST(ceil(0.01 * n) AS BIGINT))")
def threshold_negq(spark, d):
    return E.negative_quantile(_scored(spark, d), 0.01)


@query("confusion", f"WITH {_SCORED}, c AS (SELECT count(*) FILTER (WHERE probability >= 0.1 AND label = 1) AS tp, count(*) FILTER (WHERE probability >= 0.1 AND label = 0) AS fp, count(*) FILTER (WHERE probability < 0.1 AND label = 0) AS tn, count(*) FILTER (WHERE probability < 0.1 AND label = 1) AS fn FROM sc) SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 9) AS false_positive_rate FROM c")
def confusion(spark, d):
    out = E.confusion(_scored(spark, d), 0.1)
    return out.select("tp", "fp", "tn", "fn", *(F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "false_positive_rate")))


@query("prob_hist", f"WITH {_SCORED} SELECT least(CAST(floor(probability * 20) AS BIGINT), 19) AS bin, count(*) AS n FROM sc GROUP BY 1")
def prob_hist(spark, d):
    return E.histogram(_scored(spark, d))


@query("log_odds_stats", f"WITH {_SCORED}, p AS (SELECT label, probability, greatest(1e-12, least(1 - 1e-12, probability)) AS q FROM sc) SELECT label, count(*) AS n, round(avg(probability), 6) AS mean_probability, round(avg(ln(q / (1 - q))), 6) AS mean_log_odds, round(quantile_cont(ln(q / (1 - q)), 0.5), 6) AS median_log_odds FROM p GROUP BY 1")
def log_odds_stats(spark, d):
    return E.log_odds(_scored(spark, d)).select("label", "n", *(F.round(c, 6).alias(c) for c in ("mean_probability", "mean_log_odds", "median_log_odds")))


# Mining, on values that follow from the bucket and the template ----------------------------------------------------------

_CON = f"{_WIN}, cb AS (SELECT bucket_id, 'template_count_' || template_id AS feature, CAST(sum((user_id % 7) - 2) AS DOUBLE) AS shap FROM ev GROUP BY 1, 2), sz AS (SELECT window_id, count(DISTINCT bucket_id) AS size FROM wm GROUP BY 1), mn AS (SELECT wm.window_id, feature, sum(shap) / any_value(size) AS mean FROM wm JOIN cb USING (bucket_id) JOIN sz USING (window_id) GROUP BY 1, 2)"


def _contributions(spark, d):
    ev = B.assign(P.events(spark, d))
    return ev.groupBy(bucket_id(F.col("start_time")).alias("bucket_id"), F.concat(F.lit("template_count_"), "template_id").alias("feature")).agg(F.sum((F.col("user_id") % 7) - 2).cast("double").alias("shap"))


def _means(spark, d):
    return M.window_means(_members(spark, d), _contributions(spark, d))


@query("window_means", f"WITH {_CON} SELECT window_id, feature, round(mean, 9) AS mean FROM mn")
def window_means(spark, d):
    return _means(spark, d).select("window_id", "feature", F.round("mean", 9).alias("mean"))


@query("assoc_rules", f"WITH {_CON}, it AS (SELECT window_id, feature FROM mn WHERE mean >= 0.4), ct AS (SELECT feature, count(*) AS n FROM it GROUP BY 1), pr AS (SELECT a.feature AS antecedent, b.feature AS consequent, count(*) AS pair FROM it a JOIN it b ON a.window_id = b.window_id AND a.feature <> b.feature GROUP BY 1, 2) SELECT antecedent, consequent, round(pair / 100.0::DOUBLE, 9) AS support, round(pair / n, 9) AS confidence FROM pr JOIN ct ON ct.feature = pr.antecedent WHERE pair / 100.0::DOUBLE >= 0.2 AND pair / n >= 0.3")
def assoc_rules(spark, d):
    out = M.association_rules(M.itemsets(_means(spark, d), 0.4), 100, 0.2, 0.3)
    return out.select("antecedent", "consequent", F.round("support", 9).alias("support"), F.round("confidence", 9).alias("confidence"))


@query("seq_pairs", f"WITH {_WIN}, ps AS (SELECT window_id, template_id, min(ord) AS lo, max(ord) AS hi FROM wi GROUP BY 1, 2) SELECT a.template_id AS before, b.template_id AS after, count(*) AS n, round(count(*) / 1000.0::DOUBLE, 9) AS support FROM ps a JOIN ps b ON a.window_id = b.window_id AND a.lo < b.hi GROUP BY 1, 2 HAVING count(*) / 1000.0::DOUBLE >= 0.05")
def seq_pairs(spark, d):
    events = _window_instances(spark, d).select("window_id", "template_id", F.col("instance_index").alias("pos"))
    return M.ordered_pairs(events, 1000, 0.05).withColumn("support", F.round("support", 9))


@query("clusters", f"WITH {_CON}, dm AS (SELECT window_id, feature AS dominant, abs(mean) AS w FROM mn QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY abs(mean) DESC, feature) = 1), sz2 AS (SELECT dominant, count(*) AS windows, round(sum(w), 6) AS weight FROM dm GROUP BY 1 ORDER BY weight DESC, dominant LIMIT 5), t AS (SELECT dominant, windows, weight, feature, round(sum(mean) / windows, 6) AS mean FROM mn JOIN dm USING (window_id) JOIN sz2 USING (dominant) GROUP BY 1, 2, 3, 4) SELECT dominant, windows, weight, feature, mean FROM t")
def clusters(spark, d):
    return M.clusters(_means(spark, d)).select("dominant", "windows", F.round("weight", 6).alias("weight"), "feature", F.round("mean", 6).alias("mean"))


_INT = f"{_CON}, ii AS (SELECT a.bucket_id, a.feature AS feature_a, b.feature AS feature_b, a.shap * b.shap / 10 AS value FROM cb a JOIN cb b ON a.bucket_id = b.bucket_id AND a.feature < b.feature), su AS (SELECT window_id, feature_a, feature_b, avg(value) AS mean, avg(abs(value)) AS mean_abs, count(*) AS n FROM wm JOIN ii USING (bucket_id) GROUP BY 1, 2, 3)"


def _summaries(spark, d):
    a, b = _contributions(spark, d).alias("a"), _contributions(spark, d).alias("b")
    pairs = a.join(b, (F.col("a.bucket_id") == F.col("b.bucket_id")) & (F.col("a.feature") < F.col("b.feature")))
    values = pairs.select("a.bucket_id", F.col("a.feature").alias("feature_a"), F.col("b.feature").alias("feature_b"), (F.col("a.shap") * F.col("b.shap") / 10).alias("value"))
    return M.interaction_summaries(_members(spark, d), values)


@query("interaction_summaries", f"WITH {_INT} SELECT window_id, feature_a, feature_b, round(mean, 6) + 0.0::DOUBLE AS mean, round(mean_abs, 6) AS mean_abs, n FROM su")
def interaction_summaries(spark, d):
    return _summaries(spark, d).select("window_id", "feature_a", "feature_b", (F.round("mean", 6) + F.lit(0.0)).alias("mean"), F.round("mean_abs", 6).alias("mean_abs"), "n")


@query("top_interactions", f"WITH {_INT} SELECT feature_a, feature_b, round(sum(mean * n) / sum(n), 6) + 0.0::DOUBLE AS mean, round(sum(mean_abs * n) / sum(n), 6) AS mean_abs, count(DISTINCT window_id) AS windows_with_interaction FROM su GROUP BY 1, 2")
def top_interactions(spark, d):
    return M.top_interactions(_summaries(spark, d), 10).select("feature_a", "feature_b", (F.round("mean", 6) + F.lit(0.0)).alias("mean"), F.round("mean_abs", 6).alias("mean_abs"), "windows_with_interaction")


@query("neg_candidates", f"WITH {_SYM}, p AS (SELECT bucket_id AS positive, epoch_us(window_end) / 1e6 AS p_end FROM lb WHERE label = 1), n AS (SELECT bucket_id AS negative, epoch_us(window_end) / 1e6 AS n_end FROM lb WHERE label = 0), h AS (SELECT DISTINCT negative FROM n JOIN p ON abs(n_end - p_end) <= 1200) SELECT positive, negative, round(n_end - p_end, 6) AS delta FROM n JOIN p ON abs(n_end - p_end) <= 3600 WHERE negative NOT IN (SELECT negative FROM h)")
def neg_candidates(spark, d):
    return M.negative_candidates(_labels(spark, d), 20, 60).select("positive", "negative", F.round("delta", 6).alias("delta"))


@query("neg_time_matched")
def neg_time_matched(spark, d):
    return M.pick_negatives(M.negative_candidates(_labels(spark, d), 20, 60))


@query("neg_template_matched", f"WITH {_SYM}, p AS (SELECT window_end FROM lb WHERE label = 1), h AS (SELECT DISTINCT lb.bucket_id FROM lb JOIN p ON abs(epoch_us(lb.window_end) - epoch_us(p.window_end)) <= 1200 * 1000000 WHERE label = 0) SELECT bucket_id, window_end FROM lb WHERE label = 0 AND bucket_id NOT IN (SELECT bucket_id FROM h) AND bucket_id IN (SELECT bucket_id FROM ev WHERE template_id = 'purchase') ORDER BY window_end, bucket_id LIMIT 20")
def neg_template_matched(spark, d):
    return M.template_matched(_labels(spark, d), P.instances(spark, d), ["purchase"], 20, 20)


_AGG = f"{_CON}, rl AS (SELECT bucket_id, any_value(label) AS label FROM lb GROUP BY 1), ag AS (SELECT feature, sum(shap) / (SELECT count(*) FROM rl) AS mean_shap, sum(abs(shap)) / (SELECT count(*) FROM rl) AS mean_abs_shap, count(*) FILTER (WHERE shap > 0) / nullif(count(*) FILTER (WHERE shap <> 0), 0) AS frac_positive, coalesce(sum(shap) FILTER (WHERE label = 1), 0) / greatest(1, (SELECT count(*) FROM rl WHERE label = 1)) AS mean_positive_class FROM cb JOIN rl USING (bucket_id) GROUP BY 1)"


@query("shap_agg", f"WITH {_AGG} SELECT feature, round(mean_shap, 6) AS mean_shap, round(mean_abs_shap, 6) AS mean_abs_shap, round(coalesce(frac_positive, 0), 6) AS frac_positive, round(mean_positive_class, 6) AS mean_positive_class FROM ag")
def shap_agg(spark, d):
    out = M.shap_aggregate(_contributions(spark, d), _labels(spark, d).select("bucket_id", "label"))
    return out.select("feature", *(F.round(c, 6).alias(c) for c in ("mean_shap", "mean_abs_shap", "frac_positive", "mean_positive_class")))


@query("shap_template_rollup", f"WITH {_AGG} SELECT regexp_extract(feature, '^template_count_(.*)$', 1) AS template_id, round(sum(mean_shap), 6) AS mean_shap, round(sum(mean_abs_shap), 6) AS mean_abs_shap FROM ag GROUP BY 1")
def shap_template_rollup(spark, d):
    out = M.template_rollup(M.shap_aggregate(_contributions(spark, d), _labels(spark, d).select("bucket_id", "label")))
    return out.select("template_id", F.round("mean_shap", 6).alias("mean_shap"), F.round("mean_abs_shap", 6).alias("mean_abs_shap"))


def queries() -> dict[str, Query]:
    from stratalog.plans import catalog_extra, catalog_more

    return {**_QUERIES, **catalog_more.QUERIES, **catalog_extra.QUERIES}


def oracle_sql() -> dict[str, str]:
    from stratalog.plans import catalog_extra, catalog_more

    return {**_SQL, **catalog_more.SQL, **catalog_extra.SQL}

"""Queries of the parsers, the template miner, the model and the streaming variant."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions.text import sanitize, to_bytes
from stratalog.operators import buckets as B
from stratalog.operators import evaluation as E
from stratalog.operators import features as G
from stratalog.operators import labels as L
from stratalog.operators import model as T
from stratalog.operators import templates as D
from stratalog.plans import binding as P
from stratalog.plans.binding import SQL_EV
from stratalog.sources import latency, logs, sysinfo
from stratalog.sources.store import cut, shared_folder
from stratalog.streaming import buckets as S

TIME = "yyyy-MM-dd HH:mm:ss"


def doc_sanitize(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", sanitize(F.col("text")).alias("s")).select("doc_id", F.sha2("s.text", 256).alias("digest"), F.col("s.changed").alias("changed"), F.size("s.warnings").cast("long").alias("n_warnings"))


def log_lines(spark, d):
    ev = P.events(spark, d)
    ctx = F.concat(F.lit("T="), F.col("user_id").cast("string"), F.lit(",ET="))
    line = F.concat(F.date_format("ts", TIME), F.lit(" +02:00 [ "), F.col("level"), F.lit(" ] ["), F.col("component"), F.lit("] ["), ctx, F.lit("]  user="), F.col("user_id"), F.lit("   did   "), F.col("template_id"))
    console = F.concat(F.date_format("ts", TIME), F.lit(" Gateway: queue "), F.col("template_id"))
    text = F.when(F.col("ord") % 10 == 0, "\t[+] continuation").when(F.col("ord") % 10 == 1, console).otherwise(line)
    return ev.select(text.alias("value"), "ord")


def log_parse(spark, d):
    out = logs.parse_events(log_lines(spark, d))
    return out.select("ord", "ts", "level", "component", F.col("ctx")["T"].alias("thread"), F.col("ctx")["ET"].alias("et"), F.size("ctx").cast("long").alias("n_ctx"), "message_clean")


LOG_SQL = f"""WITH {SQL_EV}
SELECT ord, date_trunc('second', ts) - CASE WHEN ord % 10 = 1 THEN INTERVAL 0 HOUR ELSE INTERVAL 2 HOUR END AS ts, CASE WHEN ord % 10 = 1 THEN 'Information' ELSE level END AS level,
       CASE WHEN ord % 10 = 1 THEN 'Gateway' ELSE component END AS component, CASE WHEN ord % 10 <> 1 THEN CAST(user_id AS VARCHAR) END AS thread, CAST(NULL AS VARCHAR) AS et, CAST(5 AS BIGINT) AS n_ctx,
       CASE WHEN ord % 10 = 1 THEN 'queue ' || template_id ELSE 'user=' || user_id || ' did ' || template_id END AS message_clean
FROM ev WHERE ord % 10 <> 0"""


def latency_parse(spark, d):
    ev = P.events(spark, d)
    whole = (F.col("ord") % 500).cast("string")
    us = F.date_format("ts", "M/d/yyyy h:mm:ss a")
    box = F.concat_ws(" ║ ", us, whole, F.lit("9.5"), F.lit("0 ms"), F.concat(whole, F.lit(".5 ms")), F.lit("0 MB"), F.lit("2 KB"), F.lit("0 MB"), F.concat(whole, F.lit(".5 KB")))
    plain = F.concat_ws("  ", F.date_format("ts", TIME), F.lit("1.5"), whole, F.lit("10"), F.lit("20"), F.lit("1"), F.lit("2"))
    lines = ev.select(F.when(F.col("ord") % 3 == 0, box).when(F.col("ord") % 3 == 1, plain).otherwise("Time  Read  Write").alias("value"), "ord")
    return latency.parse_table(lines)[0].select("ord", "ts", "read_iops", "write_iops", "write_latency_ms", "write_io_size_bytes", "read_throughput_bps", "write_throughput_bps")


LATENCY_SQL = f"""WITH {SQL_EV}, x AS (SELECT ord, date_trunc('second', ts) AS ts, ord % 3 = 0 AS box, ord % 500 AS w FROM ev WHERE ord % 3 < 2)
SELECT ord, ts, CASE WHEN box THEN w ELSE 10 END::DOUBLE AS read_iops, CASE WHEN box THEN 9.5 ELSE 20 END::DOUBLE AS write_iops, CASE WHEN box THEN w + 0.5 ELSE w END::DOUBLE AS write_latency_ms,
       CASE WHEN box THEN 2048 END::BIGINT AS write_io_size_bytes, CASE WHEN box THEN 0 ELSE 1048576 END::BIGINT AS read_throughput_bps, CASE WHEN box THEN w * 1024 + 512 ELSE 2097152 END::BIGINT AS write_throughput_bps FROM x"""


def latency_json(spark, d):
    ev = P.events(spark, d)
    texts = ev.select(F.to_json(F.struct(F.array(F.struct(F.date_format("ts", TIME).alias("Time"), F.col("value").alias("WriteLatency")), F.struct(F.lit(None).cast("string").alias("Time"), F.col("value").alias("WriteLatency"))).alias(latency.JSON_KEY))).alias("value"), "ord")
    return latency.parse_json(texts).select("ord", "ts", "write_latency_ms", "read_iops", "write_throughput_bps")


def sysinfo_parse(spark, d):
    ev = P.events(spark, d).where("ord % 50 = 0")
    n = F.col("ord") % 90
    text = F.concat(
        F.lit("=" * 45 + "\n["), F.date_format("ts", "M/d/yyyy h:mm:ss a"), F.lit("] Periodic Information\n" + "=" * 45 + "\nCPU Utilization: "), n.cast("string"),
        F.lit(".5%\nMemory Utilization: 40%\nDisk Utilization: 7%\n4 HDD drives\n2 SSD drives\nVolumes : "), (n + 1).cast("string"),
        F.lit("\nHA State : Active now\nIs node leader : True\nPeer node status : up, available - True\n---- Network ----\n 10.0.0.1\nmask 255.0.0.0\n10.0.0.2\n--------\n3 Manual Pools:\n"),
        F.lit("pool1 : 4 drives. 2 volumes. 1TB / 4TB\nNo degraded volumes\nrebuild occurring\n"),
    )
    out = sysinfo.parse_reports(ev.select(text.alias("value"), "ord"))
    return out.select("ord", F.col("timestamp").alias("ts"), "cpu_util", "memory_util", "hdd_count", "ssd_count", "total_volumes", "ha_state", "is_leader", "peer_available", F.array_join("ip_addresses", ",").alias("ips"), "total_pools", F.get_json_object("pools_json", "$[0].util_pct").cast("double").alias("util_pct"), "degraded_volumes", "rebuild_active")


SYSINFO_SQL = f"""WITH {SQL_EV} SELECT ord, date_trunc('second', ts) AS ts, ord % 90 + 0.5::DOUBLE AS cpu_util, 40.0::DOUBLE AS memory_util, 4 AS hdd_count, 2 AS ssd_count, CAST(ord % 90 + 1 AS INT) AS total_volumes, 'Active' AS ha_state, true AS is_leader, true AS peer_available,
'10.0.0.1,10.0.0.2' AS ips, 3 AS total_pools, 25.0::DOUBLE AS util_pct, 0 AS degraded_volumes, true AS rebuild_active FROM ev WHERE ord % 50 = 0"""


def sysinfo_json(spark, d):
    ev = P.events(spark, d).where("ord % 50 = 0")
    line = F.when(F.col("ord") % 100 == 0, F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("value").alias("cpu_util")))).otherwise("{broken")
    return sysinfo.parse_json_lines(ev.select(line.alias("value"), "ord")).select("ord", F.col("timestamp").alias("ts"), "cpu_util", "memory_util", "ha_state", "is_leader", F.size("ip_addresses").alias("n_ips"))


def unit_bytes(spark, d):
    ev = P.events(spark, d)
    unit = F.element_at(F.split(F.lit("b,KB,mb,GB,xb"), ","), (F.col("ord") % 5 + 1).cast("int"))
    return ev.select("ord", to_bytes(F.col("ord") + 0.25, unit).alias("bytes"))


def drain_templates(spark, d):
    ev = logs.parse_events(log_lines(spark, d))
    return D.fit(ev)


def drain_match(spark, d):
    ev = logs.parse_events(log_lines(spark, d))
    return D.match(ev, D.fit(ev)).groupBy("template_str").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("params")).cast("long").alias("n_params"))


def _matrix(spark, d):
    """Each step is computed once: the plan of all steps together, made anew for each of the many jobs of a training, fills the driver."""
    buckets, instances = cut(P.buckets(spark, d)), P.instances(spark, d)
    labels = cut(L.label_buckets(buckets, L.symptoms(instances, ["error"])))
    members = cut(L.window_members(labels, buckets, 30))
    features = G.build(members, buckets, L.window_instances(members, instances, ["error"]), keep=cut)
    return G.assemble(G.rows_of(members), features)


def _trained(spark, d):
    rows, names = _matrix(spark, d)
    split = cut(E.split_balanced(cut(rows), order=("timestamp", "window_id")))
    train = split.where("split = 'train'")
    try:
        model = T.train(train)
    except T.OneLabel:  # dense logs have an error in every bucket, and so no negatives
        model = T.train_one_label(train)
    return model, split, names


def gbt_score(spark, d):
    model, rows, _ = _trained(spark, d)
    return T.score(model, rows.where("split = 'test'")).select("window_id", "label", "probability")


def tree_shap(spark, d):
    model, rows, names = _trained(spark, d)
    return T.explain(rows.where("split = 'test'"), T.leaves(spark, model, shared_folder(spark)), names)


def late_events(spark, d):
    return S.late_share(P.events(spark, d))


def stream_buckets(spark, d):
    """The event files read as a stream, aggregated to the end, from a memory table."""
    import uuid

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    level = F.element_at(F.create_map(*(F.lit(x) for kv in P.LEVEL_OF.items() for x in kv)), F.col("event_type"))
    name = f"stream_{uuid.uuid4().hex}"
    out = S.bucket_stream(raw.select(F.col("ts").cast("timestamp").alias("ts"), level.alias("level")))
    query = out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


QUERIES = {f.__name__: f for f in (doc_sanitize, log_parse, latency_parse, latency_json, sysinfo_parse, sysinfo_json, unit_bytes, drain_templates, drain_match, gbt_score, tree_shap, late_events, stream_buckets)}
_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F\x{0085}]+"
_TEMPLATES = f"WITH {SQL_EV}, m AS (SELECT ord, CASE WHEN ord % 10 = 1 THEN 'queue <*>' ELSE '<*> did ' || template_id END AS template_str FROM ev WHERE ord % 10 <> 0)"
SQL = {
    "doc_sanitize": rf"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, text IS NULL AS nl FROM documents), b AS (SELECT *, regexp_replace(t, '\x1B\[[0-?]*[ -/]*[@-~]', '', 'g') AS x FROM a), c AS (SELECT *, trim(regexp_replace(x, '{_SPACE}', ' ', 'g'), ' ') AS y FROM b)
SELECT doc_id, sha256(y) AS digest, y <> t AS changed, CAST(nl::INT + (x <> t)::INT AS BIGINT) AS n_warnings FROM c""",
    "log_parse": LOG_SQL,
    # What a reader of the lines would say their templates are: one for each kind of action, and one for the console's.
    "drain_templates": f"{_TEMPLATES} SELECT row_number() OVER (ORDER BY min(ord)) AS template_id, template_str, CAST(len(string_split(template_str, ' ')) AS INT) AS n_tokens FROM m GROUP BY template_str",
    "drain_match": f"{_TEMPLATES} SELECT template_str, count(*) AS n, CAST(1 AS BIGINT) AS n_params FROM m GROUP BY template_str",
    "latency_parse": LATENCY_SQL,
    "latency_json": f"WITH {SQL_EV} SELECT ord, date_trunc('second', ts) AS ts, value AS write_latency_ms, 0.0::DOUBLE AS read_iops, CAST(0 AS BIGINT) AS write_throughput_bps FROM ev",
    "sysinfo_parse": SYSINFO_SQL,
    "sysinfo_json": f"WITH {SQL_EV} SELECT ord, date_trunc('second', ts) AS ts, value AS cpu_util, 0.0::DOUBLE AS memory_util, 'Unknown' AS ha_state, false AS is_leader, 0 AS n_ips FROM ev WHERE ord % 100 = 0",
    "unit_bytes": f"WITH {SQL_EV} SELECT ord, CAST(round_even((ord + 0.25) * CASE ord % 5 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 END, 0) AS BIGINT) AS bytes FROM ev",
    "late_events": f"WITH {SQL_EV}, m AS (SELECT floor(epoch(ts) / 14400) AS w, max(floor(epoch(ts) / 14400)) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ev), t AS (SELECT count(*) FILTER (WHERE w < seen) AS late, count(*) AS events FROM m) SELECT late, events, late / events AS share, CASE WHEN late / events > 0.1 THEN 'error' WHEN late / events > 0.005 THEN 'warning' ELSE 'ok' END AS level FROM t",
    "stream_buckets": f"WITH {P.SQL_BUCKETS} SELECT bucket_id, start_time, end_time, {', '.join(B.COUNTS)} FROM bk",
}

"""From raw files to the bucket table, its verification, and later runs that read only what is new."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators import buckets as B
from stratalog.operators import select as Q
from stratalog.operators import templates as D
from stratalog.sources import discovery, latency, logs, sysinfo
from stratalog.sources.store import remove


def bucket_table(spark: SparkSession, files: dict[str, list[str]], minutes: int = 5, threshold: float = B.SPIKE_MS, known: DataFrame | None = None, dense: bool = False) -> tuple[DataFrame, DataFrame]:
    """(buckets, templates) of files by category."""
    events = logs.parse_events(logs.read_lines(spark, files["event"]))
    templates = D.fit(events, known=known).checkpoint()
    matched = D.match(events, templates)
    lat = latency.read(spark, files["latency"]) if files.get("latency") else None
    sysi = sysinfo.read(spark, files["system"]).withColumn("ip_addresses_json", F.when(F.size("ip_addresses") > 0, F.to_json("ip_addresses"))) if files.get("system") else None
    return B.build(matched, lat, sysi, minutes, threshold, dense), templates


def _known(spark: SparkSession, root: str, force: bool) -> tuple[dict, DataFrame | None]:
    """The manifest and the templates of earlier runs."""
    if force or B.existing(spark, f"{root}/buckets") is None:
        return {}, None
    return discovery.load_json(spark, f"{root}/manifest"), B.existing(spark, f"{root}/templates")


def save_templates(spark: SparkSession, templates: DataFrame, root: str) -> None:
    """The state of the miner, and a copy of it under the time of the run, which no later run changes."""
    own = templates.checkpoint()
    own.write.mode("overwrite").parquet(f"{root}/templates")
    own.write.mode("errorifexists").parquet(f"{root}/template_snapshots/{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}-{time.time_ns() % 10**9:09d}")


def create(spark: SparkSession, data_dir: str, output_root: str, file_limit: int = discovery.FILE_LIMIT, minutes: int = 5, threshold: float = B.SPIKE_MS, force: bool = False, patterns: dict | None = None, extensions: list[str] | None = None, ask=None, yes: bool = True, strict: bool = False, check: bool = True, verified: bool = True) -> dict:
    """Discover, check, build and write: `buckets` by day, `templates` with snapshots, `manifest`; returns the verification.

    A second run reads only files that the manifest does not have, with the templates' ids kept, and merges their buckets. If
    a file that it has was changed since, what it gave cannot be told from the rest, so the table is built anew of all files.
    """
    patterns = patterns or discovery.PATTERNS
    found = discovery.discover(spark, data_dir, patterns, extensions, file_limit)
    checked = discovery.validate(found)
    if check:
        discovery.confirm(checked, ask or input, yes, strict)
    manifest, known = _known(spark, output_root, force)
    listed = discovery.categorize(discovery.find(discovery.listing(spark, data_dir), [], extensions=extensions), patterns)
    states = discovery.manifest_changes(listed, manifest).select("path", "category", "state", "length", "modificationTime", (F.unix_micros("modificationTime") / 1e6).alias("mtime")).checkpoint()
    # No more rows than the file limit.
    rows = states.orderBy("path").collect()
    if any(r["state"] == "modified" for r in rows):
        known, rows, manifest = None, [r.asDict() | {"state": "new"} for r in rows], {}
    fresh = [r for r in rows if r["state"] == "new"]
    counts = {s: sum(r["state"] == s for r in rows) for s in ("new", "cached")}
    files = {c: [r["path"] for r in fresh if r["category"] == c] for c in patterns}
    if files.get("event"):
        table, templates = bucket_table(spark, files, minutes, threshold, known)
        table = table.checkpoint()
        path = f"{output_root}/buckets"
        if not manifest:
            remove(spark, path)
        B.upsert(spark, path, table, discovery.batch_name([r["path"] for r in fresh], [r["mtime"] for r in fresh]))
        save_templates(spark, templates, output_root)
        done = states.where(F.col("path").isin([r["path"] for r in fresh]))
        discovery.save_json(spark, f"{output_root}/manifest", discovery.manifest_of(done, path, manifest))
    own = spark.read.parquet(f"{output_root}/buckets")
    return (verify(own) if verified else {}) | checked | {"files": counts, "summary": discovery.summary_text(found, checked)}


def create_from(spark: SparkSession, own: dict, ask=None) -> dict:
    """create() with the settings of a configuration, and the summary saved if they say so."""
    patterns = {"event": tuple(own["event_patterns"]), "latency": tuple(own["latency_pattern"]), "system": tuple(own["system_pattern"])}
    told = create(
        spark, own["data_dir"], own["output_root"], own["file_limit"], own["bucket_duration"], own["spike_threshold"], own["force"], patterns, own["extensions"],
        ask, own["yes"], own["strict_mode"], not own["skip_validation"], own["verify"],
    )
    if own["save_summary"]:
        text = verification_text(told)
        spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{own['output_root']}/verification")
    return told



def verify(table: DataFrame, samples: int = 3) -> dict:
    """Number of buckets, their range and events, and a few of them at random."""
    told = Q.info(table).first().asDict() | Q.event_count(table).first().asDict()
    n = min(samples, told["buckets"])
    return told | {"samples": [r.asDict() for r in Q.get_random(table, n, seed=1).select("bucket_id", "total_events").collect()] if n else []}


def verification_text(told: dict) -> str:
    lines = [told["summary"]]
    if "buckets" in told:
        lines += [f"{told['buckets']} buckets, {told['first_start']} to {told['last_end']}, {told['events']} events", *(f"  {s['bucket_id']}: {s['total_events']} events" for s in told["samples"])]
    return "\n".join(lines)

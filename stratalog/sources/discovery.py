"""Finding, checking and remembering input files. Listings go through Spark, so any store that it reads will do."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.functions.display import size_text, time_text

#: Default name patterns by category, and seconds that a file of each is expected to take.
PATTERNS = {"event": ("*NAS*", "*PlatformClient*", "*PlatformManager*"), "latency": ("*latency*",), "system": ("*Information*",)}
SECONDS = {"event": 2.4, "latency": 1.5, "system": 1.0}
FILE_LIMIT = 50


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, name, length, modificationTime) of all files below root, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime")


def find(files: DataFrame, keywords: list[str], mode: str = "any", extensions: list[str] | None = None) -> DataFrame:
    """Files whose name has any or all keywords, in either case, and one of the last suffixes. No keyword finds all."""
    if mode not in ("any", "all"):
        raise ValueError("mode is any or all")
    hits = [F.contains(F.lower("name"), F.lit(k.lower())) for k in keywords]
    out = files
    if hits:
        total = sum((h.cast("int") for h in hits), F.lit(0))
        out = out.where(total >= (1 if mode == "any" else len(hits)))
    if extensions:
        suffix = F.concat(F.lit("."), F.lower(F.element_at(F.split("name", r"\."), -1)))
        out = out.where((F.instr("name", ".") > 0) & suffix.isin([e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions]))
    return out


def categorize(files: DataFrame, patterns: dict[str, tuple[str, ...]] = PATTERNS, first_only: bool = True) -> DataFrame:
    """Files with `category`; those of several are in the first only, or one row for each if not first_only."""
    has = lambda ps: F.exists(F.array(*(F.lit(p.replace("*", "").lower()) for p in ps)), lambda p: F.contains(F.lower("name"), p))
    found = F.filter(F.array(*(F.when(has(ps), F.lit(c)) for c, ps in patterns.items())), lambda c: c.isNotNull())
    return files.withColumn("category", F.explode(F.slice(found, 1, 1) if first_only else found))


@dataclass
class Discovery:
    files: dict[str, list[str]] = field(default_factory=dict)
    total_files: int = 0
    total_size_bytes: int = 0


def discover(spark: SparkSession, root: str, patterns: dict[str, tuple[str, ...]] = PATTERNS, extensions: list[str] | None = None, file_limit: int = FILE_LIMIT) -> Discovery:
    """Files by category. Their number is checked against the limit before they are listed on the driver."""
    rows = categorize(find(listing(spark, root), [], extensions=extensions), patterns)
    n, size = rows.agg(F.count(F.lit(1)), F.sum("length")).first()
    if not n:
        raise FileNotFoundError(f"no file below {root} has a known name")
    if n > file_limit:
        raise ValueError(f"{n} files exceed the limit of {file_limit}")
    found: dict[str, list[str]] = {c: [] for c in patterns}
    for r in rows.select("category", "path").orderBy("path").collect():
        found[r["category"]].append(r["path"])
    return Discovery(found, n, size)


def validate(found: Discovery) -> dict:
    """Whether there are events, which categories are missing, and the expected seconds."""
    missing = [c for c in SECONDS if not found.files.get(c)]
    return {"is_valid": "event" not in missing, "missing_categories": missing, "warnings": [f"no {c} files" for c in missing], "estimated_seconds": sum(SECONDS[c] * len(f) for c, f in found.files.items())}


def summary_text(found: Discovery, checked: dict) -> str:
    """What was found and is missing, how large it is, and how long it may take."""
    lines = [f"{c}: {len(f)} files" for c, f in found.files.items()]
    lines += [f"{found.total_files} files, {size_text(found.total_size_bytes)}, about {time_text(checked['estimated_seconds'])}", *(f"warning: {w}" for w in checked["warnings"])]
    return "\n".join(lines)


class Aborted(RuntimeError):
    """The user did not want to go on."""


def confirm(checked: dict, ask: Callable[[str], str] = input, yes: bool = False, strict: bool = False) -> None:
    """Go on without a question if nothing is missing or `yes`; else ask, and abort unless the answer begins with y.

    strict: a missing category is an error.
    """
    if not checked["is_valid"] or (strict and checked["missing_categories"]):
        raise ValueError("; ".join(checked["warnings"]))
    if checked["missing_categories"] and not yes and not ask(f"{'; '.join(checked['warnings'])}. Go on? [y/N] ").strip().lower().startswith("y"):
        raise Aborted("not confirmed")


def read_queue(ranges: DataFrame, until, resumed: list[str] = ()) -> DataFrame:
    """(source_file, start_time, end_time, resumed, place): the files to read for times before `until`, those that were begun first.

    ranges: as time_ranges of the log lines gives them. A batch reads all files at once; the order serves readers that do not.
    """
    own = ranges.where(F.col("start_time") < F.lit(until)).withColumn("resumed", F.col("source_file").isin(list(resumed)))
    # A row for each file of one run.
    return own.withColumn("place", F.row_number().over(Window.orderBy(F.desc("resumed"), "start_time", "source_file")))


def manifest_changes(files: DataFrame, manifest: dict) -> DataFrame:
    """files with `state`: new, modified (another time) or cached."""
    known = manifest.get("files", {})
    rows = "\n".join(f"{p}\t{float(m['mtime'])!r}" for p, m in sorted(known.items()))
    old = files.sparkSession.range(1).select(F.explode(F.split(F.lit(rows), "\n")).alias("r")).where("r <> ''").select(F.substring_index("r", "\t", 1).alias("path"), F.substring_index("r", "\t", -1).cast("double").alias("known_mtime"))
    mtime = F.unix_micros("modificationTime") / 1e6
    out = files.join(old, "path", "left")
    return out.withColumn("state", F.when(F.col("known_mtime").isNull(), "new").when(F.abs(mtime - F.col("known_mtime")) > 1e-6, "modified").otherwise("cached")).drop("known_mtime")


def batch_name(paths: list[str], mtimes: list[float]) -> str:
    """A name of a set of files at their times."""
    return hashlib.sha256("\n".join(f"{p} {m!r}" for p, m in sorted(zip(paths, mtimes, strict=True))).encode()).hexdigest()[:16]


def manifest_of(files: DataFrame, bucket_file: str, manifest: dict | None = None) -> dict:
    """The manifest after the given files (path, category, length, modificationTime) were processed."""
    now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    out = {"version": 1, "created": now, "files": {}} | (manifest or {}) | {"last_updated": now, "bucket_file": bucket_file}
    for r in files.select("path", "category", "length", (F.unix_micros("modificationTime") / 1e6).alias("mtime")).collect():
        out["files"][r["path"]] = {"category": r["category"], "size_bytes": r["length"], "mtime": r["mtime"], "processed": now}
    out["totals"] = {"files": len(out["files"]), "size_bytes": sum(f["size_bytes"] for f in out["files"].values())}
    return out


def save_json(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON text in a folder of the store, replaced as a whole."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    """A JSON text that save_json wrote, whatever its length."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))

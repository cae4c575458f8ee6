"""Periodic system reports and JSON lines as system records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.text import let, parse_time, terabytes

#: Record columns with their type and what a JSON line without them counts as.
FIELDS = {
    "cpu_util": ("double", 0.0), "memory_util": ("double", 0.0), "disk_util": ("double", 0.0), "hdd_count": ("int", 0), "ssd_count": ("int", 0), "total_volumes": ("int", 0),
    "ha_state": ("string", "Unknown"), "is_leader": ("boolean", False), "peer_available": ("boolean", False), "ip_addresses": ("array<string>", None), "pools_json": ("string", "{}"),
    "total_pools": ("int", 0), "volumes_json": ("string", "{}"), "degraded_volumes": ("int", 0), "rebuild_active": ("boolean", False),
}
FRAME = r"={40,}"
TITLE = r"\[(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d\d:\d\d\s+[AP]M)\]\s*Periodic Information"


DASHES = "-{4,}"


def sections(texts: DataFrame, column: str = "value") -> DataFrame:
    """Whole reports cut into sections (section): each from its dated title to the next, or to a frame that opens something else."""
    starts = F.split(F.regexp_replace(F.col(column), rf"(?={TITLE})", "\u0001"), "\u0001")
    # The frame below the title belongs to it; the next one ends the section.
    open_title = rf"^({TITLE}[^\n]*)\n\s*{FRAME}"
    cut = F.transform(starts, lambda s: F.get(F.split(F.regexp_replace(s, open_title, "$1"), FRAME), F.lit(0)))
    kept = [c for c in texts.columns if c != column]
    return texts.select(F.explode(F.filter(cut, lambda s: s.rlike(f"^{TITLE}"))).alias("section"), *kept).distinct()


def _rest(text: Column, label: str) -> Column:
    """What stands behind a label and a colon on its line; empty without the label. Blanks of a label stand for any."""
    return F.trim(F.regexp_extract(text, "(?im)" + label.replace(" ", r"\s+") + r"\s*:[ \t]*([^\r\n]*)", 1))


def _number(text: Column, kind: str) -> Column:
    """The number that a text begins with; null without one."""
    return F.nullif(F.regexp_extract(text, r"^(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast(kind)


def _last_count(text: Column, what: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"(\d+)\s+{what}"), F.lit(1))
    return F.coalesce(F.get(found, F.size(found) - 1).try_cast("int"), F.lit(0))


def _block(text: Column, heading: str) -> Column:
    """The lines below a heading with dashes on its own line or beside it, up to the next line with dashes."""
    line = rf"[^\n]*{heading}[^\n]*\n"
    dashed = rf"(?:[^\n]*{DASHES}[^\n]*\n{line}|[^\n]*{DASHES}{line}|[^\n]*{heading}[^\n]*{DASHES}[^\n]*\n|{line}[^\n]*{DASHES}[^\n]*\n)"
    below = F.regexp_extract(F.concat(text, F.lit("\n")), rf"(?:^|\n){dashed}(?:[^\n]*{DASHES}[^\n]*\n)?((?:(?![^\n]*{DASHES})[^\n]*\n)*)", 1)
    return F.transform(F.split(below, "\n"), lambda x: F.trim(F.regexp_replace(x, "\r", "")))


def _size_tb(text: Column) -> Column:
    """Decimal terabytes of `0.06TB`; a number without a known unit counts as such already."""
    return let(F.trim(text), lambda t: _number(t, "double") * F.coalesce(terabytes(F.lit(1.0), F.regexp_extract(t, r"([A-Za-z]*)$", 1)), F.lit(1.0)))


def parse_pool(line: Column) -> Column:
    """struct of a line `name : 9 drives. 6 volumes. 0.06TB / 161.9TB`, read part by part; null for other lines."""

    def of_parts(parts: Column) -> Column:
        part = lambda i: F.coalesce(F.trim(F.get(parts, F.lit(i))), F.lit(""))
        sizes = F.split(part(3), "/")
        used, capacity = F.get(sizes, F.lit(0)), F.get(sizes, F.lit(1))
        fits = (part(0) != "") & ~part(0).rlike(r"\W") & part(1).rlike(r"^\d+\s+drives?$") & part(2).rlike(r"^\d+\s+volumes?$") & _number(F.trim(used), "double").isNotNull() & _number(F.trim(capacity), "double").isNotNull()
        row = let(
            F.struct(_size_tb(used).alias("used"), _size_tb(capacity).alias("capacity")),
            lambda s: F.struct(
                part(0).alias("name"), _number(part(1), "int").alias("drives"), _number(part(2), "int").alias("volumes"), s["used"].alias("used_tb"), s["capacity"].alias("capacity_tb"),
                F.when(s["capacity"] > 0, s["used"] / s["capacity"] * 100).otherwise(0.0).alias("util_pct"),
            ),
        )
        return F.when(fits, row)

    # Full stops end a part only before a blank, so that decimals stay whole.
    return F.when(F.instr(line, ":") > 0, let(F.split(F.regexp_replace(line, r"^([^:]*):", "$1. "), r"\.\s", 4), of_parts))


def parse_section(text: Column) -> Column:
    """struct of one section's fields; each is read by its label from its own line."""
    percent = lambda name: F.coalesce(_number(_rest(text, f"{name} Utilization"), "double"), F.lit(0.0))
    lines = F.split(text, "\r?\n")
    true = lambda value: F.startswith(F.lower(value), F.lit("true"))
    peer = F.regexp_extract(_rest(text, "Peer node status"), r"(?i).*available\s*-\s*(\w+)", 1)
    counted = F.regexp_extract(text, r"(\d+)\s+(?:Manual\s+)?Pools?:", 1).try_cast("int")
    volumes = F.filter(_block(text, "Volumes"), lambda x: F.contains(x, F.lit("Volume")) & F.contains(x, F.lit(":")))
    details = F.transform(volumes, lambda x: F.struct(F.trim(F.replace(F.substring_index(x, ":", 1), F.lit("Volume"), F.lit(""))).alias("id"), F.trim(F.get(F.split(x, ":"), F.lit(1))).alias("details")))
    found = F.struct(
        F.filter(F.transform(lines, parse_pool), lambda p: p.isNotNull()).alias("pools"), details.alias("volumes"),
        F.filter(_block(text, "Network"), lambda x: x.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")).alias("ips"),
    )
    json = lambda rows: F.when(F.size(rows) > 0, F.to_json(rows)).otherwise("{}")
    return let(
        found,
        lambda f: F.struct(
            parse_time(F.regexp_replace(F.regexp_extract(text, TITLE, 1), r"\s+", " ")).alias("timestamp"),
            percent("CPU").alias("cpu_util"), percent("Memory").alias("memory_util"), percent("Disk").alias("disk_util"),
            _last_count(text, "HDD drives").alias("hdd_count"), _last_count(text, "SSD drives").alias("ssd_count"),
            F.coalesce(_number(_rest(text, "Volumes"), "int"), F.lit(0)).alias("total_volumes"),
            F.coalesce(F.nullif(F.regexp_extract(_rest(text, "HA State"), r"^(\w+)", 1), F.lit("")), F.lit("Unknown")).alias("ha_state"),
            true(_rest(text, "Is node leader")).alias("is_leader"), true(peer).alias("peer_available"), f["ips"].alias("ip_addresses"),
            json(f["pools"]).alias("pools_json"), F.coalesce(F.nullif(counted, F.lit(0)), F.size(f["pools"])).alias("total_pools"), json(f["volumes"]).alias("volumes_json"),
            _last_count(F.regexp_extract(text, r"(\d+\s+degraded\s+volumes?)", 1), r"degraded\s+volumes?").alias("degraded_volumes"),
            text.rlike(r"(?i)rebuild\s+occurring").alias("rebuild_active"),
        ),
    )


def parse_reports(texts: DataFrame, column: str = "value") -> DataFrame:
    """Records of whole reports; a section without a readable time is left out, one that repeats counts once."""
    kept = [c for c in texts.columns if c != column]
    rows = F.filter(F.array(parse_section(F.col("section"))), lambda r: r["timestamp"].isNotNull())
    return sections(texts, column).select(F.explode(rows).alias("r"), *kept).select("r.*", *kept)


def parse_json_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records of JSON lines with defaults; lines that are malformed or without a time go."""
    schema = "timestamp string, " + ", ".join(f"{c} {t}" for c, (t, _) in FIELDS.items())
    rows = lines.select(F.from_json(column, schema).alias("r"), *(c for c in lines.columns if c != column))
    filled = [F.coalesce(F.col(f"r.{c}"), F.array().cast(t) if c == "ip_addresses" else F.lit(v)).alias(c) for c, (t, v) in FIELDS.items()]
    return rows.select(parse_time(F.col("r.timestamp")).alias("timestamp"), *filled, *(c for c in lines.columns if c != column)).where("timestamp IS NOT NULL")


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of system files: reports, or JSON lines where a file holds no section and is named .json."""
    whole = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_file"))
    reports = F.col("value").rlike(TITLE)
    lines = whole.where(~reports & F.col("source_file").endswith(".json")).select(F.explode(F.split("value", "\r?\n")).alias("value"), "source_file")
    return parse_reports(whole.where(reports)).unionByName(parse_json_lines(lines)).withColumn("ord", F.monotonically_increasing_id())


def read_directory(spark: SparkSession, folder: str, pattern: str = "*Information*") -> DataFrame:
    """Records of the files of a folder whose names fit a pattern."""
    return read(spark, [f"{folder}/{pattern}"])

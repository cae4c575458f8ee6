"""Latency tables, boxed, spaced or JSON, as metric records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.text import leading_number, let, megabytes_per_second, parse_ms, parse_time, sized

DATED = r"(?i)^\s*(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d\d:\d\d\s+[AP]M|\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d)"
BOX = "║"
#: Top-level key of the JSON layout, as the files spell it, and the fields' names there.
JSON_KEY = "PerformanceStatstics"
JSON_FIELDS = {
    "ReadIops": "read_iops", "WriteIops": "write_iops", "ReadLatency": "read_latency_ms", "WriteLatency": "write_latency_ms",
    "ReadIoSize": "read_size_bytes", "WriteIoSize": "write_io_size_bytes", "ReadThroughput": "read_throughput_bps", "WriteThroughput": "write_throughput_bps",
}
JSON_SCHEMA = f"struct<{JSON_KEY}: array<struct<Time: string, {', '.join(f'{k}: double' for k in JSON_FIELDS)}>>>"
COLUMNS = ("ts", "metric", *JSON_FIELDS.values())


def layout(first_line: Column) -> Column:
    """json or table, by a file's first line that is not blank; a byte order mark is no content."""
    text = F.regexp_replace(F.trim(first_line), "^\uFEFF", "")
    return F.when(text.rlike(r"^[{\[]"), "json").otherwise("table")


def detect(lines: DataFrame) -> DataFrame:
    """(source_file, layout) of files of lines (value, source_file, ord)."""
    return lines.groupBy("source_file").agg(layout(F.min_by("value", "ord")).alias("layout"))


def parse_row(line: Column) -> Column:
    """struct of the metrics of a table line; null for lines without a date in front, and for too few cells.

    Eight values or more are the boxed layout with units, six or seven the spaced one without.
    """

    def row(cells: Column) -> Column:
        cell = lambda i: F.get(cells, F.lit(i))
        milliseconds = lambda i: F.coalesce(parse_ms(cell(i)), leading_number(cell(i)))
        common = [parse_time(F.regexp_replace(cell(0), r"\s+", " ")), F.lit("latency_table_row")]
        boxed = [*common, leading_number(cell(1)), leading_number(cell(2)), milliseconds(3), milliseconds(4), *(sized(cell(i)) for i in (5, 6, 7, 8))]
        none = F.lit(None).cast("long")
        spaced = [*common, leading_number(cell(3)), leading_number(cell(4)), leading_number(cell(1)), leading_number(cell(2)), none, none, megabytes_per_second(cell(5)), megabytes_per_second(cell(6))]
        named = [F.struct(*(c.alias(n) for c, n in zip(values, COLUMNS, strict=True))) for values in (boxed, spaced)]
        return F.when(F.size(cells) >= 9, named[0]).when(F.size(cells) >= 7, named[1])

    cells = F.filter(F.transform(F.split(line, rf"\s*{BOX}\s*|\s{{2,}}"), lambda c: F.trim(c)), lambda c: c != "")
    return F.when(line.rlike(DATED), let(cells, row))


def parse_table(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, errors): dated lines that cannot be read are errors, other lines headings."""
    kept = [c for c in lines.columns if c != column]
    rows = F.filter(F.array(parse_row(F.col(column))), lambda r: r["ts"].isNotNull())
    good = lines.select(F.explode(rows).alias("row"), *kept).select("row.*", *kept)
    return good, lines.where(F.col(column).rlike(DATED)).where(F.size(rows) == 0).select(column, *kept)


def parse_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """Records of whole JSON texts; a missing number is 0, and rows without a time go."""
    rows = texts.select(F.explode(F.from_json(column, JSON_SCHEMA)[JSON_KEY]).alias("r"), *(c for c in texts.columns if c != column))
    named = [F.coalesce(F.col(f"r.{k}"), F.lit(0.0)).alias(v) for k, v in JSON_FIELDS.items()]
    out = rows.select(parse_time(F.col("r.Time")).alias("ts"), F.lit("latency_json_row").alias("metric"), *named, *(c for c in texts.columns if c != column))
    return out.where("ts IS NOT NULL").withColumns({c: F.col(c).cast("long") for c in ("read_size_bytes", "write_io_size_bytes", "read_throughput_bps", "write_throughput_bps")})


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of latency files of either layout."""
    whole = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_file"))
    kind = layout(F.regexp_extract("value", r"(?s)^\uFEFF?\s*(\S[^\n]*)", 1))
    lines = whole.where(kind == "table").select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "value"), "source_file")
    records, _ = parse_table(lines)
    return records.select(*COLUMNS, "source_file", F.col("ord").cast("long")).unionByName(parse_json(whole.where(kind == "json")).select(*COLUMNS, "source_file", F.monotonically_increasing_id().alias("ord")))

"""Log lines as events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.text import context_map, let, parse_time, sanitize

#: Fixed layouts: `time [level] [component] [context] message`, blanks between the brackets or none, and `date time rest` of a console.
STANDARD = r"^\s*(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d+)?(?: ?(?:[+-]\d\d:?\d\d|Z))?)\s*\[([^\]]+)\]\s*\[([^\]]*)\]\s*\[([^\]]*)\]\s*(.*)$"
CONSOLE = r"^\s*(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\s+(.*)$"
#: Parts the fields of a line; cleaned text has none of it.
SEAM = "\x00"


def read_lines(spark: SparkSession, paths: list[str] | str, pattern: str | None = None) -> DataFrame:
    """(value, source_file, ord): the lines of text files that are not blank. Bytes that are no UTF-8 read as U+FFFD.

    ord orders the lines of a file; it is made of the partition and the row in it, and has no meaning beyond that.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    rows = reader.text(paths).select("value", F.col("_metadata.file_path").alias("source_file"))
    return rows.where(F.trim("value") != "").withColumn("ord", F.monotonically_increasing_id())


def _parts(text: Column, pattern: str, groups: int) -> Column:
    """The groups of a text that matches the pattern, by one search; else the text alone. No text holds the seam."""
    return F.split(F.regexp_replace(text, pattern, SEAM.join(f"${i}" for i in range(1, groups + 1))), SEAM, groups)


def parse_clean(clean: Column, ctx: Callable[[Column], Column] = context_map) -> Column:
    """struct(ts, level, component, ctx, message_raw, message_clean, warnings) of what sanitize() gives; null for continuations and blanks.

    ctx: what becomes of the context's text.
    """

    def row(time: Column, level: Column, component: Column, context: Column, message: Column) -> Column:
        return F.struct(
            parse_time(time).alias("ts"), level.alias("level"), component.alias("component"), ctx(context).alias("ctx"),
            clean["raw"].alias("message_raw"), message.alias("message_clean"), clean["warnings"].alias("warnings"),
        )

    def console(parts: Column) -> Column:
        rest = F.get(parts, F.lit(1))
        head = F.trim(F.substring_index(rest, ":", 1))
        named = (F.instr(rest, ":") > 0) & (head != "")
        message = F.when(named, F.trim(F.substring(rest, F.instr(rest, ":") + 1, F.length(rest)))).otherwise(rest)
        return F.when(F.size(parts) == 2, row(F.get(parts, F.lit(0)), F.lit("Information"), F.when(named, head).otherwise("console"), F.lit(None).cast("string"), message))

    def standard(parts: Column) -> Column:
        at = lambda i: F.get(parts, F.lit(i))
        return F.when(F.size(parts) == 5, row(at(0), F.trim(at(1)), F.trim(at(2)), at(3), at(4))).otherwise(let(_parts(at(0), CONSOLE, 2), console))

    return let(_parts(clean["text"], STANDARD, 5), standard)


def parse_line(raw: Column) -> Column:
    """What parse_clean gives for a raw line."""
    return let(sanitize(raw), lambda clean: parse_clean(clean))


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of lines, with the lines' other columns; lines that begin no event, or have no readable time, go.

    A generator hands the events on, so that no filter repeats the parsing. The context is read behind it, and only where it
    is asked for.
    """
    kept = [c for c in lines.columns if c != column]
    plain = let(sanitize(F.col(column)), lambda clean: parse_clean(clean, lambda ctx: ctx))
    events = lines.select(F.explode(F.filter(F.array(plain), lambda e: e["ts"].isNotNull())).alias("event"), *kept)
    names = ("ts", "level", "component", "ctx", "message_raw", "message_clean", "warnings")
    return events.select(*(context_map(F.col("event.ctx")).alias(n) if n == "ctx" else F.col(f"event.{n}") for n in names), *kept)


def time_ranges(events: DataFrame) -> DataFrame:
    """(source_file, start_time, end_time, events) of each file, from all its lines, so that no clock skew misleads; files
    without a timed event have no row."""
    return events.groupBy("source_file").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("events"))

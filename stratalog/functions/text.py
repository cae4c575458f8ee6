"""Cleaning and parsing of log text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the cleaning rules.
ANSI = r"\x1B\[[0-?]*[ -/]*[@-~]"
ODD_SPACE = r"[\u00A0\u1680\u2000-\u200B\u202F\u205F\u3000\uFEFF]"
ANY_SPACE = r"[\s\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: Runs of white space but for single plain spaces. Printable ASCII is passed over by one test a character, and only what is left
#: is looked up among the spaces.
LONG_SPACE = rf" {ANY_SPACE}+|[^ -~](?<={ANY_SPACE}){ANY_SPACE}*"
HAS_ODD_SPACE = rf"[^\x00-\x9F](?<={ODD_SPACE})"
#: Binary units, by their first letter.
UNITS = {"B": 0, "KB": 1, "MB": 2, "GB": 3, "TB": 4}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value evaluated once, however often the body names it, and whatever the optimizer merges."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sanitize(raw: Column) -> Column:
    """struct(raw, text, warnings, changed) of a message: colour codes, NULs and odd spaces go, white space collapses.

    A null message becomes the empty text with the warning input_was_none. Plain texts are told at a glance; each step is
    evaluated once, and only if there is something for it to do.
    """
    no_tags = F.array().cast("array<string>")
    collapsed = lambda text: F.trim(F.regexp_replace(text, LONG_SPACE, " "))

    def told(text: Column, clean: Column, tags: Column) -> Column:
        return let(clean, lambda c: F.struct(raw.alias("raw"), c.alias("text"), tags.alias("warnings"), (c != text).alias("changed")))

    def step_by_step(text: Column) -> Column:
        def tagged(no_ansi: Column, no_nul: Column, tight: Column, spaced: Column) -> Column:
            tags = F.array(
                F.when(raw.isNull(), "input_was_none"), F.when(no_ansi != text, "ansi_removed"), F.when(no_nul != no_ansi, "nul_removed"),
                F.when(tight != no_nul, "unicode_space_after_equals_removed"), F.when((spaced != tight) | (tight != no_nul), "unicode_space_normalized"),
            )
            return told(text, collapsed(spaced), F.filter(tags, lambda x: x.isNotNull()))

        return let(
            F.regexp_replace(text, ANSI, ""),
            lambda a: let(F.translate(a, "\x00", ""), lambda n: let(F.regexp_replace(n, f"={ODD_SPACE}+", "="), lambda t: let(F.regexp_replace(t, f"{ODD_SPACE}+", " "), lambda s: tagged(a, n, t, s)))),
        )

    def cleaned(text: Column) -> Column:
        ascii_only = F.octet_length(text) == F.length(text)
        steps = F.contains(text, F.lit("\x1b")) | F.contains(text, F.lit("\x00")) | (~ascii_only & text.rlike(HAS_ODD_SPACE))
        plain = ascii_only & ~F.contains(text, F.lit("  ")) & ~F.startswith(text, F.lit(" ")) & ~F.endswith(text, F.lit(" ")) & ~text.rlike(r"[\x00-\x1F]")
        none = F.when(raw.isNull(), F.array(F.lit("input_was_none"))).otherwise(no_tags)
        return F.when(plain, F.struct(raw.alias("raw"), text.alias("text"), none.alias("warnings"), F.lit(False).alias("changed"))).when(steps, step_by_step(text)).otherwise(told(text, collapsed(text), none))

    return let(F.coalesce(raw, F.lit("")), cleaned)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


#: Blanks before an offset, and the beginnings of the two forms of a time.
OFFSET_GAP = r"\s+(?=(?:[+-]\d\d:?\d\d|Z)$)"
ISO_TIME, US_TIME = r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d", r"(?i)^\d{1,2}/\d{1,2}/\d{4} .*[AP]M$"


def parse_time(text: Column) -> Column:
    """Naive UTC timestamp of ISO text with or without offset and fraction, or of US text with AM or PM; null if neither.

    A fraction is cut to microseconds, and a time without offset counts as UTC.
    """
    # One blank before an offset is the usual case, which needs no pattern.
    tight = lambda t: F.when(F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), F.regexp_replace(t, OFFSET_GAP, "")).otherwise(F.replace(F.replace(F.replace(t, F.lit(" +"), F.lit("+")), F.lit(" -"), F.lit("-")), F.lit(" Z"), F.lit("Z")))
    found = lambda t: F.when(t.rlike(ISO_TIME), F.try_to_timestamp(tight(t))).when(t.rlike(US_TIME), F.try_to_timestamp(F.upper(t), F.lit("M/d/yyyy h:mm:ss a")))
    return let(F.trim(text), found).cast("timestamp_ntz")


def number(text: Column) -> Column:
    """Double of plain numeric text; null for all else, forms like 1.5d or 1_000 included."""
    return F.when(F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|(?i)^[+-]?(inf|infinity|nan)$"), F.trim(text).try_cast("double"))


def to_bytes(value: Column, unit: Column) -> Column:
    """Bytes of a value in a 1024-based unit, rounded half to even; null for an unknown unit."""
    power = F.element_at(F.create_map(*(x for k, n in UNITS.items() for x in (F.lit(k), F.lit(float(1024**n))))), F.upper(F.trim(unit)))
    return F.bround(value * power).cast("long")


def parse_ms(text: Column) -> Column:
    """0.96 of `0.96 ms`; null for other text."""
    return F.regexp_extract(text, r"(?i)^\s*([+-]?\d+(?:\.\d+)?)\s*ms\s*$", 1).try_cast("double")


def safe_int(text: Column) -> Column:
    return F.trim(text).try_cast("bigint")


def split_value_unit(text: Column) -> Column:
    """struct(value, unit) of `2 KB`, `1.5MB/s` or `0`: a number and the letters behind it, upper-cased; both null for other text."""
    pattern = r"(?i)^([+-]?\d+(?:\.\d+)?)\s*([A-Z]*)(?:/s)?$"
    return let(F.trim(text), lambda t: F.when(t.rlike(pattern), F.struct(F.regexp_extract(t, pattern, 1).try_cast("double").alias("value"), F.upper(F.regexp_extract(t, pattern, 2)).alias("unit"))))


def leading_number(text: Column) -> Column:
    """A number with a unit behind it or none; empty text and zero are 0."""
    return let(F.trim(text), lambda t: F.when(t == "", F.lit(0.0)).otherwise(F.nullif(F.regexp_extract(t, r"^([+-]?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")))


def sized(text: Column) -> Column:
    """Bytes of `2 KB` or `1.5 MB/s`; 0 for anything that begins with a bare 0."""

    def bytes_of(plain: Column) -> Column:
        unit = F.upper(F.regexp_extract(plain, r"(?i)([A-Z]+)$", 1))
        return let(leading_number(plain), lambda n: F.coalesce(to_bytes(n, unit), F.when(n == 0, F.lit(0)).cast("long")))

    return let(F.regexp_replace(F.trim(text), "(?i)/s$", ""), bytes_of)


def megabytes_per_second(text: Column) -> Column:
    """Bytes a second of a number of binary megabytes a second, cut to an integer."""
    return (leading_number(text) * 1048576).cast("long")


def terabytes(value: Column, unit: Column) -> Column:
    """Decimal terabytes of a pool's size."""
    return value * F.element_at(F.create_map(*(x for k, n in (("B", -12), ("KB", -9), ("MB", -6), ("GB", -3), ("TB", 0), ("PB", 3)) for x in (F.lit(k), F.lit(10.0**n)))), F.upper(unit))


def context_map(ctx: Column) -> Column:
    """map of a comma list `k=v`, with the defaults T, ET, CG, V and S null; blank values are null, and the last of a key counts."""
    nothing = F.lit(None).cast("string")
    after = lambda p: F.nullif(F.trim(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p)))), F.lit(""))
    cut = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), after(p).alias("value"))

    def of_pairs(pairs: Column) -> Column:
        def of_keys(keys: Column) -> Column:
            every = F.concat(F.array_except(F.array(*map(F.lit, ("T", "ET", "CG", "V", "S"))), keys), keys)
            value = lambda k, back: F.coalesce(F.get(F.filter(back, lambda p: p["key"] == k), F.lit(0))["value"], nothing)
            # Reversed, the last pair of a key is the first that is found.
            repeated = let(F.reverse(pairs), lambda back: let(every, lambda names: F.map_from_arrays(names, F.transform(names, lambda k: value(k, back)))))
            plain = F.map_from_arrays(every, F.concat(F.array_repeat(nothing, F.size(every) - F.size(keys)), F.transform(pairs, lambda p: p["value"])))
            return F.when(F.size(keys) == F.size(pairs), plain).otherwise(repeated)

        return let(F.array_distinct(F.transform(pairs, lambda p: p["key"])), of_keys)

    return let(F.filter(F.transform(F.split(F.coalesce(ctx, F.lit("")), ","), cut), lambda p: p["key"] != ""), of_pairs)


def value_kind(values: str) -> Column:
    """Aggregate: numeric, boolean, datetime or categorical, whichever fits all non-null values; unknown without any."""
    v = F.col(values)
    all_of = lambda test: F.bool_and(F.when(v.isNotNull(), F.coalesce(test, F.lit(False))))
    return (
        F.when(F.count(v) == 0, "unknown")
        .when(all_of(number(v).isNotNull()), "numeric")
        .when(all_of(F.lower(F.trim(v)).isin("true", "false", "yes", "no")), "boolean")
        .when(all_of(parse_time(v).isNotNull()), "datetime")
        .otherwise("categorical")
    )


def severity(error_rate: Column) -> Column:
    return F.when(error_rate > 10, "red").when(error_rate > 1, "yellow").otherwise("green")

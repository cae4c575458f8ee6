"""Bucket alignment and identifiers (naive UTC timestamps)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"


def aligned(ts: Column, minutes: int = 5) -> Column:
    """Start of the bucket of ts: aligned within the hour for divisors of 60, from the epoch for whole hours."""
    if 60 % minutes == 0:
        whole = F.date_trunc("HOUR", ts).cast(NTZ)
        return whole + F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts) - F.minute(ts) % minutes)
    if minutes % 60:
        raise ValueError("bucket minutes must divide 60 or be whole hours")
    seconds = F.unix_timestamp(ts.cast("timestamp"))
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(minutes * 60))).cast(NTZ)


def bucket_end(start: Column, minutes: int = 5) -> Column:
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def bucket_id(start: Column) -> Column:
    return F.date_format(start, "'b_'yyyyMMdd_HHmm")


def window_count(first: Column, last: Column, minutes: int = 5) -> Column:
    """Number of buckets from that of first to that of last, both included."""
    seconds = F.unix_timestamp(aligned(last, minutes).cast("timestamp")) - F.unix_timestamp(aligned(first, minutes).cast("timestamp"))
    return (seconds / (minutes * 60) + 1).cast("long")


def seconds_of(ts: Column) -> Column:
    """Seconds since the epoch of a naive timestamp, with fractions, as a double."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def minutes_before(ts: Column, minutes: float) -> Column:
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(minutes * 60).cast("decimal(18,6)"))

"""Times: lenient parsing, windows on strings, and bucket sizes.

Records keep their time as text; rules use a timestamp.  Text without an offset counts as UTC
(or as ``assume_tz``): comparing it with text that has one is then defined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def parsed(ts: Column, assume_tz: str = "UTC") -> Column:
    """ISO text, or US dates with a 12-hour or 24-hour clock, as a timestamp; null if it is neither."""
    text = F.trim(ts.cast("string"))
    iso = F.when(text.rlike("^\\d{4}-\\d{2}-\\d{2}"), text)
    offset = text.rlike("(?:Z|[+-]\\d{2}:?\\d{2})$")
    plain = iso.try_cast("timestamp_ntz")
    local = F.convert_timezone(F.lit(assume_tz), F.lit("UTC"), plain) if assume_tz != "UTC" else plain
    us = F.coalesce(F.try_to_timestamp(text, F.lit("M/d/yyyy h:mm:ss a")), F.try_to_timestamp(text, F.lit("M/d/yyyy H:mm:ss a")))
    with_offset = F.regexp_replace(iso, "([+-]\\d{2})(\\d{2})$", "$1:$2").try_cast("timestamp")
    return F.coalesce(F.when(offset, with_offset).otherwise(local.cast("timestamp")), us)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def in_window(ts: Column, since: str | None = None, until: str | None = None) -> Column:
    """Text from ``since`` to ``until``, compared as text; what has no time is kept."""
    keep = F.lit(True)
    if since is not None:
        keep = keep & (ts >= since)
    if until is not None:
        keep = keep & (ts <= until)
    return F.coalesce(ts, F.lit("")).eqNullSafe("") | keep


def in_time_window(ts: Column, since=None, until=None) -> Column:
    """The same on timestamps."""
    keep = F.lit(True)
    if since is not None:
        keep = keep & (ts >= F.lit(since))
    if until is not None:
        keep = keep & (ts <= F.lit(until))
    return ts.isNull() | keep


def bucket_seconds(spec: str) -> int:
    """Seconds of ``30s``, ``5m``, ``1h`` or ``1d``."""
    m = re.fullmatch(r"(\d+)([smhd])", spec.strip().lower())
    if not m:
        raise ValueError(f"not a bucket size: {spec}")
    return int(m[1]) * SECONDS[m[2]]


_CLOCK = "((?:[01]\\d|2[0-3]):[0-5]\\d:[0-5]\\d)"


def _day(text: Column, form: str) -> Column:
    """A date as ``yyyy-MM-dd``; null if there is no such day."""
    return F.date_format(F.try_to_timestamp(text, F.lit(form)), "yyyy-MM-dd")


def access_time(text: Column) -> Column:
    """``10/Oct/2025:13:55:36 +0800`` as ISO text that keeps its offset; null for anything else."""
    rx = "^\\[?(\\d{1,2}/\\w{3}/\\d{4}):" + _CLOCK + "\\s*(?:([+-]\\d{2})(\\d{2}))?\\]?$"
    part = lambda k: F.regexp_extract(F.trim(text), rx, k)
    zone = F.when(part(3) != "", F.concat(part(3), F.lit(":"), part(4))).otherwise("")
    return F.concat(_day(part(1), "d/MMM/yyyy"), F.lit("T"), part(2), zone)


def syslog_time(text: Column, year: int) -> Column:
    """``Oct  1 13:55:36`` as ISO text; the year isn't in the log, so it must be given."""
    rx = "^(\\w{3})\\s+(\\d{1,2})\\s+" + _CLOCK + "$"
    part = lambda k: F.regexp_extract(F.trim(text), rx, k)
    return F.concat(_day(F.concat(part(1), F.lit(" "), part(2), F.lit(f" {year:04d}")), "MMM d yyyy"), F.lit("T"), part(3))


def epoch_time(text: Column) -> Column:
    """Seconds since 1970, as text, to ISO text in UTC; null if it isn't a number."""
    stamp = F.timestamp_seconds(F.round(text.try_cast("double"), 6))
    return F.regexp_replace(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"), "\\.000000", "")

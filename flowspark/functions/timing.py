"""Time columns without a session zone: bucket keys, floors and elapsed microseconds of timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp's own wall clock."""
    t = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    days = F.datediff(t, F.lit("1970-01-01"))
    return ((days.cast("long") * 24 + F.hour(t)) * 60 + F.minute(t)) * 60_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def minute_floor(ts: Column | str, minutes: int) -> Column:
    """'yyyy-MM-dd HH:mm' of the bucket; floors the minute of the hour, so that buckets restart each hour."""
    t = F.col(ts) if isinstance(ts, str) else ts
    floored = (F.floor(F.minute(t) / minutes) * minutes).cast("string")
    return F.concat(F.date_format(t, "yyyy-MM-dd HH"), F.lit(":"), F.lpad(floored, 2, "0"))


def in_zone(ts: Column | str, zone: str, source: str = "UTC") -> Column:
    """Wall clock in the business zone of a naive timestamp of zone ``source``."""
    return F.convert_timezone(F.lit(source), F.lit(zone), (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz"))


def date_hour(ts: Column | str) -> tuple[Column, Column]:
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(t, "yyyy-MM-dd"), F.hour(t)


def expires(hour_text: Column, days: int = 30) -> Column:
    """End of an hourly bucket's life: an hour and ``days`` after 'yyyy-MM-dd HH'."""
    start = F.to_timestamp_ntz(F.concat(hour_text, F.lit(":00:00")), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.date_format(start + F.expr(f"INTERVAL {days} DAYS 1 HOUR"), "yyyy-MM-dd HH:mm:ss")


def range_bound(text: str, end: bool) -> tuple[str, int]:
    """(date, hour) of 'YYYY-MM-DD[:HH]'; the hour defaults to 0, or 23 at the end. ValueError if malformed."""
    import datetime

    day, _, hour = text.partition(":")
    datetime.date.fromisoformat(day)
    h = int(hour) if hour else (23 if end else 0)
    if not 0 <= h <= 23:
        raise ValueError(f"hour out of range: {text}")
    return day, h


def backoff(attempts: Column | str, most: int = 60) -> Column:
    n = F.col(attempts) if isinstance(attempts, str) else attempts
    return F.least(F.lit(most), F.pow(F.lit(2), F.least(n, F.lit(6))).cast("int"))

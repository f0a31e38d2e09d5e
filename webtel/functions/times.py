"""Dates, buckets and cooldowns as columns; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of an activity bucket.
BUCKET_MS = 524_288


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def hour(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHH")


def millis(ts: Column) -> Column:
    """The nearest millisecond; half of one goes away from 1970, as in the queries' SQL."""
    t = ts.cast("timestamp")
    rest = F.pmod(F.unix_micros(t), F.lit(1000))
    return F.unix_millis(t) + ((rest > 500) | (rest == 500) & (t >= F.timestamp_seconds(F.lit(0)))).cast("long")


def next_midnight(ts: Column) -> Column:
    """The next UTC midnight; midnight itself moves on by a day."""
    return F.date_trunc("day", ts) + F.expr("INTERVAL 1 DAY")


def daily_cooldown(ts: Column, least_hours: int = 8, noise_hours: Column | None = None) -> Column:
    """When a daily message may be sent again: the later of some hours on and the next day, plus noise if given."""
    end = F.greatest(ts + F.expr(f"INTERVAL {least_hours} HOURS"), next_midnight(ts))
    return end if noise_hours is None else end + F.make_dt_interval(hours=F.lit(0), secs=(noise_hours * 3600).cast("decimal(18,6)"))


def bucket(ts: Column, size_ms: int = BUCKET_MS) -> Column:
    return F.floor(millis(ts) / size_ms)


def missed_periods(end_ms: Column, now_ms: Column, period_ms: int) -> Column:
    """Whole periods that passed since one ended."""
    return F.greatest(F.floor((now_ms - end_ms) / period_ms), F.lit(0))


def is_epoch_millis(c: Column, now_ms: Column) -> Column:
    """13 digits that are a time from February 2010 to five years ahead."""
    n = F.try_to_number(c, F.lit("9999999999999")).cast("long")
    return F.coalesce(c.rlike("^[0-9]{13}$") & n.between(1_265_000_000_000, now_ms + 5 * 365 * 86_400_000), F.lit(False))


def not_from_future(ts: Column, now: Column, tolerance: str = "2 minutes") -> Column:
    return ts <= now + F.expr(f"INTERVAL {tolerance}")

"""Calendar-week freshness in Swedish civil time.

All instants are TIMESTAMP_NTZ in UTC, so nothing depends on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZONE = "Europe/Stockholm"
FUTURE_TOLERANCE_SECONDS = 60


def utc(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def week_end(ts: Column) -> Column:
    """Exclusive end of the local calendar week holding ``ts``: next Monday 00:00, as UTC."""
    day = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), utc(ts)).cast("date")
    monday = F.date_add(day, F.lit(7) - F.weekday(day)).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(ZONE), F.lit("UTC"), monday)


def tolerated(now: Column) -> Column:
    return utc(now) + F.expr(f"INTERVAL {FUTURE_TOLERANCE_SECONDS} SECONDS")


def scan_is_current(ts: Column, now: Column) -> Column:
    """Same local week as ``now`` and at most a minute ahead of it; NULL counts as not current."""
    return F.coalesce((utc(ts) <= tolerated(now)) & (week_end(ts) == week_end(now)), F.lit(False))


def expiry(observed: Column, offer_ends: Column) -> Column:
    """Week end, or the earliest offer end after the observation when that is sooner."""
    later = F.filter(F.coalesce(offer_ends, F.array().cast("array<timestamp_ntz>")), lambda e: e > utc(observed))
    return F.least(week_end(observed), F.array_min(later))


def reference_expiry(checked: Column, valid_until: Column) -> Column:
    return F.least(week_end(checked), utc(valid_until))

"""Times from outside, windows of activity, labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(text: Column) -> Column:
    """Seconds since 1970 from a number, milliseconds, or an ISO date or time; null if it is none of these. UTC if no zone is named."""
    number = text.try_cast("double")
    seconds = F.when(F.abs(number) > 1e11, number / 1000).otherwise(number)
    iso = F.unix_micros(F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", "+00:00"))) / 1e6
    return F.coalesce(seconds, iso)


def in_bounds(ts: Column, after: float | None = None, before: float | None = None) -> Column:
    """Inclusive; an unknown time fails as soon as there is a bound."""
    ok = F.lit(True)
    if after is not None:
        ok = ok & F.coalesce(ts >= after, F.lit(False))
    if before is not None:
        ok = ok & F.coalesce(ts <= before, F.lit(False))
    return ok


def _seconds(text: str | float | None) -> float | None:
    """``epoch`` of one value on the driver."""
    if text is None or isinstance(text, (int, float)):
        return text
    try:
        number = float(text)
        return number / 1000 if abs(number) > 1e11 else number
    except ValueError:
        pass
    try:
        at = dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
        return (at if at.tzinfo else at.replace(tzinfo=dt.UTC)).timestamp()
    except ValueError:
        return None


def bounds(
    now: float, min_age_days: float | None = None, max_age_days: float | None = None, after: str | float | None = None, before: str | float | None = None,
    within_days: float | None = None, date_from: str | float | None = None, date_to: str | float | None = None,
) -> tuple[float | None, float | None]:
    """The intersection of relative and absolute limits. ``within_days`` stands in for a missing ``max_age_days``, negative ages
    and unreadable times are no limit, and a bare date in ``date_to`` means the whole day."""
    oldest = max_age_days if max_age_days is not None else within_days
    last = _seconds(date_to)
    if last is not None and isinstance(date_to, str) and len(date_to.strip()) == 10:
        last += 86400 - 0.001
    lows = [x for x in (_seconds(after), _seconds(date_from), None if oldest is None or oldest < 0 else now - oldest * 86400) if x is not None]
    highs = [x for x in (_seconds(before), last, None if min_age_days is None or min_age_days < 0 else now - min_age_days * 86400) if x is not None]
    return max(lows) if lows else None, min(highs) if highs else None


def age_label(ts: Column, now: float) -> Column:
    days = F.floor((F.lit(now) - ts) / 86400)
    return F.when(ts.isNull(), "unknown").when(days < 1, "today").when(days < 2, "1 day ago").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def activity(ts: Column, now: float, within_days: float = 14.0) -> Column:
    limit = now - (within_days if within_days >= 0 else 14.0) * 86400
    return F.when(ts.isNull() | (ts <= 0), "unknown").when(ts >= limit, "recent").otherwise("stale")

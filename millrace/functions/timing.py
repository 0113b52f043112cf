"""Time helpers as Column expressions. Durations are milliseconds; months count 30 days, quarters 91, years 365."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1000, 60_000, 3_600_000, 86_400_000
WEEK, MONTH, QUARTER, YEAR = 7 * DAY, 30 * DAY, 91 * DAY, 365 * DAY


def round_down(ts: Column, unit: str) -> Column:
    """Start of the hour, day, week (Monday), or month."""
    if unit not in ("hour", "day", "week", "month"):
        raise ValueError(f"unknown unit {unit!r}")
    return F.date_trunc(unit, ts)


#: calendar fields: the date pattern of each
FIELDS = {"year": "yyyy", "month": "M", "day": "d", "hour": "H", "minute": "m", "second": "s"}


def field(ts: Column, name: str) -> Column:
    """A calendar field as a number; months count from 1."""
    if name not in FIELDS:
        raise ValueError(f"unknown field {name!r}; one of {tuple(FIELDS)}")
    return F.date_format(ts, FIELDS[name]).cast("int")


def zone_offset_ms(ts: Column, zone: str) -> Column:
    """By how many milliseconds the clocks of ``zone`` are ahead of UTC at the instant ``ts``."""
    return F.unix_millis(F.from_utc_timestamp(ts.cast("timestamp"), zone)) - F.unix_millis(ts.cast("timestamp"))


def older_than(ts: Column, days: int, now: Column) -> Column:
    """Whether ``ts`` lies more than ``days`` times 24 hours before ``now``."""
    return F.unix_micros(ts.cast("timestamp")) < F.unix_micros(now.cast("timestamp")) - days * DAY * 1000


def human_duration(ms: Column) -> Column:
    """``[days day[s] ]`` then ``[hh:]mm:ss.s## h|min``, ``x.y s`` or ``n ms``; a minus sign in front of negative ones."""
    ms = ms.cast("bigint")
    size = F.abs(ms)
    days, rest = F.floor(size / DAY), size % DAY
    hours, in_hour = F.floor(rest / HOUR), rest % HOUR
    minutes, in_minute = F.floor(in_hour / MINUTE), in_hour % MINUTE
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    thousandths = lambda n: F.regexp_replace(F.lpad((n % SECOND).cast("string"), 3, "0"), "(?<=.)0+$", "")
    seconds = F.concat(two(F.floor(in_minute / SECOND)), F.lit("."), thousandths(in_minute))
    clock = F.concat(F.when(hours > 0, F.concat(two(hours), F.lit(":"))).otherwise(F.lit("")), two(minutes), F.lit(":"), seconds, F.when(hours > 0, F.lit(" h")).otherwise(F.lit(" min")))
    short = F.when(rest >= SECOND, F.concat(F.floor(rest / SECOND).cast("string"), F.lit("."), thousandths(rest), F.lit(" s"))).otherwise(F.concat(rest.cast("string"), F.lit(" ms")))
    return F.concat(
        F.when(ms < 0, F.lit("-")).otherwise(F.lit("")),
        F.when(days > 0, F.concat(days.cast("string"), F.when(days == 1, F.lit(" day ")).otherwise(F.lit(" days ")))).otherwise(F.lit("")),
        F.when(rest >= MINUTE, clock).otherwise(short),
    )

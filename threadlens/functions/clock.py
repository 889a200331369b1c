"""Time functions: snowflakes, parsing, calendar keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import WS, js_trim

SNOWFLAKE_EPOCH_MS = 1420070400000  # fixed value: 2015-01-01T00:00:00Z
SNOWFLAKE_STEP = 4194304  # fixed value: 22 low bits carry no time
ABSOLUTE_TIME_MS = 60 * 60 * 1000
SESSION_BREAK_MS = 4 * 60 * 60 * 1000


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def snowflake_to_ts(s: Column) -> Column:
    """Creation instant held in the high bits of a 15–20 digit id, else null."""
    steps = F.call_function("div", s.try_cast("decimal(20,0)"), F.lit(SNOWFLAKE_STEP))
    return F.when(
        s.rlike(r"^\d{15,20}$"), F.timestamp_millis(steps + F.lit(SNOWFLAKE_EPOCH_MS))
    )


def ts_to_snowflake(ts: Column) -> Column:
    steps = (millis(ts) - F.lit(SNOWFLAKE_EPOCH_MS)).cast("decimal(20,0)")
    return (steps * F.lit(SNOWFLAKE_STEP).cast("decimal(10,0)")).cast("decimal(38,0)").cast("string")


def parse_timestamp(s: Column, tz: str | None = None) -> Column:
    """ISO text first, then the US wall-clock shape read in zone ``tz``."""
    flat = F.regexp_replace(js_trim(s), rf"[{WS}]+", " ")
    iso = F.try_to_timestamp(F.when(flat.rlike(r"^\d{4}-\d{2}-\d{2}"), flat))
    us_shape = flat.rlike(r"(?i)^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} ?[AP]M$")
    us_text = F.upper(F.regexp_replace(flat, r"(?i) ?([AP]M)$", " $1"))
    us = F.try_to_timestamp(F.when(us_shape, us_text), F.lit("M/d/yyyy h:mm a"))
    if tz and tz != "UTC":
        us = F.to_utc_timestamp(us, tz)
    return F.coalesce(iso, us)


def parse_title_time(s: Column, tz: str | None = None) -> Column:
    """Rendered long title such as ``Saturday, July 12, 2025 3:50 AM``."""
    flat = F.regexp_replace(js_trim(s), rf"[{WS}]+", " ")
    no_weekday = F.regexp_replace(flat, r"^[^,\d]+, (?=\p{L})", "")
    long_form = F.try_to_timestamp(no_weekday, F.lit("MMMM d, yyyy h:mm a"))
    if tz and tz != "UTC":
        long_form = F.to_utc_timestamp(long_form, tz)
    return F.coalesce(parse_timestamp(s, tz), long_form)


def day_edge(ymd: Column, end_of_day: bool = False, tz: str = "UTC") -> Column:
    """First or last millisecond of a calendar day in zone ``tz``."""
    start = F.to_timestamp(ymd, "yyyy-MM-dd")
    if end_of_day:
        start = start + F.expr("INTERVAL '23:59:59.999' HOUR TO SECOND")
    return F.to_utc_timestamp(start, tz) if tz != "UTC" else start


def in_zone(ts: Column, tz: str = "UTC") -> Column:
    return ts if tz == "UTC" else F.from_utc_timestamp(ts, tz)


def weekday(ts: Column, tz: str = "UTC") -> Column:
    """0 = Sunday … 6 = Saturday."""
    return F.dayofweek(in_zone(ts, tz)) - 1


def hour_of(ts: Column, tz: str = "UTC") -> Column:
    return F.hour(in_zone(ts, tz))


def day_of(ts: Column, tz: str = "UTC") -> Column:
    return F.to_date(in_zone(ts, tz))


def day_key(ts: Column, tz: str = "UTC") -> Column:
    """Calendar day as ``YYYY-MM-DD``."""
    return F.date_format(in_zone(ts, tz), "yyyy-MM-dd")


def time_delta(ms: Column) -> Column:
    """``[+Ns]``, ``[+Nm]`` or ``[+Nh]``, floored."""
    s = F.floor(ms / 1000)
    amount = (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h")))
    )
    return F.concat(F.lit("[+"), amount, F.lit("]"))


def long_duration(ms: Column) -> Column:
    """``3h 5m``, or ``5m`` under an hour."""
    s = F.floor(ms / 1000)
    h = F.floor(s / 3600)
    m = F.concat(F.floor((s % 3600) / 60).cast("string"), F.lit("m"))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), m)).otherwise(m)


def clock_time(ts: Column) -> Column:
    """``3:50 AM`` in UTC."""
    return F.date_format(ts, "h:mm a")


def day_divider(ts: Column) -> Column:
    """``Saturday, Jul 12, 2025`` in UTC."""
    return F.date_format(ts, "EEEE, MMM dd, yyyy")


def http_date(ts: Column) -> Column:
    """``Sat, 12 Jul 2025 03:50:00 GMT``."""
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def persona(hour: Column) -> Column:
    """Name of the band the peak hour falls in."""
    return (
        F.when(hour < 5, "Night owls")
        .when(hour < 9, "Early birds")
        .when(hour < 12, "Morning crew")
        .when(hour < 17, "Afternoon talkers")
        .when(hour < 21, "Evening crew")
        .otherwise("Night owls")
    )

"""Column expressions shared by the operators. Everything stays in built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def minute_index(ts: Column) -> Column:
    """Minutes since 1970 as a bigint, rounded down. Works on timestamps without a zone, whatever the session's zone."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 1440 + F.hour(ts) * 60 + F.minute(ts)


def plus_minutes(ts: Column, minutes: Column | int) -> Column:
    minutes = F.lit(minutes) if isinstance(minutes, int) else minutes
    return (ts + F.make_dt_interval(mins=minutes.cast("int"))).cast("timestamp_ntz")


def minutes_between(later: Column, earlier: Column) -> Column:
    """Difference in minutes as a double, to the second."""
    seconds = lambda t: F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return (seconds(later) - seconds(earlier)) / F.lit(60.0)


def safe_divide(a: Column, b: Column) -> Column:
    """0 where the denominator is 0 or null or the numerator null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def cyclical(value: Column, period: int, prefix: str) -> list[Column]:
    angle = value.cast("double") * (2 * math.pi / period)
    return [F.sin(angle).alias(f"{prefix}_sin"), F.cos(angle).alias(f"{prefix}_cos")]


def unit_hash(value: Column, salt: int | Column) -> Column:
    """A number in [0, 1) that depends on the text and the salt alone, the same on every engine: 32 bits of an MD5."""
    salt = F.lit(str(salt)) if isinstance(salt, int) else salt.cast("string")
    digest = F.md5(F.concat(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), salt).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def right_closed(value: Column, edges: tuple[float, ...]) -> Column:
    """Labels "<= edge" of right-closed intervals and "> last"; null and values up to 0 are "unknown"."""
    out = F.when(value.isNull() | (value <= 0), F.lit("unknown"))
    for e in edges:
        out = out.when(value <= e, F.lit(f"<= {e:g}"))
    return out.otherwise(F.lit(f"> {edges[-1]:g}"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


EARTH_KM = 6371.0088  # the mean radius


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))

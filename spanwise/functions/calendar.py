"""Calendar expressions: Easter, public and school holidays, seasons, parts of a date. No table and no UDF is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed public holidays (month, day) and the movable ones in days from Easter Sunday.
FIXED_HOLIDAYS = ((1, 1), (5, 1), (5, 17), (12, 24), (12, 25), (12, 26))
DAYS_FROM_EASTER = (-3, -2, 1, 39, 49, 50)
WINTER_BREAK_WEEKS, AUTUMN_BREAK_WEEKS = (8, 9), (40, 41)
SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)}


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, in whole-number arithmetic: the Paschal full moon from the golden number
    and the century's corrections, then the following Sunday."""
    year = year.cast("int")
    q = lambda a, b: F.floor(a / b).cast("int")  # noqa: E731  exact: the numbers are small
    century, golden = q(year, F.lit(100)) + 1, year % 19 + 1
    solar = q(3 * century, F.lit(4)) - 12
    lunar = q(8 * century + 5, F.lit(25)) - 5
    sunday = q(5 * year, F.lit(4)) - solar - 10
    epact = F.pmod(11 * golden + 20 + lunar - solar, F.lit(30))
    epact = F.when(((epact == 25) & (golden > 11)) | (epact == 24), epact + 1).otherwise(epact)
    moon = 44 - epact
    moon = F.when(moon < 21, moon + 30).otherwise(moon)  # March the 21st or later
    day = moon + 7 - F.pmod(sunday + moon, F.lit(7))
    return F.date_add(F.make_date(year, F.lit(3), F.lit(1)), day - 1)


def is_public_holiday(date: Column) -> Column:
    fixed = F.lit(False)
    for month, day in FIXED_HOLIDAYS:
        fixed = fixed | ((F.month(date) == month) & (F.dayofmonth(date) == day))
    return fixed | F.datediff(date, easter(F.year(date))).isin(*DAYS_FROM_EASTER)


def is_school_holiday(date: Column, winter: tuple = WINTER_BREAK_WEEKS, autumn: tuple = AUTUMN_BREAK_WEEKS) -> Column:
    week, month, day = F.weekofyear(date), F.month(date), F.dayofmonth(date)
    breaks = (week.isin(*winter) & (month <= 3)) | (week.isin(*autumn) & (month >= 9))
    return breaks | month.between(6, 8) | ((month == 12) & (day >= 20)) | ((month == 1) & (day <= 5))


def season(month: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, months in SEASONS.items():
        out = out.when(month.isin(*months), F.lit(name))
    return out


def calendar_features(date: Column) -> list[Column]:
    """Seven columns: weekend, public and school holiday, ISO week, day of year, first and last day of the month."""
    return [
        (F.weekday(date) >= 5).cast("int").alias("is_weekend"),
        is_public_holiday(date).cast("int").alias("is_public_holiday"),
        is_school_holiday(date).cast("int").alias("is_school_holiday"),
        F.weekofyear(date).alias("weekofyear"),
        F.dayofyear(date).alias("dayofyear"),
        (F.dayofmonth(date) == 1).cast("int").alias("is_month_start"),
        (F.last_day(date) == date).cast("int").alias("is_month_end"),
    ]


def time_parts(ts: Column) -> list[Column]:
    """date, hour, minute, dayofweek (Monday 0), month, year of a timestamp."""
    return [F.to_date(ts).alias("date"), F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.weekday(ts).alias("dayofweek"), F.month(ts).alias("month"), F.year(ts).alias("year")]


def ceil_to_minute(ts: Column) -> Column:
    floor = F.date_trunc("minute", ts).cast("timestamp_ntz")
    return F.when(floor == ts.cast("timestamp_ntz"), floor).otherwise((floor + F.make_dt_interval(mins=F.lit(1))).cast("timestamp_ntz"))

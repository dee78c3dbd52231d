"""Movement events and the hour grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions import calendar
from spanwise.functions.scalars import cyclical, minute_index, plus_minutes

KEYS = ["airport_group", "date", "hour"]
# Minutes before and after its time for which a movement is active.
WINDOWS = {"dep": (-15, 8), "arr": (-16, 5)}
FLIGHT_DEFAULTS = {"cancelled": "int", "std": "timestamp_ntz", "sta": "timestamp_ntz", "atd": "timestamp_ntz", "ata": "timestamp_ntz", "service_type": "string"}


def with_defaults(flights: DataFrame, defaults: dict[str, str] = FLIGHT_DEFAULTS) -> DataFrame:
    """Adds missing columns: 0 for ``cancelled``, null for the others."""
    missing = {c: F.lit(0 if c == "cancelled" else None).cast(t) for c, t in defaults.items() if c not in flights.columns}
    return flights.withColumns(missing) if missing else flights


def usable_group(group: Column) -> Column:
    return group.isNotNull() & (group != "NA")


def build_event_table(flights: DataFrame, use_actual: bool = False) -> DataFrame:
    """Departures and arrivals as rows: flight_id, service_type, airport_group, scheduled_time, actual_time, movement, base_time.

    One pass over the flights: each gives an array of two events, which is exploded and filtered. Cancelled flights,
    those with a null ``cancelled``, and events without a group or a time go.
    """
    flights = with_defaults(flights).where("cancelled = 0")
    both = [
        F.struct(F.col(f"{m}_airport_group").alias("airport_group"), F.col(s).alias("scheduled_time"), F.col(a).alias("actual_time"), F.lit(m).alias("movement"))
        for m, s, a in (("dep", "std", "atd"), ("arr", "sta", "ata"))
    ]
    carried = [c for c in ("flight_id", "service_type", "sim_id") if c in flights.columns]
    events = flights.select(*carried, F.explode(F.array(*both)).alias("e")).select(*carried, "e.*").where(usable_group(F.col("airport_group")))
    base = F.coalesce("actual_time", "scheduled_time") if use_actual else F.col("scheduled_time")
    return events.withColumn("base_time", base).where("base_time is not null")


def with_operational_windows(events: DataFrame) -> DataFrame:
    """Adds window_start, window_end (whole minutes, half-open) and their minute numbers."""
    before, after = (F.when(F.col("movement") == "dep", F.lit(WINDOWS["dep"][i])).otherwise(F.lit(WINDOWS["arr"][i])) for i in (0, 1))
    floor = lambda t: F.date_trunc("minute", t).cast("timestamp_ntz")
    events = events.withColumn("window_start", floor(plus_minutes(F.col("base_time"), before))).withColumn("window_end", floor(plus_minutes(F.col("base_time"), after)))
    return events.withColumn("start_minute", minute_index(F.col("window_start"))).withColumn("end_minute", minute_index(F.col("window_end")))


def build_base_index(keys: DataFrame) -> DataFrame:
    """Distinct (airport_group, date, hour) with the interval, cyclical, calendar and season columns."""
    base = keys.select(*KEYS).distinct()
    start = (F.col("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour").cast("int"))).cast("timestamp_ntz")
    base = base.withColumn("interval_start", start).withColumn("interval_end", plus_minutes(F.col("interval_start"), 60))
    date = F.to_date("interval_start")
    base = base.withColumn("dayofweek", F.weekday(date)).withColumn("month", F.month(date))
    waves = [*cyclical(F.col("hour"), 24, "hour"), *cyclical(F.col("dayofweek"), 7, "dow"), *cyclical(F.col("month"), 12, "month")]
    return base.select("*", *waves, *calendar.calendar_features(date), calendar.season(F.col("month")).alias("season"))


def prepare_schedule(schedule: DataFrame) -> DataFrame:
    """Missing columns added, a null service type becomes "unknown"."""
    return with_defaults(schedule).withColumn("service_type", F.coalesce("service_type", F.lit("unknown")))


def add_airport_time_buckets(df: DataFrame) -> DataFrame:
    hour = F.concat_ws("_h", F.col("airport_group"), F.lpad(F.col("hour").cast("string"), 2, "0"))
    return df.withColumn("airport_hour_bucket", hour).withColumn("airport_dow_bucket", F.concat_ws("_d", F.col("airport_group"), F.weekday("date").cast("string")))


def select_time_window(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Inclusive bounds, either of which may be left out; the filter reaches the scan."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    return df.where(F.col(column) <= F.lit(end)) if end is not None else df

"""Sources with explicit schemas. CSV text ``NA`` reads as null."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.calendar import is_public_holiday
from spanwise.operators import weather as W
from spanwise.sources import versions

FLIGHTS = "flight_id string, dep_airport string, dep_airport_group string, arr_airport string, arr_airport_group string, service_type string, cancelled int, std timestamp_ntz, sta timestamp_ntz, atd timestamp_ntz, ata timestamp_ntz"
SCHEDULE = "flight_id string, dep_airport string, dep_airport_group string, arr_airport string, arr_airport_group string, service_type string, std timestamp_ntz, sta timestamp_ntz"
TRAINING = "airport_group string, date date, hour int, target int, feat_season string, feat_sched_concurrence int, feat_sched_flights_cnt int"
INFERENCE = "airport_group string, date date, hour int, feat_season string, feat_sched_concurrence int, feat_sched_flights_cnt int"
TEMPLATE = "airport_group string, date date, hour int, pred double"
GROUPS = "airport_group string, airport string"
HOLIDAYS = "date date, name string, is_public_holiday boolean"
AIRPORTS = "ident string, iata_code string, name string, latitude double, longitude double, elevation double"


def _typed(named: DataFrame, column: str, kind: str, strict: bool) -> Column:
    """The text column as the type; a cell that isn't one raises with its column's name, or is null unless ``strict``."""
    cell = F.col(f"`{column}`")
    value = cell.try_cast(kind)
    if strict and kind != "string":
        told = F.concat(F.lit(f"{column} ({kind}) has a cell that can't be read: "), cell)
        value = F.when(cell.isNotNull() & value.isNull(), F.raise_error(told).cast(kind)).otherwise(value)
    return value.alias(column)


def read_csv(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Columns are matched by the file's header: those that it lacks are null, others are left out. A cell that can't be
    read as its column's type fails the job when it is reached; with ``strict`` off it is null."""
    named = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    wanted = [(c.split()[0], c.split()[1]) for c in schema.split(", ")]
    return named.select(*[_typed(named, c, t, strict) if c in named.columns else F.lit(None).cast(t).alias(c) for c, t in wanted])


def load_training(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    training = read_csv(spark, path, TRAINING)
    return training.where(F.col("date") >= F.lit(since).cast("date")) if since else training


def load_flights(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, FLIGHTS)


def load_schedule(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SCHEDULE)


def load_inference(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, INFERENCE)


def load_template(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, TEMPLATE)


def load_groups(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, GROUPS)


def load_airports(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, AIRPORTS)


def load_weather(spark: SparkSession, path: str) -> DataFrame:
    return W.with_forecast_time(spark.read.parquet(path))


def load_forecast_responses(spark: SparkSession, path: str) -> DataFrame:
    """One JSON text a file line, with airport and airport_group beside the response, as a fetcher stores them."""
    return W.parse_timeseries(spark.read.schema("airport string, airport_group string, response string").json(path))


def load_public_holidays(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, HOLIDAYS)


def load_school_holidays(spark: SparkSession, path: str) -> DataFrame:
    """date, and airport_group, name, is_school_holiday as far as the file has them; the first (by name) of repeated keys."""
    named = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    columns = {"airport_group": "string", "date": "date", "name": "string", "is_school_holiday": "int"}
    rows = named.select(*[_typed(named, c, t, True) for c, t in columns.items() if c in named.columns])
    on = [c for c in ("airport_group", "date") if c in rows.columns]
    rest = [c for c in rows.columns if c not in on]
    return rows.groupBy(*on).agg(F.min(F.struct(*rest)).alias("r")).select(*on, "r.*") if rest else rows.distinct()


def generated_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Every public holiday from the first day of one year to the last of another."""
    days = spark.range(1).select(F.explode(F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.make_date(F.lit(last_year), F.lit(12), F.lit(31)))).alias("date"))
    return days.where(is_public_holiday(F.col("date")))


def date_chunks(first: date, last: date, days: int = 120) -> list[tuple[date, date]]:
    """Consecutive ranges of at most so many days, both ends included, as observations are asked for."""
    starts = range(0, (last - first).days + 1, days)
    return [(first + timedelta(days=i), min(last, first + timedelta(days=i + days - 1))) for i in starts]


def load_observations(spark: SparkSession, path: str, elements: list[str]) -> DataFrame:
    """Files of observation records (airport, airport_group, referenceTime, elementId, value), one JSON record a line, as one
    row for each airport and time with a column for each element; of repeated records the last by value counts."""
    schema = "airport string, airport_group string, referenceTime string, elementId string, value double"
    records = spark.read.schema(schema).json(path).withColumn("forecast_time", F.try_to_timestamp("referenceTime").cast("timestamp_ntz"))
    return W.observation_pivot(records.where("forecast_time is not null"), ["airport", "airport_group", "forecast_time"], elements, F.col("value"))


def load_cached(spark: SparkSession, path: str, config: dict) -> DataFrame | None:
    """The published result if it was made under the same configuration, else None."""
    return versions.current(spark, path, config)

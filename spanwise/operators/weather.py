"""Weather: hourly rollups, flags, dominant symbols, JSON and observation reshaping, coordinates."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.functions.lineage import cut_lineage
from spanwise.functions.scalars import EARTH_KM, haversine_km
from spanwise.operators.events import KEYS

# Statistics of each weather column.
STATISTICS = {
    "air_temperature": ("mean", "min", "max"), "wind_speed": ("mean", "max"), "wind_speed_of_gust": ("max",), "relative_humidity": ("mean",),
    "dew_point_temperature": ("mean",), "cloud_area_fraction": ("mean",), "cloud_area_fraction_low": ("mean",),
    "precipitation_amount_1h": ("mean", "max"), "probability_of_precipitation_1h": ("mean",),
}
_AGGREGATES = {"mean": F.avg, "min": F.min, "max": F.max}


def with_forecast_time(weather: DataFrame) -> DataFrame:
    """Derives forecast_time from date and hour, else from valid_time, time or timestamp; then date and hour from it."""
    if "forecast_time" not in weather.columns:
        if {"date", "hour"} <= set(weather.columns):
            source = F.try_to_timestamp(F.col("date").cast("string")).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour").cast("int"))
        else:
            named = next((c for c in ("valid_time", "time", "timestamp") if c in weather.columns), None)
            if named is None:
                raise ValueError("no column to take forecast_time from")
            source = F.try_to_timestamp(F.col(named).cast("string")).cast("timestamp_ntz")
        weather = weather.withColumn("forecast_time", source)
    known = weather.where("forecast_time is not null")
    return known.withColumn("date", F.to_date("forecast_time")).withColumn("hour", F.hour("forecast_time"))


def aggregate_weather(weather: DataFrame) -> DataFrame:
    """Thirteen statistics by group, date and hour, the flags made of them, and each symbol column's most frequent value
    (the least of equally frequent ones). One aggregation; missing columns count as null."""
    weather = weather.withColumns({c: F.lit(None).cast("double") for c in STATISTICS if c not in weather.columns})
    symbols = [c for c in weather.columns if c.startswith("symbol_code")]
    numbers = [_AGGREGATES[s](c).alias(f"{c}_{s}") for c, kinds in STATISTICS.items() for s in kinds]
    modes = [F.mode(c, deterministic=True).alias(f"dominant_{c}") for c in symbols]
    out = add_flags(weather.groupBy(*KEYS).agg(*numbers, *modes))
    if "symbol_code_1h" not in symbols:
        return out
    has = lambda pattern: F.coalesce(F.col("dominant_symbol_code_1h").rlike(pattern), F.lit(False)).cast("int")
    return out.withColumns({"weather_symbol_thunder": has("thunder"), "weather_symbol_snow": has("snow"), "weather_symbol_rain": has("rain|sleet")})


def add_flags(rollup: DataFrame) -> DataFrame:
    at_least = lambda c, v: (F.coalesce(F.col(c), F.lit(0.0)) >= v).cast("int")
    out = rollup.withColumn("weather_high_wind", at_least("wind_speed_of_gust_max", 15)).withColumn("weather_heavy_precip", at_least("precipitation_amount_1h_max", 3)).withColumn("weather_low_ceiling", at_least("cloud_area_fraction_low_mean", 80))
    score = 0.4 * F.col("weather_high_wind") + 0.4 * F.col("weather_heavy_precip") + 0.2 * F.col("weather_low_ceiling")
    return out.withColumn("weather_complex_score", score).withColumn("weather_ifr_proxy", F.greatest(F.col("weather_low_ceiling"), at_least("relative_humidity_mean", 90)))


def airport_hour_mean(observations: DataFrame, values: list[str]) -> DataFrame:
    """Mean of every value by group, airport and whole hour."""
    hour = F.date_trunc("hour", "forecast_time").cast("timestamp_ntz").alias("forecast_time")
    return observations.groupBy("airport_group", "airport", hour).agg(*[F.avg(v).alias(v) for v in values])


def coverage_summary(observations: DataFrame) -> DataFrame:
    return observations.groupBy("airport_group").agg(F.count(F.lit(1)).alias("n_rows"), F.min("forecast_time").alias("first_time"), F.max("forecast_time").alias("last_time"))


def group_centroid(airports: DataFrame, keys: tuple[str, ...] = ("airport_group",)) -> DataFrame:
    return airports.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("latitude", "longitude", "elevation")])


_DETAILS = "air_temperature double, wind_speed double, wind_from_direction double, wind_speed_of_gust double, relative_humidity double, cloud_area_fraction double, cloud_area_fraction_high double, cloud_area_fraction_medium double, cloud_area_fraction_low double, dew_point_temperature double"
_NEXT = "struct<details: struct<precipitation_amount: double, probability_of_precipitation: double>, summary: struct<symbol_code: string>>"
FORECAST = f"properties struct<timeseries: array<struct<time: string, data: struct<instant: struct<details: struct<{', '.join(': '.join(x.split()) for x in _DETAILS.split(', '))}>>, next_1_hours: {_NEXT}, next_6_hours: {_NEXT}, next_12_hours: {_NEXT}>>>>"


def parse_timeseries(responses: DataFrame, column: str = "response") -> DataFrame:
    """Forecast responses (airport, airport_group, JSON text) as one row for each time step; broken JSON gives no rows."""
    steps = responses.select("airport", "airport_group", F.explode(F.from_json(column, FORECAST)["properties"]["timeseries"]).alias("s"))
    details = [x.split()[0] for x in _DETAILS.split(", ")]
    ahead = [F.col(f"s.data.next_{h}_hours.{part}.{c}").alias(f"{c}_{h}h") for h in (1, 6, 12) for part, c in (("details", "precipitation_amount"), ("details", "probability_of_precipitation"), ("summary", "symbol_code"))]
    time = F.try_to_timestamp("s.time").cast("timestamp_ntz").alias("forecast_time")
    return steps.select("airport", "airport_group", time, *[F.col(f"s.data.instant.details.{d}").alias(d) for d in details], *ahead)


OBSERVATION = T.ArrayType(T.StructType([T.StructField("elementId", T.StringType()), T.StructField("value", T.DoubleType())]))


def observation_pivot(records: DataFrame, keys: list[str], elements: list[str], order: Column) -> DataFrame:
    """Elements and values in rows to one column for each named element; the last value of a key wins.

    The elements are named, so no pass over the data is needed to find them.
    """
    last = lambda e: F.max_by(F.when(F.col("elementId") == e, F.col("value")), F.when(F.col("elementId") == e, order)).alias(e)
    return records.groupBy(*keys).agg(*[last(e) for e in elements])


def _on_sphere(lat: Column, lon: Column) -> list[Column]:
    """Coordinates of the unit sphere, whose straight distances are ordered as those along its surface."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


_BITS = 20  # steps of an axis at the finest level, as a power of two: cubes of some 12 m
_FEW = 6  # levels with at most some 20,000 cubes on the sphere, however many stations


def nearest_station(airports: DataFrame, stations: DataFrame, levels: tuple[int, ...] = tuple(range(2, _BITS + 1, 2))) -> DataFrame:
    """airport, its nearest station (the least of equally near ones) and the distance; null without any station.

    Equal positions are searched for once, and stations at one position count as their least. Stations lie in cubes around
    the sphere, halved level by level (2**-19 of the radius, some 12 m, at the last); each cube has a station that speaks
    for it. A position goes down the cubes with it: of those inside the ones that it still holds, it keeps the ones that may
    be nearer than the nearest station met so far. A cube with one station is done with, so the levels end where no
    cube with several is held: their depth follows the stations, and a position holds few cubes at any density. Every
    step is an equi-join on a cube's number. Rows without coordinates have no nearest station, nor are they one.
    """
    here = airports.select("airport", "latitude", "longitude")
    known = lambda *names: reduce(and_, [F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) for n in names])
    axes, at = ("x", "y", "z"), ("latitude", "longitude")
    parts = int(here.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, since positions grow many rows each from few bytes
    points = here.where(known(*at)).select(*at).distinct().repartition(parts, *at)
    points = points.select(*at, *[c.alias(n) for n, c in zip(axes, _on_sphere(F.col("latitude"), F.col("longitude")), strict=True)])

    sites = stations.where(known("station_latitude", "station_longitude")).groupBy("station_latitude", "station_longitude").agg(F.min("station").alias("station"))
    steps = [F.least(F.floor((c + 1) * 2.0 ** (_BITS - 1)), F.lit(2**_BITS - 1)).alias(f"i{n}") for n, c in zip(axes, _on_sphere(F.col("station_latitude"), F.col("station_longitude")), strict=True)]
    placed = cut_lineage(sites.select("*", *steps))

    def cube(level: int) -> Column:
        x, y, z = (F.shiftright(f"i{n}", _BITS - level) for n in axes)
        return (x * 2**level + y) * 2**level + z

    distance = haversine_km(F.col("latitude"), F.col("longitude"), F.col("station_latitude"), F.col("station_longitude"))
    reach = F.pow(2 * F.sin(F.col("bound") / (2 * EARTH_KM)), 2) + 1e-12  # the square of the straight distance
    held, before, found = points.withColumns({"held": F.lit(0).cast("long"), "bound": F.lit(math.pi * EARTH_KM + 1e-6)}), 0, []
    for level in levels:
        size = 2.0 ** (1 - level)
        inner = placed.groupBy(cube(before).alias("held"), cube(level).alias("inner"), *[(F.shiftright(f"i{n}", _BITS - level) * size - 1).alias(f"b{n}") for n in axes])
        inner = inner.agg((F.count(F.lit(1)) > 1).alias("several"), F.min(F.struct("station", "station_latitude", "station_longitude")).alias("one")).select("held", "inner", *[f"b{n}" for n in axes], "several", "one.*")
        near = sum((F.pow(F.greatest(F.col(f"b{n}") - F.col(n), F.col(n) - F.col(f"b{n}") - size, F.lit(0.0)), 2) for n in axes), F.lit(0.0))
        met = held.join(F.broadcast(inner) if level <= _FEW else inner, "held").withColumn("near", near).where(F.col("near") <= reach)
        met = met.withColumn("distance_km", distance).withColumn("bound", F.least("bound", F.min("distance_km").over(Window.partitionBy(*at))))
        met = met.withColumn("open", F.col("several") & (F.col("near") <= reach)).where(F.col("open") | (F.col("distance_km") <= F.col("bound")))
        met = cut_lineage(met.select(*at, *axes, F.col("inner").alias("held"), "bound", "open", "distance_km", "station"))
        found.append(met.where(F.col("distance_km") <= F.col("bound")).select(*at, "distance_km", "station"))
        held, before = met.where("open").drop("open", "distance_km", "station"), level
        if held.isEmpty():
            break
    else:
        found.append(held.join(placed.withColumn("held", cube(before)), "held").select(*at, distance.alias("distance_km"), "station"))
    best = reduce(DataFrame.unionByName, found).groupBy(*at).agg(F.min(F.struct("distance_km", "station")).alias("b"))
    return here.join(best, list(at), "left").select("airport", "b.station", "b.distance_km")


def load_coordinates(metadata: DataFrame) -> DataFrame:
    """airport (its IATA code where missing), group, coordinates; rows without coordinates go."""
    needed = {"iata_code", "latitude", "longitude"}
    if missing := needed - set(metadata.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    airport = F.coalesce("airport", "iata_code") if "airport" in metadata.columns else F.col("iata_code")
    kept = [c for c in ("airport_group", "elevation") if c in metadata.columns]
    return metadata.select(airport.alias("airport"), *kept, "latitude", "longitude").dropna(subset=["latitude", "longitude"])


def filter_airports(airports: DataFrame, codes: DataFrame) -> DataFrame:
    """Airports whose iata_code is among the codes, and those whose ident is a code that no iata_code matched."""
    wanted = codes.select(F.upper("airport").alias("code")).distinct()
    known = airports.withColumn("iata_code", F.upper("iata_code")).withColumn("ident", F.upper("ident"))
    by_iata = known.join(wanted, known["iata_code"] == wanted["code"], "left_semi")
    left = wanted.join(known.select("iata_code").distinct(), F.col("code") == F.col("iata_code"), "left_anti")
    by_ident = known.join(left, known["ident"] == left["code"], "left_semi")
    return by_iata.unionByName(by_ident).dropDuplicates(["ident"])


def holiday_join(base: DataFrame, holidays: DataFrame) -> DataFrame:
    """Official holidays by date: name ("" without), public flag, and whether the name speaks of school holidays."""
    unique = holidays.groupBy("date").agg(F.min("name").alias("holiday_name"), F.max(F.col("is_public_holiday").cast("int")).alias("is_public_holiday_official"))
    out = base.join(unique, "date", "left")
    name = F.coalesce("holiday_name", F.lit(""))
    return out.withColumn("holiday_name", name).withColumn("is_public_holiday_official", F.coalesce("is_public_holiday_official", F.lit(0))).withColumn("is_school_holiday_official", F.lower(name).contains("ferie").cast("int"))


def school_holiday_join(base: DataFrame, school: DataFrame) -> DataFrame:
    """School holidays by date, and by group where the calendar has groups; the first of repeated keys (by name) counts."""
    on = ["airport_group", "date"] if "airport_group" in school.columns else ["date"]
    flag = F.col("is_school_holiday").cast("int") if "is_school_holiday" in school.columns else F.lit(1)
    name = F.coalesce("name", F.lit("")) if "name" in school.columns else F.lit("")
    first = school.groupBy(*on).agg(F.min(F.struct(name.alias("n"), flag.alias("f"))).alias("s"))
    out = base.join(first, on, "left")
    return out.withColumn("is_school_holiday_calendar", F.coalesce("s.f", F.lit(0))).withColumn("school_holiday_name", F.coalesce("s.n", F.lit(""))).drop("s")


def enrich_with_groups(airports: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every row of the group mapping (airport_group, airport) with what is known of the airport, matched by upper-case
    code; columns that both have keep the mapping's value and get the other's as ``<name>_our``."""
    known = airports.withColumn("iata_code", F.upper("iata_code"))
    wanted = mapping.withColumn("iata_code", F.upper("airport")).drop("airport")
    clash = [c for c in known.columns if c in wanted.columns and c != "iata_code"]
    return wanted.join(known.withColumnsRenamed({c: f"{c}_our" for c in clash}), "iata_code", "left")

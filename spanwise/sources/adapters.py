"""Views of the test tables in the shape of the operators' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.scalars import plus_minutes

LETTERS = "ABCDEFG"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letter(number):
    return F.substring(F.lit(LETTERS), (number % 7 + 1).cast("int"), F.lit(1))


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as movements; those of type "error" count as cancelled and are left out."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return e.select(
        F.col("event_id").cast("string").alias("flight_id"),
        letter(F.col("user_id")).alias("airport_group"),
        F.when(F.col("event_type").isin("click", "view"), F.lit("dep")).otherwise(F.lit("arr")).alias("movement"),
        F.col("ts").cast("timestamp_ntz").alias("base_time"),
        F.when(F.col("event_id") % 13 != 0, plus_minutes(F.col("ts").cast("timestamp_ntz"), F.col("event_id") % 41 - 10)).alias("actual_time"),
    )


def actual_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movements(spark, sf_dir).withColumn("base_time", F.coalesce("actual_time", "base_time"))


def grid(spark: SparkSession) -> DataFrame:
    """Every hour of 30 days from 2024-01-01 for each of the seven groups."""
    hours = spark.range(30 * 24).select((F.col("id") / 24).cast("int").alias("d"), (F.col("id") % 24).cast("int").alias("hour"))
    return hours.select(F.explode(F.array(*map(F.lit, LETTERS))).alias("airport_group"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("date"), "hour")


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as flights, with delays, cancellations and missing groups that follow from their keys."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    std = plus_minutes(F.col("o_orderdate").cast("timestamp_ntz"), (F.col("l_orderkey") % 24) * 60 + F.col("l_partkey") % 60)
    arrival = F.when(F.col("l_partkey") % 13 == 0, None).when(F.col("l_partkey") % 11 == 0, F.lit("NA")).otherwise(letter(F.col("l_partkey")))
    out = both.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("flight_id"),
        letter(F.col("l_suppkey")).alias("dep_airport_group"),
        arrival.alias("arr_airport_group"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("service_type"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).cast("int").alias("cancelled"),
        std.alias("std"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )
    out = out.withColumn("sta", plus_minutes(F.col("std"), 30 + F.col("l_partkey") % 400))
    delay = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 300 - 80
    late = (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 300 - 80
    out = out.withColumn("atd", plus_minutes(F.col("std"), delay)).withColumn("ata", plus_minutes(F.col("sta"), late))
    return out.drop("l_orderkey", "l_linenumber", "l_partkey")


def daily_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as labelled hours: one row for each (group, date, hour)."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(letter(F.col("o_custkey")).alias("airport_group"), F.to_date("o_orderdate").alias("date"), (F.col("o_orderkey") % 24).cast("int").alias("hour"), (F.col("o_orderstatus") == "F").cast("int").alias("target"))
    return rows.groupBy("airport_group", "date", "hour").agg(F.max("target").alias("target"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: value and the JSON number k become weather, the type a symbol."""
    k = F.get_json_object("props", "$.k").cast("double")
    e = table(spark, sf_dir, "events")
    symbol = F.create_map(*[F.lit(x) for pair in (("click", "rain"), ("view", "lightsnow"), ("purchase", "thunderstorm"), ("signup", "sleet"), ("error", "fair")) for x in pair])
    return e.select(
        letter(F.col("user_id")).alias("airport_group"),
        F.concat(F.lit("AP"), (F.col("user_id") % 21).cast("string")).alias("airport"),
        F.col("ts").cast("timestamp_ntz").alias("forecast_time"),
        F.to_date("ts").alias("date"),
        F.hour("ts").alias("hour"),
        (F.col("value") / 10 - 10).alias("air_temperature"),
        (F.col("value") / 15).alias("wind_speed_of_gust"),
        (k / 20).alias("precipitation_amount_1h"),
        k.alias("cloud_area_fraction_low"),
        (F.col("value") % 100).alias("relative_humidity"),
        F.when(F.col("event_id") % 5 != 0, F.try_element_at(symbol, F.col("event_type"))).alias("symbol_code_1h"),
    )

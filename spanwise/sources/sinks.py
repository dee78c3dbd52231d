"""Sinks. Paths may be of any file system that Spark writes to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.sources import versions


def write_predictions(predictions: DataFrame, path: str) -> None:
    """CSV with header, date as yyyy-MM-dd, the prediction with three decimals, ordered by date, hour and group.

    Rows are dealt to sampled ranges of the order and sorted within; files in order of their names are the whole order.
    Small results make one file, since adaptive execution joins small neighbouring ranges.
    """
    order = ["date", "hour", "airport_group"]
    rows = predictions.repartitionByRange(*order).sortWithinPartitions(*order)
    text = rows.select("airport_group", F.date_format("date", "yyyy-MM-dd").alias("date"), "hour", F.format_string("%.3f", F.col("pred").cast("double")).alias("pred"))
    text.write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small document (metrics, an analysis, a manifest of columns) as one text."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def write_columns(spark: SparkSession, columns: list[str], path: str) -> None:
    """The names and order of the columns that a model was fitted on, kept beside it."""
    write_json(spark, {"columns": list(columns)}, path)


def read_columns(spark: SparkSession, path: str) -> list[str]:
    return read_json(spark, path)["columns"]


def write_cached(df: DataFrame, path: str, config: dict) -> None:
    """A result and the configuration that it was made with, as a new version that takes the old one's place when whole."""
    versions.publish(df, path, config)


def write_keyed(df: DataFrame, path: str) -> None:
    """Out-of-fold or final predictions, keyed by group, date and hour, partitioned by month for pruned reads."""
    df.withColumn("month", F.date_format("date", "yyyy-MM")).write.mode("overwrite").partitionBy("month").parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def write_airports(airports: DataFrame, path: str) -> None:
    """Airports with their groups, codes and coordinates as CSV with header, ordered by group and code across the files."""
    order = ["airport_group", "iata_code"]
    airports.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def write_observations(observations: DataFrame, path: str) -> None:
    """Observations by airport and time as Parquet, partitioned by month; a month that is written again replaces its old rows."""
    rows = observations.withColumn("month", F.date_format("forecast_time", "yyyy-MM"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)

"""Hourly movement counts over a stream of events, late ones up to a watermark included."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.lineage import shared_folder


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """airport_group, hour_start, departures, arrivals from a stream (or table) with base_time (a timestamp) and movement."""
    marked = events.withWatermark("base_time", late) if events.isStreaming else events
    counts = marked.groupBy("airport_group", F.window("base_time", "1 hour").alias("w")).agg(F.count_if(F.col("movement") == "dep").alias("departures"), F.count_if(F.col("movement") == "arr").alias("arrivals"))
    return counts.select("airport_group", F.col("w.start").alias("hour_start"), "departures", "arrivals")


def run_available(counts: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a stream over what is there now; the last state of each group and hour. Batches go to the shared folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/n={number}")

    query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    last = F.max_by(F.struct("departures", "arrivals"), "batch").alias("r")
    return rows.groupBy("airport_group", "hour_start").agg(last).select("airport_group", "hour_start", "r.*")

"""Scheduled movements around each hour of the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.functions.scalars import minute_index, safe_divide
from spanwise.operators.events import KEYS
from spanwise.operators.overlap import on_grid

NEXT, PREVIOUS = (30, 60, 90), (30, 60)


def hourly_counts(base: DataFrame, events: DataFrame) -> DataFrame:
    """Departures, arrivals and movements whose time falls into the hour, with their ratios."""
    hour = F.floor(minute_index(F.col("base_time")) / 60)
    is_ = lambda m: F.count_if(F.col("movement") == m)
    found = events.groupBy("airport_group", hour.alias("hour_number")).agg(is_("dep").alias("scheduled_departures"), is_("arr").alias("scheduled_arrivals"), F.count(F.lit(1)).alias("scheduled_movements"))
    zero = F.lit(0).cast("long")
    out = on_grid(base.select(*KEYS, "interval_start"), found, {c: zero for c in found.columns[2:]}).drop("interval_start")
    out = out.withColumn("scheduled_dep_ratio", safe_divide(F.col("scheduled_departures"), F.col("scheduled_movements")))
    return out.withColumn("scheduled_arr_ratio", safe_divide(F.col("scheduled_arrivals"), F.col("scheduled_movements")))


def range_counts(base: DataFrame, events: DataFrame) -> DataFrame:
    """Movements in [t, t + h) and [t - h, t) around the start t of each hour, by kind.

    The longest horizon is 90 minutes, so an event can only count for the hour it falls into, the one before and the one
    after: it is exploded to these three and counted by conditions, an equi-aggregation in place of a range join.
    """
    minute = minute_index(F.col("base_time"))
    near = events.select("airport_group", "movement", minute.alias("minute"), F.explode(F.array(*[F.floor(minute / 60) + i for i in (-1, 0, 1)])).alias("hour_number"))
    near = near.select("airport_group", "movement", "hour_number", (F.col("minute") - F.col("hour_number") * 60).alias("offset"))
    count = lambda m, low, high: F.count_if((F.col("movement") == m) & (F.col("offset") >= low) & (F.col("offset") < high))
    columns = {f"scheduled_{m}_next_{h}m": count(m, 0, h) for m in ("dep", "arr") for h in NEXT} | {f"scheduled_{m}_prev_{h}m": count(m, -h, 0) for m in ("dep", "arr") for h in PREVIOUS}
    found = near.groupBy("airport_group", "hour_number").agg(*[c.alias(n) for n, c in columns.items()])
    out = on_grid(base.select(*KEYS, "interval_start"), found, {n: F.lit(0).cast("long") for n in columns}).drop("interval_start")
    both = F.col("scheduled_dep_prev_30m") + F.col("scheduled_arr_prev_30m")
    return out.withColumn("scheduled_movements_prev30_ratio", both / F.lit(30.0))


def compute_schedule_features(base: DataFrame, events: DataFrame) -> DataFrame:
    return hourly_counts(base, events).join(range_counts(base, events), KEYS)

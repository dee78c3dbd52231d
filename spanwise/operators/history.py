"""Rates and windows over past targets, and joins that fall back from fine keys to coarse ones.

Windows are partitioned by group and ordered by the hour: a group has one row for each hour, so a partition grows with
time only. Tables of rates have a row for each key (groups x hours and the like); they join without a hint, so Spark
broadcasts them when its own size check allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.operators.events import KEYS


def _rate(training: DataFrame, keys: dict[str, Column], rate: str, support: str | None = None) -> DataFrame:
    counts = [F.count("target").alias(support)] if support else []
    rows = training.select(*[c.alias(n) for n, c in keys.items()], "target").dropna(subset=list(keys))
    return rows.groupBy(*keys).agg(F.avg("target").alias(rate), *counts)


def compute_historical_baselines(base: DataFrame, training: DataFrame) -> DataFrame:
    """Keys with mean targets by (group, hour), (month, hour), (weekday, hour); a key without history gets the unweighted
    mean of the table's rates, and support 0."""
    by_hour = _rate(training, {"airport_group": F.col("airport_group"), "hour": F.col("hour")}, "hist_rate_group_hour", "hist_support_group_hour")
    by_month = _rate(training, {"month": F.month("date"), "hour": F.col("hour")}, "hist_rate_month_hour")
    by_day = _rate(training, {"dayofweek": F.weekday("date"), "hour": F.col("hour")}, "hist_rate_dow_hour")
    out = base.select(*KEYS, F.month("date").alias("month"), F.weekday("date").alias("dayofweek"))
    out = out.join(by_hour, ["airport_group", "hour"], "left").join(by_month, ["month", "hour"], "left").join(by_day, ["dayofweek", "hour"], "left")
    for table, column in ((by_hour, "hist_rate_group_hour"), (by_month, "hist_rate_month_hour"), (by_day, "hist_rate_dow_hour")):
        out = out.join(F.broadcast(table.agg(F.avg(column).alias("__mean"))), how="left").withColumn(column, F.coalesce(column, "__mean")).drop("__mean")  # one row
    return out.select(*KEYS, "hist_rate_group_hour", F.coalesce("hist_support_group_hour", F.lit(0).cast("long")).alias("hist_support_group_hour"), "hist_rate_month_hour", "hist_rate_dow_hour")


def compute_recent_target_features(training: DataFrame, windows: tuple[int, ...] = (24, 72, 168)) -> DataFrame:
    """Keys with the previous hour's target, rolling means and standard deviations over preceding rows of the group, and
    the rows since the last positive one."""
    w = Window.partitionBy("airport_group").orderBy("date", "hour")
    out = training.select(*KEYS, F.col("target").cast("double").alias("target")).withColumn("target_prev_hour", F.lag("target").over(w))
    columns = ["target_prev_hour"]
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        seen = F.count("target").over(frame)
        out = out.withColumn(f"target_rolling_mean_{n}h", F.when(seen >= max(1, n // 4), F.avg("target").over(frame)))
        out = out.withColumn(f"target_rolling_std_{n}h", F.when(seen >= max(2, n // 4), F.stddev_samp("target").over(frame)))
        columns += [f"target_rolling_mean_{n}h", f"target_rolling_std_{n}h"]
    out = out.withColumn("__row", F.row_number().over(w))
    last = F.last(F.when(F.col("target_prev_hour") >= 0.5, F.col("__row")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("hours_since_positive", (F.col("__row") - last).cast("double")).select(*KEYS, *columns, "hours_since_positive")


def last_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order, by max_by over a struct: it combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(*keys).agg(best).select(*keys, "r.*")


def recent_defaults(recent: DataFrame) -> DataFrame:
    return last_of_each(recent, ["airport_group", "hour"], ["date"])


def fill_recent_features(keys: DataFrame, recent: DataFrame, columns: list[str]) -> DataFrame:
    """Recent features for unseen hours: last known of (group, hour), else of the group, else the column's mean."""
    fine = recent_defaults(recent).select("airport_group", "hour", *columns)
    coarse = last_of_each(recent, ["airport_group"], ["date", "hour"]).select("airport_group", *[F.col(c).alias(f"{c}__group") for c in columns])
    means = recent.agg(*[F.avg(c).alias(f"{c}__mean") for c in columns])
    out = keys.join(fine, ["airport_group", "hour"], "left").join(coarse, "airport_group", "left").join(F.broadcast(means), how="left")  # one row
    return out.select(*KEYS, *[F.coalesce(c, f"{c}__group", f"{c}__mean", F.lit(0.0)).alias(c) for c in columns])


def monthly_target_stats(training: DataFrame, keys: tuple[str, ...] = ("airport_group",)) -> DataFrame:
    """Mean, median, sample deviation (0 for one row) and count of the target by month and further keys."""
    by = training.withColumn("month", F.month("date")).groupBy(*keys, "month")
    stats = by.agg(F.avg("target").alias("month_target_mean"), F.median("target").alias("month_target_median"), F.coalesce(F.stddev_samp("target"), F.lit(0.0)).alias("month_target_std"), F.count("target").alias("month_target_count"))
    return stats


def merge_monthly_stats(design: DataFrame, training: DataFrame) -> DataFrame:
    """Statistics of (group, month), else of the month over all groups, else 0; earlier columns of these names are replaced."""
    fine, coarse = monthly_target_stats(training), monthly_target_stats(training, ())
    names = fine.columns[2:]
    out = design.drop(*names).withColumn("month", F.month("date")).join(fine, ["airport_group", "month"], "left")
    out = out.join(coarse.toDF("month", *[f"{n}__all" for n in names]), "month", "left")
    return out.select(*[c for c in design.columns if c not in names], *[F.coalesce(n, f"{n}__all", F.lit(0)).alias(n) for n in names])


def impute_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and NaNs become the column's mean over known values, 0 without any."""
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    means = df.agg(*[F.avg(known(c)).alias(f"{c}__mean") for c in columns])
    out = df.join(F.broadcast(means), how="left")  # one row
    return out.withColumns({c: F.coalesce(known(c), f"{c}__mean", F.lit(0.0)) for c in columns}).drop(*means.columns)

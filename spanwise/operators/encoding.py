"""Month folds, target encodings without leaks, frozen dummy columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def month_of(column: str = "date"):
    return F.date_format(column, "yyyy-MM")


def temporal_folds(df: DataFrame, n: int = 4) -> list[str]:
    """The last n months that have earlier ones, ascending: each is validated on what comes before it. One small collect."""
    period = df.select(month_of().alias("period")).distinct()
    return sorted(r[0] for r in period.orderBy(F.desc("period")).limit(n + 1).collect())[1:]


def fold_sizes(df: DataFrame, n: int = 4) -> DataFrame:
    """period, n_train, n_val of each fold: a running sum over the months."""
    months = df.groupBy(month_of().alias("period")).agg(F.count(F.lit(1)).alias("n_val"))
    w = Window.orderBy("period")  # one row a month
    sized = months.withColumn("n_train", F.sum("n_val").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("back", F.row_number().over(Window.orderBy(F.desc("period"))))
    return sized.where(f"back <= {n} and n_train > 0").select("period", "n_train", "n_val")


def temporal_target_encoding(df: DataFrame, column: str, n: int = 4) -> DataFrame:
    """Adds ``<column>_target_enc``: in the last n months the mean target of the category over all earlier months (the
    global mean for categories not seen there), elsewhere the global mean.

    Sums by (category, month) are small; a running sum over the months gives every fold at once.
    """
    monthly = df.groupBy(F.col(column).alias("__c"), month_of().alias("__m")).agg(F.sum("target").alias("s"), F.count("target").alias("k"))
    folds = temporal_folds(df, n)
    frame = Window.partitionBy("__c").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    means = monthly.select("__c", "__m", (F.sum("s").over(frame) / F.sum("k").over(frame)).alias("__mean")).where(F.col("__m").isin(folds))
    whole = df.agg(F.avg("target").alias("__all"))
    out = df.withColumn("__m", month_of()).join(means.withColumnRenamed("__m", "__p"), (F.col(column) == F.col("__c")) & (F.col("__m") == F.col("__p")), "left")
    out = out.join(F.broadcast(whole), how="left")  # one row
    return out.withColumn(f"{column}_target_enc", F.coalesce("__mean", "__all")).drop("__m", "__c", "__p", "__mean", "__all")


def encoding_map(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.avg("target").alias(f"{column}_target_enc"))


def apply_target_encoding(df: DataFrame, mapping: DataFrame, column: str, global_mean: DataFrame) -> DataFrame:
    """The category's mean from the mapping, the global mean (a one-row table, column ``mean``) where it has none."""
    return df.join(mapping, column, "left").join(F.broadcast(global_mean), how="left").withColumn(f"{column}_target_enc", F.coalesce(f"{column}_target_enc", "mean")).drop("mean")


def vocabulary(df: DataFrame, column: str, most: int = 10_000) -> list[str]:
    """Distinct values, sorted; refuses columns with more than ``most``."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(found)


def one_hot(df: DataFrame, frozen: dict[str, list]) -> DataFrame:
    """0/1 columns ``<column>_<value>`` for a frozen vocabulary, in its order; values outside give zeros everywhere."""
    rest = [F.col(c) for c in df.columns if c not in frozen]
    return df.select(*rest, *[F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for c, values in frozen.items() for v in values])


def add_time_features(df: DataFrame) -> DataFrame:
    date = F.col("date")
    return df.withColumns({"dayofweek": F.weekday(date), "month": F.month(date), "weekofyear": F.weekofyear(date), "is_month_start": (F.dayofmonth(date) == 1).cast("int"), "is_month_end": (F.last_day(date) == date).cast("int")})

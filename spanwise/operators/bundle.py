"""Every feature that is learned from past targets, fitted on training rows alone and laid onto any rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.functions.lineage import cut_lineage
from spanwise.operators import encoding as N
from spanwise.operators import events as E
from spanwise.operators import history as H

KEYS = E.KEYS
BUCKETS = ("airport_hour_bucket", "airport_dow_bucket")


class TargetBundle:
    """Recent windows, monthly statistics, historical rates and encodings of a training set (keys and target).

    What is kept are tables of the training keys and of smaller keys, checkpointed once, so folds and inference only join.
    """

    def __init__(self, training: DataFrame, windows: tuple[int, ...] = (24, 72, 168)):
        self.training = cut_lineage(training.select(*KEYS, "target"))
        self.recent = cut_lineage(H.compute_recent_target_features(self.training, windows))
        self.recent_columns = [c for c in self.recent.columns if c not in KEYS]
        bucketed = E.add_airport_time_buckets(self.training)
        self.mean = self.training.agg(F.avg("target").alias("mean"))
        self.encodings = {c: cut_lineage(N.encoding_map(bucketed, c)) for c in BUCKETS}
        self.columns = [*self.recent_columns, *H.monthly_target_stats(self.training).columns[2:], "hist_rate_group_hour", "hist_support_group_hour", "hist_rate_month_hour", "hist_rate_dow_hour", *[f"{c}_target_enc" for c in BUCKETS]]

    def onto(self, rows: DataFrame) -> DataFrame:
        """The rows with the bundle's columns.

        Recent windows of a training hour are those of the hours before it; an hour that isn't in the training set gets
        the last known ones of its group and hour, else of its group, else the mean.
        """
        rows = rows.drop(*self.columns)
        known = self.recent.select(*KEYS, *[F.col(c).alias(f"{c}__own") for c in self.recent_columns])
        filled = H.fill_recent_features(rows.select(*KEYS), self.recent, self.recent_columns)
        recent = filled.join(known, KEYS, "left").select(*KEYS, *[F.coalesce(f"{c}__own", c).alias(c) for c in self.recent_columns])
        out = H.merge_monthly_stats(rows, self.training).join(recent, KEYS).join(H.compute_historical_baselines(rows, self.training), KEYS)
        out = E.add_airport_time_buckets(out)
        for c in BUCKETS:
            out = N.apply_target_encoding(out, self.encodings[c], c, self.mean)
        return out.drop(*BUCKETS)


def with_target_features(training: DataFrame, rows: DataFrame) -> DataFrame:
    return TargetBundle(training).onto(rows)

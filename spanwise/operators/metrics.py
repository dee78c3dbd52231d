"""Scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.operators.prefix import running_sums

# How feature names are grouped into families, first match wins.
FAMILIES = (("sim_", "simulation"), ("overlap_", "overlap"), ("scheduled_", "schedule"), ("hist_", "history"), ("target_", "history"), ("hours_since", "history"), ("weather_", "weather"), ("feat_", "given"))


def known_scores(df: DataFrame, score: str = "score", label: str = "target") -> DataFrame:
    """Rows with a label and a score that is a number."""
    return df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())


def roc_auc(df: DataFrame, by: tuple[str, ...] = (), score: str = "score", label: str = "target") -> DataFrame:
    """Area under the ROC curve, ties at half, 0.5 for a single class; rows without a score or label don't count.

    Rows are first counted by distinct score; below each score lies a running sum over ranges of the scores, so that no
    task sees more than its range, whatever the scores' scale or distribution.
    """
    steps = known_scores(df, score, label).groupBy(*by, score).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.sum(1 - F.col(label).cast("double")).alias("neg"))
    placed = running_sums(steps, [F.col(score)], {"below": F.col("neg")}, by)
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    sums = placed.groupBy(*by).agg(won.alias("won"), F.coalesce(F.sum("pos"), F.lit(0.0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0.0)).alias("n_neg"))
    return sums.select(*by, F.coalesce(F.try_divide("won", F.col("n_pos") * F.col("n_neg")), F.lit(0.5)).alias("auc"), (F.col("n_pos") + F.col("n_neg")).cast("long").alias("n"))


def monthly_auc(df: DataFrame, score: str = "score", label: str = "target") -> DataFrame:
    return roc_auc(df.withColumn("month", F.date_format("date", "yyyy-MM")), ("month",), score, label)


def month_auc(df: DataFrame, year: int, month: int, score: str = "score", label: str = "target") -> float:
    """One month's AUC; raises where the month has no scored row."""
    row = roc_auc(df.where((F.year("date") == year) & (F.month("date") == month)), (), score, label).first()
    if row is None or not row["n"]:
        raise ValueError(f"no scored rows in {year}-{month:02d}")
    return row["auc"]


def month_report(df: DataFrame, score: str = "score", label: str = "target") -> DataFrame:
    """month, n, n_positive, mean_score, auc of stored predictions, and a row "all"."""
    months = F.explode(F.array(F.date_format("date", "yyyy-MM"), F.lit("all"))).alias("month")
    rows = known_scores(df, score, label).drop("month").select("*", months)
    counts = rows.groupBy("month").agg(F.sum(F.col(label).cast("long")).alias("n_positive"), F.avg(score).alias("mean_score"))
    return roc_auc(rows, ("month",), score, label).join(counts, "month").select("month", "n", "n_positive", "mean_score", "auc")


def analysis(rows: DataFrame, importance: DataFrame, top: int = 10) -> dict:
    """What an analysis of scored rows (keys, target, score, peak) holds: summary, rates by group and month, profile by peak,
    AUC by month, the most important features and the families' shares. Every part is an aggregation of a few rows."""
    listed = lambda df: [{k: v if v is None or isinstance(v, (int, float)) else str(v) for k, v in r.asDict().items()} for r in df.collect()]
    return {
        "summary": listed(dataset_summary(rows))[0],
        "groups": listed(group_rates(rows)),
        "months": listed(monthly_rate(rows).orderBy("month")),
        "profile": listed(concurrency_profile(rows).orderBy("concurrency")),
        "auc": listed(month_report(rows).orderBy("month")),
        "features": listed(top_features(importance, top)),
        "families": listed(family_importance(importance)),
    }


def document_rows(document: dict) -> list[tuple[str, str, str]]:
    """(section, name, value) for every number and text of such a document; a list's entries are named by their first field."""
    told = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    out = []
    for section, value in document.items():
        for entry in value if isinstance(value, list) else [value]:
            lead = f"{entry[first]}." if isinstance(value, list) and (first := KEY_FIELDS.get(section)) else ""
            out += [(section, f"{lead}{k}", told(v)) for k, v in entry.items() if k != KEY_FIELDS.get(section)]
    return out


#: Which field names an entry of a section.
KEY_FIELDS = {"groups": "airport_group", "months": "month", "profile": "concurrency", "auc": "month", "features": "feature", "families": "family"}


def dataset_summary(training: DataFrame) -> DataFrame:
    return training.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("airport_group").alias("n_groups"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.avg("target").alias("positive_rate"))


def group_rates(training: DataFrame) -> DataFrame:
    """Rows and positive rate of each group, the highest rate first."""
    return training.groupBy("airport_group").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("target").alias("positive_rate")).orderBy(F.desc("positive_rate"), "airport_group")


def monthly_rate(training: DataFrame) -> DataFrame:
    return training.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("target").alias("positive_rate"))


def concurrency_profile(rows: DataFrame, least: int = 50, top: int = 12) -> DataFrame:
    """Mean score and target by the hour's peak, for peaks with ``least`` rows or more."""
    peak = F.least(F.greatest(F.col("peak").cast("int"), F.lit(0)), F.lit(top))
    return rows.groupBy(peak.alias("concurrency")).agg(F.avg("score").alias("mean_score"), F.avg("target").alias("mean_target"), F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least)


def family_importance(importance: DataFrame) -> DataFrame:
    """Shares of the total gain by family of features, the largest first."""
    family = F.when(F.lit(False), F.lit(""))
    for prefix, name in FAMILIES:
        family = family.when(F.col("feature").startswith(prefix), F.lit(name))
    shares = importance.groupBy(family.otherwise(F.lit("other")).alias("family")).agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("n_features"))
    return shares.withColumn("share", F.coalesce(F.try_divide("gain", F.sum("gain").over(Window.partitionBy())), F.lit(0.0))).orderBy(F.desc("gain"), "family")  # one row a family


def top_features(importance: DataFrame, k: int = 25) -> DataFrame:
    """The k features of the largest absolute value, ties by name."""
    return importance.orderBy(F.desc(F.abs("gain")), "feature").limit(k)


def pairwise_hinge(df: DataFrame, score: str = "score", label: str = "target") -> DataFrame:
    """Mean of max(0, negative - positive) over all pairs of a positive and a negative row, from counts and sums of
    distinct scores and running sums over them; no pair is formed."""
    steps = known_scores(df, score, label).groupBy(score).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.sum(1 - F.col(label).cast("double")).alias("neg"))
    placed = running_sums(steps, [F.col(score)], {"below": F.col("pos"), "weighed": F.col("pos") * F.col(score)})
    loss = F.sum(F.col("neg") * (F.col(score) * F.col("below") - F.col("weighed")))
    return placed.agg(F.coalesce(F.try_divide(loss, F.sum("pos") * F.sum("neg")), F.lit(0.0)).alias("loss"))

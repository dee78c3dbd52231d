"""Queries of what is learned: kernels over sequences, ranking, early stopping, node tables, stored predictions.

They register beside those of plans/queries.py; plans/learned_sql.py has the SQL of those that SQL can tell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.functions.lineage import cut_lineage
from spanwise.functions.scalars import cyclical
from spanwise.operators import encoding as N
from spanwise.operators import events as E
from spanwise.operators import kernels as K
from spanwise.operators import metrics as R
from spanwise.operators import models as ML
from spanwise.operators import overlap as O
from spanwise.operators import ranking as RK
from spanwise.operators.bundle import TargetBundle
from spanwise.plans.queries import FEATURES, KEYS, QUERIES, _fold_auc, _place, _prepare, _scored, base, forecast_responses, forecast_summary, query, rounded, target
from spanwise.plans.sequence import CHANNELS, sequence_frame
from spanwise.sources import adapters as A
from spanwise.sources import readers, sinks

RANKED = RK.Training(epochs=12, rate=0.1)


__all__ = ["QUERIES"]  # all of them, these included


@query
def kernel_features(spark, d):
    """The forty kernels' largest responses and numbers of positive ones, over each hour's sequence and the two before it."""
    s = O.build_context_sequences(O.build_minute_sequences(base(spark), A.movements(spark, d)))
    found = s.select(*KEYS, K.kernel_features(F.col("context")).alias("k"))
    text = lambda name: F.array_join(F.col(f"k.{name}").cast("array<string>"), ",").alias(name)
    return found.select(*KEYS, text("largest"), text("above"))


def _flown_hours(spark, d):
    """Every hour with a planned movement: sequences of the plan, and whether two movements or more overlapped in fact."""
    flights = A.flights(spark, d)
    planned, flown = E.build_event_table(flights), E.build_event_table(flights, use_actual=True)
    hours = planned.select("airport_group", F.to_date("base_time").alias("date"), F.hour("base_time").alias("hour")).distinct()
    grid = cut_lineage(E.build_base_index(hours))
    found = O.compute_overlap_features(grid, flown).select(*KEYS, (F.col("overlap_minutes_ge2") > 0).cast("int").alias("target"))
    return sequence_frame(grid.select(*KEYS, "interval_start").join(found, KEYS), planned, carried=("target",))


def _kernel_rows(spark, d):
    rows = K.with_kernels(_flown_hours(spark, d), CHANNELS).select(*KEYS, "target", "kernels", *cyclical(F.col("hour"), 24, "hour"))
    return cut_lineage(rows)


KERNEL_COLUMNS = ["kernels", "hour_sin", "hour_cos"]


@query
def cv_kernels(spark, d):
    """Out-of-fold AUC of a logistic model on the kernels' features of planned sequences."""
    return _fold_auc(ML.cross_validate(_kernel_rows(spark, d), lambda: ML.logistic(KERNEL_COLUMNS, 20), 2, threads=2)[0])


@query
def fitted_channel_ablation(spark, d):
    """The AUC that each of the three channels is worth to the fitted kernel model, and what is left without it."""
    rows = _kernel_rows(spark, d)
    model = ML.logistic(KERNEL_COLUMNS, 20).fit(rows)
    found = ML.ablated(lambda df: ML.positive_score(model.transform(df)), rows, CHANNELS, lambda df, c: K.without_channel(df, c, CHANNELS))
    return rounded(spark.createDataFrame(found, "channel string, lost double, auc double"))


@query
def hinge_gradient(spark, d):
    """The pairwise hinge's derivative by each row's score, at a margin of a twentieth, times a million."""
    rows = RK.hinge_gradient(_scored(spark, d), 0.05)
    return rounded(rows.select(*KEYS, "target", (F.col("pair_gradient") * 1e6).alias("gradient")))


def _ranking_rows(spark, d):
    days = cut_lineage(A.daily_target(spark, d))
    earlier, _ = RK.split_last_month(days)
    rows = _prepare(earlier, days)
    return cut_lineage(rows.select(*KEYS, "target", F.array(*FEATURES).alias("features")))


@query
def ranking_trainer(spark, d):
    """Each epoch's AUC on the held last month, and which epoch's weights are kept."""
    train, held = RK.split_last_month(_ranking_rows(spark, d))
    state = RK.fit_ranking(train, held, how=RANKED, path=_place(spark, "ranking"))
    return spark.createDataFrame([(i + 1, round(auc, 4), i + 1 == state.best_epoch) for i, auc in enumerate(state.history)], "epoch int, auc double, kept boolean")


MOST_TREES = 30


@query
def cv_early_stopped(spark, d):
    """Boosting with balanced classes that stops by the training period's last month: AUC, and how many trees were kept."""
    days = cut_lineage(A.daily_target(spark, d))
    make = lambda: ML.boosted(FEATURES, MOST_TREES, 4, weight="weight", held="held")
    fitted = ML.fit_folds(days, make, 2, _prepare, lambda rows: ML.with_held_month(ML.balanced_weights(rows)), threads=2)
    kept = spark.createDataFrame([(f.month, ML.kept_trees(f.model), MOST_TREES) for f in fitted], "fold string, n_trees int, most_trees int")
    return _fold_auc(reduce(DataFrame.unionByName, [f.scores for f in fitted])).join(kept, "fold")


@query
def split_importance(spark, d):
    """Shares of gain and of splits by family of features, from the table of a fitted forest's nodes."""
    days = cut_lineage(A.daily_target(spark, d))
    days = cut_lineage(_prepare(days, days))
    nodes = ML.tree_nodes(ML.forest(FEATURES, 10, 5).fit(days), FEATURES)
    found = ML.split_importance(nodes)
    by = lambda value, name: R.family_importance(found.select("feature", F.col(value).cast("double").alias("gain"))).select("family", "n_features", F.col("share").alias(name))
    return rounded(by("gain", "gain_share").join(by("splits", "split_share"), ["family", "n_features"]))


@query
def month_report(spark, d):
    """AUC of every month over stored predictions, and beside it that of all months."""
    path = _place(spark, "scores")
    sinks.write_keyed(_scored(spark, d).select(*KEYS, "target", "score"), path)
    return rounded(R.month_report(spark.read.parquet(path)))


@query
def target_features(spark, d):
    """The bundle of target features of the days before 1998, laid onto the days from then on."""
    days = cut_lineage(A.daily_target(spark, d))
    past, rows = days.where("date < date'1998-01-01'"), days.where("date >= date'1998-01-01'")
    return rounded(TargetBundle(past, (24,)).onto(rows).drop("target"))


@query
def analysis_document(spark, d):
    """The document of summary, rates, profile and importances, written as JSON and read again: a row for each number."""
    path = _place(spark, "analysis")
    rows = cut_lineage(O.compute_overlap_features(base(spark), A.movements(spark, d)).select(*KEYS, F.col("overlap_max").alias("peak"), (F.col("overlap_mean") / 10).alias("score")).join(target(spark, d), KEYS))
    sinks.write_json(spark, R.analysis(rows, A.table(spark, d, "part").select(F.concat(F.lit("sim_"), F.col("p_partkey").cast("string")).alias("feature"), (F.col("p_partkey") * 31 % 997).cast("double").alias("gain"))), path)
    return spark.createDataFrame(R.document_rows(sinks.read_json(spark, path)), "section string, name string, value string")


@query
def encoded_buckets(spark, d):
    """Mean targets of hour and weekday buckets before 1998, as a table that is stored and read for any later rows."""
    path = _place(spark, "encodings")
    past = E.add_airport_time_buckets(A.daily_target(spark, d).where("date < date'1998-01-01'"))
    for column in ("airport_hour_bucket", "airport_dow_bucket"):
        N.encoding_map(past, column).write.parquet(f"{path}/{column}")
    read = [spark.read.parquet(f"{path}/{c}").select(F.col(c).alias("bucket"), F.col(f"{c}_target_enc").alias("mean")) for c in ("airport_hour_bucket", "airport_dow_bucket")]
    return rounded(reduce(DataFrame.unionByName, read))


@query
def cv_stopped_perceptron(spark, d):
    """A perceptron that stops by the training period's last month: AUC, and after how many rounds its weights were best."""
    days = cut_lineage(A.daily_target(spark, d))
    make = lambda: ML.StoppedPerceptron(FEATURES, (16, 8), rounds=6, iterations=10)
    fitted = ML.fit_folds(days, make, 2, _prepare, ML.with_held_month, threads=2)
    kept = spark.createDataFrame([(f.month, f.model.best_round, f.model.rounds) for f in fitted], "fold string, best_round int, rounds int")
    return _fold_auc(reduce(DataFrame.unionByName, [f.scores for f in fitted])).join(kept, "fold")


@query
def sink_airports(spark, d):
    """Enriched airports as the sink leaves them."""
    path = _place(spark, "airports")
    sinks.write_airports(QUERIES["airport_groups_enriched"](spark, d), path)
    return readers.read_csv(spark, path, "airport_group string, iata_code string, ident string, airport_group_our string, latitude double, elevation double")


@query
def sink_observations(spark, d):
    """Observations by airport and hour as the sink leaves them, after one month was written twice."""
    path = _place(spark, "observed")
    found = cut_lineage(QUERIES["source_observations"](spark, d))
    sinks.write_observations(found, path)
    last = found.agg(F.max(F.date_format("forecast_time", "yyyy-MM"))).first()[0]
    sinks.write_observations(found.where(F.date_format("forecast_time", "yyyy-MM") == last), path)
    return spark.read.parquet(path).select(*found.columns)


@query
def source_forecasts(spark, d):
    """Forecast responses as a fetcher stores them, a JSON text a line, read to columns."""
    path = _place(spark, "forecasts")
    forecast_responses(A.weather(spark, d)).write.json(path)
    return forecast_summary(readers.load_forecast_responses(spark, path))

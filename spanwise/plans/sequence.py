"""The sequence job: context sequences and target features to out-of-fold scores, a model, predictions and an AUC report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.lineage import cut_lineage
from spanwise.operators import design as D
from spanwise.operators import events as E
from spanwise.operators import kernels as K
from spanwise.operators import models as ML
from spanwise.operators import overlap as O
from spanwise.operators.bundle import TargetBundle, with_target_features
from spanwise.operators.metrics import month_report, roc_auc
from spanwise.sources import readers, sinks

KEYS = E.KEYS
CHANNELS = ["concurrency", "departures", "arrivals"]


def sequence_frame(grid: DataFrame, events: DataFrame, before: int = 2, carried: tuple[str, ...] = ()) -> DataFrame:
    """Keys and ``carried`` columns with each channel's counts by minute: those of the ``before`` hours before it, then the hour's own.

    The hours before are hours of the clock, whether the grid has them or not, so sequences are built for them too and met
    by (group, hour number): no window over a group, and gaps in a grid are zeros, not other hours. An hour's arrays are
    moved once to each hour that they count for, and meet the grid where they then lie.
    """
    found = O.minute_counters(E.with_operational_windows(events), by_movement=True)
    names = (("c", "concurrency"), ("dep", "departures"), ("arr", "arrivals"))
    arrays = found.select("airport_group", "hour_number", *[O.minute_array(F.col("runs"), a).cast("array<int>").alias(b) for a, b in names])  # of an hour's movements, an int
    dealt = arrays.select("airport_group", "hour_number", F.explode(F.sequence(F.lit(0), F.lit(before))).alias("__ago"), *CHANNELS)
    near = dealt.groupBy("airport_group", (F.col("hour_number") + F.col("__ago")).alias("hour_number")).agg(F.collect_list(F.struct("__ago", *CHANNELS)).alias("__p"))  # as many as hours asked for
    asked = grid.select(*KEYS, *carried, O.hour_number(F.col("interval_start")).alias("hour_number"))
    met = asked.join(near, ["airport_group", "hour_number"], "left")
    zeros = F.array_repeat(F.lit(0), O.MINUTES)
    at = lambda i, c: F.coalesce(F.get(F.filter("__p", lambda x: x["__ago"] == i), F.lit(0))[c], zeros)
    return met.select(*KEYS, *carried, *[F.concat(*[at(i, c) for i in range(before, -1, -1)]).cast("array<bigint>").alias(c) for c in CHANNELS])


def run_sequence_job(spark: SparkSession, training: str, flights: str, inference: str, schedule: str, out: str, folds: int = 4, make: Callable[[list[str]], object] | None = None, threads: int = 2) -> dict:
    """Writes out-of-fold scores, the model, its columns, predictions and an AUC report below ``out``; returns the report.

    A row's features are the kernels over its three hours of planned sequences, its given columns, its calendar, and the
    target features of the training months.
    """
    make = make or (lambda columns: ML.logistic(columns, 400))
    labels = cut_lineage(readers.load_training(spark, training))
    asked = cut_lineage(readers.load_inference(spark, inference))
    planned = E.build_event_table(cut_lineage(readers.load_flights(spark, flights)).drop("cancelled", "atd", "ata"))
    future = E.build_event_table(cut_lineage(readers.load_schedule(spark, schedule)))

    def frame(given: DataFrame, events: DataFrame) -> DataFrame:
        grid = cut_lineage(E.build_base_index(given))
        numbers = [c for c in ("target", "feat_sched_concurrence", "feat_sched_flights_cnt") if c in given.columns]
        calendar = grid.drop("interval_start", "interval_end", "season")
        rows = given.select(*KEYS, *numbers).join(calendar.select(*KEYS, *[c for c in calendar.columns if c not in given.columns]), KEYS)
        return cut_lineage(K.with_kernels(D.fill_numbers(rows).join(sequence_frame(grid, events), KEYS), CHANNELS).drop(*CHANNELS))

    known, wanted = frame(labels, planned), frame(asked, future)
    bundle = TargetBundle(known)
    columns = [*[c for c in known.columns if c not in (*KEYS, "target")], *bundle.columns]
    scored, model = ML.cross_validate(known, lambda: make(columns), folds, with_target_features, refit=True, threads=threads)
    scored = cut_lineage(scored)
    report = {r["fold"]: r["auc"] for r in roc_auc(scored, ("fold",)).collect()} | {"all": roc_auc(scored).first()["auc"]}
    sinks.write_keyed(scored, f"{out}/scores")
    sinks.save_model(model, f"{out}/model")
    sinks.write_columns(spark, columns, f"{out}/columns")
    predicted = ML.positive_score(model.transform(bundle.onto(wanted))).select(*KEYS, ML.clipped(F.col("score")).alias("pred"))
    sinks.write_predictions(predicted, f"{out}/predictions")
    sinks.write_json(spark, report, f"{out}/metrics")
    return report


def report_months(spark: SparkSession, out: str) -> DataFrame:
    """The month report of a job's stored out-of-fold scores."""
    return month_report(spark.read.parquet(f"{out}/scores"))

"""The whole job: from files of flights, labels and a schedule to models, out-of-fold scores and a file of predictions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.lineage import cut_lineage
from spanwise.operators import design as D
from spanwise.operators import events as E
from spanwise.operators import models as ML
from spanwise.operators import simulate as MC
from spanwise.operators import weather as W
from spanwise.operators.bundle import TargetBundle, with_target_features
from spanwise.operators.metrics import monthly_auc, roc_auc
from spanwise.operators.sampling import cached_simulation
from spanwise.sources import readers, sinks
from spanwise.sources.versions import table_note

KEYS = E.KEYS
SIMULATED = "sim_prob_any_overlap"


@dataclass(frozen=True)
class Inputs:
    """Paths of the CSV files (weather is Parquet); those that may be left out are None by default."""

    training: str
    flights: str
    schedule: str
    inference: str
    weather: str | None = None
    public_holidays: str | None = None
    school_holidays: str | None = None
    since: str | None = None


@dataclass(frozen=True)
class Settings:
    """How much work is done; the defaults are those of a full run."""

    folds: int = 4
    simulations: int = 120
    min_simulations: int = 80
    max_error: float = 0.003
    seed: int = 123
    models: dict[str, Callable[[list[str]], Estimator]] = field(default_factory=lambda: {"logistic": lambda c: ML.logistic(c, 400), "perceptron": ML.mlp, "boosted": lambda c: ML.boosted(c, 600), "forest": ML.forest})


def static_features(grid: DataFrame, events: DataFrame, inputs: Inputs) -> DataFrame:
    """Keys with calendar, schedule, overlap, weather and holiday features, nulls as 0; nothing here knows a target."""
    spark = grid.sparkSession
    parts = [grid.drop("interval_start", "interval_end", "season"), D.build_feature_matrix(grid, events)]
    if inputs.weather:
        parts.append(W.aggregate_weather(readers.load_weather(spark, inputs.weather)))
    out = D.join_first_wins(parts)
    if inputs.public_holidays:
        out = W.holiday_join(out, readers.load_public_holidays(spark, inputs.public_holidays))
    if inputs.school_holidays:
        out = W.school_holiday_join(out, readers.load_school_holidays(spark, inputs.school_holidays))
    numbers = [c for c, t in out.dtypes if c not in KEYS and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    return D.fill_numbers(out.select(*KEYS, *numbers))


def _simulated(spark: SparkSession, out: str, name: str, grid: DataFrame, schedule: DataFrame, history: DataFrame, s: Settings) -> DataFrame:
    inputs = {"grid": grid, "schedule": schedule, "history": history}
    config = {k: v for k, v in asdict(s).items() if k not in ("models", "folds")} | {"part": name, "inputs": {k: table_note(df) for k, df in inputs.items()}}
    run = lambda: MC.run_monte_carlo(grid, schedule, history, s.simulations, s.seed, s.min_simulations, s.max_error)
    return D.join_filled(grid, cached_simulation(spark, f"{out}/simulated/{name}", config, run), SIMULATED)


def run_job(spark: SparkSession, inputs: Inputs, out: str, settings: Settings | None = None) -> dict:
    """Writes predictions, out-of-fold scores, models, the manifest of columns and metrics below ``out``; returns the metrics.

    Models are validated on the last months, each by a model of the months before it with target features of those months
    alone. The stack sees every model's out-of-fold score and the simulated probability. The best of all candidates
    scores the hours of the inference file.
    """
    s = settings or Settings()
    training = cut_lineage(readers.load_training(spark, inputs.training, inputs.since))
    asked = cut_lineage(readers.load_inference(spark, inputs.inference))
    flights, schedule = cut_lineage(readers.load_flights(spark, inputs.flights)), cut_lineage(readers.load_schedule(spark, inputs.schedule))
    past, future = (cut_lineage(E.build_base_index(x)) for x in (training, asked))
    planned = flights.drop("cancelled", "atd", "ata")

    def frame(grid: DataFrame, given: DataFrame, events: DataFrame, name: str, plan: DataFrame) -> DataFrame:
        kept = [c for c in ("target", "feat_sched_concurrence", "feat_sched_flights_cnt") if c in given.columns]
        simulated = _simulated(spark, out, name, grid, plan, flights, s)
        joined = given.select(*KEYS, *kept).join(static_features(grid, events, inputs), KEYS).join(simulated, KEYS)
        return cut_lineage(D.fill_numbers(joined))

    known = frame(past, training, E.build_event_table(planned), "past", planned)
    wanted = frame(future, asked, E.build_event_table(schedule), "future", schedule)
    static = [c for c in known.columns if c not in (*KEYS, "target")]
    bundle = TargetBundle(known)
    columns = [*static, *bundle.columns]
    sinks.write_columns(spark, columns, f"{out}/columns")

    parts, metrics = {}, {}
    for name, make in s.models.items():
        scored, model = ML.cross_validate(known, lambda make=make: make(columns), s.folds, with_target_features, refit=True)
        parts[name] = cut_lineage(scored)
        metrics[name] = {r["fold"]: r["auc"] for r in roc_auc(parts[name], ("fold",)).collect()} | {"all": roc_auc(parts[name]).first()["auc"]}
        sinks.save_model(model, f"{out}/models/{name}")
        sinks.write_keyed(parts[name], f"{out}/scores/{name}")
        parts[name], model = parts[name].drop("fold"), cut_lineage(ML.positive_score(model.transform(bundle.onto(wanted))).select(*KEYS, "score"))
        metrics[name]["future"] = model
    future_scores = {n: metrics[n].pop("future") for n in s.models}
    some = next(iter(parts.values()))
    parts["simulation"] = some.select(*KEYS, "target").join(known.select(*KEYS, F.col(SIMULATED).alias("score")), KEYS)
    future_scores["simulation"] = wanted.select(*KEYS, F.col(SIMULATED).alias("score"))
    stacker = ML.fit_stack(parts)
    candidates = {**parts, "stack": cut_lineage(ML.stack_scores(stacker, parts))}
    future_scores["stack"] = ML.stack_scores(stacker, future_scores)
    best, auc, _ = ML.best_candidate(candidates)
    metrics |= {n: {"all": roc_auc(candidates[n]).first()["auc"]} for n in ("simulation", "stack")}
    report = {"candidates": metrics, "best": best, "auc": auc, "months": {r["month"]: r["auc"] for r in monthly_auc(candidates[best]).collect()}}
    predicted = future_scores[best].select(*KEYS, ML.clipped(F.col("score")).alias("pred"))
    sinks.write_predictions(predicted, f"{out}/predictions")
    sinks.save_model(stacker, f"{out}/models/stack")
    sinks.write_json(spark, report, f"{out}/metrics")
    return report


def run_logistic(spark: SparkSession, training: str, out: str, since: str = "2022-01-01", folds: int = 4, iterations: int = 400) -> dict:
    """The logistic model alone, from the labels' own columns and target features: metrics by fold, and the model saved."""
    rows = cut_lineage(D.fill_numbers(readers.load_training(spark, training, since).drop("feat_season")))
    grid = E.build_base_index(rows).drop("interval_start", "interval_end", "season")
    rows = cut_lineage(rows.join(grid, KEYS))
    columns = [*[c for c in rows.columns if c not in (*KEYS, "target")], *TargetBundle(rows).columns]
    scored, model = ML.cross_validate(rows, lambda: ML.logistic(columns, iterations), folds, with_target_features, refit=True)
    scored = cut_lineage(scored)
    report = {r["fold"]: r["auc"] for r in roc_auc(scored, ("fold",)).collect()} | {"all": roc_auc(scored).first()["auc"]}
    sinks.save_model(model, f"{out}/models/logistic")
    sinks.write_columns(spark, columns, f"{out}/columns")
    sinks.write_keyed(scored, f"{out}/scores/logistic")
    sinks.write_json(spark, report, f"{out}/metrics")
    return report

"""A linear scorer trained on weighted log loss and the pairwise hinge, without forming a pair.

The hinge of a positive and a negative row is max(0, negative - positive + margin). Its gradient for a row is a number of
rows of the other class: those on the wrong side of the row's score, shifted by the margin. Both classes are put on one
axis, positives at score - margin and negatives at their score, counted by distinct place, and running sums over ranges
of the axis give every such number at once. An epoch is one pass over the rows, whole: Adam steps on the exact gradient
of the whole training set, on a cosine rate, until a held month's AUC no longer grows. Weights and moments are a few
numbers a feature; they and the best weights so far are written after each epoch, so a run that dies goes on from there.

Defined results: rows without a label count for nothing; a null feature counts as 0; of a single class the hinge and its
gradient are 0; equal scores at a margin of 0 have no gradient, as the hinge's corner has none.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.lineage import cut_lineage
from spanwise.operators.encoding import month_of
from spanwise.operators.metrics import roc_auc
from spanwise.operators.prefix import running_sums
from spanwise.sources.versions import current, publish

# Weight and margin of the pairwise part, epochs without a better AUC before the stop, least gain, norm and decay.
PAIR_WEIGHT, MARGIN, PATIENCE, LEAST_GAIN, LARGEST_NORM, DECAY = 0.3, 0.0, 5, 1e-4, 5.0, 1e-4
BETA1, BETA2, TINY = 0.9, 0.999, 1e-8
SAVED = "epoch int, weights array<double>, bias double, mean array<double>, square array<double>, best_auc double, best_epoch int, best_weights array<double>, best_bias double, history array<double>"


def hinge_gradient(df: DataFrame, margin: float = MARGIN, score: str = "score", label: str = "target") -> DataFrame:
    """Adds ``pair_gradient``: the derivative by the row's score of the mean hinge over all pairs of a positive and a negative row."""
    positive = F.coalesce(F.col(label) > 0, F.lit(False))
    labelled = F.col(label).isNotNull()
    place = F.when(positive, F.col(score) - F.lit(float(margin))).otherwise(F.col(score))
    placed = df.withColumn("__place", F.when(labelled, place + F.lit(0.0)))
    steps = placed.where(labelled).groupBy("__place").agg(F.sum(positive.cast("long")).alias("pos"), F.sum((~positive).cast("long")).alias("neg"))
    sums = running_sums(steps, [F.col("__place")], {"pos_below": F.col("pos"), "neg_below": F.col("neg")})
    totals = steps.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))  # one row
    found = sums.join(F.broadcast(totals), how="left").select(
        F.col("__place").alias("__at"),
        (F.col("n_neg") - F.col("neg_below") - F.col("neg")).alias("__neg_above"),
        F.col("pos_below").alias("__pos_below"),
        (F.col("n_pos") * F.col("n_neg")).alias("__pairs"),
    )
    met = placed.join(found, F.col("__place") == F.col("__at"), "left")
    rows = F.when(positive, -F.col("__neg_above")).otherwise(F.col("__pos_below"))
    gradient = F.when(labelled, F.coalesce(F.try_divide(rows.cast("double"), F.col("__pairs").cast("double")), F.lit(0.0))).otherwise(F.lit(0.0))
    return met.withColumn("pair_gradient", gradient).drop("__place", "__at", "__neg_above", "__pos_below", "__pairs")


def linear_score(features: str, weights: list[float], bias: float) -> Column:
    """Bias and weighted features of an array column. Weights are one array literal, so epochs share their compiled code."""
    each = F.zip_with(F.col(features), F.lit(list(map(float, weights))), lambda x, w: F.coalesce(x, F.lit(0.0)) * w)
    return F.aggregate(each, F.lit(float(bias)), lambda s, x: s + x)


@dataclass
class State:
    """What an epoch leaves: everything that the next one needs."""

    weights: list[float]
    bias: float = 0.0
    epoch: int = 0
    mean: list[float] = field(default_factory=list)
    square: list[float] = field(default_factory=list)
    best_auc: float = -math.inf
    best_epoch: int = 0
    best_weights: list[float] = field(default_factory=list)
    best_bias: float = 0.0
    history: list[float] = field(default_factory=list)

    @property
    def stopped(self) -> bool:
        return self.epoch - self.best_epoch >= PATIENCE


@dataclass(frozen=True)
class Training:
    epochs: int = 40
    rate: float = 0.05
    pair_weight: float = PAIR_WEIGHT
    margin: float = MARGIN
    decay: float = DECAY
    balanced: bool = True


def loss_gradient(train: DataFrame, d: int, features: str, state: State, how: Training) -> tuple[list[float], float]:
    """The whole training set's gradient by weights and bias: one pass for the hinge's counts, one for the sums."""
    label = F.col("target").cast("double")
    scored = train.where("target is not null").withColumn("score", linear_score(features, state.weights, state.bias))
    scored = hinge_gradient(scored, how.margin)
    weight = F.col("__class_weight") if how.balanced else F.lit(1.0)
    log_loss = weight * (F.try_divide(F.lit(1.0), 1 + F.exp(-F.col("score"))) - label)
    slope = log_loss / F.col("__n") + how.pair_weight * F.col("pair_gradient")
    told = scored.withColumn("__slope", slope)
    sums = told.agg(F.sum("__slope").alias("b"), *[F.sum(F.col("__slope") * F.coalesce(F.get(features, F.lit(i)), F.lit(0.0))).alias(f"g{i}") for i in range(d)]).first()
    return [(sums[f"g{i}"] or 0.0) for i in range(d)], sums["b"] or 0.0


def adam_step(state: State, gradient: list[float], slope: float, how: Training) -> State:
    """One step on the gradient, cut to the largest norm, at the epoch's cosine rate; decay pulls weights, not the bias."""
    whole = [g + how.decay * w for g, w in zip(gradient, state.weights, strict=True)] + [slope]
    norm = math.sqrt(sum(g * g for g in whole))
    whole = [g * min(1.0, LARGEST_NORM / norm) if norm else 0.0 for g in whole]
    t = state.epoch + 1
    zeros = [0.0] * len(whole)
    mean = [BETA1 * m + (1 - BETA1) * g for m, g in zip(state.mean or zeros, whole, strict=True)]
    square = [BETA2 * v + (1 - BETA2) * g * g for v, g in zip(state.square or zeros, whole, strict=True)]
    rate = how.rate * (1 + math.cos(math.pi * state.epoch / how.epochs)) / 2
    moved = [x - rate * (m / (1 - BETA1**t)) / (math.sqrt(v / (1 - BETA2**t)) + TINY) for x, m, v in zip([*state.weights, state.bias], mean, square, strict=True)]
    return State(moved[:-1], moved[-1], t, mean, square, state.best_auc, state.best_epoch, state.best_weights, state.best_bias, list(state.history))


def judged(state: State, auc: float) -> State:
    """The state after its epoch's AUC on the held month: the best weights so far are kept."""
    if auc > state.best_auc + LEAST_GAIN:
        state.best_auc, state.best_epoch, state.best_weights, state.best_bias = auc, state.epoch, list(state.weights), state.bias
    state.history.append(auc)
    return state


def fit_ranking(train: DataFrame, held: DataFrame, features: str = "features", how: Training | None = None, path: str | None = None) -> State:
    """Trains on ``train`` (features, target), watches the AUC of ``held``, and returns the last state, best weights inside.

    With a path, the state is published there after each epoch; a run under the same settings goes on from it.
    """
    how = how or Training()
    spark, d = train.sparkSession, train.select(F.max(F.size(features))).first()[0] or 0
    weighed = cut_lineage(_class_weights(train.select(features, "target")))
    held = cut_lineage(held.select(features, "target"))
    state = (_resumed(spark, path, how, d) if path else None) or State([0.0] * d)
    while state.epoch < how.epochs and not state.stopped:
        state = adam_step(state, *loss_gradient(weighed, d, features, state, how), how)
        auc = roc_auc(held.withColumn("score", linear_score(features, state.weights, state.bias))).first()
        state = judged(state, auc["auc"] if auc else 0.5)
        if path:
            _kept(spark, path, how, d, state)
    return state


def ranked(df: DataFrame, state: State, features: str = "features") -> DataFrame:
    """Adds ``score``: the probability by the best weights."""
    z = linear_score(features, state.best_weights or state.weights, state.best_bias)
    return df.withColumn("score", F.try_divide(F.lit(1.0), 1 + F.exp(-z)))


def split_last_month(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(earlier months, the held month): the last one whose rows are of both classes, without which there is no AUC to watch;
    where no month but the first is, the last one."""
    months = df.groupBy(month_of().alias("month")).agg(F.min("target").alias("low"), F.max("target").alias("high")).orderBy("month").collect()  # a row a month
    both = [r["month"] for r in months[1:] if r["low"] != r["high"]] or [r["month"] for r in months[-1:]]
    last = both[-1] if both else None
    return df.where(month_of() < last), df.where(month_of() == last)


def _class_weights(train: DataFrame) -> DataFrame:
    """n / (2 n_class) of each row, and n: counts of two classes."""
    known = train.where("target is not null")
    totals = known.agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col("target").cast("double")).alias("__pos"))  # one row
    out = known.join(F.broadcast(totals), how="left")
    own = F.when(F.col("target") > 0, F.col("__pos")).otherwise(F.col("__n") - F.col("__pos"))
    return out.withColumn("__class_weight", F.col("__n") / (2 * own)).drop("__pos")


def _note(how: Training, d: int) -> dict:
    return {**asdict(how), "dimensions": d}


def _kept(spark: SparkSession, path: str, how: Training, d: int, state: State) -> None:
    names = [c.split()[0] for c in SAVED.split(", ")]
    publish(spark.createDataFrame([tuple(getattr(state, n) for n in names)], SAVED), path, _note(how, d))


def _resumed(spark: SparkSession, path: str, how: Training, d: int) -> State | None:
    held = current(spark, path, _note(how, d))
    row = held.first() if held is not None else None
    return State(**row.asDict()) if row else None

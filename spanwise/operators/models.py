"""Models on Spark's ML library: expanding-month validation, several estimators, stacking, blending, importances."""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwise.functions.lineage import cut_lineage, remove, shared_folder
from spanwise.operators.encoding import month_of, temporal_folds
from spanwise.operators.events import KEYS
from spanwise.operators.metrics import roc_auc
from spanwise.operators.prefix import running_sums

LOW, HIGH = 1e-4, 1 - 1e-4


def logistic(columns: list[str], max_iter: int = 100, c: float = 2.0, n_rows: int = 1000) -> Pipeline:
    """Standardised logistic regression; ``c`` is the inverse penalty of a sum of losses, Spark's is of their mean."""
    return _pipeline(columns, LogisticRegression(labelCol="target", maxIter=max_iter, regParam=1 / (c * n_rows), elasticNetParam=0.0))


def mlp(columns: list[str], hidden: tuple[int, ...] = (128, 64), max_iter: int = 100, seed: int = 42) -> Pipeline:
    """Spark's perceptron has sigmoid units only."""
    return _pipeline(columns, MultilayerPerceptronClassifier(labelCol="target", layers=[len(columns), *hidden, 2], maxIter=max_iter, seed=seed))


def boosted(columns: list[str], max_iter: int = 60, depth: int = 6, rate: float = 0.1, subsample: float = 0.8, seed: int = 42, weight: str | None = None, held: str | None = None, tolerance: float = 0.001) -> Pipeline:
    """Gradient-boosted trees, standing in for the three boosting libraries; ``weight`` balances classes, rows marked by
    ``held`` aren't learned but say when to stop: where a further tree lowers their loss by less than the tolerance."""
    trees = GBTClassifier(labelCol="target", featuresCol="raw", maxIter=max_iter, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed, validationTol=tolerance)
    trees = trees.setWeightCol(weight) if weight else trees
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), trees.setValidationIndicatorCol(held) if held else trees])


def forest(columns: list[str], trees: int = 60, depth: int = 8, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), RandomForestClassifier(labelCol="target", featuresCol="raw", numTrees=trees, maxDepth=depth, seed=seed)])


def _pipeline(columns: list[str], last: Estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), last])


class StoppedPerceptron:
    """The perceptron with early stopping, which Spark's has not: fitted in rounds of iterations, each from the weights of the
    one before, until the held rows' AUC hasn't grown for ``patience`` rounds; the best round's weights are the model.

    The model is a pipeline of assembling, scaling and the best perceptron, with ``best_round`` and ``rounds`` beside.
    """

    def __init__(self, columns: list[str], hidden: tuple[int, ...] = (128, 64), rounds: int = 20, iterations: int = 10, patience: int = 2, held: str = "held", seed: int = 42):
        self.columns, self.hidden, self.rounds, self.iterations, self.patience, self.held, self.seed = columns, hidden, rounds, iterations, patience, held, seed

    def fit(self, df: DataFrame) -> PipelineModel:
        before = Pipeline(stages=[VectorAssembler(inputCols=self.columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)]).fit(df.where(~F.col(self.held)))
        train, held = (cut_lineage(before.transform(df.where(x)).select("features", "target")) for x in (~F.col(self.held), F.col(self.held)))
        weights, best, best_auc, best_round, done = None, None, -math.inf, 0, 0
        while done < self.rounds and done - best_round <= self.patience:
            mlp = MultilayerPerceptronClassifier(labelCol="target", layers=[len(self.columns), *self.hidden, 2], maxIter=self.iterations, seed=self.seed)
            model = (mlp.setInitialWeights(weights) if weights is not None else mlp).fit(train)
            weights, done = model.weights, done + 1
            auc = roc_auc(positive_score(model.transform(held))).first()
            if auc and auc["auc"] > best_auc:
                best, best_auc, best_round = model, auc["auc"], done
        fitted = PipelineModel(stages=[*before.stages, best or model])
        fitted.best_round, fitted.rounds = best_round or done, done
        return fitted


def balanced_weights(df: DataFrame, name: str = "weight") -> DataFrame:
    """n / (2 n_class) for each row: class counts are two numbers."""
    counts = df.groupBy("target").agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    return df.join(F.broadcast(counts), "target").join(F.broadcast(total), how="left").withColumn(name, F.col("__all") / (2 * F.col("__n"))).drop("__n", "__all")


def with_held_month(rows: DataFrame, name: str = "held") -> DataFrame:
    """Marks the rows of the last month, on which early stopping looks; of a single month's rows, a hashed tenth."""
    ends = rows.agg(F.min(month_of()).alias("first"), F.max(month_of()).alias("last")).first()
    if ends["first"] == ends["last"]:
        return rows.withColumn(name, F.pmod(F.xxhash64(*KEYS), F.lit(10)) == 0)
    return rows.withColumn(name, month_of() == ends["last"])


def positive_score(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("score", vector_to_array("probability")[1])


def at_once(work: list[Callable[[], object]], threads: int) -> list:
    """What each piece of work returns, in order, at most ``threads`` of them running at a time.

    Jobs of a thread go to a scheduler pool of its own, so that with fair scheduling none waits for the others' stages;
    the caller's job properties hold inside.
    """
    if threads <= 1 or len(work) <= 1:
        return [w() for w in work]
    session = SparkSession.active()
    context = session.sparkContext

    def run(i: int, w: Callable[[], object]) -> object:
        context.setLocalProperty("spark.scheduler.pool", f"at-once-{i % threads}")
        return w()

    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(session)(run), i, w) for i, w in enumerate(work)]]


@dataclass(frozen=True)
class Fold:
    """A month, the model of all earlier months, and the month's rows (keys, target, score, fold) scored by it."""

    month: str
    model: PipelineModel
    scores: DataFrame


Prepare = Callable[[DataFrame, DataFrame], DataFrame]


def fit_folds(df: DataFrame, estimator: Callable[[], Estimator], folds: int = 4, prepare: Prepare | None = None, arrange: Callable[[DataFrame], DataFrame] | None = None, threads: int = 1) -> list[Fold]:
    """Each of the last months with a model of all earlier ones, several fitted at once if ``threads`` says so.

    ``prepare(train, rows)`` adds columns that depend on the target, fitted on the training months alone; ``arrange`` adds
    what only fitting needs to the training rows (class weights, rows that are held for early stopping).
    """
    prepare = prepare or (lambda train, rows: rows)
    arrange = arrange or (lambda rows: rows)

    def one(month: str) -> Fold:
        train, held = df.where(month_of() < month), df.where(month_of() == month)
        model = estimator().fit(arrange(prepare(train, train)))
        return Fold(month, model, positive_score(model.transform(prepare(train, held))).select(*KEYS, "target", "score", F.lit(month).alias("fold")))

    months = temporal_folds(df, folds)
    if not months:
        raise ValueError("fewer than two months")
    return at_once([lambda m=m: one(m) for m in months], threads)


def cross_validate(df: DataFrame, estimator: Callable[[], Estimator], folds: int = 4, prepare: Prepare | None = None, refit: bool = False, arrange: Callable[[DataFrame], DataFrame] | None = None, threads: int = 1) -> tuple[DataFrame, PipelineModel | None]:
    """Out-of-fold scores (keys, target, score, fold), and a model of all rows where ``refit`` asks for it; see ``fit_folds``."""
    scored = reduce(DataFrame.unionByName, [f.scores for f in fit_folds(df, estimator, folds, prepare, arrange, threads)])
    whole = (prepare or (lambda train, rows: rows))(df, df) if refit else None
    return scored, estimator().fit(arrange(whole) if arrange else whole) if refit else None


def kept_trees(model: PipelineModel) -> int:
    """How many trees a fitted ensemble has: fewer than its maximum where early stopping ended it."""
    return model.stages[-1].getNumTrees


def grid_search(df: DataFrame, make: Callable[..., Estimator], grid: list[dict], folds: int = 4, threads: int = 1) -> tuple[dict, float]:
    """The parameters with the best overall out-of-fold AUC; of equals the last. Parameter sets are fitted ``threads`` at a
    time, and all of them are judged in one pass."""
    if not grid:
        raise ValueError("the grid is empty")
    df = cut_lineage(df)
    scored = at_once([lambda i=i, p=p: cross_validate(df, lambda: make(**p), folds)[0].select("target", "score", F.lit(i).alias("i")) for i, p in enumerate(grid)], threads)
    best = max(roc_auc(reduce(DataFrame.unionByName, scored), ("i",)).collect(), key=lambda r: (r["auc"], r["i"]))
    return grid[best["i"]], best["auc"]


def _joined_scores(parts: dict[str, DataFrame], target: bool) -> DataFrame:
    frames = [df.select(*KEYS, *(["target"] if target and i == 0 else []), F.col("score").alias(name)) for i, (name, df) in enumerate(parts.items())]
    return reduce(lambda a, b: a.join(b, KEYS), frames).fillna(0.0, subset=list(parts))


def fit_stack(parts: dict[str, DataFrame], c: float = 0.5) -> PipelineModel:
    """Logistic regression over several models' scores, joined by key."""
    joined = cut_lineage(_joined_scores(parts, True))
    return logistic(list(parts), c=c, n_rows=joined.count()).fit(joined)


def stack_scores(model: PipelineModel, parts: dict[str, DataFrame]) -> DataFrame:
    """Keys, target where the first part has one, one column a model and ``score``."""
    target = "target" in next(iter(parts.values())).columns
    return positive_score(model.transform(_joined_scores(parts, target))).select(*KEYS, *(["target"] if target else []), *parts, "score")


def stack(parts: dict[str, DataFrame], c: float = 0.5) -> DataFrame:
    return stack_scores(fit_stack(parts, c), parts)


def clipped(score: Column) -> Column:
    return F.greatest(F.least(score, F.lit(HIGH)), F.lit(LOW))


def best_candidate(candidates: dict[str, DataFrame]) -> tuple[str, float, DataFrame]:
    """The candidate with the highest AUC, with scores clipped away from 0 and 1; those without a known AUC are passed over."""
    aucs = {n: roc_auc(df).first()["auc"] for n, df in candidates.items() if df is not None}
    name = max(sorted(aucs), key=lambda n: aucs[n])
    return name, aucs[name], candidates[name].withColumn("score", clipped(F.col("score")))


def blend(first: DataFrame, second: DataFrame, steps: int = 20) -> tuple[float, float]:
    """The weight of the first in a weighted mean of two scores that maximises AUC, on a grid; all weights in one pass."""
    both = first.select(*KEYS, "target", F.col("score").alias("a")).join(second.select(*KEYS, F.col("score").alias("b")), KEYS)
    weights = F.explode(F.array(*[F.lit(i / steps) for i in range(steps + 1)])).alias("w")
    rows = both.select("target", "a", "b", weights).select("w", "target", (F.col("w") * F.col("a") + (1 - F.col("w")) * F.col("b")).alias("score"))
    best = max(roc_auc(rows, ("w",)).collect(), key=lambda r: (r["auc"], -r["w"]))
    return best["w"], best["auc"]


def permutation_importance(model: PipelineModel, df: DataFrame, columns: list[str], repeats: int = 3, seed: int = 0) -> DataFrame:
    """feature, gain, spread: the AUC lost when the column is shuffled, its mean and deviation over repeats, largest first.

    Rows are numbered once in a hashed order. A repeat's shuffle gives row i the values of row (a i + b) mod n, with a and n
    coprime; one shuffle serves all columns, each of which is replaced by itself after the join. So rows meet once a repeat,
    and all columns and repeats are one scoring and one AUC by (repeat, column).
    """
    numbered = cut_lineage(running_sums(df.select("target", *columns, F.xxhash64(F.lit(seed), *KEYS).alias("__h")), [F.col("__h")], {"__i": F.lit(1)}).drop("__h"))
    n, rng = numbered.count(), random.Random(seed)
    shuffles = []
    for k in range(repeats):
        a = rng.randrange(1, max(2, n))
        while math.gcd(a, n) != 1:
            a = a % n + 1
        shuffles.append((k, a, rng.randrange(max(1, n))))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).cast("decimal(38,0)").alias("a"), F.lit(b).alias("b")) for k, a, b in shuffles])).alias("__s")
    rows = numbered.select("*", each).withColumn("__j", F.pmod(F.col("__s.a") * F.col("__i") + F.col("__s.b"), F.lit(n)).cast("long"))
    other = numbered.select(F.col("__i").alias("__j"), *[F.col(c).alias(f"__{c}") for c in columns])
    variant = lambda i: F.struct(F.lit(i).alias("c"), *[F.col(f"__{c}" if i == j else c).alias(c) for j, c in enumerate(columns)])
    met = rows.join(other, "__j").select("target", F.col("__s.k").alias("k"), F.explode(F.array(*[variant(i) for i in range(len(columns))])).alias("v"))
    base = roc_auc(positive_score(model.transform(df))).first()["auc"]
    aucs = roc_auc(positive_score(model.transform(met.select("k", "target", "v.*"))), ("k", "c"))
    lost = aucs.groupBy("c").agg(F.avg(F.lit(base) - F.col("auc")).alias("gain"), F.stddev_pop("auc").alias("spread"))
    return lost.select(F.element_at(F.array(*map(F.lit, columns)), F.col("c") + 1).alias("feature"), "gain", "spread").orderBy(F.desc("gain"), "feature")


def channel_ablation(score: Callable[[DataFrame], DataFrame], df: DataFrame, channels: list[str]) -> dict[str, float]:
    """The AUC lost when an array column is set to zeros, for each channel."""
    return {c: lost for c, lost, _ in ablated(score, df, channels)}


def silenced(df: DataFrame, channel: str) -> DataFrame:
    """The rows with an array column set to zeros."""
    return df.withColumn(channel, F.transform(channel, lambda x: x * 0))


def ablated(score: Callable[[DataFrame], DataFrame], df: DataFrame, channels: list[str], without: Callable[[DataFrame, str], DataFrame] = silenced) -> list[tuple[str, float, float]]:
    """(channel, AUC lost, AUC without it) for each channel; the scorer may be any fitted model.

    ``without`` gives the rows that lack a channel; where the scorer's inputs are derived from the channels at a cost, pass
    derived rows and what a silent channel derives to. All variants go through one AUC.
    """
    variants = [df, *[without(df, c) for c in channels]]
    scored = [score(v).select("target", "score", F.lit(i).alias("variant")) for i, v in enumerate(variants)]
    aucs = {r["variant"]: r["auc"] for r in roc_auc(reduce(DataFrame.unionByName, scored), ("variant",)).collect()}
    base, *left = (aucs.get(i, 0.5) for i in range(len(variants)))
    return [(c, base - auc, auc) for c, auc in zip(channels, left, strict=True)]


def tree_nodes(model: PipelineModel, columns: list[str]) -> DataFrame:
    """tree, node, feature, gain, n_rows, weighed: a row for each split of a fitted ensemble, from the file of its nodes.

    ``weighed`` is the gain times the rows that it was reached by, as a share of the tree's sum.
    """
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/nodes-{uuid.uuid4().hex}"
    model.stages[-1].write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    reached = F.aggregate("impurityStats", F.lit(0.0), lambda s, x: s + x) if model.stages[-1].hasParam("numTrees") else F.col("rawCount").cast("double")
    splits = nodes.where("leftChild >= 0").select(F.col("treeID").alias("tree"), F.col("id").alias("node"), F.element_at(F.array(*map(F.lit, columns)), F.col("split.featureIndex") + 1).alias("feature"), "gain", reached.alias("n_rows"))
    out = cut_lineage(splits.withColumn("weighed", F.col("gain") * F.col("n_rows") / F.sum(F.col("gain") * F.col("n_rows")).over(Window.partitionBy("tree"))))  # a tree's nodes are few
    remove(spark, path)
    return out


def split_importance(nodes: DataFrame) -> DataFrame:
    """feature, gain (mean share over trees), total_gain, splits: how much, and how often, each feature splits."""
    trees = nodes.agg(F.countDistinct("tree").alias("n_trees"))  # one row
    found = nodes.groupBy("feature").agg(F.sum("weighed").alias("weighed"), F.sum("gain").alias("total_gain"), F.count(F.lit(1)).alias("splits"))
    return found.join(F.broadcast(trees), how="left").select("feature", (F.col("weighed") / F.col("n_trees")).alias("gain"), "total_gain", "splits")


def importance_table(model: PipelineModel, columns: list[str]) -> DataFrame:
    """feature, gain: importances of trees, or absolute coefficients over the scaler's deviations."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    else:
        scale = next((s.std.toArray() for s in model.stages if hasattr(s, "std")), None)
        coefficients = last.coefficients.toArray()
        values = abs(coefficients) if scale is None else [abs(c) / s if s else 0.0 for c, s in zip(coefficients, scale, strict=True)]
    return SparkSession.active().createDataFrame([(c, float(v)) for c, v in zip(columns, values, strict=True)], "feature string, gain double")

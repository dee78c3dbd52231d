"""Kernels, ranking, early stopping, node tables and parallel folds, against plain Python."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.operators import kernels as K
from spanwise.operators import metrics as R
from spanwise.operators import models as ML
from spanwise.operators import ranking as RK

KEYS = "airport_group string, date date, hour int"


def plain_kernels(xs):
    """(largest, above) of each dilation and kernel, tap by tap."""
    out = []
    for d in K.DILATIONS:
        for a, b in K.KERNELS:
            at = lambda i: xs[i] if 0 <= i < len(xs) else 0
            ys = [sum((3 if k in (a, b) else -2) * at(i + (k - 2) * d) for k in range(5)) for i in range(len(xs))]
            out.append((max(ys, default=0), sum(y > 0 for y in ys)))
    return out


def test_kernels_tap_by_tap(spark):
    rng = random.Random(1)
    rows = [[rng.randrange(4) for _ in range(n)] for n in (1, 5, 33, 60, 60)] + [[], None, [1, None, 2]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x array<long>")
    for r in df.select("i", K.kernel_features(F.col("x")).alias("k")).collect():
        want = plain_kernels([v or 0 for v in rows[r["i"]] or []])
        assert list(zip(r["k"]["largest"], r["k"]["above"], strict=True)) == want


def test_kernel_vector(spark):
    df = spark.createDataFrame([(1, [0, 2, 1], None), (2, [], [1])], "i int, a array<long>, b array<long>")
    names = K.feature_names(["a", "b"])
    for r in K.with_kernels(df, ["a", "b"]).collect():
        want = [x for xs in (r["a"], r["b"]) for largest, above in plain_kernels(xs or []) for x in (largest, above / max(1, len(xs or [])))]
        assert list(r["kernels"]) == want and len(names) == len(want)
    assert K.with_kernels(df.limit(0), ["a", "b"]).collect() == []


@pytest.mark.parametrize("margin", [0.0, 0.25])
def test_hinge_gradient_of_all_pairs(spark, margin):
    rng = random.Random(2)
    rows = [(i, rng.randrange(12) / 8, rng.random() < 0.4) for i in range(200)]
    df = spark.createDataFrame([(i, s, int(t)) for i, s, t in rows] + [(999, 0.5, None)], "i int, score double, target int")
    pos, neg = [s for _, s, t in rows if t], [s for _, s, t in rows if not t]
    got = {r["i"]: r["pair_gradient"] for r in RK.hinge_gradient(df, margin).collect()}
    for i, s, t in rows:
        want = -sum(n - s + margin > 0 for n in neg) if t else sum(s - p + margin > 0 for p in pos)
        assert abs(got[i] - want / (len(pos) * len(neg))) < 1e-12
    assert got[999] == 0.0 and len(got) == 201


def test_hinge_of_one_class_has_no_gradient(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (2, 0.1, 1)], "i int, score double, target int")
    assert {r["pair_gradient"] for r in RK.hinge_gradient(df).collect()} == {0.0}


def months(spark, n=3, per=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for m in range(n):
        for i in range(per):
            x, y = rng.gauss(0, 1), rng.gauss(0, 1)
            rows.append(("G" + str(i % 3), date(2024, 1 + m, 1) + timedelta(days=i // 24), i % 24, int(x + y / 2 + rng.gauss(0, 0.5) > 0.3), x, y))
    return spark.createDataFrame(rows, KEYS + ", target int, x double, y double").withColumn("features", F.array("x", "y"))


def test_whole_gradient_by_numpy(spark):
    """Weighted log loss and hinge together, at weights that aren't zero."""
    df = months(spark, 1, 80)
    rows = df.collect()
    x, t = np.array([[r["x"], r["y"]] for r in rows]), np.array([r["target"] for r in rows])
    state, how = RK.State([0.3, -0.2], 0.1), RK.Training(margin=0.1)
    s = x @ state.weights + state.bias
    slope = np.where(t == 1, 1 / (2 * t.mean()), 1 / (2 * (1 - t.mean()))) * (1 / (1 + np.exp(-s)) - t) / len(t)
    wrong = (s[t == 0][None, :] - s[t == 1][:, None] + how.margin) > 0
    slope[t == 1] -= how.pair_weight * wrong.sum(axis=1) / wrong.size
    slope[t == 0] += how.pair_weight * wrong.sum(axis=0) / wrong.size
    gradient, bias = RK.loss_gradient(RK._class_weights(df), 2, "features", state, how)
    assert np.allclose(gradient, slope @ x) and abs(bias - slope.sum()) < 1e-12


def test_training_ranks_and_goes_on_after_a_stop(spark, tmp_path):
    train, held = RK.split_last_month(months(spark))
    path = str(tmp_path / "state")
    RK.fit_ranking(train, held, how=RK.Training(epochs=4, rate=0.2), path=path)
    short = RK.fit_ranking(train, held, how=RK.Training(epochs=4, rate=0.2))
    again = RK.fit_ranking(train, held, how=RK.Training(epochs=4, rate=0.2), path=path)  # all epochs are there: nothing is fitted
    assert again.epoch == short.epoch == 4 and np.allclose(again.weights, short.weights)
    assert R.roc_auc(RK.ranked(held, short)).first()["auc"] > 0.9
    assert short.best_epoch >= 1 and short.history[short.best_epoch - 1] == short.best_auc


def test_early_stop_keeps_the_best_weights():
    state = RK.State([1.0])
    for epoch, auc in enumerate([0.6, 0.8, 0.8, 0.7, 0.75, 0.7, 0.7], 1):
        state.epoch, state.weights = epoch, [float(epoch)]
        state = RK.judged(state, auc)
    assert state.stopped and state.best_epoch == 2 and state.best_weights == [2.0]


def test_threads_give_the_same_scores(spark):
    df = months(spark, 4).drop("features")
    make = lambda: ML.logistic(["x", "y"], 10)
    one, two = (sorted(map(str, ML.cross_validate(df, make, 3, threads=n)[0].collect())) for n in (1, 3))
    assert one == two and len(one) == 180
    assert ML.at_once([lambda i=i: i * i for i in range(7)], 3) == [i * i for i in range(7)]
    grid = [{"trees": 2, "depth": 1}, {"trees": 4, "depth": 3}]
    forest = lambda trees, depth: ML.forest(["x", "y"], trees, depth)
    assert ML.grid_search(df, forest, grid, 1) == ML.grid_search(df, forest, grid, 1, threads=2)
    with pytest.raises(ValueError):
        ML.grid_search(df, forest, [])


def test_early_stopping_keeps_fewer_trees(spark):
    df = months(spark, 3)
    make = lambda: ML.boosted(["x", "y"], 20, 3, weight="weight", held="held")
    (fold,) = ML.fit_folds(df, make, 1, arrange=lambda rows: ML.with_held_month(ML.balanced_weights(rows)))
    assert 1 <= ML.kept_trees(fold.model) < 20
    marked = ML.with_held_month(df)
    assert {r["date"].month for r in marked.where("held").collect()} == {3}
    alone = ML.with_held_month(df.where("month(date) = 1"))
    assert 0 < alone.where("held").count() < 30


def test_node_table_sums_to_the_model_s_importances(spark):
    df = months(spark, 1, 120)
    model = ML.forest(["x", "y"], 5, 3).fit(df)
    nodes = ML.tree_nodes(model, ["x", "y"])
    found = {r["feature"]: r for r in ML.split_importance(nodes).collect()}
    whole = sum(r["gain"] for r in found.values())
    for name, value in zip(["x", "y"], model.stages[-1].featureImportances.toArray(), strict=True):
        assert abs(found[name]["gain"] / whole - value) < 1e-9
    trees = model.stages[-1].trees
    assert sum(r["splits"] for r in found.values()) == nodes.count() == sum((t.numNodes - 1) // 2 for t in trees)
    boosted = ML.tree_nodes(ML.boosted(["x", "y"], 3, 2).fit(df), ["x", "y"])
    assert boosted.select("tree").distinct().count() == 3 and boosted.where("gain <= 0 or n_rows <= 0").count() == 0


def test_permutation_importance_is_sorted_with_its_spread(spark):
    df = months(spark, 1, 120).drop("features").withColumn("z", F.lit(1.0))
    got = ML.permutation_importance(ML.logistic(["x", "y", "z"], 20).fit(df), df, ["x", "y", "z"]).collect()
    assert [r["feature"] for r in got] == ["x", "y", "z"] and got[0]["gain"] > got[1]["gain"] > 0
    assert abs(got[2]["gain"]) < 1e-12 and got[0]["spread"] > 0 and got[2]["spread"] < 1e-12


def test_month_report(spark):
    df = months(spark, 2).withColumn("score", F.col("x"))
    got = {r["month"]: r for r in R.month_report(df).collect()}
    assert set(got) == {"2024-01", "2024-02", "all"} and got["all"]["n"] == 120
    for year, month in ((2024, 1), (2024, 2)):
        assert abs(got[f"{year}-{month:02d}"]["auc"] - R.month_auc(df, year, month)) < 1e-12

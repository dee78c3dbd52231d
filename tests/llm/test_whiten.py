"""Whitening against numpy's eigenvectors of the whole covariance."""

import math

import numpy as np
import pytest

from spanwise.llm import whiten
from tests.llm.helpers import rows

SCHEMA = "vec_id long, embedding array<float>, label int, n string, x double"


def table_of(spark, vectors, ids=None):
    data = [(i if ids is None else ids[i], v, i % 3, "clash", 0.5) for i, v in enumerate(vectors)]
    return spark.createDataFrame(data, SCHEMA)


def plain(vectors, top=4):
    """Per row the exact deviation and the whitened values (of either sign), and each component's share."""
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), dtype=np.float64)
    n, sums = len(fit), [sum(int(v) for v in col) for col in zip(*sorted(set(map(tuple, x))), strict=True)]
    z = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:top], vectors[:, ::-1][:, :top]
    dev = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, dev, (np.array(x) - fit.mean(axis=0)) @ vectors / np.sqrt(values), values / np.square(z).sum() * n


def check(got, vectors, tolerance=1e-9):
    n, dev, white, share = plain(vectors)
    k = white.shape[1]
    assert len(got) == len(vectors) * k
    got = sorted(got, key=lambda r: (r["component"], r["vec_id"]))
    for c in range(k):
        own = got[c * len(vectors) : (c + 1) * len(vectors)]
        assert [r["component"] for r in own] == [c + 1] * len(own)
        assert [r["n"] for r in own] == [n] * len(own) and [r["deviation"] for r in own] == dev
        mine = np.array([r["whitened"] for r in own])
        sign = np.sign(mine @ white[:, c])
        assert np.abs(mine * sign - white[:, c]).max() < tolerance
        assert all(abs(r["explained"] / share[c] - 1) < 1e-9 for r in own)
        assert all(r["identity_error"] < 1e-9 for r in own)


def test_alike_in_every_direction(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 0.125, (400, 32)).astype(np.float32).tolist()
    check(rows(whiten.whiten(table_of(spark, vectors + vectors[:40]))), vectors + vectors[:40])


def test_a_few_directions_need_no_whole_covariance(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(0, 1, (300, 5)) * [9, 5, 3, 2, 1] @ rng.normal(0, 1, (5, 40))).astype(np.float32).tolist()
    check(rows(whiten.whiten(table_of(spark, vectors))), vectors)


def test_how_far_it_widens(spark):
    rng = np.random.default_rng(3)

    def width(vectors):
        fit = spark.createDataFrame([([int(v) for v in row],) for row in vectors], "x array<long>")
        x = np.array(vectors, dtype=np.float64)
        return whiten.leading_components(fit, x.mean(axis=0), len(x))[3]

    low = np.floor(rng.normal(0, 4, (200, 3))).astype(int) @ rng.integers(-3, 4, (3, 40))
    assert width(low.tolist()) == whiten.COMPONENTS + whiten.OVERSAMPLE
    assert width(np.floor(rng.normal(0, 40, (200, 40))).tolist()) == 40


def test_bad_vectors_have_no_result(spark):
    vectors = [[1.0, 2.0], None, [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [0.5, -0.25], [3.0, 1.0], [], [1.0], [0.5, -0.25]]
    got = rows(whiten.whiten(table_of(spark, vectors)))
    assert {r["vec_id"] for r in got} == {0, 5, 6, 9}
    keep = [0, 5, 6, 9]
    x = [[math.floor(256 * c) for c in vectors[i]] for i in keep]
    sums = [sum(c) for c in zip(*x[:3], strict=True)]
    want = {i: sum((3 * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for i, row in zip(keep, x, strict=True)}
    assert {r["vec_id"]: r["deviation"] for r in got} == want and len(got) == 8


def test_null_ids_and_repeats_stay(spark):
    vectors = np.random.default_rng(4).normal(0, 1, (20, 6)).astype(np.float32).tolist()
    got = rows(whiten.whiten(table_of(spark, vectors, [None, None, *[7] * 18])))
    assert len(got) == 80 and sum(r["vec_id"] is None for r in got) == 8


@pytest.mark.parametrize("vectors", [[], [None], [[]]])
def test_nothing_to_fit(spark, vectors):
    assert rows(whiten.whiten(table_of(spark, vectors))) == []


def test_no_variance(spark):
    got = rows(whiten.whiten(table_of(spark, [[1.0, 2.0, 3.0]] * 5)))
    assert len(got) == 15 and {(r["whitened"], r["deviation"], r["explained"]) for r in got} == {(None, 0, 0.0)}
    line = rows(whiten.whiten(table_of(spark, [[float(i), 2.0 * i, 0.0] for i in range(6)])))
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line)


def test_huge_entries(spark):
    got = rows(whiten.whiten(table_of(spark, [[3e38, 0.0], [-3e38, 1.0], [0.0, 2.0]])))
    assert len(got) == 6 and all((r["deviation"] is None) == (r["vec_id"] < 2) for r in got)

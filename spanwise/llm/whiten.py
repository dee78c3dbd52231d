"""Whitening of embeddings: a randomised range finder over all centred rows, then Rayleigh-Ritz.

A few random directions, more than the components asked for, are multiplied by the covariance again and again and made
orthonormal after each pass; what they span then holds the leading components, if the spectrum falls fast enough. Whether
it does is measured: the covariance within the span gives candidate components (Rayleigh-Ritz), and each must be an
eigenvector of the whole covariance but for rounding. Where one isn't, as with embeddings that vary alike in every
direction, the span is widened to all dimensions and the same step gives every component exactly.

The covariance itself is only ever multiplied: a pass reads the fit list's rows in Arrow batches, centres each and adds up
``z (z Q)`` inside a task. Of a task there remain as many rows as the vectors have dimensions, which are summed on the
executors; the driver sees matrices of dimensions times directions, whatever the number of rows. The fit
list (each distinct vector once, from a grouping that combines on the map side, so a vector that a third of the rows
share is one row) is checkpointed and read by every pass, so a lost executor repeats its own batches.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry have no result; nor have vectors of
another length than most distinct vectors have (of equally frequent lengths the least), and empty ones; repeated rows
have repeated results and a null vec_id stays; entries beyond a long's range stop at its ends; where all variance lies in
fewer directions than components, ``whitened`` is null for those without; ``deviation`` is null where it exceeds a long;
of a table without usable vectors there are no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.lineage import cut_lineage
from spanwise.llm.common import bounded_batches

COMPONENTS, SCALE = 4, 256
OVERSAMPLE, POWER_PASSES = 8, 2
#: A component's residual against the largest eigenvalue. Beyond it the range finder hasn't found the component.
RESIDUAL = 1e-13
SEED = 20
#: Columns of a block of partial sums.
WIDTH = 64


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) of each entry, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def _matrix(column: pa.ListArray | pa.ChunkedArray, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(rows: DataFrame, make) -> np.ndarray:
    """The sum over all rows of the matrix that ``make`` gives for a batch of x, to the driver.

    A task leaves each row of its sum as blocks of ``WIDTH`` columns, which add up on the executors, a block a row.
    """
    names = [f"v{j}" for j in range(WIDTH)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(batch.column(0))
                total = part if total is None else total + part
        for block in range(0 if total is None else -(-total.shape[1] // WIDTH)):
            own = total[:, block * WIDTH : (block + 1) * WIDTH]
            own = np.pad(own, ((0, 0), (0, WIDTH - own.shape[1])))
            at = [pa.array(np.arange(len(own), dtype=np.int32)), pa.array(np.full(len(own), block, dtype=np.int32)), pa.array(np.full(len(own), total.shape[1], dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*at, *[pa.array(c) for c in own.T]], names=["i", "block", "width", *names])

    parts = bounded_batches(rows).mapInArrow(partial, "i int, block int, width int, " + ", ".join(f"{n} double" for n in names))
    sums = parts.groupBy("i", "block", "width").agg(*[F.sum(n).alias(n) for n in names]).collect()  # dimensions times directions
    out = np.zeros((1 + max(r["i"] for r in sums), WIDTH * (1 + max(r["block"] for r in sums))))
    for r in sums:
        out[r["i"], r["block"] * WIDTH : (r["block"] + 1) * WIDTH] = r[3:]
    return out[:, : sums[0]["width"]]


def dimension_sums(fit: DataFrame, d: int) -> list[int]:
    """The exact sum of each dimension over all rows: a row a dimension of each task, added up as decimals."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            wide = len(x) and float(np.abs(x.astype(np.float64)).max()) * len(x) >= 2.0**62
            total = [t + int(s) for t, s in zip(total, (x.astype(object) if wide else x).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "s": pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))})

    parts = bounded_batches(fit).mapInArrow(partial, "i int, s decimal(38,0)")
    return [int(r["s"]) for r in parts.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()]  # a row a dimension


def covariance_times(fit: DataFrame, mean: np.ndarray, n: int, q: np.ndarray) -> tuple[np.ndarray, float]:
    """V q for the fit list's covariance V, and the trace of V, in one pass over the rows."""
    d, k = q.shape

    def make(column: pa.Array) -> np.ndarray:
        z = _matrix(column, d) - mean
        out = np.zeros((d + 1, k))
        out[:d] = z.T @ (z @ q)
        out[d, 0] = np.square(z).sum()
        return out

    sums = _summed(fit, make)
    return sums[:d] / n, float(sums[d, 0]) / n


def leading_components(fit: DataFrame, mean: np.ndarray, n: int, components: int = COMPONENTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Eigenvectors (as columns) and eigenvalues of the covariance, largest first, its trace, and how many directions it took.

    Of either sign of a component, that with its largest entry above zero is taken.
    """
    d = len(mean)
    wanted = min(components, d)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, wanted + OVERSAMPLE))))[0]
    for _ in range(POWER_PASSES if q.shape[1] < d else 0):
        q = np.linalg.qr(covariance_times(fit, mean, n, q)[0])[0]
    while True:
        image, trace = covariance_times(fit, mean, n, q)
        inside = q.T @ image
        values, turned = np.linalg.eigh((inside + inside.T) / 2)
        values, turned = values[::-1][:wanted], turned[:, ::-1][:, :wanted]
        vectors = q @ turned
        residual = np.linalg.norm(image @ turned - vectors * values, axis=0).max(initial=0.0)
        if q.shape[1] == d or residual <= RESIDUAL * max(values[0], 0.0):
            break
        q = np.eye(d)
    flip = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)])
    return vectors * np.where(flip == 0, 1.0, flip), values, trace, q.shape[1]


def whitened_identity_error(fit: DataFrame, mean: np.ndarray, n: int, scaled: np.ndarray) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, measured over its rows."""
    d, k = scaled.shape

    def make(column: pa.Array) -> np.ndarray:
        w = (_matrix(column, d) - mean) @ scaled
        return w.T @ w

    sums = _summed(fit, make)
    return float(np.abs(sums / n - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """sum (n x - S)^2 of each row, exactly; null beyond a long. Rows that may leave 64 bits on the way take Python's integers."""
    estimate = np.square(n * x.astype(np.float64) - sums.astype(np.float64)).sum(axis=1)
    reach = np.abs(n * x.astype(np.float64)).max(axis=1, initial=0.0) + float(np.abs(sums.astype(np.float64)).max(initial=0.0))
    safe = (estimate < 2.0**62) & (reach < 2.0**62)
    out: list[int | None] = [None] * len(x)
    gap = n * x[safe] - sums
    for i, value in zip(np.flatnonzero(safe), (gap * gap).sum(axis=1), strict=True):
        out[i] = int(value)
    for i in np.flatnonzero(~safe):
        value = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True))
        out[i] = value if value < 1 << 63 else None
    return out


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A row for each usable vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    kind = dict(embeddings.dtypes)[key]
    schema = f"`{key}` {kind}, {RESULT}"
    rows = embeddings.where(usable(F.col(vector))).select(key, whole(F.col(vector)).alias("x")).where(F.size("x") > 0)
    fit = cut_lineage(rows.select("x").distinct())
    length = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()  # a row for each length
    if length is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    d, n = length["d"], length["count"]
    fit = fit.where(F.size("x") == d)
    exact = dimension_sums(fit, d)
    mean = np.array([s / n for s in exact])
    vectors, values, trace, _ = leading_components(fit, mean, n, components)
    there = values > d * np.finfo(float).eps * max(values[0], 0.0)
    scaled = vectors[:, there] / np.sqrt(values[there])
    error = whitened_identity_error(fit, mean, n, scaled) if there.any() else 0.0
    share = [float(max(v, 0.0) / trace) if trace > 0 else 0.0 for v in values]
    fits = all(abs(s) < 1 << 62 for s in exact)
    sums = np.array(exact if fits else [0] * d, dtype=np.int64)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), d)
            w = np.full((len(x), k), np.nan)
            w[:, there] = (x - mean) @ scaled
            white = pa.array(w.ravel(), from_pandas=True)  # NaN, where a component has no variance, becomes null
            gaps = _deviations(x, n, sums) if fits else [None] * len(x)
            again = np.repeat(np.arange(len(x)), k)
            m = len(again)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, n)), pa.array(gaps, pa.int64()).take(pa.array(again)), white, pa.array(np.tile(share, len(x))), pa.array(np.full(m, error))],
                names=[key, *[c.split()[0] for c in RESULT.split(", ")]],
            )

    return bounded_batches(rows.where(F.size("x") == d)).mapInArrow(results, schema)

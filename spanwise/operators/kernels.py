"""Dilated convolution kernels over sequences of counts, pooled to features that a linear model can use.

A fixed family of kernels stands in for learned convolutions: of five taps two weigh 3 and three weigh -2, in all ten ways,
at dilations 1, 2, 4 and 8, so each kernel sums to zero and responds to a shape, not to a level. Of a kernel's responses
two numbers are kept, the largest and how many are above zero. Nothing is learned here, so the features of a row depend on
that row alone: no shuffle and no fitting; what is learned is the weight of each feature.

The convolutions are numpy over Arrow batches: 120 kernels over 180 places are some 300,000 steps a row, which took 25 ms
of a core as higher-order functions and takes well under a tenth of one as whole-batch arithmetic.

Defined results: taps beyond either end are 0; a null entry counts as 0; an empty or null sequence gives 0 for both numbers.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAPS, CHOSEN = 5, 2
HIGH, LOW = 3, -2
DILATIONS = (1, 2, 4, 8)
KERNELS = list(itertools.combinations(range(TAPS), CHOSEN))
ROWS = 512  # sequences that are worked on at a time: few enough to stay in a core's cache


def pooled(rows: np.ndarray, dilations: tuple[int, ...] = DILATIONS) -> np.ndarray:
    """For rows x places of counts: rows x dilations x kernels x (largest response, number above zero)."""
    n, places = rows.shape
    largest = max(int(rows.max(initial=0)), -int(rows.min(initial=0)))
    reach = (HIGH - LOW) * CHOSEN + abs(LOW) * TAPS  # no step of a response goes beyond this many times the largest count
    kind = next((t for t in (np.int16, np.int32) if largest * reach <= np.iinfo(t).max), np.int64)
    across = np.ascontiguousarray(rows.T, dtype=kind)  # places x rows: every step is over whole lines of rows
    counted = np.int16 if places <= np.iinfo(np.int16).max else np.int64
    out = np.zeros((n, len(dilations), len(KERNELS), 2), dtype=np.int64)
    for i, d in enumerate(dilations if places else ()):
        wide = np.pad(across, ((d * (TAPS // 2), d * (TAPS // 2)), (0, 0)))
        taps = [wide[d * k : d * k + places] for k in range(TAPS)]
        low = LOW * sum(taps[1:], taps[0])
        for j, (a, b) in enumerate(KERNELS):
            response = (HIGH - LOW) * (taps[a] + taps[b]) + low  # a chosen tap adds the difference to the low weight that all have
            out[:, i, j, 0], out[:, i, j, 1] = response.max(axis=0), np.add.reduce(response > 0, axis=0, dtype=counted)
    return out


def _numbers(sequence: np.ndarray | None) -> np.ndarray:
    if sequence is None:
        return np.zeros(0, np.int64)
    given = np.asarray(sequence)
    return given.astype(np.int64, copy=False) if given.dtype.kind == "i" else np.nan_to_num(given.astype(np.float64)).astype(np.int64)


def _of_series(sequences: pd.Series, dilations: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """``pooled`` of sequences of any lengths, equal ones together, and their lengths."""
    lists = [_numbers(s) for s in sequences]
    lengths = np.array([len(x) for x in lists], dtype=np.int64)
    out = np.zeros((len(lists), len(dilations), len(KERNELS), 2), dtype=np.int64)
    for length in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == length)
        for part in np.array_split(at, -(-len(at) // ROWS)):
            out[part] = pooled(np.stack([lists[i] for i in part]), dilations)
    return out, lengths


def kernel_features(sequence: Column, dilations: tuple[int, ...] = DILATIONS) -> Column:
    """largest and above (arrays of longs): each kernel's largest response and number above zero, by dilation, then kernel."""

    @F.pandas_udf("largest array<long>, above array<long>")
    def features(sequences: pd.Series) -> pd.DataFrame:
        found = _of_series(sequences, dilations)[0].reshape(len(sequences), -1, 2)
        return pd.DataFrame({"largest": list(found[:, :, 0]), "above": list(found[:, :, 1])})

    return features(sequence)


def feature_names(channels: list[str], dilations: tuple[int, ...] = DILATIONS) -> list[str]:
    """Names of the entries of a kernel vector, in its order."""
    kernels = ["".join(map(str, k)) for k in KERNELS]
    return [f"{c}_d{d}_k{k}_{what}" for c in channels for d in dilations for k in kernels for what in ("largest", "share")]


def with_kernels(df: DataFrame, channels: list[str], name: str = "kernels", dilations: tuple[int, ...] = DILATIONS) -> DataFrame:
    """Adds a vector of the largest response and the share above zero of every channel's kernels."""

    @F.pandas_udf("array<double>")
    def features(*sequences: pd.Series) -> pd.Series:
        parts = []
        for channel in sequences:
            found, lengths = _of_series(channel, dilations)
            shaped = found.astype(np.float64)
            shaped[..., 1] /= np.maximum(lengths, 1)[:, None, None]
            parts.append(shaped.reshape(len(channel), -1))
        return pd.Series(list(np.concatenate(parts, axis=1)))

    return df.withColumn(name, array_to_vector(features(*[F.col(c) for c in channels])))


def without_channel(df: DataFrame, channel: str, channels: list[str], name: str = "kernels", dilations: tuple[int, ...] = DILATIONS) -> DataFrame:
    """The rows with a channel's entries of the vector at zero, which is what ``with_kernels`` gives for a channel of zeros."""
    width = len(feature_names([channel], dilations))
    first = channels.index(channel) * width
    all_entries = vector_to_array(name)
    zeros = F.array_repeat(F.lit(0.0), width)
    kept = F.concat(F.slice(all_entries, 1, first), zeros, F.slice(all_entries, first + width + 1, width * len(channels)))
    return df.withColumn(name, array_to_vector(kept))

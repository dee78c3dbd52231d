"""Assembly of design frames: every part is joined by its key (group, date, hour), never by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.functions.scalars import unit_hash
from spanwise.operators import events as E
from spanwise.operators.history import compute_historical_baselines
from spanwise.operators.overlap import compute_overlap_features
from spanwise.operators.schedule import compute_schedule_features

KEYS = E.KEYS


def join_first_wins(frames: list[DataFrame]) -> DataFrame:
    """Left joins on the keys; of columns with the same name the first frame's stays."""
    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        fresh = [c for c in right.columns if c not in left.columns]
        return left.join(right.select(*KEYS, *fresh), KEYS, "left")

    return reduce(add, frames)


def fill_numbers(df: DataFrame, value: float = 0.0) -> DataFrame:
    """Nulls and NaNs of numeric columns become the value."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    return df.fillna(value, subset=numeric)


def build_feature_matrix(base: DataFrame, events: DataFrame, training: DataFrame | None = None, include_overlap: bool = True) -> DataFrame:
    """Schedule, overlap and history features for the base grid, nulls as 0."""
    parts = [base.select(*KEYS), compute_schedule_features(base, events)]
    if include_overlap:
        parts.append(compute_overlap_features(base, events))
    if training is not None:
        parts.append(compute_historical_baselines(base, training))
    return fill_numbers(join_first_wins(parts))


def assemble_design_frame(original: DataFrame, base: DataFrame, schedule_features: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Original columns, then the base's, the schedule's and the external ones; interval columns go."""
    return join_first_wins([original, base, schedule_features, *([external] if external is not None else [])]).drop("interval_start", "interval_end")


def split_target(features: DataFrame, target: str = "target") -> tuple[DataFrame, DataFrame]:
    """(features, keys with the target)."""
    if target not in features.columns:
        raise ValueError(f"no column {target}")
    return features.drop(target), features.select(*KEYS, target)


def drop_prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def array_of_columns(df: DataFrame, prefix: str, n: int = 60) -> DataFrame | None:
    """Columns prefix0..prefix(n-1) as one array column ``sequence``, None where they aren't all there."""
    names = [f"{prefix}{i}" for i in range(n)]
    return df.select(*[c for c in df.columns if c not in names], F.array(*names).alias("sequence")) if set(names) <= set(df.columns) else None


def ensure_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.lit(0.0) for n in names if n not in df.columns})


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; constant columns become 0."""
    stats = df.agg(*[f(c).alias(f"{c}__{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])
    out = df.join(F.broadcast(stats), how="left")  # one row
    return out.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}__mean"), F.col(f"{c}__std")), F.lit(0.0)) for c in columns}).drop(*stats.columns)


def join_filled(rows: DataFrame, values: DataFrame, column: str, otherwise: float = 0.2) -> DataFrame:
    """Keys with a value from another table; missing ones get the mean of those that were found, else ``otherwise``."""
    joined = rows.select(*KEYS).join(values.select(*KEYS, column), KEYS, "left")
    mean = joined.agg(F.avg(column).alias("__mean"))
    return joined.join(F.broadcast(mean), how="left").withColumn(column, F.coalesce(column, "__mean", F.lit(otherwise))).drop("__mean")  # one row


#: A hashed order is cut into so many equal cells, and a cell again, until one has few rows.
CELLS, FEW, DEEPEST = 1 << 10, 10_000, 4


def hash_sample(df: DataFrame, n: int, keys: list[str], seed: int = 0, few: int = FEW) -> DataFrame:
    """n rows without replacement (all, if there are no more): those with the least hash of their keys, so a rerun takes the
    same.

    Hashes are counted by cells of their range, which says in which cell the n-th lies; rows of the cells below are taken
    as they stand, wherever they are, and that cell is cut again until it has ``few`` rows. Only these are sorted.
    """
    order = unit_hash(F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), seed)
    hashed = df.withColumn("__order", order)
    cell = lambda depth: F.floor(F.col("__order") * float(CELLS**depth))  # noqa: E731  powers of two: no rounding
    inside, need = hashed, n
    for depth in range(1, DEEPEST + 1):
        counts = sorted((r["cell"], r["count"]) for r in inside.groupBy(cell(depth).alias("cell")).count().collect())  # CELLS rows at most
        for at, k in counts:
            if need <= k:
                break
            need -= k
        else:
            return df  # no more than n rows
        inside = hashed.where(cell(depth) == at)
        if k <= few:
            break
    last = inside.orderBy("__order", *keys).limit(need)
    return hashed.where(cell(depth) < at).unionByName(last).drop("__order")

"""Interval overlap per group and hour: runs of equal counts, statistics, minute sequences.

An interval touches few hours, so it is exploded to these (two for the default windows), never to minutes. Pieces of an
hour with the same first and last minute are counted first, which combines on the map side: however many intervals fall
into an hour, it is left with a bounded number of small rows, and a hot group or hour is no hot task. These few come
together by (keys, hour) and are turned into runs: stretches of the hour with the same number of active intervals. All
statistics are sums and ranks over the runs, of which an hour with few intervals has few; only minute sequences spell
out sixty counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.scalars import minute_index
from spanwise.operators.events import KEYS, with_operational_windows

MINUTES, NO_GAP, CLOSE = 60, 999.0, 3
FEATURES = {
    "overlap_max": 0.0, "overlap_mean": 0.0, "overlap_median": 0.0, "overlap_p90": 0.0, "overlap_minutes_ge2": 0.0, "overlap_minutes_ge3": 0.0,
    "overlap_pairs_per_hour": 0.0, "overlap_near_conflict_minutes": 0.0, "overlap_min_gap_minutes": NO_GAP, "overlap_near_conflict_flag": 0.0,
}


def hour_pieces(intervals: DataFrame, keys: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """One row for each hour that an interval touches: first and last minute inside the hour, and the interval's start."""
    hours = F.sequence(F.floor(F.col("start_minute") / 60), F.floor((F.col("end_minute") - 1) / 60))
    pieces = intervals.where("end_minute > start_minute").select(*keys, *carried, "start_minute", "end_minute", F.explode(hours).alias("hour_number"))
    first = F.greatest(F.col("start_minute") - F.col("hour_number") * 60, F.lit(0)).cast("int")
    last = F.least(F.col("end_minute") - F.col("hour_number") * 60, F.lit(60)).cast("int")
    return pieces.select(*keys, *carried, "hour_number", "start_minute", first.alias("first"), last.alias("until"))


def _runs(pieces: Column, counts: dict[str, Callable[[Column], Column]]) -> Column:
    """The hour's stretches of equal counts (at, len, and how many pieces cover each, by name of a filter): one sweep.

    Each piece adds its number where it begins and takes it away where it ends. The changes are sorted by minute and passed
    once; a stretch, of which an hour has sixty at most, is closed where the next change lies further on.
    """
    none = F.lit(0).cast("long")
    names = list(counts)
    change = lambda at, n: F.struct(at.alias("at"), *[v.alias(name) for name, v in n.items()])
    of = lambda x, sign: {name: F.when(test(x), x["n"] * sign).otherwise(none) for name, test in counts.items()}
    begun = F.transform(pieces, lambda x: change(x["first"], of(x, 1)))
    ended = F.transform(pieces, lambda x: change(x["until"], of(x, -1)))
    last = F.array(change(F.lit(MINUTES), dict.fromkeys(names, none)))
    changes = F.array_sort(F.concat(begun, ended, last))
    kind = "array<struct<at:int,len:int," + ",".join(f"{name}:bigint" for name in names) + ">>"
    start = F.struct(F.array().cast(kind).alias("runs"), F.lit(0).alias("at"), *[none.alias(name) for name in names])

    def step(now: Column, x: Column) -> Column:
        closed = F.array(F.struct(now["at"].alias("at"), (x["at"] - now["at"]).alias("len"), *[now[name].alias(name) for name in names]))
        runs = F.when(x["at"] > now["at"], F.concat(now["runs"], closed)).otherwise(now["runs"])
        return F.struct(runs.alias("runs"), x["at"].alias("at"), *[(now[name] + x[name]).alias(name) for name in names])

    return F.aggregate(changes, start, step)["runs"]


def minute_counters(intervals: DataFrame, keys: list[str] | None = None, by_movement: bool = False, spelled: bool = True) -> DataFrame:
    """keys, hour_number, ``runs`` (structs at, len, c: how many intervals are active), start_minutes (distinct), n; with
    ``by_movement`` the rows also have minutes of activity ``dep_minutes``, ``arr_minutes``, and the runs ``dep`` and ``arr``,
    unless ``spelled`` is off."""
    keys = keys or ["airport_group"]
    carried = ("movement",) if by_movement else ()
    pieces = hour_pieces(intervals, keys, carried)
    # equal pieces become one with a count: that combines on the map side and bounds what an hour can collect
    alike = pieces.groupBy(*keys, "hour_number", *carried, "start_minute", "first", "until").agg(F.count(F.lit(1)).alias("n"))
    together = alike.groupBy(*keys, "hour_number").agg(F.collect_list(F.struct(*carried, "start_minute", "first", "until", "n")).alias("pieces"))
    counts = {"c": lambda x: F.lit(True)}
    added = {"start_minutes": F.array_distinct(F.col("pieces.start_minute")), "n": F.aggregate("pieces", F.lit(0).cast("long"), lambda s, x: s + x["n"])}
    if by_movement:
        of = lambda m: lambda x: x["movement"] == m
        counts |= {"dep": of("dep"), "arr": of("arr")} if spelled else {}
        spent = lambda m: F.aggregate("pieces", F.lit(0).cast("long"), lambda s, x: s + F.when(x["movement"] == m, x["n"] * (x["until"] - x["first"])).otherwise(0))
        added |= {"dep_minutes": spent("dep"), "arr_minutes": spent("arr")}
    return together.withColumns({"runs": _runs(F.col("pieces"), counts), **added}).drop("pieces")


def hour_totals(runs: Column) -> Column:
    """Over the hour's minutes, in one pass: the sum and the sum of squares of the counts, how many minutes have 2, 3, 4 or
    more, and the peak."""
    none = F.lit(0).cast("long")
    start = F.struct(*[none.alias(n) for n in ("area", "squares", "ge2", "ge3", "ge4", "peak")])

    def step(now: Column, x: Column) -> Column:
        c, n = x["c"], x["len"].cast("long")
        least = lambda k: F.when(c >= k, n).otherwise(none)
        return F.struct(
            (now["area"] + c * n).alias("area"), (now["squares"] + c * c * n).alias("squares"), *[(now[f"ge{k}"] + least(k)).alias(f"ge{k}") for k in (2, 3, 4)], F.greatest(now["peak"], c).alias("peak")
        )

    return F.aggregate(runs, start, step)


def _ranked_counts(runs: Column, positions: tuple[int, ...]) -> Column:
    """The counts at positions (from 0) of the hour's sixty sorted counts, from one pass over the runs in order of count."""
    ordered = F.array_sort(F.transform(runs, lambda x: F.struct(x["c"].alias("c"), x["len"].alias("len"))))
    start = F.struct(F.lit(0).alias("seen"), *[F.lit(0).cast("long").alias(f"at{p}") for p in positions])
    step = lambda now, x: F.struct((now["seen"] + x["len"]).alias("seen"), *[F.when(now["seen"] <= p, x["c"]).otherwise(now[f"at{p}"]).alias(f"at{p}") for p in positions])
    return F.aggregate(ordered, start, step)


def overlap_statistics(counted: DataFrame) -> DataFrame:
    """Adds the ten overlap features to rows with counters, and ``totals``, which most of them come from."""
    runs, starts, totals = F.col("runs"), F.col("__starts"), F.col("totals")
    gaps = F.zip_with(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))), lambda b, a: b - a)
    gap = F.when(F.col("n") > F.size(starts), F.lit(0.0)).when(F.size(starts) >= 2, F.array_min(gaps).cast("double")).otherwise(F.lit(NO_GAP))
    low, part = int(0.9 * (MINUTES - 1)), 0.9 * (MINUTES - 1) - int(0.9 * (MINUTES - 1))
    df = counted.withColumns({"totals": hour_totals(runs), "__ranked": _ranked_counts(runs, (29, 30, low, low + 1)), "__starts": F.array_sort("start_minutes")})
    at = lambda i: F.col("__ranked")[f"at{i}"]
    return df.withColumns(
        {
            "overlap_max": totals["peak"].cast("double"),
            "overlap_mean": totals["area"] / F.lit(60.0),
            "overlap_median": (at(29) + at(30)) / F.lit(2.0),
            "overlap_p90": at(low) + (at(low + 1) - at(low)) * F.lit(part),
            "overlap_minutes_ge2": totals["ge2"].cast("double"),
            "overlap_minutes_ge3": totals["ge3"].cast("double"),
            "overlap_pairs_per_hour": (totals["squares"] - totals["area"]) / F.lit(120.0),
            "overlap_near_conflict_minutes": (totals["ge2"] - totals["ge4"]).cast("double"),
            "overlap_min_gap_minutes": gap,
            "overlap_near_conflict_flag": (gap <= CLOSE).cast("double"),
        }
    ).drop("__ranked", "__starts")


def minute_array(runs: Column, name: str = "c") -> Column:
    """The sixty counts that the runs stand for."""
    return F.flatten(F.transform(runs, lambda x: F.array_repeat(x[name], x["len"])))


def hour_number(ts: Column) -> Column:
    return F.floor(minute_index(ts) / 60)


def on_grid(base: DataFrame, found: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """The base rows with what was found for their hour, defaults elsewhere."""
    joined = base.withColumn("hour_number", hour_number(F.col("interval_start"))).join(found, ["airport_group", "hour_number"], "left")
    return joined.select(*[F.col(c) for c in base.columns], *[F.coalesce(F.col(n), d).alias(n) for n, d in defaults.items()])


def compute_overlap_features(base: DataFrame, events: DataFrame) -> DataFrame:
    """Keys of the base grid with the ten overlap features; hours without activity get 0, and a gap of 999."""
    found = overlap_statistics(minute_counters(with_operational_windows(events)))
    return on_grid(base.select(*KEYS, "interval_start"), found.select("airport_group", "hour_number", *FEATURES), {n: F.lit(v) for n, v in FEATURES.items()}).drop("interval_start")


def build_minute_sequences(base: DataFrame, events: DataFrame) -> DataFrame:
    """Keys of the base grid with three arrays of sixty counts: all movements, departures, arrivals."""
    found = minute_counters(with_operational_windows(events), by_movement=True)
    names = {"c": "concurrency", "dep": "departures", "arr": "arrivals"}
    found = found.select("airport_group", "hour_number", *[minute_array(F.col("runs"), a).alias(b) for a, b in names.items()])
    zeros = F.array_repeat(F.lit(0).cast("long"), MINUTES)
    return on_grid(base.select(*KEYS, "interval_start"), found, {n: zeros for n in names.values()}).drop("interval_start")


def build_context_sequences(sequences: DataFrame, column: str = "concurrency", before: int = 2) -> DataFrame:
    """Each row's sequence after those of the ``before`` previous rows of its group; zeros where there are none.

    A group has one row an hour, so a window over it stays small.
    """
    w = Window.partitionBy("airport_group").orderBy("date", "hour")
    zeros = F.array_repeat(F.lit(0).cast("long"), MINUTES)
    parts = [F.coalesce(F.lag(column, i).over(w), zeros) for i in range(before, 0, -1)]
    return sequences.withColumn("context", F.concat(*parts, F.col(column)))

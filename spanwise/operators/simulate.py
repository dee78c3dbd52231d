"""Monte Carlo over delays and cancellations: all simulations of a batch in one plan, with sim_id as one more key.

History and schedule are read once each: the history's movements, the resolved sides of the schedule's flights and the
steps of the delay distributions in use are checkpointed, and every batch starts from the last two. Flights are multiplied
by simulations only after that. A batch then has no shuffle in which draws meet delays while the steps are small enough to
broadcast, one in which equal pieces of an hour combine (sides lie by group and day, so most of them meet before it), one
that brings them together by (sim, group, hour), and a small one over simulations. Batches bound what is in flight;
between them only the mean and the sum of squared deviations of each metric and hour are kept, merged in the stable way,
and the adaptive stop reads one number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.lineage import cut_lineage, stored
from spanwise.operators import sampling as S
from spanwise.operators.draws import Distributions, drawn_moments
from spanwise.operators.events import KEYS, prepare_schedule, with_operational_windows
from spanwise.operators.overlap import FEATURES, hour_number, minute_counters, overlap_statistics

# The metrics of a simulation by name.
OVERLAP_METRICS = [f for f in FEATURES if f not in ("overlap_min_gap_minutes", "overlap_near_conflict_flag")]
SEQUENCE_METRICS = ["concurrency_mean", "concurrency_peak", "concurrency_std", "concurrency_area", "dep_activity", "arr_activity"]
METRICS = [f"sim_{m}" for m in (*OVERLAP_METRICS, "prob_any_overlap", *SEQUENCE_METRICS)]
#: Contexts of a schedule (group, movement, hour, service, block) up to which what they resolve to is broadcast.
MOST_CONTEXTS = 1_000_000
#: Simulations of further batches that are drawn in one pass over the sides.
AHEAD = 120


def with_cancel_rate(schedule: DataFrame, rates: DataFrame, global_rate: DataFrame) -> DataFrame:
    """Each flight with the rate of its departure where that has a group and a time, else of its arrival, else the global one."""
    counts = S.with_congestion(S.movements(schedule)).select("airport_group", "movement", "hour", "congestion_bucket").distinct()
    usable = S.usable_group(F.col("dep_airport_group")) & F.col("std").isNotNull()
    side = lambda m, t: F.struct(F.lit(m).alias("movement"), F.col(f"{m}_airport_group").alias("airport_group"), F.hour(t).alias("hour"))
    known = schedule.withColumn("__side", F.when(usable, side("dep", "std")).otherwise(side("arr", "sta")))
    known = known.select("*", "__side.*").join(counts, ["airport_group", "movement", "hour"], "left")
    keys = ["airport_group", "movement", "service_type", "hour", "congestion_bucket"]
    resolved = S.resolve_ladder(known.where("congestion_bucket is not null"), S.CANCEL_LEVELS, rates).select(*keys, "rate")
    out = known.join(resolved, keys, "left").join(F.broadcast(global_rate), how="left")  # one row
    return out.select(*schedule.columns, F.coalesce("rate", "global_rate").alias("rate"))


def placed_sides(schedule: DataFrame) -> DataFrame:
    """The sides of the schedule's flights, each with the side whose context decides on its cancellation (the departure where
    that has a group and a time), dealt by group and day and sorted by time, as parquet. A day with very many is dealt further."""
    usable = S.usable_group(F.col("dep_airport_group")) & F.col("std").isNotNull()
    of = lambda m, t: F.struct(F.lit(m).alias("movement"), F.col(f"{m}_airport_group").alias("airport_group"), F.hour(t).alias("hour"))
    flights = prepare_schedule(schedule).withColumn("decided", F.when(usable, of("dep", "std")).otherwise(of("arr", "sta")))
    sides = S.movements(flights).select("flight_id", "movement", "airport_group", "scheduled_time", "hour", "service_type", "block_bucket", "decided")
    dealt = sides.withColumn("day", F.to_date("scheduled_time")).hint("rebalance", "airport_group", "day")
    return stored(dealt.sortWithinPartitions("airport_group", "scheduled_time").drop("day"))


def prepared_sides(schedule: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each side of each flight (flight_id, movement, airport_group, scheduled_time, cancellation rate, key and size of its
    delay distribution), and the steps of the distributions in use.

    History and schedule are read once each. Of the history's movements only counts are kept; the schedule's sides are
    written once, and what their contexts resolve to is a small table that joins them wherever they are read.
    """
    past = cut_lineage(S.counted_movements(S.movements(history)))
    placed = placed_sides(schedule)
    cell = ["airport_group", "movement", "hour", "service_type"]
    contexts = cut_lineage(placed.groupBy(*cell, "block_bucket").agg(F.count(F.lit(1)).alias("sides")))
    known = S.with_congestion(contexts, weight="sides")
    rates = S.resolve_ladder(known, S.CANCEL_LEVELS, S.rates_of(past)).join(F.broadcast(S.global_rate_of(past)), how="left")  # one row
    rates = cut_lineage(rates.select(*cell, F.coalesce("rate", "global_rate").alias("rate")))
    distributions = stored(S.distributions_of(S.delays_of(past)))
    delays = S.resolve_ladder(known, S.DELAY_LEVELS, distributions.select("level", "key", "n")).select(*cell, "context", "key", "n")
    delays = cut_lineage(known.join(delays, [*cell, "context"], "left").select(*cell, "block_bucket", "key", "n"))
    small = F.broadcast if contexts.count() <= MOST_CONTEXTS else lambda df: df
    decided = placed.select("*", *[F.col(f"decided.{c}").alias(f"decided_{c}") for c in cell[:3]])
    rated = decided.join(small(rates.withColumnsRenamed({c: f"decided_{c}" for c in cell[:3]})), [*[f"decided_{c}" for c in cell[:3]], "service_type"])
    ready = rated.join(small(delays), [*cell, "block_bucket"]).select("flight_id", "movement", "airport_group", "scheduled_time", "rate", "key", "n")
    return ready, cut_lineage(S.delay_steps(distributions, delays.where("key is not null")))


def simulated_events(sides: DataFrame, steps: DataFrame, n_simulations: int, first: int = 0, last: int | None = None, seed: int = 42, stratified: bool = True, small: bool = False) -> DataFrame:
    """Events of simulations first..last-1 of n: sim_id, flight_id, movement, airport_group, base_time.

    Both sides of a flight share the draw that cancels it.
    """
    own = F.when(F.col("movement") == "dep", S.flight_offset("dep")).otherwise(S.flight_offset("arr"))
    ready = sides.select("*", S.flight_offset("cancel").alias("__cancel"), own.alias("__own")) if stratified else sides.select("*", F.lit(0.0).alias("__cancel"), F.lit(0.0).alias("__own"))
    sims = F.explode(F.sequence(F.lit(first), F.lit((n_simulations if last is None else last) - 1))).alias("sim_id")
    drawn = ready.select("*", sims).where(S.drawn_from(F.col("rate"), n_simulations, "cancel", seed, stratified, F.col("__cancel")))
    of = lambda m, more: S.uniforms(n_simulations, m, seed + more, stratified, F.col("__own"))
    u = F.when(F.col("movement") == "dep", of("dep", 1)).otherwise(of("arr", 2))
    late = F.timestamp_add("MICROSECOND", F.round(F.col("delay") * 60_000_000).cast("long"), F.col("scheduled_time"))
    return S.with_delay(drawn, steps, u, small).select("sim_id", "flight_id", "movement", "airport_group", late.cast("timestamp_ntz").alias("base_time"))


def metrics_per_simulation(events: DataFrame) -> DataFrame:
    """The fifteen metrics of each (sim, group, hour) in which something is active."""
    found = overlap_statistics(minute_counters(with_operational_windows(events), ["sim_id", "airport_group"], by_movement=True, spelled=False))
    area, squares = F.col("totals.area").cast("double"), F.col("totals.squares").cast("double")
    columns: dict[str, Column] = {f"sim_{m}": F.col(m) for m in OVERLAP_METRICS} | {
        "sim_prob_any_overlap": (F.col("overlap_minutes_ge2") > 0).cast("double"),
        "sim_concurrency_mean": area / 60.0,
        "sim_concurrency_peak": F.col("overlap_max"),
        "sim_concurrency_std": F.sqrt(F.greatest(squares / 60.0 - F.pow(area / 60.0, 2), F.lit(0.0))),
        "sim_concurrency_area": area,
        "sim_dep_activity": F.col("dep_minutes").cast("double"),
        "sim_arr_activity": F.col("arr_minutes").cast("double"),
    }
    return found.select("sim_id", "airport_group", "hour_number", *[c.alias(n) for n, c in columns.items()])


def batch_moments(per_sim: DataFrame, n: int, metrics: list[str] = METRICS) -> DataFrame:
    """Mean and sum of squared deviations of every metric by (group, hour) over n simulations; those without activity
    count as zeros, which are merged to the moments of the others."""
    parts = [f(m).alias(f"{m}{tail}") for m in metrics for f, tail in ((F.avg, "__a"), (F.var_pop, "__p"))]
    found = per_sim.groupBy("airport_group", "hour_number").agg(F.count(F.lit(1)).alias("k"), *parts)
    columns = []
    for m in metrics:
        mean, spread = F.col(f"{m}__a"), F.col(f"{m}__p") * F.col("k")
        columns += [(mean * F.col("k") / n).alias(f"{m}__m"), (spread + mean * mean * F.col("k") * (n - F.col("k")) / n).alias(f"{m}__d")]
    return found.select("airport_group", "hour_number", *columns)


def merged_moments(first: DataFrame, a: int, second: DataFrame, b: int) -> DataFrame:
    """The moments of a and b simulations together; an hour that one of them lacks was without activity there."""
    keys = ["airport_group", "hour_number"]
    both = first.join(second.toDF(*keys, *[f"{c}2" for c in second.columns[2:]]), keys, "full")
    value = lambda c: F.coalesce(c, F.lit(0.0))
    columns = []
    for m in [c.removesuffix("__m") for c in first.columns if c.endswith("__m")]:
        gap = value(f"{m}__m2") - value(f"{m}__m")
        columns += [(value(f"{m}__m") + gap * b / (a + b)).alias(f"{m}__m"), (value(f"{m}__d") + value(f"{m}__d2") + gap * gap * (a * b / (a + b))).alias(f"{m}__d")]
    return both.select(*keys, *columns)


def summary_of(base: DataFrame, moments: DataFrame, n: int, metrics: list[str] = METRICS) -> DataFrame:
    """Mean and sample deviation (0 for one simulation) of every metric for the hours of the base grid."""
    out = base.select(*KEYS, hour_number(F.col("interval_start")).alias("hour_number")).join(moments, ["airport_group", "hour_number"], "left")
    columns = []
    for m in metrics:
        spread = F.sqrt(F.coalesce(f"{m}__d", F.lit(0.0)) / float(n - 1)) if n > 1 else F.lit(0.0)
        columns += [F.coalesce(f"{m}__m", F.lit(0.0)).alias(f"{m}_mean"), spread.alias(f"{m}_std")]
    out = out.select(*KEYS, *columns)
    return out.withColumn("sim_prob_any_overlap", F.col("sim_prob_any_overlap_mean")).withColumn("simulations_used", F.lit(n))


def largest_error(moments: DataFrame, n: int) -> float:
    """The largest standard error of the probability of any overlap over all hours: one number to the driver."""
    error = F.sqrt(F.col("sim_prob_any_overlap__d") / float(max(1, n - 1))) / math.sqrt(n)
    return moments.agg(F.max(error)).first()[0] or 0.0


def run_monte_carlo(base: DataFrame, schedule: DataFrame, history: DataFrame, n_simulations: int = 200, seed: int = 42, min_simulations: int = 80, max_error: float = 0.003, adaptive: bool = True, stratified: bool = True, batch: int = 20, metrics: list[str] = METRICS) -> DataFrame:
    """The summary over up to n simulations; with ``adaptive`` it stops after the batch in which every hour's standard
    error is small enough. Batches run in order of sim_id, so the result doesn't depend on timing.

    The stop is first asked for once ``min_simulations`` have run, the smaller of that number and n. ``metrics`` are those of
    the summary; the probability of any overlap, which the stop asks for, must be among them.
    """
    if n_simulations <= 0:
        raise ValueError("n_simulations must be positive")
    if schedule.isEmpty():
        return base.select(*KEYS).withColumn("simulations_used", F.lit(0))
    sides, steps = prepared_sides(schedule, history)
    small = S.few_enough(steps)
    distributions = sides.sparkSession.sparkContext.broadcast(Distributions(steps)) if small else None

    def moments(start: int, stop: int) -> DataFrame:
        if small:
            return drawn_moments(sides, distributions, metrics, n_simulations, start, stop, seed, stratified)
        return batch_moments(metrics_per_simulation(simulated_events(sides, steps, n_simulations, start, stop, seed, stratified)), stop - start, metrics)

    if not adaptive:
        return summary_of(base, moments(0, n_simulations), n_simulations, metrics)
    done = max(1, min(n_simulations, max(batch, min(n_simulations, min_simulations))))
    total = cut_lineage(moments(0, done))
    ahead, known = done, None  # batches drawn together, of which those after a stop stay unused
    while done < n_simulations and (done == 1 or largest_error(total, done) > max_error):
        upto = min(n_simulations, done + batch)
        if small and upto > ahead:
            looks = [min(n_simulations, k) for k in range(upto, done + max(batch, AHEAD) + 1, batch) if k - batch < n_simulations]
            ahead, known = looks[-1], cut_lineage(drawn_moments(sides, distributions, metrics, n_simulations, done, looks[-1], seed, stratified, looks))
        part = known.where(F.col("upto") == upto).drop("upto") if small else moments(done, upto)
        total, done = cut_lineage(merged_moments(total, done, part, upto - done)), upto
    return summary_of(base, total, done, metrics)

"""Empirical delay distributions and cancellation rates with a ladder of fallbacks, and draws from them.

All seven levels come from one pass with grouping sets. A distribution is kept as its distinct delays with running
counts (whole minutes between the clips, so a few hundred entries at most whatever the history), never as the list of
all delays. A ladder is resolved once for each distinct context of a schedule, so draws join on one key only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.scalars import clip, minutes_between, right_closed, unit_hash
from spanwise.operators.events import usable_group, with_defaults
from spanwise.sources.readers import load_cached
from spanwise.sources.sinks import write_cached

# Clips of a delay in minutes, bucket edges, smoothing, least rows of a level.
CLIP_LOW, CLIP_HIGH = -60.0, 180.0
BLOCK_EDGES, CONGESTION_EDGES = (60, 120, 180, 240, 360), (5, 10, 20, 40)
ALPHA, LEAST = 1.0, 5
SALTS = {"cancel": 11, "dep": 23, "arr": 37}
EDGE = 1e-6
DELAY_LEVELS = [
    ("airport_group", "movement", "service_type", "hour", "context"),
    ("airport_group", "movement", "hour", "context"),
    ("movement", "hour", "context"),
    ("airport_group", "movement", "service_type", "hour"),
    ("airport_group", "movement", "hour"),
    ("movement", "hour"),
    ("movement",),
]
CANCEL_LEVELS = [tuple("congestion_bucket" if k == "context" else k for k in level) for level in DELAY_LEVELS]


def movements(flights: DataFrame) -> DataFrame:
    """Both sides of every flight that have a group and a scheduled time: airport_group, movement, scheduled and actual
    time, hour, service_type ("unknown" for null), cancelled, block minutes and their bucket."""
    flights = with_defaults(flights)
    block = minutes_between(F.col("sta"), F.col("std"))
    sides = F.array(*[F.struct(F.lit(m).alias("movement"), F.col(f"{m}_airport_group").alias("airport_group"), F.col(s).alias("scheduled_time"), F.col(a).alias("actual_time")) for m, s, a in (("dep", "std", "atd"), ("arr", "sta", "ata"))])
    kept = [c for c in ("flight_id", "rate", "decided") if c in flights.columns]
    out = flights.select(*kept, F.coalesce("service_type", F.lit("unknown")).alias("service_type"), "cancelled", right_closed(block, BLOCK_EDGES).alias("block_bucket"), F.explode(sides).alias("s"))
    out = out.select(*kept, "service_type", "cancelled", "block_bucket", "s.*").where(usable_group(F.col("airport_group")) & F.col("scheduled_time").isNotNull())
    return out.withColumn("hour", F.hour("scheduled_time"))


def with_congestion(rows: DataFrame, keys: tuple[str, ...] = ("airport_group", "movement", "hour"), weight: str | None = None) -> DataFrame:
    """Adds the number of rows that share the keys, its bucket, and the context "block|congestion". Rows that stand for several
    have their number in ``weight``.

    A groupBy joined back rather than a window: counts combine on the map side, and a hot key is no hot task.
    """
    number = F.sum(weight) if weight else F.count("scheduled_time")
    counts = rows.groupBy(*keys).agg(number.alias("congestion"))
    out = rows.join(counts, list(keys)).withColumn("congestion_bucket", right_closed(F.col("congestion"), CONGESTION_EDGES))
    return out.withColumn("context", F.concat_ws("|", "block_bucket", "congestion_bucket"))


def level_key(level: tuple[str, ...], number: int | Column) -> Column:
    """One text for the key of a level, led by the level's number."""
    number = F.lit(str(number)) if isinstance(number, int) else number.cast("string")
    return F.concat_ws("/", number, *[F.col(c).cast("string") for c in level])


def _by_level(rows: DataFrame, levels: list[tuple[str, ...]], *aggregates: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key of each level (and ``extra`` columns), from a single pass: level, key, aggregates.

    Each row is expanded to one key text for each level before the partial aggregation, as grouping sets would be.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("level"), level_key(level, i + 1).alias("key")) for i, level in enumerate(levels)]))
    expanded = rows.select("*", keys.alias("__k"))
    return expanded.groupBy(F.col("__k.level").alias("level"), F.col("__k.key").alias("key"), *extra).agg(*aggregates)


def counted_movements(past: DataFrame) -> DataFrame:
    """All that rates and distributions ask of movements, counted: service, hour, block and clipped delay (null where a movement
    didn't take place) with n, n_cancelled, and n_known (``cancelled`` isn't null).

    Its size is bounded by the delays and contexts that there are, not by the movements.
    """
    delay = F.when(F.col("actual_time").isNotNull(), clip(minutes_between(F.col("actual_time"), F.col("scheduled_time")), CLIP_LOW, CLIP_HIGH))
    keys = ("airport_group", "movement", "service_type", "hour", "block_bucket")
    return past.select(*keys, "cancelled", delay.alias("delay")).groupBy(*keys, "delay").agg(F.count(F.lit(1)).alias("n"), *_cancellations(F.sum, F.sum))


def _cancellations(added=lambda x: x, known=lambda x: x) -> list[Column]:
    return [added(F.coalesce(F.col("cancelled").cast("long"), F.lit(0))).alias("n_cancelled"), known(F.col("cancelled").isNotNull().cast("long")).alias("n_known")]


def _weighed(past: DataFrame) -> DataFrame:
    """Counted movements as they are, others with a count of one."""
    return past if "n_known" in past.columns else past.select("*", F.lit(1).cast("long").alias("n"), *_cancellations())


def delays_of(past: DataFrame) -> DataFrame:
    """Movements that took place (counted ones or rows), with their congestion among themselves and their clipped delay."""
    if "n_known" in past.columns:
        return with_congestion(past.where("delay is not null"), weight="n")
    rows = with_congestion(_weighed(past.where("actual_time is not null")))
    return rows.withColumn("delay", clip(minutes_between(F.col("actual_time"), F.col("scheduled_time")), CLIP_LOW, CLIP_HIGH))


def delay_distributions(history: DataFrame, least: int = LEAST) -> DataFrame:
    return distributions_of(delays_of(movements(history)), least)


def distributions_of(delays: DataFrame, least: int = LEAST) -> DataFrame:
    """level, key, n and cdf (ascending delays with running counts); levels but the last need ``least`` rows.

    Rows with the same finest key and delay are counted before they are expanded to the seven levels.
    """
    finest = delays.groupBy(*DELAY_LEVELS[0], "delay").agg(F.sum("n").alias("n_rows"))
    counted = _by_level(finest, DELAY_LEVELS, F.sum("n_rows").alias("k"), extra=("delay",))
    grouped = counted.groupBy("level", "key").agg(F.sum("k").alias("n"), F.array_sort(F.collect_list(F.struct("delay", "k"))).alias("steps"))
    grouped = grouped.where((F.col("n") >= least) | (F.col("level") == len(DELAY_LEVELS)))
    start = F.array().cast("array<struct<delay:double,upto:bigint>>")
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x["delay"].alias("delay"), (F.coalesce(F.get(acc, F.size(acc) - 1)["upto"], F.lit(0)) + x["k"]).alias("upto"))))
    return grouped.select("level", "key", "n", F.aggregate("steps", start, step).alias("cdf"))


def cancel_rates(history: DataFrame, alpha: float = ALPHA) -> DataFrame:
    return rates_of(movements(history), alpha)


def rates_of(past: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """level, key, n and the smoothed rate (sum + alpha) / (n + 2 alpha) of movements, counted ones or rows.

    Rows with the same finest key are counted before they are expanded to the seven levels.
    """
    rows = with_congestion(_weighed(past), weight="n")
    finest = rows.groupBy(*CANCEL_LEVELS[0]).agg(F.sum("n_cancelled").alias("n_cancelled"), F.sum("n").alias("n_rows"))
    out = _by_level(finest, CANCEL_LEVELS, F.sum("n_cancelled").alias("c"), F.sum("n_rows").alias("n"))
    return out.select("level", "key", "n", ((F.col("c") + alpha) / (F.col("n") + 2 * alpha)).alias("rate"))


def global_cancel_rate(history: DataFrame) -> DataFrame:
    return global_rate_of(movements(history))


def global_rate_of(past: DataFrame) -> DataFrame:
    """One row: the share of cancelled movements, 0.05 without any."""
    return _weighed(past).agg(F.coalesce(F.try_divide(F.sum("n_cancelled").cast("double"), F.sum("n_known")), F.lit(0.05)).alias("global_rate"))


def resolve_ladder(contexts: DataFrame, levels: list[tuple[str, ...]], fitted: DataFrame) -> DataFrame:
    """For each distinct context, the fitted row of the finest level that has its key: level, key and the fitted columns,
    null without any. Contexts are exploded to one candidate for each level and the least level found is kept."""
    columns = sorted({c for level in levels for c in level})
    wanted = contexts.select(*columns).distinct()
    candidates = wanted.select(*columns, F.explode(F.array(*[level_key(level, i + 1) for i, level in enumerate(levels)])).alias("key"))
    best = candidates.join(fitted, "key", "left").groupBy(*columns).agg(F.min_by(F.struct("level", "key", *[c for c in fitted.columns if c not in ("level", "key")]), F.col("level")).alias("f"))
    return best.select(*columns, "f.*")


def uniforms(n: int, stream: str, seed: int = 42, stratified: bool = True, offset: Column | None = None) -> Column:
    """Stratified draws shared by all flights: ((sim + 1/2) / n + unit(flight)) mod 1, with a jitter within its stratum.

    A column of flight_id and sim_id alone, so draws are the same whatever the partitions, and nothing is stored. Rows that
    were given ``flight_offset`` before they were multiplied by simulations pass it, and the flight isn't hashed again.
    """
    sim = F.col("sim_id")
    jitter = unit_hash(F.concat_ws(":", F.col("flight_id"), sim.cast("string")), SALTS[stream] + 1000 * seed)
    if not stratified:
        return clip(jitter, EDGE, 1 - EDGE)
    return clip(_stratum(n, stream, offset) + (jitter - 0.5) / F.lit(float(n)), EDGE, 1 - EDGE)


def flight_offset(stream: str) -> Column:
    """The part of a draw that all simulations of a flight share."""
    return unit_hash(F.col("flight_id"), SALTS[stream])


def _stratum(n: int, stream: str, offset: Column | None) -> Column:
    """The middle of the draw's stratum."""
    spread = (F.col("sim_id") + 0.5) / F.lit(float(n)) + (flight_offset(stream) if offset is None else offset)
    return spread - F.floor(spread)


def drawn_from(least: Column, n: int, stream: str, seed: int = 42, stratified: bool = True, offset: Column | None = None) -> Column:
    """Whether the draw is ``least`` or more. Sums round in order, so where the ends of its stratum lie on one side the
    draw does too, and only the other draws need their jitter."""
    u = uniforms(n, stream, seed, stratified, offset)
    if not stratified:
        return u >= least
    end = lambda jitter: clip(_stratum(n, stream, offset) + F.lit((jitter - 0.5) / float(n)), EDGE, 1 - EDGE)
    return F.when(end(0.0) >= least, F.lit(True)).when(end(1.0) < least, F.lit(False)).otherwise(u >= least)


def quantile_of(cdf: Column, n: Column, u: Column) -> Column:
    """The delay at position min(n - 1, floor(u n)) of the sorted delays; 0 without a distribution."""
    position = F.least(n - 1, F.floor(u * n))
    return F.coalesce(F.get(F.filter(cdf, lambda x: x["upto"] > position), F.lit(0))["delay"], F.lit(0.0))


#: Positions of a distribution are dealt to so many equal stretches, each of which keeps the steps that reach into it.
STRETCHES = 16
#: Bytes of the steps in use up to which they are broadcast to the draws; more are joined by shuffle.
BROADCAST_STEPS = 64 << 20


def stretch_of(position: Column, n: Column) -> Column:
    return F.floor(position * F.lit(STRETCHES) / n).cast("int")


def delay_steps(distributions: DataFrame, keys: DataFrame) -> DataFrame:
    """key, stretch, upto, delays: of those distributions whose key is among the keys, the steps by stretch of positions.

    A distribution has a step for each distinct delay, whatever the number of flights behind it, so a key has a few hundred
    entries at most, and its stretches hold these and one more each.
    """
    used = distributions.join(keys.select("key").distinct(), "key", "left_semi")
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("cdf.upto", F.lit(1), F.size("cdf") - 1))
    each = used.select("key", "n", F.explode(F.zip_with("cdf", before, lambda x, first: F.struct(first.alias("first"), x["upto"].alias("upto"), x["delay"].alias("delay")))).alias("s"))
    reached = F.sequence(stretch_of(F.col("s.first"), F.col("n")), stretch_of(F.col("s.upto") - 1, F.col("n")))
    placed = each.select("key", F.explode(reached).alias("stretch"), F.struct("s.upto", "s.delay").alias("step"))
    steps = placed.groupBy("key", "stretch").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    return steps.select("key", "stretch", F.col("steps.upto").alias("upto"), F.col("steps.delay").alias("delays"))


def few_enough(steps: DataFrame) -> bool:
    """Whether (checkpointed) steps are small enough to broadcast: their size is measured, 64 bytes a row and 16 a step."""
    return (steps.agg(F.sum(64 + F.octet_length("key") + 16 * F.size("upto"))).first()[0] or 0) <= BROADCAST_STEPS


def with_delay(rows: DataFrame, steps: DataFrame, u: Column, small: bool = False) -> DataFrame:
    """Adds ``delay`` at position min(n - 1, floor(u n)) of the row's distribution (key, n): an equi-join with one row of
    steps, among which the position is found; 0 without a distribution. ``small`` steps are broadcast, so draws stay where
    they are."""
    placed = rows.withColumn("__position", F.least(F.col("n") - 1, F.floor(u * F.col("n"))).cast("long"))
    met = placed.withColumn("stretch", stretch_of(F.col("__position"), F.col("n"))).join(F.broadcast(steps) if small else steps, ["key", "stretch"], "left")
    found = F.get(F.col("delays"), F.size(F.filter("upto", lambda x: x <= F.col("__position"))))
    return met.withColumn("delay", F.coalesce(found, F.lit(0.0))).drop("__position", "stretch", "upto", "delays")


def fingerprint() -> dict:
    """What identifies the samplers in a cache note: change a value and cached simulations no longer match."""
    return {"clip": [CLIP_LOW, CLIP_HIGH], "block_edges": list(BLOCK_EDGES), "congestion_edges": list(CONGESTION_EDGES), "alpha": ALPHA, "least": LEAST, "salts": SALTS, "version": 2}


def cached_simulation(spark: SparkSession, path: str, config: dict, make) -> DataFrame:
    """A simulation's result from its cache if the configuration and the samplers are the same, else made and published.

    The configuration must hold what identifies the inputs (``versions.table_note``).
    """
    note = {**config, "samplers": fingerprint()}
    held = load_cached(spark, path, note)
    if held is None:
        write_cached(make(), path, note)
        held = load_cached(spark, path, note)
    return held

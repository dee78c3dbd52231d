"""Draws counted in numpy are those of the DataFrames, and what they leave behind doesn't grow with the flights."""

import inspect
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanwise.functions.lineage import shared_folder
from spanwise.operators import draws as D
from spanwise.operators import events as E
from spanwise.operators import sampling as S
from spanwise.operators import simulate as MC
from spanwise.plans import queries as Q

START = datetime(2025, 7, 1, 22, 10, 30)
FLIGHTS = "flight_id string, dep_airport_group string, arr_airport_group string, service_type string, std timestamp_ntz, sta timestamp_ntz, atd timestamp_ntz, ata timestamp_ntz, cancelled int"


def flights(spark, n=60):
    """Ids of several lengths, one longer than a block of MD5, one null; delays of whole and of broken minutes."""
    rows = []
    for i in range(n):
        std = START + timedelta(minutes=7 * i)
        sta, late = std + timedelta(minutes=45), timedelta(seconds=37 * i % 9000 - 1500)
        name = None if i == 5 else "Ω" * 40 if i == 6 else f"FL{i**3}"
        rows.append((name, "X" if i % 3 else "NA", "Y" if i % 4 else None, "REG" if i % 5 else None, std, sta, std + late, sta + 2 * late, int(i % 6 == 0)))
    return spark.createDataFrame(rows, FLIGHTS)


@pytest.mark.parametrize("stratified", [True, False])
def test_counted_draws_have_the_moments_of_the_rows(spark, stratified):
    f = flights(spark)
    sides, steps = MC.prepared_sides(f, f)
    held = spark.sparkContext.broadcast(D.Distributions(steps))
    told = lambda df: {(r["airport_group"], r["hour_number"]): r for r in df.collect()}
    got = told(D.drawn_moments(sides, held, MC.METRICS, 12, 3, 11, stratified=stratified))
    want = told(MC.batch_moments(MC.metrics_per_simulation(MC.simulated_events(sides, steps, 12, 3, 11, stratified=stratified)), 8))
    assert want.keys() == got.keys() and len(want) > 10
    for key, r in want.items():
        assert all(abs(r[c] - got[key][c]) < 1e-6 for c in r.asDict() if c.endswith(("__m", "__d")))


def test_an_hours_size_does_not_depend_on_its_flights(spark):
    def parts(n):
        at = F.lit(START).cast("timestamp_ntz")
        rows = spark.range(n, numPartitions=1).select(F.concat(F.lit("F"), "id").alias("flight_id"), F.lit("dep").alias("movement"), F.lit("X").alias("airport_group"), at.alias("scheduled_time"), F.lit(0.2).alias("rate"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("n"))
        return D.counted_draws(rows, held, 8, 0, 8).agg(F.count(F.lit(1)), F.sum(F.octet_length("changes") + F.octet_length("departures"))).first()

    held = spark.sparkContext.broadcast(D.Distributions(spark.createDataFrame([], "key string, stretch int, upto array<bigint>, delays array<double>")))
    few, many = parts(40), parts(20_000)
    assert few[0] == many[0] == 2 and many[1] < 4 * few[1]


def test_a_history_is_kept_as_counts(spark):
    """Movements that agree in all that is asked of them are one row, with the rates and distributions of the rows."""
    f = flights(spark).crossJoin(spark.range(50).select())
    past = S.movements(f)
    counted = S.counted_movements(past)
    assert counted.count() <= past.count() / 50
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(S.rates_of(counted)) == rows(S.rates_of(past)) and rows(S.global_rate_of(counted)) == rows(S.global_rate_of(past))
    assert rows(S.distributions_of(S.delays_of(counted))) == rows(S.distributions_of(S.delays_of(past)))


def test_settled_hours_leave_the_overlaps_as_they_are(spark):
    """Busy hours, quiet ones and cancelled flights: the overlaps of all draws, in parts small and large, from several tasks."""
    busy = flights(spark, 200).crossJoin(spark.range(9).select(F.col("id").alias("copy"))).withColumn("flight_id", F.concat_ws("-", "flight_id", "copy")).drop("copy")
    late = F.make_dt_interval(days=F.lit(3))
    quiet = flights(spark, 8).withColumns({c: (F.col(c) + late).cast("timestamp_ntz") for c in ("std", "sta", "atd", "ata")})
    sides, steps = MC.prepared_sides(busy.unionByName(quiet), busy)
    held = spark.sparkContext.broadcast(D.Distributions(steps))
    name, told = f"sim_{D.OVERLAPS}__m", lambda df: {(r["airport_group"], r["hour_number"]): r[name] for r in df.collect() if r[name]}
    want = told(D.drawn_moments(sides, held, MC.METRICS, 40, 0, 40))
    assert {v < 1 for v in want.values()} == {True, False}
    for some in (sides, sides.repartition(5), sides.orderBy(F.desc("scheduled_time"))):
        assert told(D.drawn_moments(some, held, [f"sim_{D.OVERLAPS}"], 40, 0, 40)) == want


def test_prepared_sides_take_little_room(spark):
    """What preparation writes to the shared folder is narrow for sides and doesn't grow with the history's movements."""
    folder = shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)
    f = flights(spark).crossJoin(spark.range(400).select())
    before = size()
    sides, _ = MC.prepared_sides(f, f)
    assert size() - before < 40 * sides.count()


def test_adaptive_stop_runs_in_full(spark, small, monkeypatch):
    """The query leaves the number of simulations and the error at the operator's own."""
    given = {}

    def run(base, schedule, history, *args, **kwargs):
        given.update(inspect.signature(MC_RUN).bind(base, schedule, history, *args, **kwargs).arguments)
        return base.select(*MC.KEYS).withColumn("sim_prob_any_overlap", F.lit(0.0)).withColumn("simulations_used", F.lit(0))

    MC_RUN = MC.run_monte_carlo
    monkeypatch.setattr(MC, "run_monte_carlo", run)
    Q.adaptive_stop(spark, small)
    assert set(given) <= {"base", "schedule", "history", "metrics"}


def test_batches_drawn_together_are_those_drawn_one_by_one(spark, monkeypatch):
    f = flights(spark)
    grid = grid_of(spark)
    run = lambda: sorted(map(str, MC.run_monte_carlo(grid, f.drop("cancelled", "atd", "ata"), f, 23, min_simulations=5, max_error=0.11, batch=5).collect()))
    passes, drawn = [], MC.drawn_moments
    monkeypatch.setattr(MC, "drawn_moments", lambda *args: passes.append(args[4:6]) or drawn(*args))
    together = run()
    assert passes == [(0, 5), (5, 23)]
    monkeypatch.setattr(MC, "AHEAD", 1)
    assert run() == together and len(passes) > 3


def grid_of(spark):
    return E.build_base_index(spark.createDataFrame([(g, (START + timedelta(hours=h)).date(), (START + timedelta(hours=h)).hour) for g in "XY" for h in range(9)], "airport_group string, date date, hour int"))

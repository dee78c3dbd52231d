import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.functions.scalars import right_closed
from spanwise.operators import events as E
from spanwise.operators import sampling as S
from spanwise.operators import simulate as MC

START = datetime(2025, 7, 1, 8)
FLIGHTS = "flight_id string, dep_airport_group string, arr_airport_group string, service_type string, std timestamp_ntz, sta timestamp_ntz, atd timestamp_ntz, ata timestamp_ntz, cancelled int"


def flights(spark, n=6):
    """Alternating X to Y and back every hour, 55 minutes long, five minutes late off and five early on."""
    rows = []
    for i in range(n):
        std, pair = START + timedelta(hours=i), ("X", "Y") if i % 2 == 0 else ("Y", "X")
        rows.append((f"FL{i:03}", *pair, "REG", std, std + timedelta(minutes=55), std + timedelta(minutes=5), std + timedelta(minutes=50), 0))
    return spark.createDataFrame(rows, FLIGHTS)


def base(spark):
    return E.build_base_index(spark.createDataFrame([(g, START.date(), h) for g in "XY" for h in range(8, 14)], "airport_group string, date date, hour int"))


def test_monte_carlo_stops_and_reports(spark):
    f = flights(spark)
    got = MC.run_monte_carlo(base(spark), f.drop("cancelled", "atd", "ata"), f, 40, seed=0, min_simulations=10, max_error=0.5, batch=10).collect()
    assert len(got) == 12 and {r["simulations_used"] for r in got} == {10}
    assert {f"{m}_{k}" for m in MC.METRICS for k in ("mean", "std")} < set(got[0].asDict())
    assert all(0 <= r["sim_prob_any_overlap"] <= 1 for r in got)


def test_one_simulation_has_no_spread(spark):
    f = flights(spark)
    got = MC.run_monte_carlo(base(spark), f.drop("cancelled", "atd", "ata"), f, 1, adaptive=False).collect()
    assert all(r[f"{m}_std"] == 0 for r in got for m in MC.METRICS)


def test_bad_and_empty_input(spark):
    f = flights(spark)
    with pytest.raises(ValueError):
        MC.run_monte_carlo(base(spark), f, f, 0)
    assert {r["simulations_used"] for r in MC.run_monte_carlo(base(spark), f.limit(0), f, 5).collect()} == {0}


def test_the_same_draws_give_the_same_events(spark):
    f = flights(spark)
    sides, steps = MC.prepared_sides(f, f)
    one, two = (sorted(map(str, MC.simulated_events(s, steps, 8, small=small).collect())) for s, small in ((sides, False), (sides.repartition(5), True)))
    assert one == two and len(one) > 0


def test_levels_need_five_rows(spark):
    def history(n):
        rows = [(f"A{i}", "X", None, "REG", START, None, START + timedelta(minutes=i), None, 0) for i in range(n)]
        return {r["level"] for r in S.delay_distributions(spark.createDataFrame(rows, FLIGHTS)).collect()}

    assert history(4) == {7} and history(5) == set(range(1, 8))


def test_inverse_cdf_and_clips(spark):
    rows = [(f"A{i}", "X", None, "REG", START, None, START + timedelta(minutes=m), None, 0) for i, m in enumerate([-500, 0, 0, 10, 999])]
    top = S.delay_distributions(spark.createDataFrame(rows, FLIGHTS)).where("level = 7")
    dist = np.array([-60, 0, 0, 10, 180])
    us = [0.0, 0.19, 0.2, 0.59, 0.6, 0.8, 0.999999]
    got = top.select(*[S.quantile_of(F.col("cdf"), F.col("n"), F.lit(u)).alias(f"u{i}") for i, u in enumerate(us)]).first()
    assert list(got) == [dist[min(4, int(u * 5))] for u in us]


def test_buckets_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (None, -1.0, 0.0, 60.0, 60.01, 360.0, 361.0)], "v double")
    assert [r[0] for r in df.select(right_closed(F.col("v"), S.BLOCK_EDGES)).collect()] == ["unknown", "unknown", "unknown", "<= 60", "<= 120", "<= 360", "> 360"]
    five = spark.createDataFrame([(v,) for v in (5, 6, 40, 41)], "v int")
    assert [r[0] for r in five.select(right_closed(F.col("v"), S.CONGESTION_EDGES)).collect()] == ["<= 5", "<= 10", "<= 40", "> 40"]


def test_draws_are_stratified(spark):
    sims = spark.range(40).select(F.lit("FL1").alias("flight_id"), F.col("id").alias("sim_id")).withColumn("u", S.uniforms(40, "dep"))
    u = sorted(r["u"] for r in sims.collect())
    assert all(0 < x < 1 for x in u) and len({int(x * 20) for x in u}) == 20


def test_cancel_rate_ladder(spark):
    f = flights(spark).withColumn("cancelled", (F.col("flight_id") == "FL000").cast("int"))
    rates = {r["key"]: r["rate"] for r in S.cancel_rates(f).collect()}
    assert rates["5/X/dep/8"] == (1 + 1) / (1 + 2) and rates["7/dep"] == (1 + 1) / (6 + 2)
    unknown = f.where("flight_id = 'FL000'").withColumn("dep_airport_group", F.lit("NA")).withColumn("arr_airport_group", F.lit(None).cast("string"))
    one = MC.with_cancel_rate(E.prepare_schedule(unknown), S.cancel_rates(f), S.global_cancel_rate(f)).first()
    assert abs(one["rate"] - 2 / 12) < 1e-9  # no usable side: the share of cancelled movements


def test_delays_by_steps_are_those_of_the_sorted_list(spark):
    rng = random.Random(5)
    lists = {f"k{n}": sorted(float(rng.randrange(-60, 181, 1 if n % 2 else 40)) for _ in range(n)) for n in (1, 2, 31, 32, 33, 700)}
    cdfs = [(1, k, len(v), [(d, sum(x <= d for x in v)) for d in sorted(set(v))]) for k, v in lists.items()]
    fitted = spark.createDataFrame(cdfs, "level int, key string, n long, cdf array<struct<delay:double,upto:bigint>>")
    draws = [(k, len(v), u) for k, v in lists.items() for u in (0.0, 0.1, 0.25, 0.499, 0.5, 0.9, 0.999999, *(i / len(v) for i in range(0, len(v), 7)))] + [(None, None, 0.5), ("k0", 9, 0.5)]
    rows = spark.createDataFrame(draws, "key string, n long, u double")
    steps = S.delay_steps(fitted, rows)
    assert S.few_enough(steps)
    for small in (False, True):
        got = S.with_delay(rows, steps, F.col("u"), small).collect()
        assert len(got) == len(draws)
        for r in got:
            v = lists.get(r["key"])
            assert r["delay"] == (v[min(len(v) - 1, int(r["u"] * len(v)))] if v else 0.0)
    assert S.delay_steps(fitted, rows).groupBy("key").count().agg(F.max("count")).first()[0] <= S.STRETCHES

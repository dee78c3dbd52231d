from datetime import datetime, timedelta

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spanwise.operators import events as E
from spanwise.operators import overlap as O
from spanwise.operators import schedule as P

DAY = datetime(2025, 7, 1)
EVENTS = "airport_group string, movement string, base_time timestamp_ntz"


def grid(spark, groups="XY", hours=range(24)):
    return E.build_base_index(spark.createDataFrame([(g, DAY.date(), h) for g in groups for h in hours], "airport_group string, date date, hour int"))


def run(spark, rows, groups="XY"):
    events = spark.createDataFrame([(g, m, DAY + timedelta(minutes=t)) for g, m, t in rows], EVENTS)
    return {(r["airport_group"], r["hour"]): r.asDict() for r in O.compute_overlap_features(grid(spark, groups), events).collect()}


def test_one_departure_and_one_arrival_at_the_same_time(spark):
    got = run(spark, [("X", "dep", 480), ("X", "arr", 480)])
    seven, eight = got["X", 7], got["X", 8]
    assert (seven["overlap_max"], seven["overlap_minutes_ge2"], seven["overlap_min_gap_minutes"], seven["overlap_near_conflict_flag"]) == (2, 15, 1, 1)
    assert eight["overlap_minutes_ge2"] == 5 and eight["overlap_mean"] == (8 + 5) / 60
    assert got["Y", 8]["overlap_max"] == 0 and got["Y", 8]["overlap_min_gap_minutes"] == 999


def test_touching_windows_do_not_overlap(spark):
    got = run(spark, [("X", "dep", 480), ("X", "dep", 503)])  # [465, 488) and [488, 511)
    assert got["X", 8]["overlap_max"] == 1 and got["X", 8]["overlap_min_gap_minutes"] == 23 and got["X", 8]["overlap_near_conflict_flag"] == 0


def test_identical_starts_have_gap_zero_and_single_ones_none(spark):
    assert run(spark, [("X", "dep", 480), ("X", "dep", 480)])["X", 8]["overlap_min_gap_minutes"] == 0
    assert run(spark, [("X", "dep", 480)])["X", 8]["overlap_min_gap_minutes"] == 999
    assert run(spark, [("Z", "dep", 480)])["X", 8]["overlap_max"] == 0


@settings(deadline=None, max_examples=15, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("XY"), st.sampled_from(["dep", "arr"]), st.integers(0, 1439)), max_size=60))
def test_against_a_loop_over_minutes(spark, rows):
    got = run(spark, rows)
    for g in "XY":
        own = [(t - 15, t + 8) if m == "dep" else (t - 16, t + 5) for x, m, t in rows if x == g]
        for h in range(24):
            c = np.array([sum(s <= m < e for s, e in own) for m in range(60 * h, 60 * h + 60)])
            starts = sorted(s for s, e in own if s < 60 * h + 60 and e > 60 * h)
            gap = min((b - a for a, b in zip(starts, starts[1:], strict=False)), default=999)
            want = [c.max(), c.mean(), np.median(c), np.quantile(c, 0.9), (c >= 2).sum(), (c >= 3).sum(), (c * (c - 1) / 2).sum() / 60, ((c >= 2) & (c <= 3)).sum(), gap, float(gap <= 3)]
            assert np.allclose([got[g, h][n] for n in O.FEATURES], want)


def test_sequences_and_context(spark):
    events = spark.createDataFrame([("X", "dep", DAY + timedelta(minutes=480))], EVENTS)
    seq = O.build_context_sequences(O.build_minute_sequences(grid(spark, "X"), events))
    rows = {r["hour"]: r for r in seq.collect()}
    assert rows[7]["departures"] == [0] * 45 + [1] * 15 and sum(rows[7]["arrivals"]) == 0
    assert rows[8]["concurrency"][:9] == [1] * 8 + [0]
    assert rows[9]["context"] == rows[7]["concurrency"] + rows[8]["concurrency"] + rows[9]["concurrency"]
    assert rows[0]["context"][:120] == [0] * 120


def test_schedule_counts_of_a_group_with_departures_only(spark):
    events = spark.createDataFrame([("X", "dep", DAY + timedelta(minutes=m)) for m in (479, 480, 509, 510, 569, 570)], EVENTS)
    row = next(r for r in P.compute_schedule_features(grid(spark, "X"), events).collect() if r["hour"] == 8)
    assert (row["scheduled_departures"], row["scheduled_arrivals"], row["scheduled_dep_ratio"]) == (3, 0, 1.0)
    assert (row["scheduled_dep_next_30m"], row["scheduled_dep_next_60m"], row["scheduled_dep_next_90m"]) == (2, 3, 4)
    assert (row["scheduled_dep_prev_30m"], row["scheduled_dep_prev_60m"], row["scheduled_arr_prev_60m"]) == (1, 1, 0)


def test_no_events(spark):
    empty = spark.createDataFrame([], EVENTS)
    assert {r["overlap_min_gap_minutes"] for r in O.compute_overlap_features(grid(spark, "X"), empty).collect()} == {999.0}
    assert P.compute_schedule_features(grid(spark, "X"), empty).count() == 24

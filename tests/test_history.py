import hashlib
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from spanwise.functions import calendar as C
from spanwise.operators.prefix import running_sums
from spanwise.operators import design as D
from spanwise.operators import encoding as N
from spanwise.operators import history as H
from spanwise.operators import metrics as R
from spanwise.operators import models as ML
from spanwise.operators import weather as W

ROWS = "airport_group string, date date, hour int, target int"


def hours(spark, values, groups=("A",)):
    return spark.createDataFrame([(g, date(2024, 1, 1) + timedelta(days=i // 24), i % 24, v) for g in groups for i, v in enumerate(values)], ROWS)


def by_hour(df, group="A"):
    return [r for r in df.orderBy("date", "hour").collect() if r["airport_group"] == group]


def test_lags_and_rolling_windows(spark):
    got = by_hour(H.compute_recent_target_features(hours(spark, [0, 1, 0, 0, 1, 0, 0, 0]), (4,)))
    assert [r["target_prev_hour"] for r in got] == [None, 0, 1, 0, 0, 1, 0, 0]
    assert [r["target_rolling_mean_4h"] for r in got][:6] == [None, 0, 0.5, 1 / 3, 0.25, 0.5]
    assert got[1]["target_rolling_std_4h"] is None and abs(got[2]["target_rolling_std_4h"] - 0.5**0.5) < 1e-12
    assert [r["hours_since_positive"] for r in got] == [None, None, 0, 1, 2, 0, 1, 2]


def test_windows_wait_for_a_quarter_and_do_not_bleed(spark):
    got = H.compute_recent_target_features(hours(spark, [1] * 30, ("A", "B")), (24,))
    for g in "AB":
        means = [r["target_rolling_mean_24h"] for r in by_hour(got, g)]
        assert means[:6] == [None] * 6 and means[6] == 1.0


def test_fallbacks(spark):
    recent = H.compute_recent_target_features(hours(spark, [0, 1] * 15, ("A", "B")), (24,)).where("airport_group = 'A' and hour <> 3")
    new = hours(spark, [0] * 24, ("A", "C")).withColumn("date", F.lit("2024-02-01").cast("date")).drop("target")
    out = {(r["airport_group"], r["hour"]): r["target_prev_hour"] for r in H.fill_recent_features(new, recent, ["target_prev_hour"]).collect()}
    assert out["A", 2] == 1.0 and out["A", 3] == 0.0 and 0 < out["C", 3] < 1  # own hour, the group's last, the mean


def test_easter_and_holidays(spark):
    known = {1954: (4, 18), 1981: (4, 19), 2000: (4, 23), 2008: (3, 23), 2011: (4, 24), 2024: (3, 31), 2025: (4, 20), 2038: (4, 25), 2049: (4, 18), 2076: (4, 19)}
    got = {r["y"]: r["e"] for r in spark.createDataFrame([(y,) for y in known], "y int").select("y", C.easter(F.col("y")).alias("e")).collect()}
    assert {y: (e.month, e.day) for y, e in got.items()} == known
    days = spark.createDataFrame([(date(2024, 12, 24),), (date(2024, 3, 31),), (date(2024, 4, 1),), (date(2024, 12, 30),)], "d date")
    out = days.select("d", *C.calendar_features(F.col("d"))).collect()
    assert [r["is_public_holiday"] for r in out] == [1, 0, 1, 0] and out[3]["weekofyear"] == 1


def test_modes_and_flags(spark):
    rows = [("A", date(2024, 1, 1), 3, 20.0, s) for s in ("snow", "rain", "rain", "snow", None)] + [("A", date(2024, 1, 1), 4, None, None)]
    got = {r["hour"]: r for r in W.aggregate_weather(spark.createDataFrame(rows, "airport_group string, date date, hour int, wind_speed_of_gust double, symbol_code_1h string")).collect()}
    assert got[3]["dominant_symbol_code_1h"] == "rain" and got[3]["weather_symbol_rain"] == 1 and got[3]["weather_high_wind"] == 1
    assert got[4]["dominant_symbol_code_1h"] is None and got[4]["weather_high_wind"] == 0 and got[4]["air_temperature_mean"] is None
    with pytest.raises(ValueError):
        W.with_forecast_time(spark.createDataFrame([(1,)], "x int"))


def test_auc_edges(spark):
    auc = lambda rows: R.roc_auc(spark.createDataFrame(rows, "score double, target int")).first()["auc"]
    assert auc([(0.1, 0), (0.9, 1)]) == 1.0 and auc([(0.5, 0), (0.5, 1), (0.5, 1)]) == 0.5 and auc([(0.2, 1), (0.3, 1)]) == 0.5
    with pytest.raises(ValueError):
        R.month_auc(spark.createDataFrame([("A", date(2024, 1, 1), 0, 1, 0.5)], f"{ROWS}, score double"), 2025, 7)


def test_folds_and_one_hot(spark):
    df = spark.createDataFrame([("A", date(2024, m, 1), 0, m % 2) for m in range(1, 7)], ROWS)
    assert N.temporal_folds(df) == ["2024-03", "2024-04", "2024-05", "2024-06"]
    assert N.temporal_folds(df.where("month(date) < 3")) == ["2024-02"] and N.temporal_folds(df.limit(0)) == []
    hot = N.one_hot(spark.createDataFrame([("A",), ("Z",), (None,)], "g string"), {"g": ["A", "B"]}).collect()
    assert [tuple(r) for r in hot] == [(1, 0), (0, 0), (0, 0)]
    with pytest.raises(ValueError):
        N.vocabulary(df, "date", 3)
    with pytest.raises(ValueError):
        ML.cross_validate(df.limit(0), lambda: None)


def test_assembly(spark):
    left = spark.createDataFrame([("A", date(2024, 1, 1), 0, 5)], "airport_group string, date date, hour int, x int")
    right = left.withColumn("x", F.lit(7)).withColumn("y", F.lit(None).cast("double"))
    out = D.fill_numbers(D.join_first_wins([left, right])).first()
    assert out["x"] == 5 and out["y"] == 0.0
    with pytest.raises(ValueError):
        D.split_target(left)
    assert D.array_of_columns(left, "m") is None and D.ensure_columns(left, ["z"]).first()["z"] == 0.0
    std = D.standardise(spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double"), ["a", "b"]).collect()
    assert [tuple(r) for r in std] == [(-1.0, 0.0), (1.0, 0.0)]


def test_numbered_and_ablation(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("h"))
    numbered = running_sums(df, [F.col("h")], {"i": F.lit(1)}).orderBy("h").collect()
    assert [r["i"] for r in numbered] == list(range(1000))
    rows = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "target int, a array<double>")
    assert ML.channel_ablation(lambda d: d.withColumn("score", F.get("a", F.lit(0))), rows, ["a"]) == {"a": 0.5}


def test_baselines_fall_back_to_the_mean_of_means(spark):
    training = spark.createDataFrame([("A", date(2024, 1, 1), 0, 1), ("A", date(2024, 1, 8), 0, 0), ("B", date(2024, 1, 2), 0, 1)], ROWS)
    base = spark.createDataFrame([("A", date(2024, 1, 15), 0), ("C", date(2024, 2, 4), 7)], "airport_group string, date date, hour int")
    got = {r["airport_group"]: r for r in H.compute_historical_baselines(base, training).collect()}
    assert (got["A"]["hist_rate_group_hour"], got["A"]["hist_support_group_hour"]) == (0.5, 2)
    assert (got["C"]["hist_rate_group_hour"], got["C"]["hist_support_group_hour"]) == (0.75, 0)  # the mean of 0.5 and 1
    assert abs(got["C"]["hist_rate_month_hour"] - 2 / 3) < 1e-12 and got["C"]["hist_rate_dow_hour"] == 0.75


def test_month_statistics_fall_back_to_the_month_then_to_zero(spark):
    training = spark.createDataFrame([("A", date(2024, 1, 1), 0, 1), ("A", date(2024, 1, 2), 0, 0), ("B", date(2024, 2, 2), 0, 1)], ROWS)
    design = spark.createDataFrame([("A", date(2025, 1, 1), 0, 9.0), ("B", date(2025, 1, 1), 0, 9.0), ("B", date(2025, 3, 1), 0, 9.0)], "airport_group string, date date, hour int, month_target_mean double")
    got = [r.asDict() for r in H.merge_monthly_stats(design, training).orderBy("airport_group", "date").collect()]
    assert [r["month_target_mean"] for r in got] == [0.5, 0.5, 0.0] and [r["month_target_count"] for r in got] == [2, 2, 0]
    assert H.monthly_target_stats(training.where("airport_group = 'B'")).first()["month_target_std"] == 0.0


def test_imputation_and_filled_joins(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, None), (3.0, None)], "a double, b double")
    assert [tuple(r) for r in H.impute_means(df, ["a", "b"]).collect()] == [(1.0, 0.0), (2.0, 0.0), (2.0, 0.0), (3.0, 0.0)]
    keys = hours(spark, [0, 0])
    empty = keys.withColumn("v", F.lit(1.0)).limit(0)
    assert {r["v"] for r in D.join_filled(keys, empty, "v").collect()} == {0.2}
    assert D.hash_sample(keys, 5, ["airport_group", "date", "hour"]).count() == 2


def test_nearest_station_beyond_the_cells(spark):
    airports = spark.createDataFrame([("near", 60.0, 10.0), ("edge", 60.0, 179.9), ("far", -60.0, -100.0)], "airport string, latitude double, longitude double")
    stations = spark.createDataFrame([("s1", 60.5, 10.5), ("s2", 60.0, -179.8), ("s3", 61.0, 12.0)], "station string, station_latitude double, station_longitude double")
    got = {r["airport"]: r for r in W.nearest_station(airports, stations).collect()}
    assert got["near"]["station"] == "s1" and got["edge"]["station"] == "s2" and got["edge"]["distance_km"] < 20 and got["far"]["station"] == "s2"
    assert {r["station"] for r in W.nearest_station(airports, stations.limit(0)).collect()} == {None}


def test_enrichment_keeps_unknown_airports(spark):
    airports = spark.createDataFrame([("enx", "osl", "Oslo", "mine")], "ident string, iata_code string, name string, airport_group string")
    out = W.enrich_with_groups(airports, spark.createDataFrame([("A", "OSL"), ("A", "zzz")], "airport_group string, airport string")).orderBy("iata_code").collect()
    assert [(r["iata_code"], r["ident"], r["airport_group"], r["airport_group_our"]) for r in out] == [("OSL", "enx", "A", "mine"), ("ZZZ", None, "A", None)]


def test_auc_passes_over_unknown_scores(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, 1), (0.5, 0), (None, 1), (0.7, 1), (0.9, None)], "score double, target int")
    assert R.roc_auc(df).first().asDict() == {"auc": 1.0, "n": 2}
    assert R.roc_auc(df.limit(0)).first().asDict() == {"auc": 0.5, "n": 0}


def test_auc_of_rare_and_of_wide_scores(spark):
    """Scores far below one and far beyond it, against all pairs."""
    import itertools

    rng = __import__("random").Random(2)
    for scale in (1e-9, 1.0, 1e12):
        data = [(rng.randrange(40) * scale, int(rng.random() < 0.3)) for _ in range(300)]
        pos, neg = ([x for x, y in data if y == k] for k in (1, 0))
        want = sum((p > n) + (p == n) / 2 for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
        assert abs(R.roc_auc(spark.createDataFrame(data, "score double, target int")).first()["auc"] - want) < 1e-9


def test_running_sums_by_key(spark):
    data = [(k, i, (i * 7) % 5) for k in ("a", None, "b") for i in range(50)]
    got = running_sums(spark.createDataFrame(data, "k string, i int, v int"), [F.col("i")], {"s": F.col("v"), "n": F.lit(1)}, ("k",)).collect()
    assert len(got) == 150 and all(r["n"] == r["i"] and r["s"] == sum((j * 7) % 5 for j in range(r["i"])) for r in got)


def test_nearest_station_against_all_pairs(spark):
    """Stations in one country, airports everywhere, poles and the date line included."""
    import math

    rng = __import__("random").Random(4)
    stations = [(f"s{i}", rng.uniform(58, 71), rng.uniform(5, 30)) for i in range(120)]
    airports = [(f"a{i}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [("pole", 90.0, 0.0), ("line", 60.0, 180.0), ("here", *stations[0][1:])]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    got = W.nearest_station(spark.createDataFrame(airports, "airport string, latitude double, longitude double"), spark.createDataFrame(stations, "station string, station_latitude double, station_longitude double"))
    assert {r["airport"]: round(r["distance_km"], 6) for r in got.collect()} == {n: round(min(km(a, b, c, d) for _, c, d in stations), 6) for n, a, b in airports}


def test_hashed_sample_cuts_cells_until_few_rows_are_sorted(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k")).union(spark.createDataFrame([("same",)] * 40, "k string"))
    digest = lambda k: int(hashlib.md5(f"{k}|0".encode()).hexdigest()[:8], 16)
    order = sorted([str(i) for i in range(3000)] + ["same"] * 40, key=lambda k: (digest(k), k))
    for n, few in ((1, 1), (700, 1), (700, 10_000), (order.index("same") + 17, 5), (3040, 10)):
        assert sorted(r["k"] for r in D.hash_sample(df, n, ["k"], few=few).collect()) == sorted(order[:n])
    assert D.hash_sample(df, 9999, ["k"]).count() == 3040 and D.hash_sample(df, 0, ["k"]).count() == 0 and D.hash_sample(df.limit(0), 3, ["k"]).count() == 0

"""The whole job on a small generated season, and the bundle of target features."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from spanwise.operators import events as E
from spanwise.operators import models as ML
from spanwise.operators.bundle import TargetBundle, with_target_features
from spanwise.plans import job, sequence
from spanwise.sources import sinks, versions

FIRST, DAYS, GROUPS = date(2024, 3, 20), 60, ("X", "Y")


def season(folder):
    """Flights between two groups, busier by day; an hour's label is whether its planned flights are two or more."""
    rng = random.Random(7)
    files = {n: [] for n in ("training", "flights", "schedule", "inference")}
    for day in (FIRST + timedelta(days=i) for i in range(DAYS + 3)):
        known, count = day < FIRST + timedelta(days=DAYS), {}
        for hour in range(24):
            for n in range(rng.choice((0, 1, 2, 2)) if 6 <= hour <= 20 else int(rng.random() < 0.15)):
                std = datetime(day.year, day.month, day.day, hour) + timedelta(minutes=rng.randrange(60))
                a, b = rng.sample(GROUPS, 2)
                sta, late = std + timedelta(minutes=50), timedelta(minutes=rng.randrange(-5, 25))
                ident = f"F{day:%m%d}{hour:02d}{n}"
                if known:
                    cancelled = int(rng.random() < 0.03)
                    files["flights"].append(f"{ident},{a},{b},REG,{cancelled},{std},{sta},{'NA' if cancelled else std + late},{'NA' if cancelled else sta + late}")
                else:
                    files["schedule"].append(f"{ident},{a},{b},REG,{std},{sta}")
                for group, at in ((a, std), (b, sta)):
                    count[group, at.hour] = count.get((group, at.hour), 0) + (at.date() == day)
        for group in GROUPS:
            for hour in range(24):
                key, n = f"{group},{day},{hour}", count.get((group, hour), 0)
                files["training" if known else "inference"].append(f"{key},{int(n >= 2)},{n}" if known else f"{key},{n}")
    heads = {"training": "airport_group,date,hour,target,feat_sched_flights_cnt", "inference": "airport_group,date,hour,feat_sched_flights_cnt"}
    heads |= {"flights": "flight_id,dep_airport_group,arr_airport_group,service_type,cancelled,std,sta,atd,ata", "schedule": "flight_id,dep_airport_group,arr_airport_group,service_type,std,sta"}
    for name, lines in files.items():
        (folder / f"{name}.csv").write_text("\n".join([heads[name], *lines]) + "\n")
    return job.Inputs(**{n: str(folder / f"{n}.csv") for n in files})


def test_job_from_files_to_predictions(spark, tmp_path):
    inputs, out = season(tmp_path), str(tmp_path / "out")
    small = job.Settings(folds=1, simulations=6, min_simulations=4, max_error=0.5, models={"logistic": lambda c: ML.logistic(c, 20), "forest": lambda c: ML.forest(c, 5, 4)})
    report = job.run_job(spark, inputs, out, small)
    assert set(report["candidates"]) == {"logistic", "forest", "simulation", "stack"} and report["best"] in report["candidates"]
    assert report["auc"] == max(x["all"] for x in report["candidates"].values()) > 0.9
    assert set(report["candidates"]["logistic"]) == {"2024-05", "all"} == {*report["months"], "all"}
    got = spark.read.option("header", True).csv(f"{out}/predictions").collect()
    assert len(got) == 2 * 24 * 3 and got[0].asDict().keys() == {"airport_group", "date", "hour", "pred"}
    assert all(0 <= float(r["pred"]) <= 1 and len(r["pred"]) == 5 for r in got)
    assert [(r["date"], int(r["hour"]), r["airport_group"]) for r in got] == sorted((r["date"], int(r["hour"]), r["airport_group"]) for r in got)
    assert sinks.read_json(spark, f"{out}/metrics")["best"] == report["best"]
    columns = sinks.read_columns(spark, f"{out}/columns")
    assert job.SIMULATED in columns and "hist_rate_group_hour" in columns and "target" not in columns
    assert spark.read.parquet(f"{out}/scores/forest").where("month = '2024-05'").count() == 2 * 24 * 18
    assert versions.current(spark, f"{out}/simulated/future").count() == 2 * 24 * 3


def test_logistic_job(spark, tmp_path):
    inputs = season(tmp_path)
    report = job.run_logistic(spark, inputs.training, str(tmp_path / "out"), folds=1, iterations=20)
    assert set(report) == {"2024-05", "all"} and report["all"] > 0.9


def test_target_features_know_the_training_rows_only(spark):
    rows = [(g, FIRST + timedelta(days=i // 24), i % 24, (i * 5 + len(g)) % 3 % 2) for g in GROUPS for i in range(24 * 10)]
    every = spark.createDataFrame(rows, "airport_group string, date date, hour int, target int")
    train, held = every.where(F.col("date") < FIRST + timedelta(days=8)), every.where(F.col("date") >= FIRST + timedelta(days=8))
    bundle = TargetBundle(train)
    first = bundle.onto(held.drop("target")).orderBy("airport_group", "date", "hour").collect()
    flipped = with_target_features(train, held.withColumn("target", 1 - F.col("target"))).drop("target").orderBy("airport_group", "date", "hour").collect()
    assert first == [r for r in flipped] and len(first) == 2 * 48 and set(bundle.columns) <= set(first[0].asDict())
    assert all(v is not None for r in first for v in r)
    own = bundle.onto(train).where("target_rolling_mean_24h is not null").count()
    assert own == 2 * 24 * 8


def test_sequence_job_and_its_month_report(spark, tmp_path):
    inputs, out = season(tmp_path), str(tmp_path / "seq")
    report = sequence.run_sequence_job(spark, inputs.training, inputs.flights, inputs.inference, inputs.schedule, out, folds=1, make=lambda c: ML.logistic(c, 20))
    assert set(report) == {"2024-05", "all"} and report["all"] > 0.9
    months = {r["month"]: r["auc"] for r in sequence.report_months(spark, out).collect()}
    assert abs(months["2024-05"] - report["2024-05"]) < 1e-9 and abs(months["all"] - report["all"]) < 1e-9
    got = spark.read.option("header", True).csv(f"{out}/predictions").collect()
    assert len(got) == 2 * 24 * 3 and all(0 <= float(r["pred"]) <= 1 for r in got)
    assert "kernels" in sinks.read_columns(spark, f"{out}/columns")


def test_sequences_of_the_hours_before_are_those_of_the_clock(spark):
    events = spark.createDataFrame([("f", "X", "dep", datetime(2024, 5, 1, 7, 30)), ("g", "X", "arr", datetime(2024, 5, 1, 9, 10))], "flight_id string, airport_group string, movement string, base_time timestamp_ntz")
    hours = spark.createDataFrame([("X", date(2024, 5, 1), 9), ("Y", date(2024, 5, 1), 9)], "airport_group string, date date, hour int")
    got = {r["airport_group"]: r for r in sequence.sequence_frame(E.build_base_index(hours), events).collect()}
    assert [i for i, c in enumerate(got["X"]["departures"]) if c] == list(range(15, 38))
    assert [i for i, c in enumerate(got["X"]["arrivals"]) if c] == list(range(114, 135)) and len(got["X"]["concurrency"]) == 180
    assert got["Y"]["concurrency"] == [0] * 180

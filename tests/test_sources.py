from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from spanwise.sources import readers, sinks, versions
from spanwise.streaming import hourly


def put(path, text):
    path.write_text(text)
    return str(path)


def test_csv_sources(spark, tmp_path):
    path = put(tmp_path / "f.csv", "flight_id,dep_airport_group,arr_airport_group,service_type,cancelled,std,extra\nF1,A,NA,REG,0,2025-07-01 08:00:00,x\nF2,NA,B,,bad,broken,y\n")
    with pytest.raises(Exception, match="cancelled \\(int\\) has a cell that can't be read: bad"):
        readers.load_flights(spark, path).select("flight_id", "cancelled").collect()
    assert readers.load_flights(spark, path).select("flight_id").count() == 2
    flights = readers.read_csv(spark, path, readers.FLIGHTS, strict=False)
    rows = flights.orderBy("flight_id").collect()
    assert rows[0]["arr_airport_group"] is None and str(rows[0]["std"]) == "2025-07-01 08:00:00" and rows[0]["sta"] is None
    assert rows[1]["cancelled"] is None and rows[1]["std"] is None and "extra" not in flights.columns
    training = put(tmp_path / "t.csv", "airport_group,date,hour,target\nA,2021-05-01,3,1\nA,2022-05-01,3,0\n")
    assert readers.load_training(spark, training).count() == 2 and readers.load_training(spark, training, "2022-01-01").count() == 1
    assert readers.load_inference(spark, training).columns[:3] == ["airport_group", "date", "hour"]
    assert readers.load_schedule(spark, training).count() == 2 and readers.load_template(spark, training).first()["pred"] is None
    assert readers.load_groups(spark, put(tmp_path / "g.csv", "airport_group,airport\nA,OSL\n")).first()["airport"] == "OSL"
    school = readers.load_school_holidays(spark, put(tmp_path / "s.csv", "date,name,is_school_holiday\n2025-02-17,b,1\n2025-02-17,a,1\n"))
    assert [r["name"] for r in school.collect()] == ["a"]
    assert readers.load_public_holidays(spark, put(tmp_path / "h.csv", "date,name,is_public_holiday\n2025-05-17,Day,true\n")).first()["is_public_holiday"] is True
    assert readers.generated_holidays(spark, 2025, 2025).count() == 12


def test_weather_sources(spark, tmp_path):
    spark.createDataFrame([("A", "2025-07-01 08:30:00", 1.0), ("A", None, 2.0)], "airport_group string, valid_time string, air_temperature double").write.parquet(str(tmp_path / "w"))
    rows = readers.load_weather(spark, str(tmp_path / "w")).collect()
    assert len(rows) == 1 and rows[0]["date"] == date(2025, 7, 1) and rows[0]["hour"] == 8
    response = '{"properties":{"timeseries":[{"time":"2025-07-01T08:00:00Z","data":{"instant":{"details":{"air_temperature":12.5}},"next_1_hours":{"summary":{"symbol_code":"rain"},"details":{"precipitation_amount":0.3}}}}]}}'
    spark.createDataFrame([("OSL", "A", response), ("BGO", "B", "{broken")], "airport string, airport_group string, response string").write.json(str(tmp_path / "j"))
    flat = readers.load_forecast_responses(spark, str(tmp_path / "j")).collect()
    assert len(flat) == 1 and (flat[0]["air_temperature"], flat[0]["precipitation_amount_1h"], flat[0]["symbol_code_1h"], flat[0]["symbol_code_6h"]) == (12.5, 0.3, "rain", None)


def test_cache_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", date(2025, 10, 1), 5, 0.12345), ("A", date(2025, 9, 1), 5, 1.0)], "airport_group string, date date, hour int, pred double")
    sinks.write_predictions(df, str(tmp_path / "p"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "p")).collect()] == [("A", "2025-09-01", "5", "1.000"), ("A", "2025-10-01", "5", "0.123")]
    path = str(tmp_path / "c")
    assert readers.load_cached(spark, path, {"n": 1}) is None
    sinks.write_cached(df, path, {"n": 1, "edges": (1, 2)})
    assert readers.load_cached(spark, path, {"n": 1, "edges": (1, 2)}).count() == 2 and readers.load_cached(spark, path, {"n": 2}) is None
    spark.createDataFrame([("{broken",)], "value string").write.mode("overwrite").text(f"{path}.meta")
    assert readers.load_cached(spark, path, {"n": 1}) is None
    sinks.write_json(spark, {"auc": 0.9}, str(tmp_path / "m"))
    assert sinks.read_json(spark, str(tmp_path / "m")) == {"auc": 0.9}
    sinks.write_keyed(df, str(tmp_path / "k"))
    assert spark.read.parquet(str(tmp_path / "k")).where("month = '2025-10'").count() == 1


def test_stream_counts_late_events(spark, tmp_path):
    schema = "airport_group string, movement string, base_time timestamp"
    for i, hour in enumerate(("08", "09", "08")):
        spark.sql(f"select 'A' airport_group, 'dep' movement, timestamp'2025-07-01 {hour}:15:00' base_time").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {str(r["hour_start"]): (r["departures"], r["arrivals"]) for r in hourly.run_available(hourly.hourly_counts(stream), spark).collect()}
    assert got == {"2025-07-01 08:00:00": (2, 0), "2025-07-01 09:00:00": (1, 0)}
    assert hourly.hourly_counts(spark.read.schema(schema).parquet(str(tmp_path / "in"))).count() == 2


def test_cached_simulation_is_made_once(spark, tmp_path):
    from spanwise.operators.sampling import cached_simulation

    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert cached_simulation(spark, str(tmp_path / "s"), {"n": 8}, make).count() == 3
    assert len(made) == 1 and cached_simulation(spark, str(tmp_path / "s"), {"n": 9}, make).count() == 3 and len(made) == 2


def test_models_and_manifests_are_read_again(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from spanwise.operators import models

    df = spark.createDataFrame([(float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(60)], "a double, b double, target int")
    model = models.logistic(["a", "b"], 10).fit(df)
    sinks.save_model(model, str(tmp_path / "model"))
    sinks.save_model(model, str(tmp_path / "model"))
    sinks.write_columns(spark, ["a", "b"], str(tmp_path / "columns"))
    assert sinks.read_columns(spark, str(tmp_path / "columns")) == ["a", "b"]
    again = PipelineModel.load(str(tmp_path / "model"))
    score = lambda m: [r["score"] for r in models.positive_score(m.transform(df)).collect()]
    assert score(again) == score(model)


def test_airports_from_a_file(spark, tmp_path):
    path = put(tmp_path / "a.csv", "ident,iata_code,name,latitude,longitude,elevation\nENGM,OSL,Oslo,60.19,11.1,208\nENXX,NA,None,NA,NA,NA\n")
    got = readers.load_airports(spark, path).orderBy("ident").collect()
    assert got[0]["latitude"] == 60.19 and got[1]["iata_code"] is None and got[1]["elevation"] is None


def test_observation_chunks():
    chunks = readers.date_chunks(date(2024, 1, 1), date(2024, 12, 31), 120)
    assert chunks == [(date(2024, 1, 1), date(2024, 4, 29)), (date(2024, 4, 30), date(2024, 8, 27)), (date(2024, 8, 28), date(2024, 12, 25)), (date(2024, 12, 26), date(2024, 12, 31))]
    assert readers.date_chunks(date(2024, 1, 2), date(2024, 1, 1), 120) == []


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path):
    path, note = str(tmp_path / "v"), {"n": 1}
    sinks.write_cached(spark.range(3), path, note)
    boom = F.udf(lambda x: 1 // 0, "long")
    with pytest.raises(Exception):
        sinks.write_cached(spark.range(5).select(boom("id").alias("id")), path, {"n": 2})
    assert readers.load_cached(spark, path, note).count() == 3 and readers.load_cached(spark, path, {"n": 2}) is None
    kept, point = versions._point, lambda *a: (_ for _ in ()).throw(RuntimeError("died between data and pointer"))
    versions._point = point
    try:
        with pytest.raises(RuntimeError):
            sinks.write_cached(spark.range(5), path, {"n": 2})
    finally:
        versions._point = kept
    assert readers.load_cached(spark, path, note).count() == 3 and readers.load_cached(spark, path, {"n": 2}) is None
    sinks.write_cached(spark.range(7), path, {"n": 2})
    assert readers.load_cached(spark, path, {"n": 2}).count() == 7 and readers.load_cached(spark, path, note) is None
    sinks.write_cached(spark.range(8), path, {"n": 3})
    assert len(list((tmp_path / "v").glob("version-*"))) == 2  # the current one and the one before
    (tmp_path / "v" / f".{versions.POINTER}.crc").unlink()
    (tmp_path / "v" / versions.POINTER).write_text("{broken")
    assert versions.current(spark, path) is None


def test_notes_tell_other_inputs(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (1, "a")], "i int, s string")
    assert versions.table_note(df) == versions.table_note(df.repartition(3).orderBy("s"))
    for other in (df.where("i = 1"), df.withColumn("s", F.lit("a")), df.distinct(), df.withColumnRenamed("s", "t")):
        assert versions.table_note(other) != versions.table_note(df)
    assert versions.table_note(df.limit(0))["rows"] == 0


def test_prediction_files_are_in_order(spark, tmp_path):
    rows = [(g, date(2024, 1, 1) + timedelta(days=i % 40), i % 24, 0.5) for i in range(960) for g in "AB"]
    df = spark.createDataFrame(rows, "airport_group string, date date, hour int, pred double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_predictions(df, str(tmp_path / "p"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "p").glob("part-*.csv"))
    lines = [line.split(",") for f in files for line in f.read_text().splitlines()[1:]]
    got = [(d, int(h), g) for g, d, h, _ in lines]
    assert len(files) > 1 and got == sorted((str(d), h, g) for g, d, h, _ in rows)

"""What a query must cover, whatever the tables hold."""

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanwise.operators import kernels as K
from spanwise.operators import models as ML
from spanwise.operators import weather as W


def test_easter_of_every_year(spark, small):
    rows = entry.queries()["easter_dates"](spark, small).collect()
    assert {r["year"] for r in rows} == set(range(1900, 2100)) and len(rows) == 200


def test_nearest_station_at_equal_and_dense_positions(spark, monkeypatch):
    """A position is searched for once, and among stations that lie close together it meets few (F9)."""
    rng = __import__("random").Random(9)
    stations = [(f"s{i:04}", 60 + rng.randrange(40_000) / 1e6, 10 + rng.randrange(80_000) / 1e6) for i in range(2000)]
    stations += [("r", *stations[0][1:]), ("nowhere", None, 10.0), ("lost", float("nan"), 10.0)]
    places = [(60 + rng.random() / 25, 10 + rng.random() / 12) for _ in range(30)] + [(-60.0, -170.0), stations[0][1:]]
    airports = [(f"a{i}", *places[i % len(places)]) for i in range(320)] + [("unplaced", None, 10.0)]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    met, plain = spark.sparkContext.accumulator(0), W.haversine_km

    def counted(*columns):
        @F.udf("double")
        def seen(distance):
            met.add(1)
            return distance

        return seen(plain(*columns))

    monkeypatch.setattr(W, "haversine_km", counted)
    got = W.nearest_station(spark.createDataFrame(airports, "airport string, latitude double, longitude double"), spark.createDataFrame(stations, "station string, station_latitude double, station_longitude double"))
    got = {r["airport"]: (r["station"], r["distance_km"]) for r in got.collect()}
    want = {p: min((km(*p, c, d), n) for n, c, d in stations[:-2]) for p in places}
    assert len(got) == len(airports) and got.pop("unplaced") == (None, None)
    for name, (station, distance) in got.items():
        best, nearest = want[places[int(name[1:]) % len(places)]]
        assert station == nearest and abs(distance - best) < 1e-6
    assert met.value < 10_000  # of 640,000 pairs; 32 positions


def test_a_silent_channel_is_taken_from_the_kernels_that_are_there(spark):
    """Kernels are worked out once, and without a channel they are what its zeros would give (F10)."""
    rng = __import__("random").Random(10)
    rows = [(i % 2, *([rng.randrange(9) for _ in range(n)] for n in (30, 30, 0 if i == 3 else 30)), None if i == 5 else [70_000, 3 * 10**14, 1]) for i in range(12)]
    channels = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "target int, a array<bigint>, b array<bigint>, c array<bigint>, d array<bigint>")
    whole = K.with_kernels(df, channels)
    for c in channels:
        want = [r["kernels"] for r in K.with_kernels(ML.silenced(df, c), channels).collect()]
        assert [r["kernels"] for r in K.without_channel(whole, c, channels).collect()] == want
    score = lambda d: d.withColumn("score", F.aggregate(vector_to_array("kernels"), F.lit(0.0), lambda s, x: s + x))
    assert ML.ablated(score, whole, channels, lambda d, c: K.without_channel(d, c, channels)) == ML.ablated(lambda d: score(K.with_kernels(d, channels)), df, channels)

"""Draws cost what they must: a flight is hashed once, a draw's jitter only where it counts, and draws stay where they are."""

from pyspark.sql import functions as F

from spanwise.operators import sampling as S
from spanwise.operators import simulate as MC
from spanwise.plans import queries as Q


def test_draws_with_a_flights_offset_are_the_same(spark):
    for n in (1, 8, 200):
        sims = spark.range(60).select(F.concat(F.lit("FL"), F.col("id").cast("string")).alias("flight_id"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sim_id"))
        sims = sims.withColumn("u", S.uniforms(n, "cancel")).withColumn("least", F.when(F.col("sim_id") % 3 == 0, F.col("u")).when(F.col("sim_id") % 3 == 1, F.rand(3)).otherwise(F.col("u") + F.lit(2.0**-53)))
        at = S.flight_offset("cancel")
        told = sims.select("u", "least", S.uniforms(n, "cancel", offset=at).alias("v"), S.drawn_from(F.col("least"), n, "cancel", offset=at).alias("kept"))
        plain = sims.select("u", "least", S.drawn_from(F.col("least"), n, "cancel", stratified=False).alias("kept"), S.uniforms(n, "cancel", stratified=False).alias("v"))
        assert all(r["u"] == r["v"] and r["kept"] == (r["u"] >= r["least"]) for r in told.collect())
        assert all(r["kept"] == (r["v"] >= r["least"]) for r in plain.collect())


def test_small_steps_come_to_the_draws(spark, small):
    """The draws of simulated_events meet their steps by broadcast, and the sides of a group's day lie together."""
    plan = Q.simulated_events(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    sides, _ = MC.prepared_sides(*reversed(Q._split(spark, small)))
    placed = sides.withColumn("part", F.spark_partition_id())
    days = placed.groupBy("airport_group", F.to_date("scheduled_time").alias("day")).agg(F.count_distinct("part").alias("n"))
    assert days.agg(F.max("n")).first()[0] == 1

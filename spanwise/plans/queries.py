"""Every operator as a named query over the test tables; plans/oracle.py has the SQL that each is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.functions import calendar as C
from spanwise.functions.lineage import cut_lineage, shared_folder, stored
from spanwise.functions.scalars import cyclical, unit_hash
from spanwise.operators import design as D
from spanwise.operators import encoding as N
from spanwise.operators import events as E
from spanwise.operators import history as H
from spanwise.operators import metrics as R
from spanwise.operators import models as ML
from spanwise.operators import overlap as O
from spanwise.operators import sampling as S
from spanwise.operators import schedule as P
from spanwise.operators import simulate as MC
from spanwise.operators import weather as W
from spanwise.operators.prefix import running_sums
from spanwise.sources import adapters as A
from spanwise.sources import readers as load
from spanwise.sources import sinks
from spanwise.sources.readers import generated_holidays
from spanwise.streaming import hourly

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEYS = E.KEYS
SIMULATIONS = 8


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, without negative zeros."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if isinstance(f.dataType, T.DoubleType) else F.col(c) for c, f in zip(df.columns, df.schema, strict=True)])


def base(spark: SparkSession) -> DataFrame:
    return E.build_base_index(A.grid(spark))


def target(spark: SparkSession, d: str) -> DataFrame:
    """1 for hours of the grid in which two movements or more are active at once, by actual times."""
    found = O.compute_overlap_features(base(spark), A.actual_movements(spark, d))
    return found.select(*KEYS, (F.col("overlap_minutes_ge2") > 0).cast("int").alias("target"))


# --- events and grid


@query
def event_unpivot_scheduled(spark, d):
    return E.build_event_table(A.flights(spark, d))


@query
def event_unpivot_actual(spark, d):
    return E.build_event_table(A.flights(spark, d), use_actual=True)


@query
def base_hour_grid(spark, d):
    return rounded(E.build_base_index(A.daily_target(spark, d).select(*KEYS)))


@query
def operational_windows(spark, d):
    return E.with_operational_windows(A.movements(spark, d)).select("flight_id", "airport_group", "movement", "window_start", "window_end", "start_minute", "end_minute")


@query
def july_flights(spark, d):
    both = A.flights(spark, d)
    start, end = F.lit("1997-07-01").cast("timestamp_ntz"), F.lit("1997-07-31 23:59:59").cast("timestamp_ntz")
    return both.where(F.col("std").between(start, end) | F.col("sta").between(start, end)).groupBy("dep_airport_group").agg(F.count(F.lit(1)).alias("n_flights"), F.min("std").alias("first_std"), F.max("sta").alias("last_sta"))


@query
def prepared_schedule(spark, d):
    return E.prepare_schedule(A.flights(spark, d)).groupBy("service_type").agg(F.count(F.lit(1)).alias("n_flights"), F.sum("cancelled").alias("n_cancelled"))


# --- overlap


@query
def minute_concurrency(spark, d):
    counted = O.minute_counters(E.with_operational_windows(A.movements(spark, d)))
    minutes = counted.select("airport_group", "hour_number", F.posexplode(O.minute_array(F.col("runs"))).alias("m", "n"))
    return minutes.where("n > 0").select("airport_group", (F.col("hour_number") * 60 + F.col("m")).alias("minute"), F.col("n").cast("long").alias("concurrency"))


@query
def overlap_features(spark, d):
    return rounded(O.compute_overlap_features(base(spark), A.movements(spark, d)))


@query
def overlap_min_gap(spark, d):
    return O.compute_overlap_features(base(spark), A.actual_movements(spark, d)).select(*KEYS, "overlap_min_gap_minutes", "overlap_near_conflict_flag")


def _text(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query
def minute_sequences(spark, d):
    s = O.build_minute_sequences(base(spark), A.movements(spark, d))
    return s.select(*KEYS, *[_text(c).alias(c) for c in ("concurrency", "departures", "arrivals")])


@query
def context_sequences(spark, d):
    s = O.build_context_sequences(O.build_minute_sequences(base(spark), A.movements(spark, d)))
    return s.select(*KEYS, F.size("context").cast("long").alias("n"), _text("context").alias("context"))


# --- schedule


@query
def schedule_hourly_counts(spark, d):
    return rounded(P.hourly_counts(base(spark), A.movements(spark, d)))


@query
def schedule_range_counts(spark, d):
    return rounded(P.range_counts(base(spark), A.movements(spark, d)))


# --- calendar


@query
def calendar_features(spark, d):
    days = A.daily_target(spark, d).select("date").distinct()
    return days.select("date", *C.calendar_features(F.col("date")))


@query
def easter_dates(spark, d):
    """Easter of every year from 1900 to 2099, and of any other year that orders come from."""
    ordered = A.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).where("year is not null")
    years = spark.range(1900, 2100).select(F.col("id").cast("int").alias("year")).union(ordered).distinct()
    return years.select("year", C.easter(F.col("year")).alias("easter"))


@query
def public_holidays_generated(spark, d):
    """Every public holiday of the years that orders come from."""
    ends = A.table(spark, d, "orders").agg(F.min(F.year("o_orderdate")).alias("first"), F.max(F.year("o_orderdate")).alias("last")).first()
    return generated_holidays(spark, ends["first"], ends["last"])


@query
def season_map(spark, d):
    days = A.daily_target(spark, d)
    return days.groupBy(C.season(F.month("date")).alias("season")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("target").alias("n_positive"))


@query
def time_features(spark, d):
    days = N.add_time_features(A.daily_target(spark, d).select("date").distinct())
    return rounded(days.select("*", *cyclical(F.col("month"), 12, "month"), *cyclical(F.col("dayofweek"), 7, "dow")))


@query
def airport_time_buckets(spark, d):
    return E.add_airport_time_buckets(A.daily_target(spark, d))


# --- history


@query
def historical_rates(spark, d):
    return rounded(H.compute_historical_baselines(base(spark), A.daily_target(spark, d)))


@query
def monthly_target_stats(spark, d):
    return rounded(H.monthly_target_stats(A.daily_target(spark, d)))


@query
def monthly_stats_fallback(spark, d):
    days = A.daily_target(spark, d)
    return rounded(H.merge_monthly_stats(days.drop("target"), days))


@query
def target_lag(spark, d):
    return H.compute_recent_target_features(target(spark, d), ()).select(*KEYS, "target_prev_hour")


@query
def target_rolling(spark, d):
    return rounded(H.compute_recent_target_features(target(spark, d), (24, 72, 168, 336)).drop("target_prev_hour", "hours_since_positive"))


@query
def hours_since_positive(spark, d):
    return H.compute_recent_target_features(target(spark, d), ()).select(*KEYS, "hours_since_positive")


@query
def recent_defaults(spark, d):
    return rounded(H.recent_defaults(H.compute_recent_target_features(target(spark, d), (24,))))


@query
def recent_fallback_fill(spark, d):
    recent = H.compute_recent_target_features(target(spark, d), (24,))
    new = A.grid(spark).where("date = date'2024-01-30'").withColumn("date", F.date_add("date", 1))
    return rounded(H.fill_recent_features(new, recent, ["target_prev_hour", "target_rolling_mean_24h", "hours_since_positive"]))


@query
def mean_imputation(spark, d):
    recent = H.compute_recent_target_features(target(spark, d), (24,))
    return rounded(H.impute_means(recent, ["target_prev_hour", "target_rolling_mean_24h", "target_rolling_std_24h", "hours_since_positive"]))


# --- weather and reference tables


@query
def weather_rollup(spark, d):
    out = W.aggregate_weather(A.weather(spark, d).drop("symbol_code_1h"))
    return rounded(out.select(*KEYS, *[f"{c}_{s}" for c, kinds in W.STATISTICS.items() if c in ("air_temperature", "wind_speed_of_gust", "relative_humidity", "cloud_area_fraction_low", "precipitation_amount_1h") for s in kinds]))


@query
def weather_flags(spark, d):
    out = W.aggregate_weather(A.weather(spark, d))
    return rounded(out.select(*KEYS, *[c for c in out.columns if c.startswith("weather_")]))


@query
def dominant_symbol(spark, d):
    return W.aggregate_weather(A.weather(spark, d)).select(*KEYS, "dominant_symbol_code_1h")


def forecast_responses(rows):
    """airport, airport_group, response: weather rows as forecast responses of one time step each."""
    step = lambda h, x: F.struct(F.struct(x.alias("precipitation_amount")).alias("details"), F.struct(F.col("symbol_code_1h").alias("symbol_code")).alias("summary")).alias(f"next_{h}_hours")
    instant = F.struct(F.struct("air_temperature", "wind_speed_of_gust").alias("details")).alias("instant")
    data = F.struct(instant, step(1, F.col("precipitation_amount_1h")), step(6, F.col("precipitation_amount_1h") * 2)).alias("data")
    time = F.date_format("forecast_time", "yyyy-MM-dd HH:mm:ss").alias("time")
    response = F.to_json(F.struct(F.struct(F.array(F.struct(time, data)).alias("timeseries")).alias("properties")))
    return rows.select("airport", "airport_group", response.alias("response"))


def forecast_summary(flat):
    return rounded(flat.groupBy("airport", "airport_group").agg(*[F.avg(c).alias(c) for c in ("air_temperature", "wind_speed_of_gust", "precipitation_amount_1h", "precipitation_amount_6h")], F.count("symbol_code_1h").alias("n_symbols"), F.count("symbol_code_12h").alias("n_symbols_12h"), F.min("forecast_time").alias("first_time")))


@query
def props_json_flatten(spark, d):
    """Events as forecast responses of one time step each, and back to columns."""
    return forecast_summary(W.parse_timeseries(forecast_responses(A.weather(spark, d))))


@query
def observation_pivot(spark, d):
    e = A.table(spark, d, "events").select(A.letter(F.col("user_id")).alias("airport_group"), F.to_date("ts").alias("date"), F.col("event_type").alias("elementId"), "value", "event_id")
    return W.observation_pivot(e, ["airport_group", "date"], ["click", "view", "purchase"], F.col("event_id"))


@query
def airport_hour_mean(spark, d):
    return rounded(W.airport_hour_mean(A.weather(spark, d), ["air_temperature", "relative_humidity"]))


@query
def coverage_summary(spark, d):
    return W.coverage_summary(A.weather(spark, d))


def _airports(spark, d):
    """Customers as airports: coordinates follow from the key, null for some."""
    key = F.col("c_custkey")
    return A.table(spark, d, "customer").select(
        F.concat(F.lit("x"), key.cast("string")).alias("ident"),
        F.concat(F.lit("c"), (key % 500).cast("string")).alias("iata_code"),
        A.letter(F.col("c_nationkey")).alias("airport_group"),
        F.when(key % 17 != 0, 58 + (key % 1300) / F.lit(100.0)).alias("latitude"),
        (5 + (key * 7 % 2500) / F.lit(100.0)).alias("longitude"),
        (key % 900).cast("double").alias("elevation"),
    )


@query
def coordinates_scan(spark, d):
    return rounded(W.load_coordinates(_airports(spark, d)))


@query
def group_centroid(spark, d):
    return rounded(W.group_centroid(_airports(spark, d)))


@query
def airport_semi_anti(spark, d):
    codes = A.table(spark, d, "nation").select(F.explode(F.array(F.concat(F.lit("C"), F.col("n_nationkey").cast("string")), F.concat(F.lit("X"), (F.col("n_nationkey") + 700).cast("string")), F.concat(F.lit("X"), (F.col("n_nationkey") + 3).cast("string")))).alias("airport"))
    return W.filter_airports(_airports(spark, d), codes).select("ident", "iata_code", "airport_group")


@query
def nearest_station(spark, d):
    s = A.table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("station"), (58 + (F.col("s_suppkey") * 37 % 1300) / F.lit(100.0)).alias("station_latitude"), (5 + (F.col("s_suppkey") * 11 % 2500) / F.lit(100.0)).alias("station_longitude"))
    a = W.load_coordinates(_airports(spark, d).withColumn("airport", F.col("ident")))
    return W.nearest_station(a, s).select("airport", F.round("distance_km", 3).alias("distance_km"))


@query
def airport_groups_enriched(spark, d):
    mapping = A.table(spark, d, "nation").select(A.letter(F.col("n_nationkey")).alias("airport_group"), F.concat(F.lit("C"), (F.col("n_nationkey") * 30).cast("string")).alias("airport"))
    out = W.enrich_with_groups(_airports(spark, d), mapping)
    return rounded(out.select("airport_group", "iata_code", "ident", "airport_group_our", "latitude", "elevation"))


@query
def holiday_join(spark, d):
    days = A.daily_target(spark, d)
    holidays = generated_holidays(spark, 1995, 2001).withColumn("name", F.when(F.month("date") == 12, F.lit("Juleferie")).otherwise(F.lit("Holiday"))).withColumn("is_public_holiday", F.lit(True))
    return W.holiday_join(days, holidays)


@query
def school_holiday_join(spark, d):
    days = A.daily_target(spark, d)
    school = days.select("airport_group", "date").distinct().where("weekofyear(date) in (8, 40) and airport_group < 'D'").withColumn("name", F.concat(F.lit("break "), F.weekofyear("date").cast("string"))).withColumn("is_school_holiday", F.lit(1))
    return W.school_holiday_join(days, school.unionByName(school.withColumn("name", F.lit("zz"))))


# --- folds and encodings


@query
def temporal_folds(spark, d):
    return N.fold_sizes(A.daily_target(spark, d))


@query
def temporal_target_encoding(spark, d):
    days = E.add_airport_time_buckets(A.daily_target(spark, d)).drop("airport_dow_bucket")
    return rounded(N.temporal_target_encoding(days, "airport_hour_bucket"))


@query
def apply_target_encoding(spark, d):
    days = E.add_airport_time_buckets(A.daily_target(spark, d)).drop("airport_hour_bucket")
    train = days.where("date < date'1999-01-01'")
    return rounded(N.apply_target_encoding(days, N.encoding_map(train, "airport_dow_bucket"), "airport_dow_bucket", train.agg(F.avg("target").alias("mean"))))


@query
def one_hot_frozen(spark, d):
    return N.one_hot(A.daily_target(spark, d), {"airport_group": list("ABCDE")})  # F and G were unknown when it was frozen


# --- metrics and reports


def _scored(spark, d):
    days = A.daily_target(spark, d)
    rates = H.compute_historical_baselines(days, days)
    return days.join(rates, KEYS).withColumn("score", F.round((F.col("hist_rate_group_hour") + F.col("hist_rate_dow_hour")) / 2, 9))


@query
def roc_auc(spark, d):
    return rounded(R.roc_auc(_scored(spark, d)))


@query
def monthly_auc(spark, d):
    return rounded(R.monthly_auc(_scored(spark, d)))


@query
def pairwise_hinge(spark, d):
    return rounded(R.pairwise_hinge(_scored(spark, d)))


@query
def dataset_summary(spark, d):
    return rounded(R.dataset_summary(A.daily_target(spark, d)))


@query
def group_rates(spark, d):
    return rounded(R.group_rates(A.daily_target(spark, d)))


@query
def monthly_rate(spark, d):
    return rounded(R.monthly_rate(A.daily_target(spark, d)))


@query
def concurrency_profile(spark, d):
    found = O.compute_overlap_features(base(spark), A.movements(spark, d)).join(target(spark, d), KEYS)
    return rounded(R.concurrency_profile(found.select(F.col("overlap_max").alias("peak"), (F.col("overlap_mean") / 10).alias("score"), "target")))


def _importance(spark, d):
    p = A.table(spark, d, "part")
    prefix = F.element_at(F.array(*map(F.lit, ("sim_", "overlap_", "scheduled_", "hist_", "weather_", "hour_"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select(F.concat(prefix, F.col("p_partkey").cast("string")).alias("feature"), (F.col("p_partkey") * 31 % 997).cast("double").alias("gain"))


@query
def family_importance(spark, d):
    return rounded(R.family_importance(_importance(spark, d)))


@query
def topk_coefficients(spark, d):
    return R.top_features(_importance(spark, d), 25)


# --- sampling and simulation


def _cdf_summary(df):
    at = lambda u: S.quantile_of(F.col("cdf"), F.col("n"), F.lit(u))
    return df.select("level", "key", "n", at(0.0).alias("low"), at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.999999).alias("high"))


@query
def cancel_rates(spark, d):
    return rounded(S.cancel_rates(A.flights(spark, d)))


@query
def delay_distributions(spark, d):
    return rounded(_cdf_summary(S.delay_distributions(A.flights(spark, d))))


@query
def congestion_buckets(spark, d):
    rows = S.with_congestion(S.movements(A.flights(spark, d)), ("airport_group", "movement", "scheduled_time"))
    return rows.groupBy("movement", "block_bucket", "congestion_bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.max("congestion").alias("most"))


def _split(spark, d):
    """History: flights before 1998; schedule: flights from then on, without what isn't known of the future."""
    both = A.flights(spark, d)
    return both.where("std < timestamp_ntz'1998-01-01 00:00:00'"), both.where("std >= timestamp_ntz'1998-01-01 00:00:00'").drop("cancelled", "atd", "ata")


@query
def cancel_ladder(spark, d):
    history, schedule = _split(spark, d)
    rates = S.cancel_rates(history)
    flights = MC.with_cancel_rate(E.prepare_schedule(schedule), rates, S.global_cancel_rate(history))
    return rounded(flights.groupBy("dep_airport_group", "service_type", F.hour("std").alias("hour")).agg(F.count(F.lit(1)).alias("n_flights"), F.avg("rate").alias("rate")))


@query
def delay_quantile_lookup(spark, d):
    history, schedule = _split(spark, d)
    sides, steps = MC.prepared_sides(schedule, history)
    drawn = S.with_delay(sides, steps, unit_hash(F.col("flight_id"), 5), S.few_enough(steps))
    return rounded(drawn.select("flight_id", "movement", "airport_group", "scheduled_time", F.col("n").alias("n_history"), "delay"))


@query
def stratified_uniforms(spark, d):
    streams = ("cancel", "dep", "arr")
    flights = A.flights(spark, d).select("flight_id", *[S.flight_offset(s).alias(f"o_{s}") for s in streams])
    sims = flights.select("*", F.explode(F.sequence(F.lit(0), F.lit(SIMULATIONS - 1))).alias("sim_id"))
    drawn = sims.select("sim_id", *[S.uniforms(SIMULATIONS, s, offset=F.col(f"o_{s}")).alias(s) for s in streams])
    return drawn.groupBy("sim_id").agg(*[(F.round(f(s), 9)).alias(f"{s}_{n}") for s in streams for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


@query
def simulated_events(spark, d):
    history, schedule = _split(spark, d)
    sides, steps = MC.prepared_sides(schedule, history)
    events = MC.simulated_events(sides, steps, SIMULATIONS, small=S.few_enough(steps))
    return events.groupBy("sim_id", "airport_group", "movement").agg(F.count(F.lit(1)).alias("n_events"), F.min("base_time").alias("first_time"), F.max("base_time").alias("last_time"), F.sum(F.hour("base_time") * 60 + F.minute("base_time")).cast("long").alias("minutes"))


def _schedule_grid(schedule):
    return E.build_base_index(E.build_event_table(schedule).select("airport_group", F.to_date("base_time").alias("date"), F.hour("base_time").alias("hour")))


@query
def simulation_summary(spark, d):
    history, schedule = _split(spark, d)
    schedule = stored(schedule)
    return rounded(MC.run_monte_carlo(_schedule_grid(schedule), schedule, history, SIMULATIONS, adaptive=False))


@query
def adaptive_stop(spark, d):
    history, schedule = _split(spark, d)
    schedule = stored(schedule)
    out = MC.run_monte_carlo(_schedule_grid(schedule), schedule, history, metrics=["sim_prob_any_overlap"])
    return rounded(out.select(*KEYS, "sim_prob_any_overlap", "simulations_used"))


# --- assembly


@query
def feature_matrix(spark, d):
    days = A.daily_target(spark, d)
    return rounded(D.build_feature_matrix(base(spark), A.movements(spark, d), days))


@query
def design_frame(spark, d):
    grid = base(spark)
    original = target(spark, d)
    weather = W.aggregate_weather(A.weather(spark, d)).select(*KEYS, "air_temperature_mean", "weather_ifr_proxy")
    parts = D.assemble_design_frame(original, grid, P.compute_schedule_features(grid, A.movements(spark, d)), weather)
    return rounded(D.fill_numbers(parts.select(*KEYS, "target", "season", "is_weekend", "scheduled_movements", "scheduled_dep_next_90m", "air_temperature_mean", "weather_ifr_proxy")))


@query
def simulation_fill(spark, d):
    """Every hour of a July; orders give values for some of them."""
    values = A.daily_target(spark, d).withColumn("sim_prob_any_overlap", F.col("target").cast("double"))
    hours = A.grid(spark).select("airport_group", F.add_months("date", -318).alias("date"), "hour")  # July 1997 for January 2024
    return rounded(D.join_filled(hours, values, "sim_prob_any_overlap"))


@query
def hash_sample(spark, d):
    return D.hash_sample(A.daily_target(spark, d), 200, KEYS)


@query
def minute_bounds(spark, d):
    m = A.movements(spark, d)
    return m.select("flight_id", *C.time_parts(F.col("base_time")), F.date_trunc("minute", "base_time").cast("timestamp_ntz").alias("floored"), C.ceil_to_minute(F.col("base_time")).alias("ceiled"))


# --- models


FEATURES = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos", "hist_rate_group_hour", "hist_rate_month_hour", "hist_rate_dow_hour"]


def _prepare(train, rows):
    """Rates from the training months, and cyclical columns."""
    waves = [*cyclical(F.col("hour"), 24, "hour"), *cyclical(F.weekday("date"), 7, "dow"), *cyclical(F.month("date"), 12, "month")]
    return rows.select(*KEYS, "target", *waves).join(H.compute_historical_baselines(rows, train), KEYS)


def _fold_auc(scored):
    return R.roc_auc(scored, ("fold",)).select("fold", F.round("auc", 4).alias("auc"), "n")


@query
def cv_logistic(spark, d):
    days = cut_lineage(A.daily_target(spark, d))
    return _fold_auc(ML.cross_validate(days, lambda: ML.logistic(FEATURES, 20), 4, _prepare)[0])


@query
def cv_boosted_trees(spark, d):
    days = cut_lineage(A.daily_target(spark, d))
    return _fold_auc(ML.cross_validate(days, lambda: ML.boosted(FEATURES, 5, 4), 2, _prepare)[0])


@query
def cv_perceptron(spark, d):
    days = cut_lineage(A.daily_target(spark, d))
    return _fold_auc(ML.cross_validate(days, lambda: ML.mlp(FEATURES, (16, 8), 20), 2, _prepare)[0])


@query
def stacked_ensemble(spark, d):
    days = cut_lineage(A.daily_target(spark, d))
    parts = {n: cut_lineage(ML.cross_validate(days, e, 2, _prepare)[0]) for n, e in (("logistic", lambda: ML.logistic(FEATURES, 10)), ("forest", lambda: ML.forest(FEATURES, 10, 5)))}
    stacked = ML.stack(parts)
    name, auc, _ = ML.best_candidate({**parts, "stack": stacked})
    weight, blended = ML.blend(parts["logistic"], parts["forest"])
    return spark.createDataFrame([(name, round(auc, 4), weight, round(blended, 4))], "best string, auc double, blend_weight double, blend_auc double")


@query
def permutation_importance(spark, d):
    days = cut_lineage(A.daily_target(spark, d))
    days = cut_lineage(_prepare(days, days))
    return ML.permutation_importance(ML.logistic(FEATURES).fit(days), days, FEATURES)


@query
def balanced_weights(spark, d):
    return rounded(ML.balanced_weights(A.daily_target(spark, d)))


@query
def tuned_forest(spark, d):
    """The better of four forests by out-of-fold AUC."""
    days = cut_lineage(A.daily_target(spark, d))
    days = cut_lineage(_prepare(days, days))
    grid = [{"trees": n, "depth": k} for n in (5, 10) for k in (3, 5)]
    best, auc = ML.grid_search(days, lambda trees, depth: ML.forest(FEATURES, trees, depth), grid, 2, threads=4)
    return spark.createDataFrame([(best["trees"], best["depth"], round(auc, 4))], "trees int, depth int, auc double")


@query
def fitted_importance(spark, d):
    """Shares of a fitted forest's importance by family, and beside them a logistic model's coefficients'."""
    days = cut_lineage(A.daily_target(spark, d))
    days = cut_lineage(_prepare(days, days))
    tables = {n: ML.importance_table(e.fit(days), FEATURES).withColumn("model", F.lit(n)) for n, e in (("forest", ML.forest(FEATURES, 10, 5)), ("logistic", ML.logistic(FEATURES)))}
    return reduce(DataFrame.unionByName, [R.family_importance(t).withColumn("model", F.lit(n)) for n, t in tables.items()])


# --- sources and sinks: test tables written to the shared folder and read again


def _place(spark, name):
    return f"{shared_folder(spark)}/again-{uuid.uuid4().hex}/{name}"


def _as_csv(df, name):
    path = _place(df.sparkSession, name)
    df.write.option("header", True).option("nullValue", "NA").csv(path)
    return path


@query
def source_training(spark, d):
    days = A.daily_target(spark, d)
    rows = days.withColumn("feat_season", C.season(F.month("date"))).withColumn("feat_sched_concurrence", F.when(F.col("hour") % 5 != 0, F.col("hour")))
    return load.load_training(spark, _as_csv(rows, "training"), "1997-01-01")


@query
def source_flights(spark, d):
    return load.load_flights(spark, _as_csv(A.flights(spark, d), "flights"))


@query
def source_schedule(spark, d):
    return load.load_schedule(spark, _as_csv(A.flights(spark, d).drop("cancelled", "atd", "ata"), "schedule"))


@query
def source_inference(spark, d):
    rows = A.daily_target(spark, d).select("hour", "date", F.col("airport_group"), C.season(F.month("date")).alias("feat_season"))
    return load.load_inference(spark, _as_csv(rows, "inference"))


@query
def source_template(spark, d):
    rows = A.daily_target(spark, d).withColumn("pred", F.when(F.col("hour") != 3, F.col("hour") / 32))
    return load.load_template(spark, _as_csv(rows, "template"))


@query
def source_groups(spark, d):
    rows = A.table(spark, d, "nation").select(A.letter(F.col("n_nationkey")).alias("airport_group"), F.col("n_name").alias("airport"), "n_regionkey")
    return load.load_groups(spark, _as_csv(rows, "groups"))


@query
def source_airports(spark, d):
    return load.load_airports(spark, _as_csv(_airports(spark, d).drop("airport_group"), "airports"))


@query
def source_weather(spark, d):
    path = _place(spark, "weather")
    w = A.weather(spark, d)
    w.withColumn("valid_time", F.date_format("forecast_time", "yyyy-MM-dd HH:mm:ss")).drop("forecast_time", "date", "hour").write.parquet(path)
    return rounded(load.load_weather(spark, path).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("air_temperature").alias("mean_temperature"), F.max("symbol_code_1h").alias("last_symbol")))


@query
def source_observations(spark, d):
    path = _place(spark, "observations")
    e = A.table(spark, d, "events").where("event_type <> 'error'")
    e.select(F.concat(F.lit("AP"), (F.col("user_id") % 21).cast("string")).alias("airport"), A.letter(F.col("user_id")).alias("airport_group"), F.date_format("ts", "yyyy-MM-dd HH:00:00").alias("referenceTime"), F.col("event_type").alias("elementId"), "value").write.json(path)
    return load.load_observations(spark, path, ["click", "view", "purchase"])


@query
def source_public_holidays(spark, d):
    days = A.daily_target(spark, d).select("date").distinct().where(C.is_public_holiday(F.col("date")))
    rows = days.select("date", F.when(F.month("date") != 5, F.date_format("date", "'day 'MM-dd")).alias("name"), (F.dayofmonth("date") % 2 == 0).alias("is_public_holiday"))
    return load.load_public_holidays(spark, _as_csv(rows, "holidays"))


@query
def source_school_holidays(spark, d):
    days = A.daily_target(spark, d).select("airport_group", "date").distinct().where("weekofyear(date) in (8, 40)")
    named = days.select("*", F.explode(F.array(F.lit("b"), F.lit("a"), F.lit("c"))).alias("name")).withColumn("is_school_holiday", (F.col("name") != "b").cast("int"))
    return load.load_school_holidays(spark, _as_csv(named, "school"))


@query
def cached_result(spark, d):
    """Made once; the second time, with another recipe under the same configuration, it comes from the cache."""
    path, config = _place(spark, "cached"), {"levels": 7, "by": ["group", "hour"]}
    S.cached_simulation(spark, path, config, lambda: S.cancel_rates(A.flights(spark, d)))
    return rounded(S.cached_simulation(spark, path, config, lambda: spark.range(1)))


@query
def sink_predictions(spark, d):
    """Predictions as they stand in the files: the position of each row in the files' order by name."""
    path = _place(spark, "predictions")
    days = A.daily_target(spark, d).drop("target").withColumn("pred", (F.col("hour") * 41 + F.dayofmonth("date") * 7) % 997 / 997)
    sinks.write_predictions(days.repartition(5, "hour"), path)
    lines = spark.read.option("header", True).csv(path).withColumns({"__file": F.input_file_name(), "__line": F.monotonically_increasing_id()})
    placed = running_sums(lines, [F.col("__file"), F.col("__line")], {"position": F.lit(1)})
    return placed.drop("__file", "__line")


@query
def sink_keyed(spark, d):
    path = _place(spark, "keyed")
    sinks.write_keyed(A.daily_target(spark, d), path)
    return spark.read.parquet(path).where("month = '1997-07'").select(*KEYS, "target")


@query
def sink_manifest(spark, d):
    path = _place(spark, "columns")
    days = A.daily_target(spark, d)
    sinks.write_columns(spark, ["hour", "target", "date", "airport_group"], path)
    return days.select(*sinks.read_columns(spark, path)).toDF("first", "second", "third", "fourth")


# --- frames of columns


@query
def split_target(spark, d):
    features, target = D.split_target(A.daily_target(spark, d))
    return target.join(features.withColumn("month", F.month("date")), KEYS)


@query
def drop_prefixed(spark, d):
    return rounded(D.drop_prefixed(E.build_base_index(A.daily_target(spark, d).select(*KEYS)), "is_"))


@query
def array_of_columns(spark, d):
    s = O.build_minute_sequences(base(spark), A.movements(spark, d))
    wide = s.select(*KEYS, *[F.get("concurrency", F.lit(i)).alias(f"m{i}") for i in range(60)])
    return D.array_of_columns(wide, "m").select(*KEYS, _text("sequence").alias("sequence"))


@query
def ensure_columns(spark, d):
    return D.ensure_columns(A.daily_target(spark, d), ["target", "extra"])


@query
def standardised(spark, d):
    days = A.daily_target(spark, d)
    return rounded(D.standardise(days.withColumn("one", F.lit(1.0)), ["target", "one"]))


@query
def time_window(spark, d):
    inside = E.select_time_window(A.flights(spark, d), "std", datetime(1997, 7, 1), datetime(1997, 7, 31, 23, 59, 59))
    return inside.groupBy("dep_airport_group").agg(F.count(F.lit(1)).alias("n_flights"), F.min("std").alias("first_std"))


@query
def sequence_ablation(spark, d):
    """The AUC that departures and arrivals are worth to a score made of their minutes."""
    s = cut_lineage(O.build_minute_sequences(base(spark), A.movements(spark, d)).join(target(spark, d), KEYS))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    lost = ML.channel_ablation(lambda df: df.withColumn("score", (2 * total("departures") + total("arrivals")).cast("double")), s, ["departures", "arrivals"])
    return spark.createDataFrame([(c, round(x, 6)) for c, x in lost.items()], "channel string, lost double")


# --- streaming


@query
def streaming_hourly_counts(spark, d):
    stream = spark.readStream.schema(A.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    events = stream.where("event_type <> 'error'").select(A.letter(F.col("user_id")).alias("airport_group"), F.when(F.col("event_type").isin("click", "view"), F.lit("dep")).otherwise(F.lit("arr")).alias("movement"), F.col("ts").cast("timestamp").alias("base_time"))
    out = hourly.run_available(hourly.hourly_counts(events), spark)
    return out.select("airport_group", F.col("hour_start").cast("timestamp_ntz").alias("hour_start"), "departures", "arrivals")

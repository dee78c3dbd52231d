"""DuckDB SQL for the queries, written independently of the Spark plans: theta joins, unnested minutes, window functions."""

from __future__ import annotations

R = "round({}, 6) + 0.0"


def r(expression: str, name: str) -> str:
    return f"round(cast({expression} as double), 6) + 0.0 AS {name}"


def with_(*ctes: str) -> str:
    """WITH of the named views and what they need, in order."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for other in NEEDS.get(name, ()):
            need(other)
        order.append(name)

    for c in ctes:
        need(c)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n"


def letter(x: str) -> str:
    return f"substr('ABCDEFG', cast(({x}) % 7 + 1 AS integer), 1)"


def bucket(x: str, edges: tuple[int, ...]) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} <= 0 THEN 'unknown' " + " ".join(f"WHEN {x} <= {e} THEN '<= {e}'" for e in edges) + f" ELSE '> {edges[-1]}' END"


BLOCK, CONGESTION = (60, 120, 180, 240, 360), (5, 10, 20, 40)
LEVELS = [
    ("airport_group", "movement", "service_type", "hour", "context"), ("airport_group", "movement", "hour", "context"), ("movement", "hour", "context"),
    ("airport_group", "movement", "service_type", "hour"), ("airport_group", "movement", "hour"), ("movement", "hour"), ("movement",),
]


def level_key(i: int, context: str, prefix: str = "") -> str:
    return f"concat_ws('/', '{i + 1}', " + ", ".join(f"cast({prefix}{context if c == 'context' else c} AS varchar)" for c in LEVELS[i]) + ")"


def windows(source: str) -> str:
    return f"""SELECT *, date_trunc('minute', base_time - to_minutes(CASE movement WHEN 'dep' THEN 15 ELSE 16 END)) AS window_start,
        date_trunc('minute', base_time + to_minutes(CASE movement WHEN 'dep' THEN 8 ELSE 5 END)) AS window_end FROM {source}"""


def minute(x: str) -> str:
    return f"cast(epoch_us({x}) // 60000000 AS bigint)"


def sides(source: str, extra: str = "") -> str:
    one = lambda m, s, a: f"""SELECT flight_id, coalesce(service_type, 'unknown') AS service_type, coalesce(cancelled, 0) AS cancelled, (epoch(sta) - epoch(std)) / 60.0 AS block,
        '{m}' AS movement, {m}_airport_group AS airport_group, {s} AS scheduled_time, {a} AS actual_time, hour({s}) AS hour {extra}
        FROM {source} WHERE {m}_airport_group IS NOT NULL AND {m}_airport_group <> 'NA' AND {s} IS NOT NULL"""  # noqa: E731
    return one("dep", "std", "atd") + " UNION ALL " + one("arr", "sta", "ata")


def congested(source: str, keys: str = "airport_group, movement, hour", where: str = "true") -> str:
    return f"""SELECT *, {bucket('congestion', CONGESTION)} AS congestion_bucket, block_bucket || '|' || {bucket('congestion', CONGESTION)} AS context FROM (
        SELECT *, {bucket('block', BLOCK)} AS block_bucket, count(*) OVER (PARTITION BY {keys}) AS congestion FROM {source} WHERE {where})"""


def by_levels(source: str, context: str, select: str, having: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {i + 1} AS level, {level_key(i, context)} AS key, {select} FROM {source} GROUP BY 2 {having.format(level=i + 1)}" for i in range(7))


def ladder(fitted: str, context: str, value: str, alias: str) -> tuple[str, str]:
    """(joins, coalesce) over the seven levels."""
    joins = " ".join(f"LEFT JOIN {fitted} {alias}{i} ON {alias}{i}.key = {level_key(i, context, 's.')}" for i in range(7))
    return joins, "coalesce(" + ", ".join(f"{alias}{i}.{value}" for i in range(7)) + ")"


def overlap(events: str) -> dict[str, str]:
    """Views of minute counts and hour statistics over an events view."""
    return {
        f"{events}_w": windows(events),
        f"{events}_m": f"SELECT airport_group, movement, unnest(range({minute('window_start')}, {minute('window_end')})) AS minute FROM {events}_w",
        f"{events}_c": f"SELECT airport_group, minute, count(*) AS c, count(*) FILTER (movement = 'dep') AS dep, count(*) FILTER (movement = 'arr') AS arr FROM {events}_m GROUP BY ALL",
        f"{events}_g": f"SELECT g.airport_group, g.date, g.hour, m.m AS m, coalesce(c.c, 0) AS c, coalesce(c.dep, 0) AS dep, coalesce(c.arr, 0) AS arr FROM grid g CROSS JOIN (SELECT unnest(range(60)) AS m) m LEFT JOIN {events}_c c ON c.airport_group = g.airport_group AND c.minute = {minute('g.interval_start')} + m.m",
        f"{events}_a": f"SELECT g.airport_group, g.date, g.hour, {minute('w.window_start')} AS s, lag({minute('w.window_start')}) OVER (PARTITION BY g.airport_group, g.date, g.hour ORDER BY w.window_start) AS p FROM grid g JOIN {events}_w w ON w.airport_group = g.airport_group AND w.window_start < g.interval_start + INTERVAL 1 hour AND w.window_end > g.interval_start",
        f"{events}_gap": f"SELECT airport_group, date, hour, min(s - p) AS gap FROM {events}_a GROUP BY ALL",
        f"{events}_o": f"""SELECT airport_group, date, hour, max(c) AS overlap_max, avg(c) AS overlap_mean, quantile_cont(cast(c AS double), 0.5) AS overlap_median, quantile_cont(cast(c AS double), 0.9) AS overlap_p90,
            count(*) FILTER (c >= 2) AS overlap_minutes_ge2, count(*) FILTER (c >= 3) AS overlap_minutes_ge3, sum(c * (c - 1) / 2.0) / 60.0 AS overlap_pairs_per_hour,
            count(*) FILTER (c BETWEEN 2 AND 3) AS overlap_near_conflict_minutes FROM {events}_g GROUP BY ALL""",
    }


EVENT = "SELECT flight_id, service_type, {m}_airport_group AS airport_group, {s} AS scheduled_time, {a} AS actual_time, '{m}' AS movement, {b} AS base_time FROM flights WHERE cancelled = 0 AND {m}_airport_group IS NOT NULL AND {m}_airport_group <> 'NA' AND {b} IS NOT NULL"
SCHOOL = "((week(date) IN (8, 9) AND month(date) <= 3) OR (week(date) IN (40, 41) AND month(date) >= 9) OR month(date) BETWEEN 6 AND 8 OR (month(date) = 12 AND day(date) >= 20) OR (month(date) = 1 AND day(date) <= 5))"
# Gauss's rule, for 1900 to 2099
EASTER = """SELECT y AS year, make_date(y, 3, 22) + cast(d + e - CASE WHEN (d = 29 AND e = 6) OR (d = 28 AND e = 6 AND a > 10) THEN 7 ELSE 0 END AS integer) AS easter
    FROM (SELECT y, a, d, (2 * (y % 4) + 4 * (y % 7) + 6 * d + 5) % 7 AS e FROM (SELECT y, y % 19 AS a, (19 * (y % 19) + 24) % 30 AS d FROM (SELECT unnest(range(1900, 2100)) AS y)))"""
HOLIDAY = "(strftime(date, '%m-%d') IN ('01-01', '05-01', '05-17', '12-24', '12-25', '12-26') OR date - (SELECT cast(easter AS date) FROM easters WHERE easters.year = year(days.date)) IN (-3, -2, 1, 39, 49, 50))"
CALENDAR = f"""cast(isodow(date) >= 6 AS integer) AS is_weekend, cast({HOLIDAY} AS integer) AS is_public_holiday, cast({SCHOOL} AS integer) AS is_school_holiday,
    cast(week(date) AS integer) AS weekofyear, cast(dayofyear(date) AS integer) AS dayofyear, cast(day(date) = 1 AS integer) AS is_month_start, cast(last_day(date) = date AS integer) AS is_month_end"""
SEASON = "CASE WHEN month({0}) IN (12, 1, 2) THEN 'winter' WHEN month({0}) <= 5 THEN 'spring' WHEN month({0}) <= 8 THEN 'summer' ELSE 'autumn' END"


def wave(x: str, period: int, name: str) -> str:
    return ", ".join(r(f"{f}(2 * pi() * {x} / {period})", f"{name}_{f}") for f in ("sin", "cos"))


def unit(x: str, salt: int) -> str:
    return f"cast('0x' || substr(md5({x} || '|{salt}'), 1, 8) AS bigint) / 4294967296.0"


def draw(stream: str, n: int = 8, seed: int = 42) -> str:
    salt, seed = {"cancel": (11, seed), "dep": (23, seed), "arr": (37, seed)}[stream]
    spread = f"((sim_id + 0.5) / {float(n)} + {unit('flight_id', salt)})"
    jitter = unit("(flight_id || ':' || sim_id)", salt + 1000 * seed)
    return f"greatest(least({spread} - floor({spread}) + ({jitter} - 0.5) / {float(n)}, 0.999999), 0.000001)"


VIEWS = {
    "movements": f"SELECT cast(event_id AS varchar) AS flight_id, {letter('user_id')} AS airport_group, CASE WHEN event_type IN ('click', 'view') THEN 'dep' ELSE 'arr' END AS movement, ts AS base_time, CASE WHEN event_id % 13 <> 0 THEN ts + to_minutes(cast(event_id % 41 - 10 AS integer)) END AS actual_time FROM events WHERE event_type <> 'error'",
    "actuals": "SELECT * REPLACE (coalesce(actual_time, base_time) AS base_time) FROM movements",
    "grid": "SELECT airport_group, cast(t AS date) AS date, cast(hour(t) AS integer) AS hour, t AS interval_start FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E', 'F', 'G']) AS airport_group), (SELECT unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 hour)) AS t)",
    "flights0": f"""SELECT l_orderkey || '-' || l_linenumber AS flight_id, {letter('l_suppkey')} AS dep_airport_group,
        CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 11 = 0 THEN 'NA' ELSE {letter('l_partkey')} END AS arr_airport_group,
        CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS service_type, cast(l_returnflag = 'R' AND l_linestatus = 'F' AS integer) AS cancelled,
        o_orderdate + to_minutes(cast(l_orderkey % 24 * 60 + l_partkey % 60 AS integer)) AS std, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "flights1": "SELECT *, std + to_minutes(cast(30 + l_partkey % 400 AS integer)) AS sta FROM flights0",
    "flights": "SELECT *, std + to_minutes(cast((l_orderkey * 7 + l_linenumber) % 300 - 80 AS integer)) AS atd, sta + to_minutes(cast((l_partkey * 7 + l_linenumber) % 300 - 80 AS integer)) AS ata FROM flights1",
    "days": f"SELECT airport_group, date, hour, max(target) AS target FROM (SELECT {letter('o_custkey')} AS airport_group, cast(o_orderdate AS date) AS date, cast(o_orderkey % 24 AS integer) AS hour, cast(o_orderstatus = 'F' AS integer) AS target FROM orders) GROUP BY ALL",
    "weather": f"""SELECT {letter('user_id')} AS airport_group, 'AP' || (user_id % 21) AS airport, ts AS forecast_time, cast(ts AS date) AS date, cast(hour(ts) AS integer) AS hour, value / 10 - 10 AS air_temperature,
        value / 15 AS wind_speed_of_gust, cast(props->>'$.k' AS double) / 20 AS precipitation_amount_1h, cast(props->>'$.k' AS double) AS cloud_area_fraction_low, value % 100 AS relative_humidity,
        CASE WHEN event_id % 5 <> 0 THEN CASE event_type WHEN 'click' THEN 'rain' WHEN 'view' THEN 'lightsnow' WHEN 'purchase' THEN 'thunderstorm' WHEN 'signup' THEN 'sleet' WHEN 'error' THEN 'fair' END END AS symbol_code_1h FROM events""",
    "easters": EASTER,
    **overlap("movements"),
    **overlap("actuals"),
    "target": "SELECT airport_group, date, hour, cast(overlap_minutes_ge2 > 0 AS integer) AS target FROM actuals_o",
    "lagged": "SELECT *, lag(target) OVER (PARTITION BY airport_group ORDER BY date, hour) AS prev, row_number() OVER (PARTITION BY airport_group ORDER BY date, hour) AS n FROM target",
    "since": "SELECT *, n - max(CASE WHEN prev >= 0.5 THEN n END) OVER (PARTITION BY airport_group ORDER BY date, hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM lagged",
    "recent": "SELECT airport_group, date, hour, cast(prev AS double) AS target_prev_hour, CASE WHEN count(target) OVER w >= 6 THEN avg(target) OVER w END AS target_rolling_mean_24h, CASE WHEN count(target) OVER w >= 6 THEN stddev_samp(target) OVER w END AS target_rolling_std_24h, cast(since AS double) AS hours_since_positive FROM since WINDOW w AS (PARTITION BY airport_group ORDER BY date, hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)",
    "rates": "SELECT * FROM days",
    "sides": sides("flights"),
    "sided": congested("sides"),
    "flown": congested("sides", where="actual_time IS NOT NULL"),
    "delays": "SELECT *, greatest(least((epoch(actual_time) - epoch(scheduled_time)) / 60.0, 180.0), -60.0) AS delay FROM flown",
    "history": "SELECT * FROM flights WHERE std < TIMESTAMP '1998-01-01'",
    "future": "SELECT flight_id, dep_airport_group, arr_airport_group, coalesce(service_type, 'unknown') AS service_type, 0 AS cancelled, std, sta, cast(NULL AS timestamp) AS atd, cast(NULL AS timestamp) AS ata FROM flights WHERE std >= TIMESTAMP '1998-01-01'",
    "scored": "SELECT d.*, round((gh.v + dh.v) / 2, 9) AS score FROM days d JOIN (SELECT airport_group, hour, avg(target) AS v FROM days GROUP BY ALL) gh USING (airport_group, hour) JOIN (SELECT isodow(date) AS dow, hour, avg(target) AS v FROM days GROUP BY ALL) dh ON dh.dow = isodow(d.date) AND dh.hour = d.hour",
    "airports": f"SELECT 'x' || c_custkey AS ident, 'c' || (c_custkey % 500) AS iata_code, {letter('c_nationkey')} AS airport_group, CASE WHEN c_custkey % 17 <> 0 THEN 58 + (c_custkey % 1300) / 100.0 END AS latitude, 5 + (c_custkey * 7 % 2500) / 100.0 AS longitude, cast(c_custkey % 900 AS double) AS elevation FROM customer",
    "importance": "SELECT ['sim_', 'overlap_', 'scheduled_', 'hist_', 'weather_', 'hour_'][cast(p_partkey % 6 + 1 AS integer)] || p_partkey AS feature, cast(p_partkey * 31 % 997 AS double) AS gain FROM part",
}
NEEDS = {
    "actuals": ("movements",), "flights1": ("flights0",), "flights": ("flights1",), "lagged": ("target",), "target": ("actuals_o",), "since": ("lagged",), "recent": ("since",),
    "sides": ("flights",), "sided": ("sides",), "flown": ("sides",), "delays": ("flown",), "history": ("flights",), "future": ("flights",), "scored": ("days",),
    **{f"{e}_{a}": tuple(f"{e}_{b}" if b else e for b in bs) + (("grid",) if a in ("g", "a") else ()) for e in ("movements", "actuals") for a, bs in {"w": ("",), "m": ("w",), "c": ("m",), "g": ("c",), "a": ("w",), "gap": ("a",), "o": ("g",)}.items()},
}


def fitted(history: str, prefix: str) -> dict[str, str]:
    """Views of delay quantiles' inputs and cancel rates over a history view."""
    return {
        f"{prefix}_s": sides(history),
        f"{prefix}_sc": congested(f"{prefix}_s"),
        f"{prefix}_d": "SELECT *, greatest(least((epoch(actual_time) - epoch(scheduled_time)) / 60.0, 180.0), -60.0) AS delay FROM (" + congested(f"{prefix}_s", where="actual_time IS NOT NULL") + ")",
        f"{prefix}_cdf": by_levels(f"{prefix}_d", "context", "count(*) AS n, list(delay ORDER BY delay) AS ordered", "HAVING count(*) >= 5 OR {level} = 7"),
        f"{prefix}_rate": by_levels(f"{prefix}_sc", "congestion_bucket", "(sum(cancelled) + 1.0) / (count(*) + 2.0) AS rate"),
    }


VIEWS |= fitted("history", "h")
NEEDS |= {"h_s": ("history",), "h_sc": ("h_s",), "h_d": ("h_s",), "h_cdf": ("h_d",), "h_rate": ("h_sc",)}

VIEWS["future_s"] = congested("(" + sides("future") + ")")
NEEDS["future_s"] = ("future",)
# congestion of the future's sides by key, and each flight's deciding side
VIEWS["future_k"] = "SELECT DISTINCT airport_group, movement, hour, congestion_bucket FROM future_s"
NEEDS["future_k"] = ("future_s",)
_joins, _rate = ladder("h_rate", "congestion_bucket", "rate", "c")
VIEWS["h_rated"] = f"""SELECT s.flight_id, s.dep_airport_group, s.arr_airport_group, s.service_type, s.cancelled, s.std, s.sta, s.atd, s.ata, coalesce({_rate}, g.rate) AS rate FROM (
    SELECT f.*, f.m AS movement, f.g AS airport_group, f.h AS hour, k.congestion_bucket FROM (SELECT *, dep_airport_group IS NOT NULL AND dep_airport_group <> 'NA' AS u, CASE WHEN u THEN 'dep' ELSE 'arr' END AS m, CASE WHEN u THEN dep_airport_group ELSE arr_airport_group END AS g, hour(CASE WHEN u THEN std ELSE sta END) AS h FROM future) f
    LEFT JOIN future_k k ON k.airport_group = f.g AND k.movement = f.m AND k.hour = f.h) s {_joins} CROSS JOIN (SELECT avg(cancelled) AS rate FROM h_s) g"""
NEEDS["h_rated"] = ("future_k", "h_rate", "h_s")
_joins, _ = ladder("h_cdf", "context", "n", "d")
VIEWS["h_sides"] = congested("(" + sides("h_rated", ", rate") + ")")
NEEDS["h_sides"] = ("h_rated",)
_n, _o = ("coalesce(" + ", ".join(f"d{i}.{c}" for i in range(7)) + ")" for c in ("n", "ordered"))
VIEWS["h_ready"] = f"SELECT s.*, {_n} AS n, {_o} AS ordered FROM h_sides s {_joins}"
NEEDS["h_ready"] = ("h_sides", "h_cdf")

VIEWS["sims"] = "SELECT *, unnest(range(8)) AS sim_id FROM h_ready"
VIEWS["stop_sims"] = "SELECT *, unnest(range(200)) AS sim_id FROM h_ready"
NEEDS["stop_sims"] = ("h_ready",)
VIEWS["stop_drawn"] = f"SELECT *, CASE movement WHEN 'dep' THEN {draw('dep', 200, 43)} ELSE {draw('arr', 200, 44)} END AS u FROM stop_sims WHERE {draw('cancel', 200)} >= rate"
NEEDS["stop_drawn"] = ("stop_sims",)
VIEWS["stop_simulated"] = "SELECT sim_id, flight_id, movement, airport_group, scheduled_time + to_seconds(60 * coalesce(ordered[cast(least(n - 1, floor(u * n)) AS integer) + 1], 0)) AS base_time FROM stop_drawn"
NEEDS["stop_simulated"] = ("stop_drawn",)
VIEWS["stop_w"] = windows("stop_simulated")
NEEDS["stop_w"] = ("stop_simulated",)
VIEWS["stop_c"] = f"SELECT sim_id, airport_group, minute FROM (SELECT sim_id, airport_group, unnest(range({minute('window_start')}, {minute('window_end')})) AS minute FROM stop_w) GROUP BY ALL HAVING count(*) >= 2"
NEEDS["stop_c"] = ("stop_w",)
VIEWS["stop_h"] = "SELECT DISTINCT sim_id, airport_group, minute // 60 AS h FROM stop_c"
NEEDS["stop_h"] = ("stop_c",)
# after 80, 100 and so on to 200 simulations: the hours' shares with an overlap, and the largest standard error of a share
VIEWS["stop_p"] = "SELECT n, airport_group, h, count(*) FILTER (sim_id < n) AS k FROM stop_h CROSS JOIN (SELECT unnest(range(80, 201, 20)) AS n) GROUP BY ALL"
NEEDS["stop_p"] = ("stop_h",)
VIEWS["stop_n"] = "SELECT coalesce(min(n) FILTER (error <= 0.003), 200) AS used FROM (SELECT n, max(sqrt((k - k * k / n) / (n - 1)) / sqrt(n)) AS error FROM (SELECT n, cast(k AS double) AS k FROM stop_p) GROUP BY n)"
NEEDS["stop_n"] = ("stop_p",)
NEEDS["sims"] = ("h_ready",)
VIEWS["drawn"] = f"SELECT *, CASE movement WHEN 'dep' THEN {draw('dep', seed=43)} ELSE {draw('arr', seed=44)} END AS u FROM sims WHERE {draw('cancel')} >= rate"
NEEDS["drawn"] = ("sims",)
VIEWS["simulated"] = "SELECT sim_id, flight_id, movement, airport_group, scheduled_time + to_seconds(60 * coalesce(ordered[cast(least(n - 1, floor(u * n)) AS integer) + 1], 0)) AS base_time FROM drawn"
NEEDS["simulated"] = ("drawn",)
VIEWS["sim_grid"] = "SELECT DISTINCT airport_group, cast(scheduled_time AS date) AS date, cast(hour(scheduled_time) AS integer) AS hour FROM future_s"
NEEDS["sim_grid"] = ("future_s",)
VIEWS["sim_w"] = windows("simulated")
NEEDS["sim_w"] = ("simulated",)
VIEWS["sim_c"] = f"SELECT sim_id, airport_group, minute, count(*) AS c, count(*) FILTER (movement = 'dep') AS dep, count(*) FILTER (movement = 'arr') AS arr FROM (SELECT sim_id, airport_group, movement, unnest(range({minute('window_start')}, {minute('window_end')})) AS minute FROM sim_w) GROUP BY ALL"
NEEDS["sim_c"] = ("sim_w",)
_at = "CASE WHEN 60 - count(*) > {i} THEN 0 ELSE list(c ORDER BY c)[{i} + 1 - (60 - count(*))] END"
VIEWS["sim_h"] = f"""SELECT sim_id, airport_group, minute // 60 AS h, max(c) AS overlap_max, sum(c) / 60.0 AS overlap_mean, ({_at.format(i=29)} + {_at.format(i=30)}) / 2.0 AS overlap_median,
    {_at.format(i=53)} + 0.1 * ({_at.format(i=54)} - {_at.format(i=53)}) AS overlap_p90, count(*) FILTER (c >= 2) AS overlap_minutes_ge2, count(*) FILTER (c >= 3) AS overlap_minutes_ge3, sum(c * (c - 1)) / 120.0 AS overlap_pairs_per_hour,
    count(*) FILTER (c BETWEEN 2 AND 3) AS overlap_near_conflict_minutes, cast(count(*) FILTER (c >= 2) > 0 AS integer) AS prob_any_overlap, sum(c) / 60.0 AS concurrency_mean, max(c) AS concurrency_peak,
    sqrt(greatest(sum(c * c) / 60.0 - (sum(c) / 60.0) ^ 2, 0)) AS concurrency_std, sum(c) AS concurrency_area, sum(dep) AS dep_activity, sum(arr) AS arr_activity FROM sim_c GROUP BY ALL"""
NEEDS["sim_h"] = ("sim_c",)
SIM = ["overlap_max", "overlap_mean", "overlap_median", "overlap_p90", "overlap_minutes_ge2", "overlap_minutes_ge3", "overlap_pairs_per_hour", "overlap_near_conflict_minutes", "prob_any_overlap", "concurrency_mean", "concurrency_peak", "concurrency_std", "concurrency_area", "dep_activity", "arr_activity"]
OVERLAP = ["overlap_max", "overlap_mean", "overlap_median", "overlap_p90", "overlap_minutes_ge2", "overlap_minutes_ge3", "overlap_pairs_per_hour", "overlap_near_conflict_minutes"]
COUNTS = {f"scheduled_{m}_next_{h}m": (m, 0, h) for m in ("dep", "arr") for h in (30, 60, 90)} | {f"scheduled_{m}_prev_{h}m": (m, -h, 0) for m in ("dep", "arr") for h in (30, 60)}


def hist(source: str, rows: str, extra: str = "") -> str:
    one = lambda keys, name: f"{name} AS (SELECT {keys}, avg(target) AS v, count(target) AS k FROM {source} GROUP BY ALL)"
    return f"""WITH {one('airport_group, hour', 'gh')}, {one('month(date) AS mo, hour', 'mh')}, {one('isodow(date) AS dow, hour', 'dh')}
        SELECT b.airport_group, b.date, b.hour, {r('coalesce(gh.v, (SELECT avg(v) FROM gh))', 'hist_rate_group_hour')}, cast(coalesce(gh.k, 0) AS bigint) AS hist_support_group_hour,
        {r('coalesce(mh.v, (SELECT avg(v) FROM mh))', 'hist_rate_month_hour')}, {r('coalesce(dh.v, (SELECT avg(v) FROM dh))', 'hist_rate_dow_hour')} {extra} FROM {rows} b
        LEFT JOIN gh ON gh.airport_group = b.airport_group AND gh.hour = b.hour LEFT JOIN mh ON mh.mo = month(b.date) AND mh.hour = b.hour LEFT JOIN dh ON dh.dow = isodow(b.date) AND dh.hour = b.hour"""


def month_stats(keys: str) -> str:
    return f"SELECT {keys} month(date) AS month, avg(target) AS a, median(target) AS b, coalesce(stddev_samp(target), 0) AS c, count(target) AS d FROM days GROUP BY ALL"


AUC = """SELECT {by} (sum(CASE WHEN target = 1 THEN rk END) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * (count(*) - sum(target))) AS auc, sum(target) AS p, count(*) AS n
    FROM (SELECT *, strftime(date, '%Y-%m') AS month, rank() OVER ({part} ORDER BY score) + (count(*) OVER ({part2} score) - 1) / 2.0 AS rk FROM scored) {group}"""
_hourly = "SELECT g.airport_group, g.date, g.hour, count(*) FILTER (m.movement = 'dep') AS dep, count(*) FILTER (m.movement = 'arr') AS arr, count(m.movement) AS n_all FROM grid g LEFT JOIN movements m ON m.airport_group = g.airport_group AND m.base_time >= g.interval_start AND m.base_time < g.interval_start + INTERVAL 1 hour GROUP BY ALL"
_ranges = "SELECT g.airport_group, g.date, g.hour, " + ", ".join(f"count(*) FILTER (m.movement = '{m}' AND m.minute - {minute('g.interval_start')} >= {a} AND m.minute - {minute('g.interval_start')} < {b}) AS {n}" for n, (m, a, b) in COUNTS.items()) + f" FROM grid g LEFT JOIN (SELECT *, {minute('base_time')} AS minute FROM movements) m ON m.airport_group = g.airport_group AND m.base_time >= g.interval_start - INTERVAL 61 minute AND m.base_time < g.interval_start + INTERVAL 91 minute GROUP BY ALL"
VIEWS |= {"hourly": _hourly, "ranges": _ranges}
NEEDS |= {"hourly": ("grid", "movements"), "ranges": ("grid", "movements")}
_schedule = """cast(dep AS bigint) AS scheduled_departures, cast(arr AS bigint) AS scheduled_arrivals, cast(n_all AS bigint) AS scheduled_movements, """ + r("CASE WHEN n_all > 0 THEN dep / n_all ELSE 0 END", "scheduled_dep_ratio") + ", " + r("CASE WHEN n_all > 0 THEN arr / n_all ELSE 0 END", "scheduled_arr_ratio")
_ranged = ", ".join(f"cast({n} AS bigint) AS {n}" for n in COUNTS) + ", " + r("(scheduled_dep_prev_30m + scheduled_arr_prev_30m) / 30.0", "scheduled_movements_prev30_ratio")
_gap = "cast(coalesce(gap, 999) AS double) AS overlap_min_gap_minutes, cast(coalesce(gap, 999) <= 3 AS double) AS overlap_near_conflict_flag"
_day_bucket = "airport_group || '_d' || (isodow(date) - 1)"
_hour_bucket = "airport_group || '_h' || lpad(cast(hour AS varchar), 2, '0')"
_cdf = ", ".join(r(f"ordered[cast(least(n - 1, floor({u} * n)) AS integer) + 1]", name) for u, name in ((0.0, "low"), (0.25, "q25"), (0.5, "q50"), (0.999999, "high")))

SQL: dict[str, str] = {
    "event_unpivot_scheduled": with_("flights") + " UNION ALL ".join(EVENT.format(m=m, s=s, a=a, b=s) for m, s, a in (("dep", "std", "atd"), ("arr", "sta", "ata"))),
    "event_unpivot_actual": with_("flights") + " UNION ALL ".join(EVENT.format(m=m, s=s, a=a, b=f"coalesce({a}, {s})") for m, s, a in (("dep", "std", "atd"), ("arr", "sta", "ata"))),
    "base_hour_grid": with_("days", "easters") + f"""SELECT airport_group, date, hour, interval_start, interval_start + INTERVAL 1 hour AS interval_end, cast(isodow(date) - 1 AS integer) AS dayofweek, cast(month(date) AS integer) AS month,
        {wave('hour', 24, 'hour')}, {wave('(isodow(date) - 1)', 7, 'dow')}, {wave('month(date)', 12, 'month')}, {CALENDAR}, {SEASON.format('date')} AS season FROM (SELECT *, date + to_hours(hour) AS interval_start FROM days) AS days""",
    "operational_windows": with_("movements_w") + f"SELECT flight_id, airport_group, movement, window_start, window_end, {minute('window_start')} AS start_minute, {minute('window_end')} AS end_minute FROM movements_w",
    "july_flights": with_("flights") + "SELECT dep_airport_group, count(*) AS n_flights, min(std) AS first_std, max(sta) AS last_sta FROM flights WHERE std BETWEEN TIMESTAMP '1997-07-01' AND TIMESTAMP '1997-07-31 23:59:59' OR sta BETWEEN TIMESTAMP '1997-07-01' AND TIMESTAMP '1997-07-31 23:59:59' GROUP BY ALL",
    "prepared_schedule": with_("flights") + "SELECT coalesce(service_type, 'unknown') AS service_type, count(*) AS n_flights, cast(sum(cancelled) AS bigint) AS n_cancelled FROM flights GROUP BY 1",
    "minute_concurrency": with_("movements_c") + "SELECT airport_group, minute, cast(c AS bigint) AS concurrency FROM movements_c",
    "overlap_features": with_("movements_o", "movements_gap") + "SELECT airport_group, date, hour, " + ", ".join(r(c, c) for c in OVERLAP) + f", {_gap} FROM movements_o LEFT JOIN movements_gap USING (airport_group, date, hour)",
    "overlap_min_gap": with_("actuals_gap") + f"SELECT airport_group, date, hour, {_gap} FROM grid LEFT JOIN actuals_gap USING (airport_group, date, hour)",
    "minute_sequences": with_("movements_g") + "SELECT airport_group, date, hour, " + ", ".join(f"string_agg(cast({c} AS varchar), ',' ORDER BY m) AS {n}" for c, n in (("c", "concurrency"), ("dep", "departures"), ("arr", "arrivals"))) + " FROM movements_g GROUP BY ALL",
    "context_sequences": with_("movements_g") + "SELECT airport_group, date, hour, cast(180 AS bigint) AS n, coalesce(lag(s, 2) OVER w, z) || ',' || coalesce(lag(s) OVER w, z) || ',' || s AS context FROM (SELECT airport_group, date, hour, string_agg(cast(c AS varchar), ',' ORDER BY m) AS s, repeat('0,', 59) || '0' AS z FROM movements_g GROUP BY ALL) WINDOW w AS (PARTITION BY airport_group ORDER BY date, hour)",
    "schedule_hourly_counts": with_("hourly") + f"SELECT airport_group, date, hour, {_schedule} FROM hourly",
    "schedule_range_counts": with_("ranges") + f"SELECT airport_group, date, hour, {_ranged} FROM ranges",
    "calendar_features": with_("days", "easters") + f"SELECT date, {CALENDAR} FROM (SELECT DISTINCT date FROM days) AS days",
    "easter_dates": with_("easters") + "SELECT cast(year AS integer) AS year, cast(easter AS date) AS easter FROM easters",
    "public_holidays_generated": with_("easters") + f"SELECT date FROM (SELECT cast(unnest(range(a, b, INTERVAL 1 day)) AS date) AS date FROM (SELECT make_timestamp(min(year(o_orderdate)), 1, 1, 0, 0, 0) AS a, make_timestamp(max(year(o_orderdate)) + 1, 1, 1, 0, 0, 0) AS b FROM orders)) AS days WHERE {HOLIDAY}",
    "season_map": with_("days") + f"SELECT {SEASON.format('date')} AS season, count(*) AS n_rows, cast(sum(target) AS bigint) AS n_positive FROM days GROUP BY 1",
    "time_features": with_("days") + f"SELECT date, cast(isodow(date) - 1 AS integer) AS dayofweek, cast(month(date) AS integer) AS month, cast(week(date) AS integer) AS weekofyear, cast(day(date) = 1 AS integer) AS is_month_start, cast(last_day(date) = date AS integer) AS is_month_end, {wave('month(date)', 12, 'month')}, {wave('(isodow(date) - 1)', 7, 'dow')} FROM (SELECT DISTINCT date FROM days)",
    "airport_time_buckets": with_("days") + f"SELECT *, {_hour_bucket} AS airport_hour_bucket, {_day_bucket} AS airport_dow_bucket FROM days",
    "historical_rates": hist("days", "grid").replace("WITH ", with_("days", "grid").rstrip() + ",\n", 1),
    "monthly_target_stats": with_("days") + f"SELECT airport_group, cast(month(date) AS integer) AS month, {r('avg(target)', 'month_target_mean')}, {r('median(target)', 'month_target_median')}, {r('coalesce(stddev_samp(target), 0)', 'month_target_std')}, count(target) AS month_target_count FROM days GROUP BY ALL",
    "monthly_stats_fallback": with_("days") + f"""SELECT x.airport_group, x.date, x.hour, {r('coalesce(f.a, g.a, 0)', 'month_target_mean')}, {r('coalesce(f.b, g.b, 0)', 'month_target_median')}, {r('coalesce(f.c, g.c, 0)', 'month_target_std')}, cast(coalesce(f.d, g.d, 0) AS bigint) AS month_target_count
        FROM days x LEFT JOIN ({month_stats('airport_group,')}) f ON f.airport_group = x.airport_group AND f.month = month(x.date) LEFT JOIN ({month_stats('')}) g ON g.month = month(x.date)""",
    "target_lag": with_("lagged") + "SELECT airport_group, date, hour, cast(prev AS double) AS target_prev_hour FROM lagged",
    "target_rolling": with_("lagged") + "SELECT airport_group, date, hour, " + ", ".join(r(f"CASE WHEN count(target) OVER w{n} >= {max(low, n // 4)} THEN {f}(target) OVER w{n} END", f"target_rolling_{name}_{n}h") for n in (24, 72, 168, 336) for f, name, low in (("avg", "mean", 1), ("stddev_samp", "std", 2))) + " FROM lagged WINDOW " + ", ".join(f"w{n} AS (PARTITION BY airport_group ORDER BY date, hour ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (24, 72, 168, 336)),
    "hours_since_positive": with_("since") + "SELECT airport_group, date, hour, cast(since AS double) AS hours_since_positive FROM since",
    "recent_defaults": with_("recent") + "SELECT airport_group, hour, date, " + ", ".join(r(c, c) for c in ("target_prev_hour", "target_rolling_mean_24h", "target_rolling_std_24h", "hours_since_positive")) + " FROM recent QUALIFY row_number() OVER (PARTITION BY airport_group, hour ORDER BY date DESC) = 1",
    "recent_fallback_fill": with_("recent") + ", kept AS (SELECT * FROM recent), fine AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY airport_group, hour ORDER BY date DESC) = 1), coarse AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY airport_group ORDER BY date DESC, hour DESC) = 1) SELECT g.airport_group, DATE '2024-01-31' AS date, g.hour, " + ", ".join(r(f"coalesce(fine.{c}, coarse.{c}, (SELECT avg({c}) FROM kept), 0)", c) for c in ("target_prev_hour", "target_rolling_mean_24h", "hours_since_positive")) + " FROM (SELECT DISTINCT airport_group, hour FROM grid) g LEFT JOIN fine ON fine.airport_group = g.airport_group AND fine.hour = g.hour LEFT JOIN coarse ON coarse.airport_group = g.airport_group",
    "mean_imputation": with_("recent") + "SELECT airport_group, date, hour, " + ", ".join(r(f"coalesce({c}, (SELECT avg({c}) FROM recent), 0)", c) for c in ("target_prev_hour", "target_rolling_mean_24h", "target_rolling_std_24h", "hours_since_positive")) + " FROM recent",
    "weather_rollup": with_("weather") + "SELECT airport_group, date, hour, " + ", ".join(r(f"{f}({c})", f"{c}_{n}") for c, kinds in (("air_temperature", "mean min max"), ("wind_speed_of_gust", "max"), ("relative_humidity", "mean"), ("cloud_area_fraction_low", "mean"), ("precipitation_amount_1h", "mean max")) for n in kinds.split() for f in ["avg" if n == "mean" else n]) + " FROM weather GROUP BY ALL",
    "weather_flags": with_("weather") + f""", agg AS (SELECT airport_group, date, hour, cast(max(wind_speed_of_gust) >= 15 AS integer) AS hw, cast(max(precipitation_amount_1h) >= 3 AS integer) AS hp, cast(avg(cloud_area_fraction_low) >= 80 AS integer) AS lc, avg(relative_humidity) AS rh FROM weather GROUP BY ALL),
        sym AS (SELECT airport_group, date, hour, symbol_code_1h AS s FROM weather WHERE symbol_code_1h IS NOT NULL GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY airport_group, date, hour ORDER BY count(*) DESC, symbol_code_1h) = 1)
        SELECT airport_group, date, hour, hw AS weather_high_wind, hp AS weather_heavy_precip, lc AS weather_low_ceiling, {r('0.4 * hw + 0.4 * hp + 0.2 * lc', 'weather_complex_score')}, cast(lc = 1 OR rh >= 90 AS integer) AS weather_ifr_proxy,
        cast(coalesce(contains(s, 'thunder'), false) AS integer) AS weather_symbol_thunder, cast(coalesce(contains(s, 'snow'), false) AS integer) AS weather_symbol_snow, cast(coalesce(contains(s, 'rain') OR contains(s, 'sleet'), false) AS integer) AS weather_symbol_rain FROM agg LEFT JOIN sym USING (airport_group, date, hour)""",
    "dominant_symbol": with_("weather") + "SELECT airport_group, date, hour, s AS dominant_symbol_code_1h FROM (SELECT DISTINCT airport_group, date, hour FROM weather) LEFT JOIN (SELECT airport_group, date, hour, symbol_code_1h AS s FROM weather WHERE symbol_code_1h IS NOT NULL GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY airport_group, date, hour ORDER BY count(*) DESC, symbol_code_1h) = 1) USING (airport_group, date, hour)",
    "props_json_flatten": with_("weather") + f"SELECT airport, airport_group, {r('avg(air_temperature)', 'air_temperature')}, {r('avg(wind_speed_of_gust)', 'wind_speed_of_gust')}, {r('avg(precipitation_amount_1h)', 'precipitation_amount_1h')}, {r('avg(precipitation_amount_1h * 2)', 'precipitation_amount_6h')}, count(symbol_code_1h) AS n_symbols, cast(0 AS bigint) AS n_symbols_12h, date_trunc('second', min(forecast_time)) AS first_time FROM weather GROUP BY ALL",
    "observation_pivot": f"SELECT {letter('user_id')} AS airport_group, cast(ts AS date) AS date, " + ", ".join(f"arg_max(value, event_id) FILTER (event_type = '{e}') AS \"{e}\"" for e in ("click", "view", "purchase")) + " FROM events GROUP BY 1, 2",
    "airport_hour_mean": with_("weather") + f"SELECT airport_group, airport, date_trunc('hour', forecast_time) AS forecast_time, {r('avg(air_temperature)', 'air_temperature')}, {r('avg(relative_humidity)', 'relative_humidity')} FROM weather GROUP BY 1, 2, 3",
    "coverage_summary": with_("weather") + "SELECT airport_group, count(*) AS n_rows, min(forecast_time) AS first_time, max(forecast_time) AS last_time FROM weather GROUP BY 1",
    "coordinates_scan": with_("airports") + f"SELECT iata_code AS airport, airport_group, {r('elevation', 'elevation')}, {r('latitude', 'latitude')}, {r('longitude', 'longitude')} FROM airports WHERE latitude IS NOT NULL AND longitude IS NOT NULL",
    "group_centroid": with_("airports") + f"SELECT airport_group, {r('avg(latitude)', 'latitude')}, {r('avg(longitude)', 'longitude')}, {r('avg(elevation)', 'elevation')} FROM airports GROUP BY 1",
    "airport_semi_anti": with_("airports") + ", codes AS (SELECT DISTINCT unnest(['C' || n_nationkey, 'X' || (n_nationkey + 700), 'X' || (n_nationkey + 3)]) AS code FROM nation), up AS (SELECT upper(ident) AS ident, upper(iata_code) AS iata_code, airport_group FROM airports) SELECT DISTINCT ident, iata_code, airport_group FROM up WHERE iata_code IN (SELECT code FROM codes) OR ident IN (SELECT code FROM codes WHERE code NOT IN (SELECT iata_code FROM up))",
    "nearest_station": with_("airports") + """SELECT ident AS airport, round(min(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - longitude) / 2), 2))))), 3) AS distance_km
        FROM airports CROSS JOIN (SELECT 58 + (s_suppkey * 37 % 1300) / 100.0 AS lat, 5 + (s_suppkey * 11 % 2500) / 100.0 AS lon FROM supplier) s WHERE latitude IS NOT NULL GROUP BY 1""",
    "holiday_join": with_("days", "easters") + f"SELECT airport_group, date, hour, target, CASE WHEN h THEN CASE WHEN month(date) = 12 THEN 'Juleferie' ELSE 'Holiday' END ELSE '' END AS holiday_name, cast(h AS integer) AS is_public_holiday_official, cast(h AND month(date) = 12 AS integer) AS is_school_holiday_official FROM (SELECT *, coalesce({HOLIDAY}, false) AS h FROM days)",
    "school_holiday_join": with_("days") + "SELECT airport_group, date, hour, target, cast(week(date) IN (8, 40) AND airport_group < 'D' AS integer) AS is_school_holiday_calendar, CASE WHEN week(date) IN (8, 40) AND airport_group < 'D' THEN 'break ' || week(date) ELSE '' END AS school_holiday_name FROM days",
    "temporal_folds": with_("days") + "SELECT period, cast(n_train AS bigint) AS n_train, n_val FROM (SELECT period, n_val, sum(n_val) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_train, row_number() OVER (ORDER BY period DESC) AS back FROM (SELECT strftime(date, '%Y-%m') AS period, count(*) AS n_val FROM days GROUP BY 1)) WHERE back <= 4 AND n_train > 0",
    "temporal_target_encoding": with_("days") + f""", b AS (SELECT *, {_hour_bucket} AS airport_hour_bucket, strftime(date, '%Y-%m') AS p FROM days), folds AS (SELECT DISTINCT p FROM b ORDER BY p DESC LIMIT 4),
        enc AS (SELECT f.p, t.airport_hour_bucket AS c, avg(t.target) AS v FROM folds f JOIN b t ON t.p < f.p GROUP BY ALL)
        SELECT b.airport_group, b.date, b.hour, b.target, b.airport_hour_bucket, {r('coalesce(enc.v, (SELECT avg(target) FROM b))', 'airport_hour_bucket_target_enc')} FROM b LEFT JOIN enc ON enc.p = b.p AND enc.c = b.airport_hour_bucket""",
    "apply_target_encoding": with_("days") + f""", b AS (SELECT *, {_day_bucket} AS airport_dow_bucket FROM days), train AS (SELECT * FROM b WHERE date < DATE '1999-01-01'), m AS (SELECT airport_dow_bucket, avg(target) AS v FROM train GROUP BY 1)
        SELECT b.*, {r('coalesce(m.v, (SELECT avg(target) FROM train))', 'airport_dow_bucket_target_enc')} FROM b LEFT JOIN m USING (airport_dow_bucket)""",
    "one_hot_frozen": with_("days") + "SELECT date, hour, target, " + ", ".join(f"cast(airport_group = '{g}' AS integer) AS airport_group_{g}" for g in "ABCDE") + " FROM days",
    "roc_auc": with_("scored") + f"SELECT {r('auc', 'auc')}, cast(n AS bigint) AS n FROM (" + AUC.format(by="", part="", part2="PARTITION BY", group="") + ")",
    "monthly_auc": with_("scored") + f"SELECT month, {r('CASE WHEN p = 0 OR p = n THEN 0.5 ELSE auc END', 'auc')}, cast(n AS bigint) AS n FROM (" + AUC.format(by="month,", part="PARTITION BY strftime(date, '%Y-%m')", part2="PARTITION BY strftime(date, '%Y-%m'),", group="GROUP BY month") + ")",
    "pairwise_hinge": with_("scored") + f", s AS (SELECT score, sum(target) AS p, sum(1 - target) AS q FROM scored GROUP BY 1) SELECT {r('sum(a.p * b.q * greatest(b.score - a.score, 0)) / sum(a.p * b.q)', 'loss')} FROM s a CROSS JOIN s b",
    "dataset_summary": with_("days") + f"SELECT count(*) AS n_rows, count(DISTINCT airport_group) AS n_groups, min(date) AS first_date, max(date) AS last_date, {r('avg(target)', 'positive_rate')} FROM days",
    "group_rates": with_("days") + f"SELECT airport_group, count(*) AS n_rows, {r('avg(target)', 'positive_rate')} FROM days GROUP BY 1",
    "monthly_rate": with_("days") + f"SELECT strftime(date, '%Y-%m') AS month, count(*) AS n_rows, {r('avg(target)', 'positive_rate')} FROM days GROUP BY 1",
    "concurrency_profile": with_("movements_o", "target") + f"SELECT cast(least(overlap_max, 12) AS integer) AS concurrency, {r('avg(overlap_mean / 10)', 'mean_score')}, {r('avg(target)', 'mean_target')}, count(*) AS n_rows FROM movements_o JOIN target USING (airport_group, date, hour) GROUP BY 1 HAVING count(*) >= 50",
    "family_importance": with_("importance") + f", f AS (SELECT CASE split_part(feature, '_', 1) WHEN 'sim' THEN 'simulation' WHEN 'overlap' THEN 'overlap' WHEN 'scheduled' THEN 'schedule' WHEN 'hist' THEN 'history' WHEN 'weather' THEN 'weather' ELSE 'other' END AS family, gain FROM importance) SELECT family, {r('sum(gain)', 'gain')}, count(*) AS n_features, {r('sum(gain) / (SELECT sum(gain) FROM f)', 'share')} FROM f GROUP BY 1",
    "topk_coefficients": with_("importance") + "SELECT * FROM importance ORDER BY abs(gain) DESC, feature LIMIT 25",
    "cancel_rates": with_("sided") + f"SELECT level, key, n, {r('rate', 'rate')} FROM (" + by_levels("sided", "congestion_bucket", "count(*) AS n, (sum(cancelled) + 1.0) / (count(*) + 2.0) AS rate") + ")",
    "delay_distributions": with_("delays") + f"SELECT level, key, n, {_cdf} FROM (" + by_levels("delays", "context", "count(*) AS n, list(delay ORDER BY delay) AS ordered", "HAVING count(*) >= 5 OR {level} = 7") + ")",
    "congestion_buckets": with_("sides") + "SELECT movement, block_bucket, congestion_bucket, count(*) AS n_rows, max(congestion) AS most FROM (" + congested("sides", "airport_group, movement, scheduled_time") + ") GROUP BY ALL",
    "cancel_ladder": with_("h_rated") + f"SELECT dep_airport_group, service_type, cast(hour(std) AS integer) AS hour, count(*) AS n_flights, {r('avg(rate)', 'rate')} FROM h_rated GROUP BY 1, 2, 3",
    "stratified_uniforms": with_("flights") + ", s AS (SELECT flight_id, cast(unnest(range(8)) AS integer) AS sim_id FROM flights) SELECT sim_id, " + ", ".join(f"round({f}(u_{s}), 9) AS {s}_{n}" for s in ("cancel", "dep", "arr") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))) + f" FROM (SELECT sim_id, {', '.join(f'{draw(s)} AS u_{s}' for s in ('cancel', 'dep', 'arr'))} FROM s) GROUP BY 1",
    "simulated_events": with_("simulated") + "SELECT cast(sim_id AS integer) AS sim_id, airport_group, movement, count(*) AS n_events, min(base_time) AS first_time, max(base_time) AS last_time, cast(sum(hour(base_time) * 60 + minute(base_time)) AS bigint) AS minutes FROM simulated GROUP BY ALL",
    "simulation_summary": with_("sim_h", "sim_grid") + "SELECT g.airport_group, g.date, g.hour, " + ", ".join(r(f"coalesce(sum({m}), 0) / 8.0", f"sim_{m}_mean") + ", " + r(f"sqrt(greatest((coalesce(sum({m} * {m}), 0) - coalesce(sum({m}), 0) * coalesce(sum({m}), 0) / 8.0) / 7.0, 0))", f"sim_{m}_std") for m in SIM) + f", {r('coalesce(sum(prob_any_overlap), 0) / 8.0', 'sim_prob_any_overlap')}, cast(8 AS integer) AS simulations_used FROM sim_grid g LEFT JOIN sim_h s ON s.airport_group = g.airport_group AND s.h = cast(epoch(cast(g.date AS timestamp)) // 3600 AS bigint) + g.hour GROUP BY 1, 2, 3",
    "feature_matrix": "",
    "airport_groups_enriched": with_("airports") + f"SELECT m.airport_group, m.code AS iata_code, a.ident, a.airport_group AS airport_group_our, {r('latitude', 'latitude')}, {r('elevation', 'elevation')} FROM (SELECT {letter('n_nationkey')} AS airport_group, 'C' || (n_nationkey * 30) AS code FROM nation) m LEFT JOIN airports a ON upper(a.iata_code) = m.code",
    "simulation_fill": with_("days", "grid") + f", j AS (SELECT g.airport_group, g.d AS date, g.hour, cast(target AS double) AS v FROM (SELECT airport_group, hour, date + cast(DATE '1997-07-01' - DATE '2024-01-01' AS integer) AS d FROM grid) g LEFT JOIN days ON days.airport_group = g.airport_group AND days.date = g.d AND days.hour = g.hour) SELECT airport_group, date, hour, {r('coalesce(v, (SELECT avg(v) FROM j), 0.2)', 'sim_prob_any_overlap')} FROM j",
    "hash_sample": with_("days") + f"SELECT * FROM days ORDER BY {unit(chr(40) + 'airport_group || ' + repr('/') + ' || date || ' + repr('/') + ' || hour' + chr(41), 0)}, airport_group, date, hour LIMIT 200",
    "minute_bounds": with_("movements") + "SELECT flight_id, cast(base_time AS date) AS date, cast(hour(base_time) AS integer) AS hour, cast(minute(base_time) AS integer) AS minute, cast(isodow(base_time) - 1 AS integer) AS dayofweek, cast(month(base_time) AS integer) AS month, cast(year(base_time) AS integer) AS year, date_trunc('minute', base_time) AS floored, date_trunc('minute', base_time + INTERVAL 59999999 microseconds) AS ceiled FROM movements",
    "design_frame": with_("target", "hourly", "ranges", "weather") + f""", w AS (SELECT airport_group, date, hour, avg(air_temperature) AS t, cast(avg(cloud_area_fraction_low) >= 80 OR avg(relative_humidity) >= 90 AS integer) AS ifr FROM weather GROUP BY ALL)
        SELECT airport_group, date, hour, target, {SEASON.format('date')} AS season, cast(isodow(date) >= 6 AS integer) AS is_weekend, cast(n_all AS bigint) AS scheduled_movements, scheduled_dep_next_90m, {r('coalesce(t, 0)', 'air_temperature_mean')}, coalesce(ifr, 0) AS weather_ifr_proxy FROM target JOIN hourly USING (airport_group, date, hour) JOIN ranges USING (airport_group, date, hour) LEFT JOIN w USING (airport_group, date, hour)""",
    "delay_quantile_lookup": with_("h_ready") + f"SELECT flight_id, movement, airport_group, scheduled_time, n AS n_history, {r('coalesce(ordered[cast(least(n - 1, floor(' + unit('flight_id', 5) + ' * n)) AS integer) + 1], 0)', 'delay')} FROM h_ready",
    "streaming_hourly_counts": with_("movements") + "SELECT airport_group, date_trunc('hour', base_time) AS hour_start, count(*) FILTER (movement = 'dep') AS departures, count(*) FILTER (movement = 'arr') AS arrivals FROM movements GROUP BY 1, 2",
    "adaptive_stop": with_("sim_grid", "stop_n") + f"""SELECT g.airport_group, g.date, g.hour, {r('coalesce(p.k, 0) / cast(used AS double)', 'sim_prob_any_overlap')}, cast(used AS integer) AS simulations_used FROM sim_grid g CROSS JOIN stop_n
        LEFT JOIN stop_p p ON p.n = used AND p.airport_group = g.airport_group AND p.h = {minute('(g.date + to_hours(g.hour))')} // 60""",
    "balanced_weights": with_("days") + f"SELECT airport_group, date, hour, target, {r('count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY target))', 'weight')} FROM days",
    "source_training": with_("days") + f"SELECT airport_group, date, hour, target, {SEASON.format('date')} AS feat_season, CASE WHEN hour % 5 <> 0 THEN hour END AS feat_sched_concurrence, cast(NULL AS integer) AS feat_sched_flights_cnt FROM days WHERE date >= DATE '1997-01-01'",
    "source_flights": with_("flights") + "SELECT flight_id, cast(NULL AS varchar) AS dep_airport, dep_airport_group, cast(NULL AS varchar) AS arr_airport, nullif(arr_airport_group, 'NA') AS arr_airport_group, service_type, cancelled, std, sta, atd, ata FROM flights",
    "source_schedule": with_("flights") + "SELECT flight_id, cast(NULL AS varchar) AS dep_airport, dep_airport_group, cast(NULL AS varchar) AS arr_airport, nullif(arr_airport_group, 'NA') AS arr_airport_group, service_type, std, sta FROM flights",
    "source_inference": with_("days") + f"SELECT airport_group, date, hour, {SEASON.format('date')} AS feat_season, cast(NULL AS integer) AS feat_sched_concurrence, cast(NULL AS integer) AS feat_sched_flights_cnt FROM days",
    "source_template": with_("days") + "SELECT airport_group, date, hour, CASE WHEN hour <> 3 THEN hour / 32.0::double END AS pred FROM days",
    "source_groups": f"SELECT {letter('n_nationkey')} AS airport_group, n_name AS airport FROM nation",
    "source_airports": with_("airports") + "SELECT ident, iata_code, cast(NULL AS varchar) AS name, latitude, longitude, elevation FROM airports",
    "source_weather": with_("weather") + f"SELECT airport_group, cast(date_trunc('second', forecast_time) AS date) AS date, hour, count(*) AS n_rows, {r('avg(air_temperature)', 'mean_temperature')}, max(symbol_code_1h) AS last_symbol FROM weather GROUP BY ALL",
    "source_observations": f"SELECT 'AP' || (user_id % 21) AS airport, {letter('user_id')} AS airport_group, date_trunc('hour', ts) AS forecast_time, " + ", ".join(f"max(value) FILTER (event_type = '{x}') AS {x}" for x in ("click", "view", "purchase")) + " FROM events WHERE event_type <> 'error' GROUP BY ALL",
    "source_public_holidays": with_("easters", "days") + f"SELECT date, CASE WHEN month(date) <> 5 THEN strftime(date, 'day %m-%d') END AS name, day(date) % 2 = 0 AS is_public_holiday FROM (SELECT DISTINCT date FROM days) AS days WHERE {HOLIDAY}",
    "source_school_holidays": with_("days") + "SELECT DISTINCT airport_group, date, 'a' AS name, cast(1 AS integer) AS is_school_holiday FROM days WHERE week(date) IN (8, 40)",
    "sink_predictions": with_("days") + "SELECT airport_group, strftime(date, '%Y-%m-%d') AS date, cast(hour AS varchar) AS hour, printf('%.3f', cast((hour * 41 + day(date) * 7) % 997 AS double) / 997) AS pred, row_number() OVER (ORDER BY days.date, days.hour, airport_group) - 1 AS position FROM days",
    "sink_keyed": with_("days") + "SELECT airport_group, date, hour, target FROM days WHERE strftime(date, '%Y-%m') = '1997-07'",
    "sink_manifest": with_("days") + "SELECT hour AS first, target AS second, date AS third, airport_group AS fourth FROM days",
    "split_target": with_("days") + "SELECT airport_group, date, hour, target, cast(month(date) AS integer) AS month FROM days",
    "ensure_columns": with_("days") + "SELECT *, cast(0 AS double) AS extra FROM days",
    "standardised": with_("days") + f"SELECT airport_group, date, hour, {r('(target - avg(target) OVER ()) / stddev_pop(target) OVER ()', 'target')}, cast(0 AS double) AS one FROM days",
    "time_window": with_("flights") + "SELECT dep_airport_group, count(*) AS n_flights, min(std) AS first_std FROM flights WHERE std BETWEEN TIMESTAMP '1997-07-01' AND TIMESTAMP '1997-07-31 23:59:59' GROUP BY ALL",
}
SQL["cached_result"] = SQL["cancel_rates"]
SQL["drop_prefixed"] = f"SELECT * EXCLUDE (is_weekend, is_public_holiday, is_school_holiday, is_month_start, is_month_end) FROM ({SQL['base_hour_grid']})"
SQL["array_of_columns"] = f"SELECT airport_group, date, hour, concurrency AS sequence FROM ({SQL['minute_sequences']})"
SQL["feature_matrix"] = with_("days", "hourly", "ranges", "movements_o", "movements_gap") + f", hr AS ({hist('days', 'grid')}) SELECT airport_group, date, hour, {_schedule}, {_ranged}, " + ", ".join(r(c, c) for c in OVERLAP) + f", {_gap}, hist_rate_group_hour, hist_support_group_hour, hist_rate_month_hour, hist_rate_dow_hour FROM hourly JOIN ranges USING (airport_group, date, hour) JOIN movements_o USING (airport_group, date, hour) JOIN hr USING (airport_group, date, hour) LEFT JOIN movements_gap USING (airport_group, date, hour)"

"""DuckDB SQL for the queries of plans/learned.py that SQL can tell: all pairs, unnested taps, ranks."""

from __future__ import annotations

from spanwise.plans import oracle
from spanwise.plans.oracle import hist, r, with_



def auc(source: str, score: str, by: str = "") -> str:
    """A query of the AUC (0.5 for a single class) by Mann and Whitney's ranks."""
    part = f"PARTITION BY {by}" if by else ""
    tied = f"PARTITION BY {by + ', ' if by else ''}{score}"
    return f"""SELECT {by + ',' if by else ''} CASE WHEN sum(target) IN (0, count(*)) THEN 0.5 ELSE (sum(CASE WHEN target = 1 THEN rk END) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * (count(*) - sum(target))) END AS auc
        FROM (SELECT *, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER ({tied}) - 1) / 2.0 AS rk FROM {source}) {'GROUP BY ' + by if by else ''}"""


_kernels = "SELECT d, a, b, row_number() OVER (ORDER BY d, a, b) AS k FROM (SELECT unnest([1, 2, 4, 8]) AS d), (SELECT unnest(range(5)) AS a), (SELECT unnest(range(5)) AS b) WHERE a < b"
_context = "SELECT airport_group, date, hour, coalesce(lag(s, 2) OVER w, z) || coalesce(lag(s) OVER w, z) || s AS x FROM (SELECT airport_group, date, hour, list(c ORDER BY m) AS s, [0 FOR i IN range(60)] AS z FROM movements_g GROUP BY ALL) WINDOW w AS (PARTITION BY airport_group ORDER BY date, hour)"
_tap = "p[i + ({t} - 2) * d + 17]"
_response = "5 * (p[i + (a - 2) * d + 17] + p[i + (b - 2) * d + 17]) - 2 * (" + " + ".join(_tap.format(t=t) for t in range(5)) + ")"
_recent = ("target_prev_hour", "target_rolling_mean_24h", "target_rolling_std_24h", "hours_since_positive")
_past = f"""past AS (SELECT * FROM days WHERE date < DATE '1998-01-01'), coming AS (SELECT airport_group, date, hour FROM days WHERE date >= DATE '1998-01-01'),
l AS (SELECT *, lag(target) OVER w AS prev, row_number() OVER w AS n FROM past WINDOW w AS (PARTITION BY airport_group ORDER BY date, hour)),
s AS (SELECT *, n - max(CASE WHEN prev >= 0.5 THEN n END) OVER (PARTITION BY airport_group ORDER BY date, hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM l),
recent AS (SELECT airport_group, date, hour, cast(prev AS double) AS target_prev_hour, CASE WHEN count(target) OVER w >= 6 THEN avg(target) OVER w END AS target_rolling_mean_24h,
    CASE WHEN count(target) OVER w >= 6 THEN stddev_samp(target) OVER w END AS target_rolling_std_24h, cast(since AS double) AS hours_since_positive FROM s WINDOW w AS (PARTITION BY airport_group ORDER BY date, hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
fine AS (SELECT * FROM recent QUALIFY row_number() OVER (PARTITION BY airport_group, hour ORDER BY date DESC) = 1), coarse AS (SELECT * FROM recent QUALIFY row_number() OVER (PARTITION BY airport_group ORDER BY date DESC, hour DESC) = 1),
mf AS (SELECT airport_group, month(date) AS month, avg(target) AS a, median(target) AS b, coalesce(stddev_samp(target), 0) AS c, count(target) AS d FROM past GROUP BY ALL),
mg AS (SELECT month(date) AS month, avg(target) AS a, median(target) AS b, coalesce(stddev_samp(target), 0) AS c, count(target) AS d FROM past GROUP BY ALL),
eh AS (SELECT airport_group, hour, avg(target) AS v FROM past GROUP BY ALL), ed AS (SELECT airport_group, isodow(date) AS dow, avg(target) AS v FROM past GROUP BY ALL), """
_months = ("month_target_mean", "month_target_median", "month_target_std")
_profile = "SELECT cast(least(overlap_max, 12) AS integer) AS name, count(*) AS n_rows, avg(overlap_mean / 10) AS mean_score, avg(target) AS mean_target FROM rows GROUP BY 1 HAVING count(*) >= 50"
_told = lambda x: f"printf('%.6f', cast({x} AS double))"

SQL: dict[str, str] = {
    "kernel_features": with_("movements_g") + f""", x AS ({_context}), z AS (SELECT airport_group, date, hour, [0 FOR i IN range(16)] || x || [0 FOR i IN range(16)] AS p FROM x),
        v AS (SELECT airport_group, date, hour, k, [{_response} FOR i IN range(180)] AS y FROM z CROSS JOIN ({_kernels}))
        SELECT airport_group, date, hour, string_agg(cast(list_max(y) AS varchar), ',' ORDER BY k) AS largest, string_agg(cast(len([e FOR e IN y IF e > 0]) AS varchar), ',' ORDER BY k) AS above FROM v GROUP BY ALL""",
    "hinge_gradient": with_("scored") + f""", s AS (SELECT score, sum(target) AS p, sum(1 - target) AS q FROM scored GROUP BY 1),
        g AS (SELECT a.score, sum(CASE WHEN b.score > a.score - 0.05 THEN b.q ELSE 0 END) AS above, sum(CASE WHEN b.score - 0.05 < a.score THEN b.p ELSE 0 END) AS below FROM s a CROSS JOIN s b GROUP BY 1)
        SELECT airport_group, date, hour, target, {r('1000000 * CASE WHEN target = 1 THEN -above ELSE below END / (SELECT sum(p) * sum(q) FROM s)', 'gradient')} FROM scored JOIN g USING (score)""",
    "month_report": with_("scored") + f""", rows AS (SELECT *, unnest([strftime(date, '%Y-%m'), 'all']) AS month FROM scored), a AS ({auc('rows', 'score', 'month')})
        SELECT month, count(*) AS n, cast(sum(target) AS bigint) AS n_positive, {r('avg(score)', 'mean_score')}, {r('any_value(auc)', 'auc')} FROM rows JOIN a USING (month) GROUP BY month""",
    "sequence_ablation": with_("movements_g", "target") + f""", rows AS (SELECT g.airport_group, g.date, g.hour, any_value(target) AS target, sum(dep) AS dep, sum(arr) AS arr, 2 * sum(dep) + sum(arr) AS twofold FROM movements_g g JOIN target USING (airport_group, date, hour) GROUP BY ALL),
        a AS ({auc('rows', 'twofold')}), b AS ({auc('rows', 'arr')}), c AS ({auc('rows', '(2 * dep)')})
        SELECT 'departures' AS channel, {r('a.auc - b.auc', 'lost')} FROM a, b UNION ALL SELECT 'arrivals', {r('a.auc - c.auc', 'lost')} FROM a, c""",
    "target_features": with_("days") + ", " + _past + hist("past", "coming")[5:].replace("SELECT b.airport_group, b.date, b.hour,", "SELECT b.airport_group, b.date, b.hour, " + ", ".join(r(f"coalesce(mf.{c}, mg.{c}, 0)", n) for c, n in zip("abc", _months, strict=True))
        + ", cast(coalesce(mf.d, mg.d, 0) AS bigint) AS month_target_count, " + ", ".join(r(f"coalesce(fine.{c}, coarse.{c}, (SELECT avg({c}) FROM recent), 0)", c) for c in _recent)
        + ", " + r("coalesce(eh.v, (SELECT avg(target) FROM past))", "airport_hour_bucket_target_enc") + ", " + r("coalesce(ed.v, (SELECT avg(target) FROM past))", "airport_dow_bucket_target_enc") + ", ", 1)
        + """ LEFT JOIN mf ON mf.airport_group = b.airport_group AND mf.month = month(b.date) LEFT JOIN mg ON mg.month = month(b.date) LEFT JOIN fine ON fine.airport_group = b.airport_group AND fine.hour = b.hour
        LEFT JOIN coarse ON coarse.airport_group = b.airport_group LEFT JOIN eh ON eh.airport_group = b.airport_group AND eh.hour = b.hour LEFT JOIN ed ON ed.airport_group = b.airport_group AND ed.dow = isodow(b.date)""",
    "encoded_buckets": with_("days") + f""", past AS (SELECT * FROM days WHERE date < DATE '1998-01-01') SELECT airport_group || '_h' || lpad(cast(hour AS varchar), 2, '0') AS bucket, {r('avg(target)', 'mean')} FROM past GROUP BY 1
        UNION ALL SELECT airport_group || '_d' || (isodow(date) - 1), {r('avg(target)', 'mean')} FROM past GROUP BY 1""",
    "analysis_document": with_("movements_o", "target") + f""", rows AS (SELECT airport_group, date, hour, overlap_max, overlap_mean, overlap_mean / 10 AS score, target FROM movements_o JOIN target USING (airport_group, date, hour)),
        twice AS (SELECT *, unnest([strftime(date, '%Y-%m'), 'all']) AS month FROM rows), a AS ({auc('twice', 'score', 'month')}),
        f AS (SELECT 'sim_' || p_partkey AS feature, cast(p_partkey * 31 % 997 AS double) AS gain FROM part), top AS (SELECT * FROM f ORDER BY gain DESC, feature LIMIT 10),
        whole AS (SELECT count(*) AS n_rows, count(DISTINCT airport_group) AS n_groups, min(date) AS first_date, max(date) AS last_date, {_told('avg(target)')} AS positive_rate FROM rows),
        groups AS (SELECT airport_group AS name, count(*) AS n_rows, {_told('avg(target)')} AS positive_rate FROM rows GROUP BY 1), months AS (SELECT strftime(date, '%Y-%m') AS name, count(*) AS n_rows, {_told('avg(target)')} AS positive_rate FROM rows GROUP BY 1),
        profile AS ({_profile}), aucs AS (SELECT month AS name, count(*) AS n, cast(sum(target) AS bigint) AS n_positive, {_told('avg(score)')} AS mean_score, {_told('any_value(auc)')} AS auc FROM twice JOIN a USING (month) GROUP BY month)
        """ + " UNION ALL ".join(
            [f"SELECT 'summary' AS section, '{c}' AS name, cast({c} AS varchar) AS value FROM whole" for c in ("n_rows", "n_groups", "first_date", "last_date", "positive_rate")]
            + [f"SELECT '{t}', name || '.{c}', cast({c} AS varchar) FROM {t}" for t in ("groups", "months") for c in ("n_rows", "positive_rate")]
            + [f"SELECT 'profile', name || '.{c}', {_told(c)} FROM profile" for c in ("mean_score", "mean_target")] + ["SELECT 'profile', name || '.n_rows', cast(n_rows AS varchar) FROM profile"]
            + [f"SELECT 'auc', name || '.{c}', cast({c} AS varchar) FROM aucs" for c in ("n", "n_positive", "mean_score", "auc")]
            + [f"SELECT 'features', feature || '.gain', {_told('gain')} FROM top"]
            + [f"SELECT 'families', 'simulation.{c}', {v} FROM f" for c, v in (("gain", _told("sum(gain)")), ("n_features", "cast(count(*) AS varchar)"), ("share", _told("max(1)")))]
        ),
}
SQL |= {"sink_airports": oracle.SQL["airport_groups_enriched"], "sink_observations": oracle.SQL["source_observations"], "source_forecasts": oracle.SQL["props_json_flatten"]}

"""History of daily analyses per host, trend checks, rate alerts and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelog.functions import values as V
from sievelog.operators import analysis as A, history as H, rate as RT, trend as T
from sievelog.operators.sequence import trailing_sums
from sievelog.plans import oracle as O
from sievelog.plans.queries_analysis import BAD, LINES_SQL, lines, r6
from sievelog.plans.registry import query
from sievelog.sources.store import materialise
from sievelog.sources.views import table

KEYS = ["host", "ts"]

HISTORY_SQL = f"""{LINES_SQL}, history AS (SELECT host, date_trunc('day', ts) AS ts, count(*) AS total_logs,
 count(*) FILTER (WHERE {BAD}) AS n_anomalies, avg(CASE WHEN {BAD} THEN CAST(1 AS DOUBLE) ELSE 0 END) * 100 AS anomaly_rate,
 min(anomaly_score) AS score_min, max(anomaly_score) AS score_max, avg(anomaly_score) AS score_mean,
 stddev_pop(anomaly_score) AS score_std, {', '.join(f"count(*) FILTER (WHERE {BAD} AND severity_level = '{lv}') AS sev_{lv.lower()}" for lv in A.LEVELS)},
 count(*) FILTER (WHERE {BAD} AND is_auth_failure = 1) AS auth_failures, count(*) FILTER (WHERE is_collscan = 1) AS collscans,
 count(*) FILTER (WHERE is_slow_query = 1) AS slow_queries, count(*) FILTER (WHERE is_drop_operation = 1) AS drop_operations
 FROM lines GROUP BY 1, 2)"""
W = f"WITH {HISTORY_SQL}"


def history(spark, d):
    return H.build_history(lines(spark, d).withColumn("ts", F.date_trunc("day", "ts")), KEYS)


def us(c="ts"):
    return V.micros(F.col(c)).alias(f"{c}_us")


@query("g22_history_statistics", f"""{W} SELECT count(*) AS analyses, CAST(sum(n_anomalies) AS BIGINT) AS anomalies, CAST(sum(total_logs) AS BIGINT) AS logs,
 round(avg(anomaly_rate), 2) AS avg_rate, round(max(anomaly_rate), 2) AS max_rate, count(DISTINCT host) AS hosts FROM history
 WHERE ts >= (SELECT max(ts) FROM history) - INTERVAL 20 DAY""")
def history_statistics(spark, d):
    h = history(spark, d)
    return H.statistics(H.drop_expired(h, h.agg(F.max("ts")).scalar(), 20))


@query("p12_history_page", f"""{W} SELECT host, epoch_us(ts) AS ts_us, n_anomalies, round(anomaly_rate, 6) AS anomaly_rate FROM history
 WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' AND anomaly_rate >= 20 ORDER BY ts DESC, host LIMIT 30 OFFSET 5""")
def history_page(spark, d):
    return H.history_page(history(spark, d), "2024-01-05", "2024-01-25", min_rate=20, skip=5, limit=30).select(
        "host", us(), "n_anomalies", r6("anomaly_rate"))


@query("g28_recent_metrics", f"""{W}, r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC) AS rn FROM history)
SELECT host, CAST(sum(n_anomalies) AS BIGINT) AS anomalies, CAST(sum(total_logs) AS BIGINT) AS logs,
 round(CAST(sum(n_anomalies) AS DOUBLE) / sum(total_logs) * 100, 6) AS rate FROM r WHERE rn <= 10 GROUP BY host""")
def recent_metrics(spark, d):
    return H.recent_metrics(history(spark, d)).select("host", "anomalies", "logs", r6("rate"))


@query("j12_previous_baseline", f"""{W} SELECT host, epoch_us(ts) AS ts_us, round(last_value(CASE WHEN n_anomalies > 5 THEN anomaly_rate END IGNORE NULLS)
 OVER (PARTITION BY host ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS baseline FROM history""")
def previous_baseline(spark, d):
    h = history(spark, d).withColumn("v", F.when(F.col("n_anomalies") > 5, F.col("anomaly_rate")))
    return h.withColumn("b", H.previous_baseline(h, ["host"], "v")).select("host", us(), r6("baseline", F.col("b")))


@query("w15_w16_latest", f"""{W}, r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC) AS rn FROM history WHERE n_anomalies > 0)
SELECT host, epoch_us(ts) AS ts_us, n_anomalies, total_logs FROM r WHERE rn = 1""")
def latest(spark, d):
    return H.latest_per_key(history(spark, d).filter("n_anomalies > 0"), ["host"]).select("host", us(), "n_anomalies", "total_logs")


@query("w17_model_weights", f"""{W}, a AS (SELECT host, ts, row_number() OVER (PARTITION BY host ORDER BY ts DESC) - 1 AS age, count(*) OVER (PARTITION BY host) AS m FROM history),
r AS (SELECT *, CASE WHEN age = m - 1 THEN power(CAST(0.9 AS DOUBLE) / 1.9, age) ELSE power(CAST(0.9 AS DOUBLE) / 1.9, age) / 1.9 END AS raw FROM a WHERE age < 10)
SELECT host, epoch_us(ts) AS ts_us, round(raw / sum(raw) OVER (PARTITION BY host), 6) AS weight FROM r""")
def model_weights(spark, d):
    return H.ensemble_weights(history(spark, d), ["host"], "ts").select("host", us(), r6("weight"))


@query("s21_retention", f"""{W} SELECT host, count(*) AS kept FROM history WHERE ts >= (SELECT max(ts) FROM history) - INTERVAL 7 DAY GROUP BY host""")
def retention(spark, d):
    h = history(spark, d)
    return H.drop_expired(h, h.agg(F.max("ts")).scalar(), 7).groupBy("host").agg(F.count(F.lit(1)).alias("kept"))


@query("s22_model_versions", """WITH v AS (SELECT user_id, event_id, event_id % 37 = 0 AS is_active,
 row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
SELECT user_id, event_id FROM v WHERE rn <= 3 OR is_active""")
def model_versions(spark, d):
    e = table(spark, d, "events").withColumn("is_active", F.col("event_id") % 37 == 0)
    return H.keep_versions(e, ["user_id"], 3, "event_id").select("user_id", "event_id")


@query("s23_trimmed_table", """SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn,
 floor(count(*) OVER () * CAST(0.2 AS DOUBLE)) AS cut FROM events) t WHERE rn > cut""")
def trimmed_table(spark, d):
    return H.trim_oldest(table(spark, d, "events"), "ts", "event_id").select("event_id")


@query("s17_capped_arrays", f"""WITH {LINES_SQL}, b AS (SELECT host, log_id, row_number() OVER (PARTITION BY host ORDER BY severity_score DESC, log_id) AS rn,
 count(*) OVER (PARTITION BY host) AS n FROM lines WHERE {BAD})
SELECT host, n > 100 AS is_truncated, count(*) AS stored FROM b WHERE rn <= 100 GROUP BY 1, 2""")
def capped_arrays(spark, d):
    from sievelog.sources.store import capped_anomalies
    return capped_anomalies(lines(spark, d), ["host"], 100).select("host", "is_truncated", F.size("anomalies").cast("bigint").alias("stored"))


@query("s20_normalised_layouts", f"""{W} SELECT host, epoch_us(ts) AS ts_us, n_anomalies, total_logs FROM history""")
def normalised_layouts(spark, d):
    from sievelog.sources.store import normalise_layout
    h = history(spark, d).select("host", "ts", "n_anomalies", "total_logs")
    odd = F.dayofmonth("ts") % 2 == 1
    flat = h.filter(odd)
    nested = h.filter(~odd).select("host", "ts", F.struct(F.struct("n_anomalies", "total_logs").alias("summary")).alias("data"))
    return normalise_layout(flat.unionByName(nested, allowMissingColumns=True)).select("host", us(), "n_anomalies", "total_logs")


# ---- trend ----

_PAST = []
for _v, _e in {"rate": "anomaly_rate", "score": "abs(score_mean)", "spread": "abs(score_std)", "tail": "abs(score_min)",
               "severe": "CASE WHEN n_anomalies > 0 THEN CAST(sev_critical + sev_high AS DOUBLE) / n_anomalies * 100 END",
               "k_slow_queries": "CAST(slow_queries AS DOUBLE)", "k_collscans": "CAST(collscans AS DOUBLE)",
               "k_auth_failures": "CAST(auth_failures AS DOUBLE)"}.items():
    _PAST += [f"{_e} AS {_v}", f"avg({_e}) OVER p AS {_v}_avg", f"count({_e}) OVER p AS {_v}_n", f"stddev_pop({_e}) OVER p AS {_v}_pop",
              f"min({_e}) OVER p AS {_v}_lo", f"max({_e}) OVER p AS {_v}_hi",
              *[f"lag({_e}, {i}) OVER o AS {_v}_{i}" for i in (1, 2, 3, 4)]]
PAST_SQL = f"""{HISTORY_SQL}, past AS (SELECT host, ts, count(*) OVER p AS n_past, {', '.join(_PAST)} FROM history
 WINDOW o AS (PARTITION BY host ORDER BY ts), p AS (PARTITION BY host ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"""


def _chg(v):
    return f"(({v} - {v}_avg) / {v}_avg * 100)"


def _mono(v):
    return f"({v}_1 >= {v}_2 AND {v}_2 >= {v}_3 AND {v} > {v}_1 AND {v}_n >= 3)"


def _row(kind, severity, base, now, change, cond, places=4):
    return (f"SELECT host, epoch_us(ts) AS ts_us, '{kind}' AS alert_type, {severity} AS severity, round(CAST({base} AS DOUBLE), {places}) AS baseline_value, "
            f"round(CAST({now} AS DOUBLE), {places}) AS current_value, round(CAST({change} AS DOUBLE), 2) AS change_pct FROM past WHERE n_past >= 3 AND ({cond})")


def _sev(v, t):
    return f"CASE WHEN {_chg(v)} > {t * 2} THEN 'CRITICAL' ELSE 'WARNING' END"


_ACC = ["((rate - rate_1) - (rate_1 - rate_2))", "((rate_1 - rate_2) - (rate_2 - rate_3))", "(CASE WHEN n_past >= 4 THEN (rate_2 - rate_3) - (rate_3 - rate_4) END)"]
_SPEED = " + ".join(f"COALESCE(CAST({a} > 0.1 AS INTEGER), 0)" for a in _ACC)
_MEAN_ACC = f"(({_ACC[0]} + {_ACC[1]} + COALESCE({_ACC[2]}, 0)) / CASE WHEN n_past >= 4 THEN 3 ELSE 2 END)"
_CHECKS = [
    _row("anomaly_rate_increase", "'WARNING'", "0", "rate", "100", "rate_avg = 0 AND rate > 0"),
    _row("anomaly_rate_increase", _sev("rate", 50), "rate_avg", "rate", _chg("rate"), f"rate_avg > 0 AND {_chg('rate')} > 50"),
    _row("anomaly_rate_monotonic_increase", "'WARNING'", "rate_3", "rate", _chg("rate"), f"rate_avg > 0 AND {_mono('rate')}"),
    _row("severity_escalation", "CASE WHEN severe > 50 THEN 'CRITICAL' ELSE 'WARNING' END", "severe_avg", "severe", "severe - severe_avg",
         "severe_n > 0 AND severe - severe_avg > 30", 2),
    _row("ml_score_degradation", _sev("score", 30), "score_avg", "score", _chg("score"), f"score_n >= 2 AND {_chg('score')} > 30"),
    _row("ml_score_monotonic_degradation", "'WARNING'", "score_3", "score", _chg("score"), _mono("score")),
    _row("ml_score_spread_widening", _sev("spread", 50), "spread_avg", "spread", _chg("spread"), f"spread_n >= 2 AND {_chg('spread')} > 50"),
    _row("ml_tail_risk_increase", "'WARNING'", "tail_avg", "tail", _chg("tail"), f"tail_n >= 2 AND {_chg('tail')} > 40"),
    _row("severity_distribution_shift", "CASE WHEN severe - severe_avg > 30 THEN 'CRITICAL' ELSE 'WARNING' END", "severe_avg", "severe",
         "severe - severe_avg", "severe_n >= 2 AND severe - severe_avg > 15", 2),
    _row("rate_acceleration", f"CASE WHEN {_MEAN_ACC} > 1 THEN 'CRITICAL' ELSE 'WARNING' END", "rate_1 - rate_2", "rate - rate_1", _MEAN_ACC,
         f"rate_n >= 3 AND ({_SPEED}) >= 2 AND rate > rate_1"),
    _row("stable_degradation", "'WARNING'", "rate_avg", "rate", "rate_pop / rate_avg * 100", "rate_n >= 4 AND rate_avg > 0 AND rate_pop / rate_avg < 0.3 AND rate > rate_avg * 1.3"),
    _row("improvement_detected", "'INFO'", "rate_avg", "rate", _chg("rate"), f"rate_n >= 3 AND rate_avg > 0 AND {_chg('rate')} < -40"),
]
for _m, _t in T.SOURCE_METRICS["mongodb"]:
    _CHECKS += [_row(f"source_{_m}", "'INFO'", "0", f"k_{_m}", "100", f"k_{_m}_avg <= 0 AND k_{_m} > 0", 2),
                _row(f"source_{_m}", _sev(f"k_{_m}", _t), f"k_{_m}_avg", f"k_{_m}", _chg(f"k_{_m}"), f"k_{_m}_avg > 0 AND {_chg(f'k_{_m}')} > {_t}", 2)]


@query("tr02_tr11_trend_alerts", f"WITH {PAST_SQL} " + " UNION ALL ".join(_CHECKS))
def trend_alerts(spark, d):
    return T.trend_alerts(history(spark, d), ["host"]).select("host", us(), "alert_type", "severity", "baseline_value", "current_value", "change_pct")


@query("tr03_concentration", f"""WITH {LINES_SQL}, comp AS (SELECT host, date_trunc('day', ts) AS ts, c, count(*) FILTER (WHERE {BAD}) AS n FROM lines GROUP BY 1, 2, 3),
i AS (SELECT host, ts, row_number() OVER (PARTITION BY host ORDER BY ts) AS i FROM (SELECT DISTINCT host, ts FROM comp) t),
s AS (SELECT comp.host, comp.ts, i, c, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY comp.host, i) * 100 AS share FROM comp JOIN i ON comp.host = i.host AND comp.ts = i.ts WHERE n > 0),
b AS (SELECT *, COALESCE(avg(share) OVER (PARTITION BY host, c ORDER BY i RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS base FROM s)
SELECT host, epoch_us(ts) AS ts_us, c AS component, round(share, 2) AS current_value, round(base, 2) AS baseline_value FROM b WHERE i > 3 AND share >= 40 AND share > base * 1.5""")
def concentration(spark, d):
    hits = T.concentration_alerts(history(spark, d), ["host"], threshold=40.0)
    return hits.select("host", us(), F.replace("metric_name", F.lit("component_concentration_"), F.lit("")).alias("component"),
                       "current_value", "baseline_value")


@query("tr05_temporal_shift", f"""WITH {LINES_SQL}, h AS (SELECT host, date_trunc('day', ts) AS ts, hour_of_day AS hr, count(*) AS n FROM lines WHERE {BAD} GROUP BY 1, 2, 3),
days AS (SELECT host, ts, row_number() OVER (PARTITION BY host ORDER BY ts) AS i FROM (SELECT DISTINCT host, date_trunc('day', ts) AS ts FROM lines) t),
pk AS (SELECT h.host, i, h.ts, hr FROM (SELECT *, row_number() OVER (PARTITION BY host, ts ORDER BY n DESC, hr) AS rn FROM h) h JOIN days ON h.host = days.host AND h.ts = days.ts WHERE rn <= 3),
f AS (SELECT d.host, d.i, p.hr, count(*) AS n FROM days d JOIN pk p ON p.host = d.host AND p.i BETWEEN d.i - 10 AND d.i - 1 WHERE d.i > 3 GROUP BY 1, 2, 3),
usual AS (SELECT host, i, hr FROM (SELECT *, row_number() OVER (PARTITION BY host, i ORDER BY n DESC, hr) AS rn FROM f) t WHERE rn <= 3),
o AS (SELECT pk.host, pk.i, pk.ts, count(*) AS n, count(usual.hr) AS common FROM pk LEFT JOIN usual ON usual.host = pk.host AND usual.i = pk.i AND usual.hr = pk.hr WHERE pk.i > 3 GROUP BY 1, 2, 3)
SELECT host, epoch_us(ts) AS ts_us, round((1 - CAST(common AS DOUBLE) / n) * 100, 1) AS change_pct FROM o WHERE n >= 2 AND 1 - CAST(common AS DOUBLE) / n > 0.5""")
def temporal_shift(spark, d):
    return T.temporal_alerts(history(spark, d), ["host"]).select("host", us(), "change_pct")


@query("tr01_tr12_directions")
def directions(spark, d):
    h = materialise(history(spark, d), "history")
    return T.directions(h, T.all_alerts(h, ["host"]), ["host"]).select("host", us(), "direction", "info", "warning", "critical")


@query("g26_trend_summary", f"""WITH {PAST_SQL} SELECT host, epoch_us(ts) AS ts_us, n_past AS history_window, round(rate, 6) AS current_rate, round(rate_avg, 6) AS baseline_rate,
 round(rate_lo, 6) AS min_rate, round(rate_hi, 6) AS max_rate, round(CASE WHEN rate_avg > 0 THEN rate_pop / rate_avg END, 6) AS volatility_cv,
 CASE WHEN score / score_avg > 1.1 THEN 'worsening' WHEN score / score_avg < 0.9 THEN 'improving' WHEN score_avg IS NOT NULL THEN 'stable' END AS score_direction FROM past""")
def trend_summary(spark, d):
    out = T.trend_summary(history(spark, d), ["host"])
    return out.select("host", us(), "history_window", *[r6(c) for c in ("current_rate", "baseline_rate", "min_rate", "max_rate", "volatility_cv")], "score_direction")


# ---- rate alerts ----

EV = RT.EVENTS["mongodb"]
SMALL = {k: tuple(max(1, x // 50) for x in v) for k, v in RT.THRESHOLDS.items()}
_CELLS = " UNION ALL ".join(
    f"SELECT host, span_us, '{w}' AS win, {m} AS minutes, '{e.name}' AS event, CAST({SMALL[e.threshold_key][i]} AS DOUBLE) AS threshold, CAST({e.multiplier} AS DOUBLE) AS multiplier, "
    f"count(*) FILTER (WHERE age_us <= {m * RT.MINUTE}) AS lines, count(*) FILTER (WHERE age_us > {m * RT.MINUTE}) AS lines_outside, "
    f"count(*) FILTER (WHERE age_us <= {m * RT.MINUTE} AND {BAD}) AS anomalies, "
    f"COALESCE(sum(CASE WHEN age_us <= {m * RT.MINUTE} AND {BAD} THEN CASE severity_level WHEN 'CRITICAL' THEN 3.0 WHEN 'HIGH' THEN 2.0 WHEN 'MEDIUM' THEN 1.0 WHEN 'LOW' THEN 0.5 ELSE 1.0 END END), 0) AS weight, "
    f"count(*) FILTER (WHERE age_us <= {m * RT.MINUTE} AND {BAD} AND severity_level IN ('CRITICAL', 'HIGH')) AS severe, "
    f"count(*) FILTER (WHERE age_us <= {m * RT.MINUTE} AND {e.condition}) AS cnt, count(*) FILTER (WHERE age_us > {m * RT.MINUTE} AND {e.condition}) AS cnt_out FROM aged GROUP BY 1, 2"
    for i, (w, m) in enumerate(RT.WINDOWS) for e in EV)
RATE_SQL = f"""{LINES_SQL}, aged AS (SELECT *, max(epoch_us(ts)) OVER (PARTITION BY host) - epoch_us(ts) AS age_us,
 max(epoch_us(ts)) OVER (PARTITION BY host) - min(epoch_us(ts)) OVER (PARTITION BY host) AS span_us FROM lines), cells AS ({_CELLS})"""


@query("r01_window_counts", f"WITH {RATE_SQL} SELECT host, win AS \"window\", event, cnt AS count, cnt_out AS count_outside, lines, anomalies, round(CAST(weight AS DOUBLE), 6) AS weight FROM cells")
def window_counts(spark, d):
    return RT.window_counts(lines(spark, d), EV).select("host", "window", "event", "count", "count_outside", "lines", "anomalies", r6("weight"))


@query("r03_r09_rate_alerts", f"""WITH {RATE_SQL}, m AS (SELECT *, cnt / threshold AS exceed, CAST(cnt AS DOUBLE) / minutes AS rate, CAST(anomalies AS DOUBLE) / lines * 100 AS density,
 CAST(weight AS DOUBLE) / lines * 100 AS wdensity, CASE WHEN lines_outside >= 10 THEN cnt_out / greatest(CAST(span_us AS DOUBLE) / 60000000 - minutes, 1) ELSE 0 END AS base
 FROM cells WHERE cnt >= threshold),
k AS (SELECT *, density > 5 AS sup, density > 0 AND (wdensity > 8 OR (density > 5 AND severe >= 2)) AS strong, count(*) OVER (PARTITION BY host, event) AS windows_hit,
 count(*) OVER (PARTITION BY host, win) AS events_in_window, exceed >= multiplier AND NOT (base > 0 AND rate / CASE WHEN base > 0 THEN base ELSE 1 END < 1.2) AS first_critical FROM m)
SELECT host, win AS "window", event, cnt AS count, round(exceed, 6) AS exceed_ratio, round(base, 6) AS baseline_rate, windows_hit, events_in_window,
 CASE WHEN first_critical OR sup OR strong OR windows_hit >= 2 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
 round(least(round(least(0.5 + (exceed - 1) * 0.15, 0.85) + CASE WHEN strong THEN 0.15 WHEN sup THEN 0.1 ELSE 0 END, 3), 0.99), 3) AS confidence FROM k""")
def rate_alerts(spark, d):
    out = RT.judge(RT.window_counts(lines(spark, d), EV), EV, thresholds=SMALL)
    return out.select("host", "window", "event", "count", r6("exceed_ratio"), r6("baseline_rate"), "windows_hit", "events_in_window",
                      "severity", F.round("confidence", 3).alias("confidence"))


@query("r02_samples", f"""WITH {RATE_SQL}, x AS ({' UNION ALL '.join(
    f"SELECT host, '{w}' AS win, '{e.name}' AS event, ts, log_id, substr(msg, 1, 200) AS m FROM aged WHERE age_us <= {m * RT.MINUTE} AND {e.condition}"
    for w, m in RT.WINDOWS for e in EV)}), r AS (SELECT *, row_number() OVER (PARTITION BY host, win, event ORDER BY ts, log_id) AS rn FROM x)
SELECT host, win AS "window", event, string_agg(m, '|' ORDER BY rn) AS samples FROM r WHERE rn <= 3 GROUP BY 1, 2, 3""")
def rate_samples(spark, d):
    return RT.samples(lines(spark, d), EV).select("host", "window", "event", F.concat_ws("|", "samples").alias("samples"))


@query("r07_cooldown", """WITH RECURSIVE a AS (SELECT DISTINCT user_id % 8 AS host, (epoch_us(ts) // 300000000) * 300000000 AS t FROM events WHERE event_type = 'error'),
r AS (SELECT host, min(t) AS t FROM a GROUP BY host
 UNION ALL SELECT r.host, (SELECT min(a.t) FROM a WHERE a.host = r.host AND a.t >= r.t + 43200000000) FROM r WHERE r.t IS NOT NULL)
SELECT host, t AS kept_us FROM r WHERE t IS NOT NULL""")
def cooldown(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'")
    evaluations = e.select((F.col("user_id") % 8).alias("host"), V.time_slice(F.col("ts"), 5).alias("us")).distinct().withColumn(
        "ts", F.timestamp_micros("us"))
    return RT.cooldown(evaluations, ["host"], "ts", 720)


#: Errors in the trailing window at which an evaluation alerts.
_ALERT_AT = {"short": 1, "medium": 2, "long": 3}


@query("r07_r08_cooled_alerts", f"""WITH RECURSIVE e AS (SELECT user_id % 8 AS host, (epoch_us(ts) // 300000000) * 300000000 AS t, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2),
a AS ({" UNION ALL ".join(f"SELECT host, '{w}' AS win, t, n, c FROM (SELECT host, t, n, sum(n) OVER (PARTITION BY host ORDER BY t RANGE BETWEEN {m * RT.MINUTE - 1} PRECEDING AND CURRENT ROW) AS c FROM e) x WHERE c >= {_ALERT_AT[w]}" for w, m in RT.WINDOWS)}),
r AS (SELECT host, win, min(t) AS t FROM a GROUP BY ALL
 UNION ALL SELECT r.host, r.win, (SELECT min(a.t) FROM a WHERE a.host = r.host AND a.win = r.win AND a.t >= r.t + 10800000000) FROM r WHERE r.t IS NOT NULL),
k AS (SELECT a.host, a.win, a.t, a.c FROM a JOIN r ON a.host = r.host AND a.win = r.win AND a.t = r.t)
SELECT host, win AS "window", t AS at_us, CAST(c AS BIGINT) AS count, count(*) OVER (PARTITION BY host, t) AS windows_hit,
 CASE WHEN count(*) OVER (PARTITION BY host, t) >= 2 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM k""")
def cooled_alerts(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").select(
        (F.col("user_id") % 8).alias("host"), F.timestamp_micros(V.time_slice(F.col("ts"), 5)).alias("ts"))
    one = {"count": F.lit(1).cast("bigint")}
    found = [trailing_sums(e, ["host"], "ts", one, m * RT.MINUTE).filter(F.col("count") >= _ALERT_AT[w]).withColumn("window", F.lit(w))
             for w, m in RT.WINDOWS]
    alerts = found[0].unionByName(found[1]).unionByName(found[2]).select(
        "host", F.lit("error").alias("event"), "window", F.timestamp_micros("_us").alias("ts"), "count", F.lit("WARNING").alias("severity"))
    return RT.cooled(alerts, minutes=180).select("host", "window", V.micros(F.col("ts")).alias("at_us"), "count", "windows_hit", "severity")


# ---- dashboards over prediction alerts derived from the history ----

ALERTS_SQL = f"""{HISTORY_SQL}, alerts AS (SELECT host, ts, src AS alert_source, CASE WHEN v > 10 THEN 'CRITICAL' WHEN v > 7 THEN 'WARNING' WHEN v > 5 THEN 'INFO' ELSE 'OK' END AS max_severity, v > 5 AS has_alerts
 FROM (SELECT host, ts, 'trend' AS src, n_anomalies AS v FROM history UNION ALL SELECT host, ts, 'rate', collscans FROM history UNION ALL SELECT host, ts, 'forecast', slow_queries FROM history) t)"""


def alerts(spark, d):
    h = history(spark, d)
    cells = F.array(*[F.struct(F.lit(s).alias("alert_source"), F.col(c).alias("v")) for s, c in (
        ("trend", "n_anomalies"), ("rate", "collscans"), ("forecast", "slow_queries"))])
    v = F.col("v")
    return h.select("host", "ts", F.inline(cells)).withColumns({
        "max_severity": F.when(v > 10, "CRITICAL").when(v > 7, "WARNING").when(v > 5, "INFO").otherwise("OK"), "has_alerts": v > 5})


@query("g23_g41_alert_summary", f"""WITH {ALERTS_SQL} SELECT alert_source, max_severity, count(*) AS checks, count(*) FILTER (WHERE has_alerts) AS with_alerts, max(epoch_us(ts)) AS latest_us
FROM alerts GROUP BY GROUPING SETS ((alert_source, max_severity), ())""")
def alert_summary(spark, d):
    return H.alert_summary(alerts(spark, d)).select("alert_source", "max_severity", "checks", "with_alerts", V.micros(F.col("latest")).alias("latest_us"))


@query("g24_alert_series", f"""WITH {ALERTS_SQL} SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS checks, count(*) FILTER (WHERE has_alerts) AS alerts,
 {', '.join(f"count(*) FILTER (WHERE alert_source = '{s}') AS {s}_checks, count(*) FILTER (WHERE alert_source = '{s}' AND has_alerts) AS {s}_alerts" for s in ('trend', 'rate', 'forecast'))}
FROM alerts GROUP BY 1""")
def alert_series(spark, d):
    return H.alert_series(alerts(spark, d), V.bucket_label(F.col("ts"), 30), ["trend", "rate", "forecast"])


@query("g41_cube", f"""WITH {ALERTS_SQL} SELECT host, alert_source, max_severity, count(*) AS n FROM alerts GROUP BY CUBE (host, alert_source, max_severity)""")
def alert_cube(spark, d):
    return alerts(spark, d).cube("host", "alert_source", "max_severity").agg(F.count(F.lit(1)).alias("n"))


@query("g25_k07_server_overview", f"""WITH {ALERTS_SQL} SELECT host, count(*) AS checks, count(*) FILTER (WHERE has_alerts) AS alerts,
 round(avg(CASE WHEN has_alerts THEN CAST(1 AS DOUBLE) ELSE 0 END) * 100, 6) AS alert_rate, count(*) FILTER (WHERE max_severity = 'CRITICAL') AS criticals,
 count(*) FILTER (WHERE max_severity = 'WARNING') AS warnings, CASE WHEN count(*) FILTER (WHERE max_severity = 'CRITICAL') > 0 THEN 'CRITICAL'
 WHEN count(*) FILTER (WHERE max_severity = 'WARNING') > 0 THEN 'WARNING' WHEN count(*) FILTER (WHERE has_alerts) > 0 THEN 'INFO' ELSE 'OK' END AS risk_level FROM alerts GROUP BY host""")
def server_overview(spark, d):
    return H.server_overview(alerts(spark, d)).select("host", "checks", "alerts", r6("alert_rate"), "criticals", "warnings", "risk_level")


@query("p13_alerts_page", f"""WITH {ALERTS_SQL} SELECT host, alert_source, max_severity, epoch_us(ts) AS ts_us FROM alerts WHERE has_alerts AND alert_source = 'trend'
 AND ts >= (SELECT max(ts) FROM alerts) - INTERVAL 7 DAY ORDER BY ts DESC, host LIMIT 20""")
def alerts_page(spark, d):
    a = alerts(spark, d)
    return H.alerts_page(a, a.agg(F.max("ts")).scalar(), 7, source="trend", only_alerts=True, limit=20).select(
        "host", "alert_source", "max_severity", us())


@query("e31_combined_insight", f"""WITH {ALERTS_SQL}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, alert_source ORDER BY ts DESC) AS rn FROM alerts) t WHERE rn = 1),
g AS (SELECT host, max(CASE max_severity WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END) AS worst, count(DISTINCT CASE WHEN has_alerts THEN alert_source END) AS n FROM l GROUP BY host)
SELECT host, n AS sources_alerting, CASE greatest(worst, CASE WHEN n >= 3 THEN 3 WHEN n >= 2 THEN 2 ELSE 0 END) WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' WHEN 1 THEN 'INFO' ELSE 'OK' END AS risk_level FROM g""")
def combined_insight(spark, d):
    newest = H.latest_per_key(alerts(spark, d), ["host", "alert_source"])
    return H.combined_insight(newest).select("host", "sources_alerting", "risk_level")


# ---- feedback, from labels joined to documents ----

@query("j09_g29_feedback", """WITH f AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'true_positive' ELSE 'false_positive' END AS label FROM labels)
SELECT lang, count(*) FILTER (WHERE label = 'true_positive') AS true_positives, count(*) FILTER (WHERE label = 'false_positive') AS false_positives,
 round(CAST(count(*) FILTER (WHERE label = 'true_positive') AS DOUBLE) / count(*), 6) AS precision,
 CASE WHEN count(*) >= 50 THEN 'high' WHEN count(*) >= 20 THEN 'medium' WHEN count(*) >= 5 THEN 'low' ELSE 'very_low' END AS confidence
FROM f JOIN documents USING (doc_id) GROUP BY lang""")
def feedback(spark, d):
    labels = table(spark, d, "labels")
    fresh = labels.groupBy("doc_id").agg(F.max("quality").alias("q")).select(
        "doc_id", F.when(F.col("q") == 1, "true_positive").otherwise("false_positive").alias("label"))
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return H.feedback_metrics(fresh.join(docs, "doc_id"), ["lang"]).select("lang", "true_positives", "false_positives", r6("precision"), "confidence")

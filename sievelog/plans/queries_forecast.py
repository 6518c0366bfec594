"""Series statistics, forecasts and forecast alerts over whole histories. Every analysis of a host stands in three series,
that of its month, of its half month and of its week, which have the lengths that the four tiers are for."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelog.functions import values as V
from sievelog.operators import forecast as FC
from sievelog.plans.queries_analysis import r6
from sievelog.plans.queries_history import HISTORY_SQL, history
from sievelog.plans.registry import query
from sievelog.sources.store import materialise

METRICS = FC.METRICS["mongodb"]
SCOPED_SQL = """scoped AS (SELECT h.* EXCLUDE (host, scopes), host || ' ' || unnest(scopes) AS host FROM (SELECT *,
 [strftime(ts, '%Y-%m'), strftime(ts, '%Y-%m') || CASE WHEN day(ts) <= 15 THEN ' first half' ELSE ' second half' END,
  'week of ' || strftime(date_trunc('week', ts), '%Y-%m-%d')] AS scopes FROM history) h)"""


def scoped_history(spark, d):
    """The history with a row for each of an analysis's series; the host names the host and the period."""
    month = F.date_format("ts", "yyyy-MM")
    half = F.concat(month, F.when(F.dayofmonth("ts") <= 15, " first half").otherwise(" second half"))
    week = F.concat(F.lit("week of "), F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))
    rows = history(spark, d).withColumn("_scope", F.explode(F.array(month, half, week)))
    return rows.withColumn("host", F.concat_ws(" ", "host", "_scope")).drop("_scope")


_SERIES = {"anomaly_rate": "anomaly_rate", "anomaly_count": "n_anomalies", "collscan_count": "collscans", "mean_anomaly_score": "abs(score_mean)",
           "slow_query_count": "slow_queries", "auth_failure_count": "auth_failures"}
SERIES_SQL = f"""{HISTORY_SQL}, {SCOPED_SQL},
long AS ({' UNION ALL '.join(f"SELECT host, ts, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM scoped" for m, e in _SERIES.items())}),
p AS (SELECT *, row_number() OVER (PARTITION BY host, metric ORDER BY ts) - 1 AS x, count(*) OVER (PARTITION BY host, metric) AS n FROM long),
arr AS (SELECT host, metric, max(n) AS n, list(value ORDER BY ts) AS v FROM p GROUP BY 1, 2),
gaps AS (SELECT host, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY host ORDER BY ts)) AS DOUBLE) / 3600000000 AS h FROM scoped),
iv AS (SELECT host, COALESCE(avg(CASE WHEN h > 0 AND h < 168 THEN h END), CAST(0.5 AS DOUBLE)) AS interval_hours FROM gaps GROUP BY host)"""
KEEP = list(_SERIES)


def arrays(spark, d):
    long = FC.long_series(scoped_history(spark, d), [m for m in METRICS if m.name in KEEP])
    return long.groupBy("host", "metric").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"]).alias("v"))


@query("m06_regression", f"""WITH {SERIES_SQL} SELECT host, metric, count(*) AS n, round(COALESCE(regr_slope(value, x), 0), 6) AS slope,
 round(COALESCE(regr_intercept(value, x), avg(value)), 6) AS intercept,
 round(CASE WHEN count(*) < 2 OR var_pop(value) = 0 THEN 0 ELSE regr_r2(value, x) END + 1e-9, 6) AS r2 FROM p GROUP BY 1, 2""")
def regression(spark, d):
    a = arrays(spark, d).withColumns({**V.regression(F.col("v")), "mean": V.series_mean(F.col("v")), "std": V.series_std(F.col("v"))})
    a = a.withColumn("intercept", F.col("mean") - F.col("slope") * F.col("mean_x"))
    a = a.withColumn("r2", V.r_squared(F.col("v"), F.col("mean"), F.col("slope"), F.col("intercept")))
    return a.select("host", "metric", F.size("v").cast("bigint").alias("n"), r6("slope"), r6("intercept"), r6("r2", F.col("r2") + 1e-9))


@query("m07_m09_series_statistics", f"""WITH {SERIES_SQL} SELECT host, metric, round(sum(value * (x + 1)) / sum(x + 1), 6) AS wma,
 round(COALESCE(stddev_samp(value), 0), 6) AS std, round(CASE WHEN avg(value) = 0 THEN 0 ELSE COALESCE(stddev_samp(value), 0) / abs(avg(value)) END, 6) AS cv FROM p GROUP BY 1, 2""")
def series_statistics(spark, d):
    v = F.col("v")
    return arrays(spark, d).select("host", "metric", r6("wma", V.weighted_mean(v)), r6("std", V.series_std(v)),
                                   r6("cv", F.when(V.series_mean(v) == 0, 0.0).otherwise(V.series_std(v) / F.abs(V.series_mean(v)))))


@query("m08_w12_ewma", f"""WITH {SERIES_SQL} SELECT host, metric, round(list_reduce(v, lambda a, x: CAST(0.3 AS DOUBLE) * x + CAST(0.7 AS DOUBLE) * a), 6) AS fast,
 round(list_reduce(v, lambda a, x: CAST(0.1 AS DOUBLE) * x + CAST(0.9 AS DOUBLE) * a), 6) AS slow FROM arr""")
def ewma(spark, d):
    return arrays(spark, d).select("host", "metric", r6("fast", V.ewma_last(F.col("v"), 0.3)), r6("slow", V.ewma_last(F.col("v"), 0.1)))


@query("m10_robust_baseline", f"""WITH {SERIES_SQL}, s AS (SELECT host, metric, n, list_sort(v) AS s FROM arr),
q AS (SELECT *, s[n // 4 + 1] AS q1, s[3 * n // 4 + 1] AS q3, CASE WHEN n % 2 = 1 THEN s[n // 2 + 1] ELSE (s[n // 2] + s[n // 2 + 1]) / 2 END AS med FROM s),
f AS (SELECT *, list_filter(s, lambda z: z >= q1 - 1.5 * (q3 - q1) AND z <= q3 + 1.5 * (q3 - q1)) AS inside FROM q)
SELECT host, metric, round(CASE WHEN n < 4 THEN med ELSE list_avg(inside) END, 6) AS centre,
 round(CASE WHEN n < 4 OR q3 - q1 <= 0 THEN COALESCE(list_stddev_samp(s), 0) ELSE (q3 - q1) / 2 END, 6) AS spread FROM f""")
def robust_baseline(spark, d):
    return V.robust_baseline(arrays(spark, d), "v").select("host", "metric", r6("centre"), r6("spread"))


@query("t07_mean_intervals", f"""WITH {SERIES_SQL} SELECT host, round(interval_hours, 6) AS interval_hours FROM iv""")
def mean_intervals(spark, d):
    return FC.mean_interval(scoped_history(spark, d)).select("host", r6("interval_hours"))


@query("m11_fc07_seasonality", """WITH l AS (SELECT user_id % 8 AS host, ts, value FROM events),
w AS (SELECT host, count(*) AS n, avg(value) AS mean, CAST(hour(max(ts) + INTERVAL 6 HOUR) AS INTEGER) AS target FROM l GROUP BY 1),
h AS (SELECT host, CAST(hour(ts) AS INTEGER) AS h, avg(value) AS m FROM l GROUP BY 1, 2),
r AS (SELECT w.host, max(n) AS n, max(mean) AS mean, count(*) AS hours, max(CASE WHEN h = target THEN m END) AS exact,
 avg(CASE WHEN abs(h - target) <= 2 OR abs(h - target) >= 22 THEN m END) AS near FROM w JOIN h ON w.host = h.host GROUP BY 1)
SELECT host, round(CASE WHEN n >= 8 AND hours >= 3 AND mean > 0 THEN greatest(CAST(0.5 AS DOUBLE), least(CAST(2 AS DOUBLE), COALESCE(exact, near) / mean)) ELSE 1 END, 6) AS season FROM r""")
def seasonality(spark, d):
    from sievelog.sources.views import table
    e = table(spark, d, "events")
    series = e.select((F.col("user_id") % 8).alias("host"), "ts", F.lit("m").alias("metric"), "value")
    return FC.seasonality(series, 6).select("host", r6("season"))



@query("fc01_fc06_forecasts", f"""WITH {SERIES_SQL}, st AS (SELECT host, metric, max(n) AS n, avg(value) AS mean, COALESCE(stddev_samp(value), 0) AS sd, max(CASE WHEN x = n - 1 THEN value END) AS cur,
 max(CASE WHEN x = n - 2 THEN value END) AS prev, max(CASE WHEN x = n - 3 THEN value END) AS prev2 FROM p GROUP BY 1, 2),
rg AS (SELECT host, metric, COALESCE(regr_slope(value, x), 0) AS slope, COALESCE(regr_intercept(value, x), avg(value)) AS icpt,
 CASE WHEN var_pop(value) = 0 THEN 0 ELSE regr_r2(value, x) END AS r2 FROM (SELECT host, metric, value, n, CASE WHEN n < 20 THEN x ELSE x - (n - greatest(10, n // 2)) END AS x FROM p) t WHERE x >= 0 GROUP BY 1, 2),
ew AS (SELECT host, metric, list_reduce(v, lambda a, z: CAST(0.3 AS DOUBLE) * z + CAST(0.7 AS DOUBLE) * a) AS fast, list_reduce(v, lambda a, z: CAST(0.1 AS DOUBLE) * z + CAST(0.9 AS DOUBLE) * a) AS slow FROM arr),
j AS (SELECT st.*, slope, icpt, r2, fast, fast - slow AS mom, 6 / interval_hours AS steps FROM st JOIN rg USING (host, metric) JOIN ew USING (host, metric) JOIN iv USING (host))
SELECT host, metric, CASE WHEN n < 5 THEN 0 WHEN n < 10 THEN 1 WHEN n < 20 THEN 2 ELSE 3 END AS tier,
 round(CASE WHEN n < 5 THEN NULL WHEN n < 10 THEN greatest(0, cur + (cur - prev2) / 2 * steps) WHEN n < 20 THEN greatest(0, slope * (n - 1 + steps) + icpt)
  ELSE greatest(0, fast + slope * steps + mom * steps * 0.5) END, 5) AS forecast_value,
 round(CASE WHEN n < 5 THEN NULL WHEN n < 10 THEN greatest(0, cur + (cur - prev2) / 2 * steps) + 2 * sd WHEN n < 20 THEN NULL
  ELSE greatest(0, fast + slope * steps + mom * steps * 0.5) + 2 * sd * (1 + CASE WHEN mean = 0 THEN 0 ELSE sd / abs(mean) END) END, 5) AS upper_bound,
 CASE WHEN n < 5 THEN CASE WHEN cur > prev * 1.05 THEN 'rising' WHEN cur < prev * 0.95 THEN 'falling' ELSE 'stable' END
  WHEN n < 10 THEN CASE WHEN (cur - prev2) / 2 > 0.001 THEN 'rising' WHEN (cur - prev2) / 2 < -0.001 THEN 'falling' ELSE 'stable' END
  WHEN n < 20 THEN CASE WHEN slope > 0.001 THEN 'rising' WHEN slope < -0.001 THEN 'falling' ELSE 'stable' END
  ELSE CASE WHEN slope > 0.001 AND mom > 0 THEN 'rising' WHEN slope < -0.001 AND mom < 0 THEN 'falling' WHEN mom > sd * 0.5 THEN 'accelerating'
   WHEN mom < -sd * 0.5 THEN 'decelerating' ELSE 'stable' END END AS direction FROM j""")
def forecasts(spark, d):
    out = FC.forecast(scoped_history(spark, d), [m for m in METRICS if m.name in KEEP], seasonal=False)
    upper = F.when(F.col("tier") != 2, F.col("upper_bound"))
    return out.select("host", "metric", "tier", F.round("forecast_value", 5).alias("forecast_value"), F.round(upper, 5).alias("upper_bound"), "direction")


@query("m14_fc05_intervals", f"""WITH {SERIES_SQL}, rg AS (SELECT host, metric, max(n) AS n, regr_slope(value, x) AS slope, regr_intercept(value, x) AS icpt, regr_sxx(value, x) AS sxx, avg(x) AS mx FROM p WHERE n >= 10 AND n < 20 GROUP BY 1, 2),
e AS (SELECT p.host, p.metric, sqrt(sum((value - slope * x - icpt) * (value - slope * x - icpt)) / (max(rg.n) - 2)) AS se FROM p JOIN rg USING (host, metric) GROUP BY 1, 2),
k AS (SELECT *, n - 1 + 6 / interval_hours AS fx FROM rg JOIN e USING (host, metric) JOIN iv USING (host))
SELECT host, metric, round(slope * fx + icpt + 2 * se * sqrt(1 + CAST(1 AS DOUBLE) / n + (fx - mx) * (fx - mx) / sxx), 5) AS upper_bound,
 round(greatest(0, slope * fx + icpt - 2 * se * sqrt(1 + CAST(1 AS DOUBLE) / n + (fx - mx) * (fx - mx) / sxx)), 5) AS lower_bound FROM k""")
def intervals(spark, d):
    out = FC.forecast(scoped_history(spark, d), [m for m in METRICS if m.name in KEEP], seasonal=False).filter("tier = 2")
    return out.select("host", "metric", F.round("upper_bound", 5).alias("upper_bound"), F.round("lower_bound", 5).alias("lower_bound"))


@query("fc09_risk_context", f"""WITH {SERIES_SQL}, r AS (SELECT host, ts, abs(score_mean) AS score, anomaly_rate AS rate, sev_critical + sev_high AS severe,
 row_number() OVER (PARTITION BY host ORDER BY ts DESC) AS k, row_number() OVER (PARTITION BY host ORDER BY ts) - 1 AS x FROM scoped),
b AS (SELECT host, avg(score) AS base, stddev_samp(score) AS sd, avg(rate) AS base_rate, count(*) AS n FROM r WHERE k > 1 GROUP BY host),
s AS (SELECT host, CASE WHEN count(*) >= 3 THEN regr_slope(score, x) ELSE 0 END AS slope FROM r GROUP BY host)
SELECT r.host, CAST(CASE WHEN n >= 3 THEN score > base + greatest(sd * 1.5, base * 0.1) ELSE base > 0 AND score > base * 1.15 END AS INTEGER) AS score_worsening,
 round(slope, 6) AS score_slope, round(CASE WHEN base_rate > 0 THEN rate / base_rate ELSE 1 END, 6) AS density_ratio,
 CASE WHEN severe >= 3 OR rate > 15 THEN 'CRITICAL' WHEN severe >= 1 OR rate > 8 THEN 'WARNING' WHEN rate > 0 THEN 'INFO' ELSE 'OK' END AS ml_risk
FROM r JOIN b ON r.host = b.host JOIN s ON r.host = s.host WHERE k = 1""")
def risk_context(spark, d):
    out = FC.risk_context(scoped_history(spark, d))
    return out.select("host", F.col("score_worsening").cast("int").alias("score_worsening"), r6("score_slope"), r6("density_ratio"), "ml_risk")


@query("m12_m13_cusum_residuals")
def cusum_residuals(spark, d):
    a = arrays(spark, d).withColumns({**V.regression(F.col("v")), "mean": V.series_mean(F.col("v")), "std": V.series_std(F.col("v"))})
    a = a.withColumn("intercept", F.col("mean") - F.col("slope") * F.col("mean_x"))
    return a.select("host", "metric", F.concat_ws(",", V.cusum_changes(F.col("v"), F.col("mean"), F.col("std")).cast("array<string>")).alias("changes"),
                    r6("consistency", V.residual_consistency(F.col("v"), F.col("slope"), F.col("intercept"))))


def _full(spark, d):
    """The history is a stored table in use; here it is written once and the four forecast inputs read it."""
    h = materialise(scoped_history(spark, d), "history")
    return FC.with_risk(FC.forecast(h, METRICS), FC.risk_context(h))


@query("fc08_adjusted_forecasts")
def adjusted_forecasts(spark, d):
    return _full(spark, d).select("host", "metric", "tier", "direction", r6("forecast_value"), r6("confidence"), r6("adjusted_confidence"))


@query("fc10_forecast_alerts")
def forecast_alerts(spark, d):
    return FC.forecast_alerts(materialise(_full(spark, d), "forecasts"), METRICS).select("host", "metric", "severity", "tier", "direction", r6("pct_above"), r6("forecast_value"))


@query("fc11_forecast_report")
def forecast_report(spark, d):
    f = materialise(_full(spark, d), "forecasts")
    return FC.forecast_report(f, FC.forecast_alerts(f, METRICS)).select("host", "risk", "alerts", "rising", "falling", "stable", "to_next_tier", r6("mean_confidence"))

"""Forecasts per host and metric over the history of analyses.

The history is turned into one sorted array per (host, metric): as many values as analyses in the retention,
never log lines. Every tier is array expressions on that row; the number of values picks the tier.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievelog.functions import values as V


@dataclass(frozen=True)
class Metric:
    """A history metric: SQL over the history row, percent above baseline that warns / is critical, least value."""

    name: str
    expression: str
    warn_pct: float
    critical_pct: float
    least: float


_GRADED = "(sev_critical + sev_high + sev_medium + sev_low + sev_info)"
# ---- fixed values: metrics per source ----
COMMON = [
    Metric("anomaly_rate", "anomaly_rate", 50.0, 100.0, 0.5),
    Metric("anomaly_count", "n_anomalies", 80.0, 150.0, 3),
    Metric("critical_ratio", f"if({_GRADED} > 0, (sev_critical + sev_high) / {_GRADED} * 100, null)", 30.0, 80.0, 5.0),
    Metric("critical_count", "sev_critical + sev_high", 50.0, 100.0, 2),
    Metric("error_count", "aggregate(map_values(components), 0L, (a, x) -> a + x)", 60.0, 120.0, 3),
    Metric("mean_anomaly_score", "abs(score_mean)", 40.0, 80.0, 0.15),
]
METRICS = {
    "mongodb": COMMON + [
        Metric("slow_query_count", "slow_queries", 60.0, 120.0, 5), Metric("collscan_count", "collscans", 50.0, 100.0, 3),
        Metric("auth_failure_count", "auth_failures", 40.0, 80.0, 5)],
    "mssql": COMMON + [
        Metric("auth_failure_count", "failed_logins", 40.0, 80.0, 5),
        Metric("high_severity_count", "high_severity_errors", 50.0, 100.0, 3),
        Metric("connection_error_count", "connection_errors", 60.0, 120.0, 5)],
    "elasticsearch": COMMON + [
        Metric("oom_count", "oom_errors", 30.0, 80.0, 1), Metric("circuit_breaker_count", "circuit_breakers", 40.0, 100.0, 2),
        Metric("shard_failure_count", "shard_failures", 50.0, 100.0, 3), Metric("gc_overhead_count", "gc_events", 60.0, 120.0, 5),
        Metric("disk_watermark_count", "disk_warnings", 30.0, 80.0, 2), Metric("master_election_count", "master_elections", 30.0, 80.0, 2),
        Metric("connection_error_count", "connection_errors", 60.0, 120.0, 5)],
}


def long_series(history: DataFrame, metrics: list[Metric]) -> DataFrame:
    """(host, ts, metric, value) rows; a metric that is null on an analysis is left out there."""
    cells = F.array(*[F.struct(F.lit(m.name).alias("metric"), F.expr(m.expression).cast("double").alias("value")) for m in metrics])
    return history.select("host", "ts", F.inline(cells)).filter("value is not null")


def mean_interval(history: DataFrame) -> DataFrame:
    """Average hours between analyses of a host, gaps of a week and more ignored, half an hour by default."""
    gap = (V.micros(F.col("ts")) - V.micros(F.lag("ts").over(Window.partitionBy("host").orderBy("ts")))) / F.lit(3.6e9)
    return history.withColumn("_g", gap).groupBy("host").agg(F.coalesce(
        F.avg(F.when((F.col("_g") > 0) & (F.col("_g") < 168), F.col("_g"))), F.lit(0.5)).alias("interval_hours"))


def seasonality(series: DataFrame, horizon_hours: int) -> DataFrame:
    """Factor per (host, metric): mean of the target hour (or of the hours within two of it) over the overall mean,
    between 0.5 and 2; 1 with fewer than eight values or three distinct hours."""
    hours = series.groupBy("host", "metric", F.hour("ts").alias("h")).agg(F.avg("value").alias("m"))
    whole = series.groupBy("host", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        F.max_by(F.hour(F.col("ts") + F.make_dt_interval(hours=F.lit(horizon_hours))), "ts").alias("target"))
    gap = F.abs(F.col("h") - F.col("target"))
    per = hours.join(whole, ["host", "metric"]).groupBy("host", "metric").agg(
        F.max("n").alias("n"), F.max("mean").alias("mean"), F.count(F.lit(1)).alias("hours"),
        F.max(F.when(gap == 0, F.col("m"))).alias("exact"), F.avg(F.when((gap <= 2) | (gap >= 22), F.col("m"))).alias("near"))
    ratio = F.coalesce("exact", "near") / F.col("mean")
    factor = F.when((F.col("n") >= 8) & (F.col("hours") >= 3) & (F.col("mean") > 0) & ratio.isNotNull(),
                    F.greatest(F.lit(0.5), F.least(F.lit(2.0), ratio))).otherwise(F.lit(1.0))
    return per.select("host", "metric", factor.alias("season"))


def risk_context(history: DataFrame) -> DataFrame:
    """Model risk of the newest analysis of each host against the ones before it."""
    rows = history.groupBy("host").agg(F.array_sort(F.collect_list(F.struct(
        "ts", F.abs("score_mean").alias("score"), F.col("anomaly_rate").cast("double").alias("rate"),
        (F.col("sev_critical") + F.col("sev_high")).alias("severe")))).alias("r"))
    rows = rows.withColumns({"now": F.element_at("r", -1), "past": F.slice("r", 1, F.size("r") - 1)})
    rows = rows.withColumns({
        "scores": F.transform("past", lambda x: x["score"]), "rates": F.transform("past", lambda x: x["rate"]),
        "all_scores": F.transform("r", lambda x: x["score"])})
    rows = rows.withColumns({"base": F.when(F.size("past") > 0, V.series_mean(F.col("scores"))).otherwise(F.col("now.score")),
                             "base_rate": F.when(F.size("past") > 0, V.series_mean(F.col("rates"))).otherwise(F.col("now.rate")),
                             "sd": V.series_std(F.col("scores"))})
    worse = F.when(F.size("past") >= 3, F.col("now.score") > F.col("base") + F.greatest(F.col("sd") * 1.5, F.col("base") * 0.1)).otherwise(
        (F.col("base") > 0) & (F.col("now.score") > F.col("base") * 1.15))
    rate, severe = F.col("now.rate"), F.col("now.severe")
    level = (F.when((severe >= 3) | (rate > 15), "CRITICAL").when((severe >= 1) | (rate > 8), "WARNING").when(rate > 0, "INFO").otherwise("OK"))
    return rows.select(
        "host", worse.alias("score_worsening"),
        F.when(F.size("r") >= 3, V.regression(F.col("all_scores"))["slope"]).otherwise(F.lit(0.0)).alias("score_slope"),
        F.when(F.col("base_rate") > 0, rate / F.col("base_rate")).otherwise(F.lit(1.0)).alias("density_ratio"),
        level.alias("ml_risk"), severe.alias("critical_count"))


def forecast(history: DataFrame, metrics: list[Metric], horizon_hours: int = 6, min_points: int = 5,
             seasonal: bool = True, fast: float = 0.3, slow: float = 0.1) -> DataFrame:
    """One row per (host, metric): tier, forecast, bounds, direction, confidence."""
    long = long_series(history, metrics)
    v, n, c = F.col("v"), F.col("n"), F.col
    df = long.groupBy("host", "metric").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"]).alias("v"))
    df = df.join(mean_interval(history), "host")
    df = df.join(seasonality(long, horizon_hours), ["host", "metric"]) if seasonal else df.withColumn("season", F.lit(1.0))
    df = df.withColumns({"n": F.size("v"), "mean": V.series_mean(v), "std": V.series_std(v), "current": F.element_at("v", -1),
                         "steps": F.lit(float(horizon_hours)) / c("interval_hours")})
    df = df.withColumns({
        "volatility": F.when(c("mean") == 0, 0.0).otherwise(c("std") / F.abs("mean")),
        # the regression uses the whole series below twenty values, else the newer half (at least ten)
        "r": F.when(n < 20, v).otherwise(F.slice("v", -F.greatest(F.lit(10), F.floor(n / 2).cast("int")), F.greatest(F.lit(10), F.floor(n / 2).cast("int")))),
        "tier": F.when(n < min_points, 0).when(n < 10, 1).when(n < 20, 2).otherwise(3)})
    df = df.withColumns(V.regression(c("r"))).withColumn("r_mean", V.series_mean(c("r"))).withColumn(
        "intercept", c("r_mean") - c("slope") * c("mean_x"))
    df = df.withColumns({
        "r2": V.r_squared(c("r"), c("r_mean"), c("slope"), c("intercept")), "consistency": V.residual_consistency(c("r"), c("slope"), c("intercept")),
        "fast": V.ewma_last(v, fast), "momentum": V.ewma_last(v, fast) - V.ewma_last(v, slow), "changes": V.cusum_changes(v, c("mean"), c("std")),
        "x_ahead": n - 1 + c("steps"), "wma": V.weighted_mean(v),
        "step_trend": F.when(n >= 3, (c("current") - F.try_element_at("v", F.lit(-3))) / 2).otherwise(F.lit(0.0))})
    zero = F.lit(0.0)
    reg_point = c("slope") * c("x_ahead") + c("intercept")
    margin = V.interval_margin(c("r"), c("slope"), c("intercept"), c("x_ahead"))
    t1 = F.greatest(zero, c("current") + c("step_trend") * c("steps"))
    t2 = F.greatest(zero, reg_point)
    t3 = F.greatest(zero, c("fast") + c("slope") * c("steps") + c("momentum") * c("steps") * 0.5)
    spread3 = c("std") * (F.lit(1.0) + c("volatility")) * F.sqrt(F.greatest(c("steps"), F.lit(1.0))) * 2
    tier = c("tier")
    late = F.size(F.filter("changes", lambda i: i > n - 5))
    calm = F.least(c("volatility"), F.lit(1.0))
    conf1 = F.least(F.lit(0.4), F.lit(0.2) + n * 0.03) * F.greatest(F.lit(0.5), F.lit(1.0) - calm * 0.4)
    conf2 = F.least(F.lit(0.7), c("r2") * 0.5 + n * 0.01 + c("consistency") * 0.15) * F.greatest(F.lit(0.5), F.lit(1.0) - calm * 0.3)
    conf3 = F.greatest(F.lit(0.1), F.least(F.lit(0.9), c("r2") * 0.4 + F.least(n, F.lit(50)) * 0.005 + (F.lit(1.0) - calm) * 0.2
                                           + c("consistency") * 0.1 - F.least(F.lit(0.15), late * 0.07)))
    previous = F.try_element_at("v", F.lit(-2))
    sign = lambda x: F.when(x > 0.001, "rising").when(x < -0.001, "falling").otherwise("stable")
    dir0 = (F.when(n < 2, "unknown").when(c("current") > previous * 1.05, "rising").when(c("current") < previous * 0.95, "falling").otherwise("stable"))
    dir3 = (F.when((c("slope") > 0.001) & (c("momentum") > 0), "rising").when((c("slope") < -0.001) & (c("momentum") < 0), "falling")
            .when(c("momentum") > c("std") * 0.5, "accelerating").when(c("momentum") < -c("std") * 0.5, "decelerating").otherwise("stable"))
    pick = lambda a, b, d: F.when(tier == 1, a).when(tier == 2, b).when(tier == 3, d)
    df = df.withColumns({
        "forecast_value": pick(t1, t2, t3) * c("season"),
        "upper_bound": pick(t1 + c("std") * 2, reg_point + margin, t3 + spread3) * c("season"),
        "lower_bound": pick(F.greatest(zero, t1 - c("std") * 2), F.greatest(zero, reg_point - margin), F.greatest(zero, t3 - spread3)) * c("season"),
        "confidence": F.when(tier == 0, F.when(n < 2, 0.0).otherwise(0.1)).otherwise(pick(conf1, conf2, conf3)),
        "direction": F.when(tier == 0, dir0).otherwise(pick(sign(c("step_trend")), sign(c("slope")), dir3)),
        "trend_slope": F.when(tier == 1, c("step_trend")).otherwise(c("slope"))})
    return df.select("host", "metric", "tier", "n", "v", "current", "forecast_value", "lower_bound", "upper_bound", "confidence",
                     "direction", "volatility", "trend_slope", "wma", "momentum", "r2", "consistency", "changes", "season")


def with_risk(forecasts: DataFrame, context: DataFrame) -> DataFrame:
    """Confidence moved by the model's own risk: up when both point up, down when they disagree."""
    c = F.col
    df = forecasts.join(context, "host", "left")
    signal = (F.when(c("ml_risk") == "CRITICAL", 2.0).when(c("ml_risk") == "WARNING", 1.0).when(c("ml_risk") == "OK", -0.5).otherwise(0.0)
              + F.when(c("score_worsening"), 1.0).otherwise(0.0)
              + F.when(c("density_ratio") > 2, 0.5).when(c("density_ratio") < 0.5, -0.5).otherwise(0.0)
              + F.when(c("score_slope") > 0.02, 0.5).otherwise(0.0))
    df = df.withColumn("_s", F.when(c("ml_risk").isNotNull(), signal))
    s, k = c("_s"), c("confidence")
    up = (F.when(s >= 2, F.least(F.lit(0.95), k + F.least(F.lit(0.2), s * 0.05)))
          .when(s >= 1, F.least(F.lit(0.9), k + F.least(F.lit(0.1), s * 0.04)))
          .when(s <= -0.5, F.greatest(F.lit(0.05), k - F.least(F.lit(0.15), F.abs(s) * 0.06))).otherwise(k))
    flat = (F.when(s >= 2, F.greatest(F.lit(0.05), k - F.least(F.lit(0.12), s * 0.04)))
            .when(s >= 1, F.greatest(F.lit(0.05), k - F.least(F.lit(0.06), s * 0.03))).otherwise(k))
    rising = c("direction").isin("rising", "accelerating")
    return df.withColumn("adjusted_confidence", F.when(s.isNull(), k).when(rising, up).otherwise(flat)).drop("_s")


def forecast_alerts(forecasts: DataFrame, metrics: list[Metric]) -> DataFrame:
    """Rising forecasts far enough above the robust baseline of the earlier values."""
    c = F.col
    rows = [(m.name, m.warn_pct, m.critical_pct, float(m.least)) for m in metrics]
    limits = forecasts.sparkSession.createDataFrame(rows, "metric string, warn double, crit double, least double")
    df = forecasts.join(F.broadcast(limits), "metric").withColumn(
        "_w", F.when(c("n") > 3, F.slice("v", 1, c("n") - 1)).otherwise(c("v")))
    df = V.robust_baseline(df, "_w").withColumnsRenamed({"centre": "_centre", "spread": "_spread"})
    df = df.withColumn("baseline", F.when(c("_centre") <= 0, V.series_mean(c("_w"))).otherwise(c("_centre")))
    wide = F.when((c("_spread") > 0) & (c("baseline") > 0) & (c("_spread") / c("baseline") > 0.3),
                  F.lit(1.0) + F.least(F.lit(0.5), c("_spread") / c("baseline") * 0.8)).otherwise(F.lit(1.0))
    above = F.when(c("baseline") <= 0, F.when(c("forecast_value") > c("least"), 100.0).otherwise(0.0)).otherwise(
        (c("forecast_value") - c("baseline")) / c("baseline") * 100)
    df = df.withColumns({"pct_above": above, "_warn": c("warn") * wide, "_crit": c("crit") * wide})
    first = F.when((c("pct_above") >= c("_crit")) & (c("volatility") <= 0.6), "CRITICAL").otherwise("WARNING")
    signals = (c("ml_risk").isin("CRITICAL", "WARNING").cast("int") + F.coalesce(c("score_worsening"), F.lit(False)).cast("int")
               + (c("score_slope") > 0.01).cast("int") + (c("density_ratio") > 1.5).cast("int"))
    boosted = (c("metric") != "mean_anomaly_score") & c("ml_risk").isNotNull() & (
        (F.coalesce(signals, F.lit(0)) >= 2) | ((c("adjusted_confidence") > 0.65) & (c("pct_above") >= c("_crit") * 0.8)))
    hit = df.filter(c("forecast_value").isNotNull() & (c("adjusted_confidence") >= 0.15) & (c("pct_above") >= c("_warn"))
                    & (c("forecast_value") >= c("least")) & c("direction").isin("rising", "accelerating"))
    return hit.withColumn("severity", F.when((first == "CRITICAL") | boosted, "CRITICAL").otherwise("WARNING")).select(
        "host", "metric", "severity", "current", "forecast_value", "baseline", "pct_above", "adjusted_confidence", "tier", "direction")


def forecast_report(forecasts: DataFrame, alerts: DataFrame) -> DataFrame:
    """Worst risk, mean confidence and direction counts per host, and values missing to the next tier."""
    c = F.col
    base = forecasts.groupBy("host").agg(
        F.avg("adjusted_confidence").alias("mean_confidence"), F.count_if(c("direction").isin("rising", "accelerating")).alias("rising"),
        F.count_if(c("direction").isin("falling", "decelerating")).alias("falling"), F.count_if(c("direction") == "stable").alias("stable"),
        F.max(F.when(c("n") < 5, 5 - c("n")).when(c("n") < 10, 10 - c("n")).when(c("n") < 20, 20 - c("n")).otherwise(0)).alias("to_next_tier"))
    worst = alerts.groupBy("host").agg(F.max(F.when(c("severity") == "CRITICAL", 2).otherwise(1)).alias("w"), F.count(F.lit(1)).alias("alerts"))
    out = base.join(worst, "host", "left")
    return out.withColumns({"alerts": F.coalesce("alerts", F.lit(0).cast("bigint")),
                            "risk": F.when(c("w") == 2, "CRITICAL").when(c("w") == 1, "WARNING").otherwise("OK")}).drop("w")

"""Trend checks: every analysis against the ten before it on the same host. All checks are expressions over one
pass of ordered frames; each fired check becomes one alert row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ALERT = ("struct<alert_type string, severity string, metric_name string, baseline_value double, current_value double, "
         "change_pct double, window_size int>")
LOOKBACK = 10
MIN_HISTORY = 3

# ---- fixed values: watched counters per source with their rise in percent ----
SOURCE_METRICS = {
    "mongodb": [("slow_queries", 60.0), ("collscans", 50.0), ("auth_failures", 40.0)],
    "mssql": [("failed_logins", 40.0), ("high_severity_errors", 50.0)],
    "elasticsearch": [("oom_errors", 30.0), ("circuit_breakers", 40.0), ("shard_failures", 50.0)],
}


def _alert(when: Column, kind: str, severity: Column | str, metric: str, base: Column, now: Column, change: Column,
           window: Column, places: int = 4) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    number = lambda c, n: F.round(c.cast("double"), n)
    return F.when(when, F.struct(
        F.lit(kind).alias("alert_type"), level.alias("severity"), F.lit(metric).alias("metric_name"),
        number(base, places).alias("baseline_value"), number(now, places).alias("current_value"),
        number(change, 2).alias("change_pct"), window.cast("int").alias("window_size")))


def _grade(change: Column, threshold: float) -> Column:
    return F.when(change > threshold * 2, "CRITICAL").otherwise("WARNING")


def with_past(history: DataFrame, keys: list[str], values: dict[str, Column], lookback: int = LOOKBACK) -> DataFrame:
    """For each value v: v itself, and mean, count, min, max and the three predecessors over the past records."""
    order = Window.partitionBy(*keys).orderBy("ts")
    past = order.rowsBetween(-lookback, -1)
    df = history.withColumns(values)
    out = {"n_past": F.count(F.lit(1)).over(past)}
    for v in values:
        out |= {f"{v}_avg": F.avg(v).over(past), f"{v}_n": F.count(v).over(past), f"{v}_lo": F.min(v).over(past),
                f"{v}_hi": F.max(v).over(past), f"{v}_pop": F.stddev_pop(v).over(past),
                **{f"{v}_{i}": F.lag(v, i).over(order) for i in (1, 2, 3)}}
    return df.withColumns(out)


def trend_alerts(history: DataFrame, keys: list[str], source: str = "mongodb") -> DataFrame:
    """Alert rows (keys, ts, alert fields) for every analysis with enough history."""
    critical_high = F.col("sev_critical") + F.col("sev_high")
    graded = sum([F.col(f"sev_{x}") for x in ("critical", "high", "medium", "low", "info")], F.lit(0))
    counters = SOURCE_METRICS[source]
    df = with_past(history, keys, {
        "rate": F.col("anomaly_rate").cast("double"), "score": F.abs("score_mean"), "spread": F.abs("score_std"),
        "tail": F.abs("score_min"), "severe": F.when(graded > 0, critical_high / graded * 100),
        **{f"k_{m}": F.col(m).cast("double") for m, _ in counters}})
    order = Window.partitionBy(*keys).orderBy("ts")
    df = df.withColumns({"_d0": F.col("rate") - F.col("rate_1"), "_d1": F.col("rate_1") - F.col("rate_2"),
                         "_d2": F.col("rate_2") - F.col("rate_3")})
    df = df.withColumn("_d3", F.lag("_d2", 1).over(order))
    c = F.col
    change = lambda v: (c(v) - c(f"{v}_avg")) / c(f"{v}_avg") * 100
    rising = lambda v: (c(f"{v}_1") >= c(f"{v}_2")) & (c(f"{v}_2") >= c(f"{v}_3")) & (c(v) > c(f"{v}_1")) & (c(f"{v}_n") >= 3)
    zero = F.lit(0.0)
    # second differences inside the window of `lookback` records and the current one
    second = [c("_d0") - c("_d1"), c("_d1") - c("_d2"), F.when(c("n_past") >= 4, c("_d2") - c("_d3"))]
    speeding = sum([F.coalesce((s > 0.1).cast("int"), F.lit(0)) for s in second], F.lit(0))
    mean_second = (second[0] + second[1] + F.coalesce(second[2], zero)) / F.when(second[2].isNull(), 2).otherwise(3)
    shift = c("severe") - c("severe_avg")
    alerts = [
        _alert((c("rate_avg") == 0) & (c("rate") > 0), "anomaly_rate_increase", "WARNING", "anomaly_rate", zero, c("rate"),
               F.lit(100.0), c("rate_n")),
        _alert((c("rate_avg") > 0) & (change("rate") > 50), "anomaly_rate_increase", _grade(change("rate"), 50.0),
               "anomaly_rate", c("rate_avg"), c("rate"), change("rate"), c("rate_n")),
        _alert((c("rate_avg") > 0) & rising("rate"), "anomaly_rate_monotonic_increase", "WARNING", "anomaly_rate_trend",
               c("rate_3"), c("rate"), change("rate"), F.lit(4)),
        _alert((c("severe_n") > 0) & (shift > 30), "severity_escalation",
               F.when(c("severe") > 50, "CRITICAL").otherwise("WARNING"), "critical_severity_ratio", c("severe_avg"),
               c("severe"), shift, c("severe_n"), 2),
        _alert((c("score_n") >= 2) & (c("score_avg") > 0) & (change("score") > 30), "ml_score_degradation",
               _grade(change("score"), 30.0), "ml_mean_anomaly_score", c("score_avg"), c("score"), change("score"),
               c("score_n")),
        _alert((c("score_avg") > 0) & rising("score"), "ml_score_monotonic_degradation", "WARNING", "ml_score_trend",
               c("score_3"), c("score"), change("score"), F.lit(4)),
        _alert((c("spread_n") >= 2) & (c("spread_avg") > 0) & (change("spread") > 50), "ml_score_spread_widening",
               _grade(change("spread"), 50.0), "ml_score_std_dev", c("spread_avg"), c("spread"), change("spread"), c("spread_n")),
        _alert((c("tail_n") >= 2) & (c("tail_avg") > 0) & (change("tail") > 40), "ml_tail_risk_increase", "WARNING",
               "ml_score_min", c("tail_avg"), c("tail"), change("tail"), c("tail_n")),
        _alert((c("severe_n") >= 2) & (shift > 15), "severity_distribution_shift",
               F.when(shift > 30, "CRITICAL").otherwise("WARNING"), "severity_critical_high_pct", c("severe_avg"),
               c("severe"), shift, c("severe_n"), 2),
        _alert((c("rate_n") >= 3) & (speeding >= 2) & (c("_d0") > 0), "rate_acceleration",
               F.when(mean_second > 1, "CRITICAL").otherwise("WARNING"), "anomaly_rate_acceleration", c("_d1"), c("_d0"),
               mean_second, c("rate_n") + 1),
        _alert((c("rate_n") >= 4) & (c("rate_avg") > 0) & (c("rate_pop") / c("rate_avg") < 0.3)
               & (c("rate") > c("rate_avg") * 1.3), "stable_degradation", "WARNING", "volatility_cv", c("rate_avg"), c("rate"),
               c("rate_pop") / c("rate_avg") * 100, c("rate_n")),
        _alert((c("rate_n") >= 3) & (c("rate_avg") > 0) & (change("rate") < -40), "improvement_detected", "INFO",
               "anomaly_rate", c("rate_avg"), c("rate"), change("rate"), c("rate_n")),
    ]
    for m, threshold in counters:
        v = f"k_{m}"
        alerts += [
            _alert((c(f"{v}_avg") <= 0) & (c(v) > 0), f"source_{m}", "INFO", m, zero, c(v), F.lit(100.0), c(f"{v}_n"), 2),
            _alert((c(f"{v}_avg") > 0) & (change(v) > threshold), f"source_{m}", _grade(change(v), threshold), m,
                   c(f"{v}_avg"), c(v), change(v), c(f"{v}_n"), 2)]
    fired = df.filter(c("n_past") >= MIN_HISTORY).select(*keys, "ts", F.explode(F.array_compact(F.array(*alerts))).alias("a"))
    return fired.select(*keys, "ts", "a.*")


def concentration_alerts(history: DataFrame, keys: list[str], lookback: int = LOOKBACK, threshold: float = 60.0) -> DataFrame:
    """A component with at least 60 % of the anomalies and more than 1.5 times its past share. Shares are compared by
    analysis number, so a component absent from some analyses still looks back over the same ones."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("ts"))
    rows = history.withColumn("_i", number).select(*keys, "ts", "_i", F.explode("components").alias("component", "n"))
    total = F.sum("n").over(Window.partitionBy(*keys, "_i"))
    past = Window.partitionBy(*keys, "component").orderBy("_i").rangeBetween(-lookback, -1)
    shares = rows.withColumn("share", F.col("n") / total * 100).withColumns({
        "base": F.coalesce(F.avg("share").over(past), F.lit(0.0)), "seen": F.count("share").over(past)})
    hit = shares.filter((F.col("_i") > MIN_HISTORY) & (F.col("share") >= threshold) & (F.col("share") > F.col("base") * 1.5))
    return hit.select(*keys, "ts", F.lit("component_concentration").alias("alert_type"), F.lit("WARNING").alias("severity"),
                      F.concat(F.lit("component_concentration_"), "component").alias("metric_name"),
                      F.round("base", 2).alias("baseline_value"), F.round("share", 2).alias("current_value"),
                      F.round(F.col("share") - F.col("base"), 2).alias("change_pct"), F.col("seen").cast("int").alias("window_size"))


def temporal_alerts(history: DataFrame, keys: list[str], lookback: int = LOOKBACK) -> DataFrame:
    """Peak hours that left the three most frequent past peak hours (equal counts by hour)."""
    past = Window.partitionBy(*keys).orderBy("ts").rowsBetween(-lookback, -1)
    df = history.withColumns({"_past": F.flatten(F.collect_list("peak_hours").over(past)), "n_past": F.count(F.lit(1)).over(past)})
    usual = F.slice(F.array_sort(F.transform(F.array_distinct("_past"), lambda h: F.struct(
        (-F.size(F.filter("_past", lambda x: x == h))).alias("n"), h.alias("h")))), 1, 3)
    df = df.withColumn("_usual", F.transform(usual, lambda s: s["h"]))
    shift = F.lit(1.0) - F.size(F.array_intersect("peak_hours", "_usual")) / F.size("peak_hours")
    hit = df.filter((F.col("n_past") >= MIN_HISTORY) & (F.size("_past") > 0) & (F.size("peak_hours") >= 2) & (shift > 0.5))
    return hit.select(*keys, "ts", F.lit("temporal_shift").alias("alert_type"), F.lit("INFO").alias("severity"),
                      F.lit("peak_hour_shift").alias("metric_name"), F.element_at("_usual", 1).cast("double").alias("baseline_value"),
                      F.element_at("peak_hours", 1).cast("double").alias("current_value"),
                      F.round(shift * 100, 1).alias("change_pct"), F.col("n_past").cast("int").alias("window_size"))


def all_alerts(history: DataFrame, keys: list[str], source: str = "mongodb") -> DataFrame:
    return (trend_alerts(history, keys, source).unionByName(concentration_alerts(history, keys))
            .unionByName(temporal_alerts(history, keys)))


def directions(history: DataFrame, alerts: DataFrame, keys: list[str]) -> DataFrame:
    """Direction of every analysis with its alert counts."""
    bad = F.col("alert_type") != "improvement_detected"
    per = alerts.groupBy(*keys, "ts").agg(
        F.count_if(bad).alias("worse"), F.count_if(~bad).alias("better"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("INFO", "WARNING", "CRITICAL")],
        F.count_if(bad & (F.col("severity") == "CRITICAL")).alias("_crit"), F.count_if(bad & (F.col("severity") == "WARNING")).alias("_warn"),
        F.count_distinct(F.when(bad & (F.col("severity") != "INFO"), F.col("alert_type"))).alias("_types"))
    seen = F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy("ts").rowsBetween(-LOOKBACK, -1))
    df = history.select(*keys, "ts", seen.alias("n_past")).join(per, [*keys, "ts"], "left")
    direction = (F.when(F.col("n_past") < MIN_HISTORY, "insufficient_data").when(F.col("worse").isNull(), "stable")
                 .when(F.col("worse") == 0, "improving").when((F.col("_crit") > 0) | (F.col("_types") >= 3), "critical")
                 .when(F.col("_warn") > 0, "degrading").otherwise("stable"))
    zero = F.lit(0).cast("bigint")
    return df.select(*keys, "ts", direction.alias("direction"),
                     *[F.coalesce(n, zero).alias(n) for n in ("info", "warning", "critical")])


def trend_summary(history: DataFrame, keys: list[str]) -> DataFrame:
    """Window size, current and past rates, population variation and score direction of every analysis."""
    df = with_past(history, keys, {"rate": F.col("anomaly_rate").cast("double"), "score": F.abs("score_mean")})
    ratio = F.col("score") / F.col("score_avg")
    return df.select(
        *keys, "ts", F.col("n_past").alias("history_window"), F.col("rate").alias("current_rate"), F.col("rate_avg").alias("baseline_rate"),
        F.col("rate_lo").alias("min_rate"), F.col("rate_hi").alias("max_rate"),
        F.when(F.col("rate_avg") > 0, F.col("rate_pop") / F.col("rate_avg")).alias("volatility_cv"),
        F.when(ratio > 1.1, "worsening").when(ratio < 0.9, "improving").when(ratio.isNotNull(), "stable").alias("score_direction"))

"""Trend, rate and forecast behaviour on hand-made histories."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievelog.operators import forecast as FC, history as H, rate as RT, trend as T

SCHEMA = ("host string, ts timestamp, total_logs bigint, n_anomalies bigint, anomaly_rate double, score_min double, score_max double, score_mean double, "
          "score_std double, sev_critical bigint, sev_high bigint, sev_medium bigint, sev_low bigint, sev_info bigint, slow_queries bigint, collscans bigint, "
          "auth_failures bigint, components map<string,bigint>, peak_hours array<int>")


def history(spark, scores, rates=None, severe=None, hours=1):
    start = datetime(2025, 1, 1)
    rows = []
    for i, s in enumerate(scores):
        rate = rates[i] if rates else 5.0
        crit = severe[i] if severe else 0
        rows.append(("h", start + timedelta(hours=i * hours), 40, 2, rate, -0.5, -0.1, -s, 0.1, crit, 0, 10 - crit, 0, 0, 0, 0, 0, {"A": 5, "B": 5}, [1, 2, 3]))
    return spark.createDataFrame(rows, SCHEMA)


def kinds(df):
    last = df.agg(F.max("ts")).first()[0]
    alerts = T.all_alerts(df, ["host"]).filter(F.col("ts") == last)
    return {r["alert_type"] for r in alerts.collect()}


def test_stable_scores_raise_nothing(spark):
    assert kinds(history(spark, [0.30, 0.32, 0.29, 0.31, 0.30])) == set()


def test_score_degradation(spark):
    assert "ml_score_degradation" in kinds(history(spark, [0.25] * 5 + [0.45]))


def test_score_monotonic(spark):
    assert "ml_score_monotonic_degradation" in kinds(history(spark, [0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50]))


def test_one_record_is_not_enough(spark):
    df = history(spark, [0.2, 0.9])
    assert kinds(df) == set()
    assert [r["direction"] for r in T.directions(df, T.all_alerts(df, ["host"]), ["host"]).collect()] == ["insufficient_data"] * 2


def test_rate_from_zero_and_direction(spark):
    df = history(spark, [0.3] * 6, rates=[0.0] * 5 + [4.0])
    assert "anomaly_rate_increase" in kinds(df)
    last = T.directions(df, T.all_alerts(df, ["host"]), ["host"]).orderBy(F.col("ts").desc()).first()
    assert last["direction"] in ("degrading", "critical")


def test_missing_rate_is_skipped(spark):
    df = history(spark, [0.3] * 6, rates=[5.0, None, 5.0, None, 5.0, 5.0])
    assert "anomaly_rate_increase" not in kinds(df)


def test_severity_escalation(spark):
    assert {"severity_escalation", "severity_distribution_shift"} <= kinds(history(spark, [0.3] * 5, severe=[0, 0, 0, 0, 6]))


def test_forecast_reports_score_and_context(spark):
    df = history(spark, [0.3 + 0.01 * i for i in range(9)], rates=[3.0 + 0.5 * i for i in range(8)] + [12.0], hours=4)
    metrics = FC.METRICS["mongodb"]
    out = FC.with_risk(FC.forecast(df, metrics), FC.risk_context(df))
    rows = {r["metric"]: r for r in out.collect()}
    assert rows["mean_anomaly_score"]["forecast_value"] > 0 and rows["mean_anomaly_score"]["tier"] == 1
    assert rows["anomaly_rate"]["ml_risk"] == "WARNING" and rows["anomaly_rate"]["direction"] == "rising"
    assert all(0 <= r["adjusted_confidence"] <= 0.99 for r in rows.values())


@pytest.mark.parametrize("n,tier", [(1, 0), (4, 0), (5, 1), (10, 2), (20, 3)])
def test_tiers(spark, n, tier):
    out = FC.forecast(history(spark, [0.3] * n), FC.METRICS["mongodb"]).filter("metric = 'anomaly_rate'").first()
    assert out["tier"] == tier
    if tier:
        assert out["lower_bound"] <= out["forecast_value"] <= out["upper_bound"]


def lines(spark, n=50, errors_every=3):
    start = datetime(2025, 1, 1)
    rows = [(i, start + timedelta(seconds=2 * i), "h", "E" if i % errors_every == 0 else "I", f"m{i}", 1 if i % 2 == 0 else 0, 0, 0, 0, 0,
             -1 if i % 3 == 0 else 1, "HIGH") for i in range(n)]
    return spark.createDataFrame(rows, "log_id int, ts timestamp, host string, s string, msg string, is_auth_failure int, is_slow_query int, is_collscan int, "
                                 "is_drop_operation int, is_out_of_memory int, prediction int, severity_level string")


def test_rate_alerts(spark):
    ev = RT.EVENTS["mongodb"]
    small = {**RT.THRESHOLDS, "auth_failure": (20, 20, 1000), "error_burst": (10, 1000, 1000)}
    out = RT.judge(RT.window_counts(lines(spark), ev), ev, thresholds=small).collect()
    got = {(r["window"], r["event"]): r for r in out}
    assert set(got) == {("short", "auth_failure"), ("medium", "auth_failure"), ("short", "error_burst")}
    assert got[("short", "auth_failure")]["count"] == 25 and got[("short", "auth_failure")]["windows_hit"] == 2
    assert got[("short", "error_burst")]["events_in_window"] == 2
    assert all(r["severity"] == "CRITICAL" and r["confidence"] <= 0.99 for r in out)
    samples = RT.samples(lines(spark), ev).filter("window = 'short' and event = 'auth_failure'").first()["samples"]
    assert samples == ["m0", "m2", "m4"]


def test_cooldown_restarts_at_the_kept_alert(spark):
    start = datetime(2025, 1, 1)
    df = spark.createDataFrame([("k", start + timedelta(minutes=m)) for m in (0, 10, 29, 31, 50, 61, 62)], "k string, ts timestamp")
    kept = [r["kept_us"] for r in RT.cooldown(df, ["k"], "ts", 30).collect()]
    base = min(kept)
    assert sorted((k - base) // 60_000_000 for k in kept) == [0, 31, 61]


def test_weights_follow_the_recurrence(spark):
    start = datetime(2025, 1, 1)
    df = spark.createDataFrame([("h", start + timedelta(days=i)) for i in range(4)], "host string, ts timestamp")
    weights = []
    for _ in range(4):
        weights = [w * 0.9 for w in weights] + [1.0]
        weights = [w / sum(weights) for w in weights]
    got = [r["weight"] for r in H.ensemble_weights(df, ["host"], "ts").orderBy("ts").collect()]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, weights))


def test_convergence_raises_risk(spark):
    rows = [("a", "trend", "INFO", True), ("a", "rate", "INFO", True), ("b", "trend", "INFO", True), ("c", "trend", "INFO", True), ("c", "rate", "INFO", True), ("c", "forecast", "OK", True)]
    out = H.combined_insight(spark.createDataFrame(rows, "host string, alert_source string, max_severity string, has_alerts boolean"))
    assert {r["host"]: r["risk_level"] for r in out.collect()} == {"a": "WARNING", "b": "INFO", "c": "CRITICAL"}


# ---- cooldown ----

def kept_one_by_one(times, far):
    out, last = [], None
    for t in sorted(set(times)):
        if last is None or t - last >= far:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("span", [1, 2, 64])
def test_cooldown_against_one_by_one(spark, span):
    import random
    rnd, far, times = random.Random(span), 30 * 60_000_000, {}
    for key in ("a", "b", None, "steady", "far", "exact"):
        step = {"steady": lambda: 60_000_000, "far": lambda: rnd.randint(1, 20) * far, "exact": lambda: far}.get(key, lambda: rnd.choice([1, 7_000_000, 400_000_000, far, 3 * far]))
        t, times[key] = 1_704_067_200_000_000, []
        for _ in range(400):
            t += step()
            times[key].append(t)
    rows = [(k, t) for k, v in times.items() for t in v for _ in range(2)] + [("a", None), ("lost", None)]
    df = spark.createDataFrame(rows, "k string, us bigint").select("k", F.timestamp_micros("us").alias("ts")).repartition(5)
    got = sorted((r["k"] or "", r["kept_us"]) for r in RT.cooldown(df, ["k"], "ts", span=span).collect())
    assert got == sorted((k or "", t) for k, v in times.items() for t in kept_one_by_one(v, far))
    assert RT.cooldown(df.limit(0), ["k"], "ts").count() == 0


def test_cooldown_of_a_million_times_of_one_key(spark):
    df = spark.range(1_000_000, numPartitions=8).select(F.lit("hot").alias("k"), F.timestamp_micros(F.col("id") * 61_000_000).alias("ts"))
    got = sorted(r["kept_us"] for r in RT.cooldown(df, ["k"], "ts").collect())
    assert got == [i * 61_000_000 for i in range(0, 1_000_000, 30)]


def test_cooldown_comes_before_persistence(spark):
    start = datetime(2025, 1, 1)
    rows = [("h", "error", "short", start, "WARNING"), ("h", "error", "short", start + timedelta(minutes=20), "WARNING"),
            ("h", "error", "long", start + timedelta(minutes=20), "WARNING"), ("h", "error", "short", start + timedelta(minutes=60), "WARNING"),
            ("h", "error", "long", start + timedelta(minutes=60), "WARNING"), (None, "oom", "short", start, "WARNING")]
    out = RT.cooled(spark.createDataFrame(rows, "host string, event string, window string, ts timestamp, severity string")).collect()
    got = {(r["host"], r["window"], (r["ts"] - start).seconds // 60): (r["windows_hit"], r["severity"]) for r in out}
    # at 20 minutes the short window is cooling down, so the long one stands alone
    assert got == {("h", "short", 0): (1, "WARNING"), ("h", "long", 20): (1, "WARNING"), ("h", "short", 60): (2, "CRITICAL"),
                   ("h", "long", 60): (2, "CRITICAL"), (None, "short", 0): (1, "WARNING")}

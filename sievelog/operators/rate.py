"""Rate alerts: event counts in windows that end at the newest line of a host, against thresholds, the rate
outside the window, and the anomalies inside it.

Two map-side combined passes: newest and oldest line per host, then every counter of every window at once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sievelog.functions.values import micros
from sievelog.operators.lookup import attach, null_safe
from sievelog.operators.sequence import top_n

if TYPE_CHECKING:
    import pyarrow as pa

MINUTE = 60_000_000


@dataclass(frozen=True)
class Event:
    """A counter: SQL condition on a line, its threshold key, and the multiple of the threshold that is critical."""

    name: str
    condition: str
    threshold_key: str
    multiplier: float


# ---- fixed values: counters per source ----
EVENTS = {
    "mongodb": [
        Event("auth_failure", "is_auth_failure = 1", "auth_failure", 1.5),
        Event("error_burst", "s in ('E', 'F')", "error_burst", 2.0),
        Event("slow_query", "is_slow_query = 1", "slow_query", 2.0),
        Event("collscan", "is_collscan = 1", "collscan", 1.5),
        Event("drop_operation", "is_drop_operation = 1", "drop_operation", 1.0),
        Event("oom", "is_out_of_memory = 1", "oom", 1.0),
    ],
    "mssql": [
        Event("failed_login", "is_failed_login = 1", "failed_login", 1.5),
        Event("connection_error", "is_connection_error = 1", "connection_error", 2.0),
        Event("permission_error", "is_permission_error = 1", "permission_error", 1.5),
        Event("high_severity", "is_high_severity_error = 1", "high_severity", 1.0),
        Event("ag_error", "is_availability_group_error = 1", "ag_error", 1.0),
        Event("fdhost_crash", "is_fdhost_crash = 1", "fdhost_crash", 1.0),
    ],
    "elasticsearch": [
        Event("oom", "is_oom_error = 1", "oom", 1.0),
        Event("circuit_breaker", "is_circuit_breaker = 1", "circuit_breaker", 1.0),
        Event("shard_failure", "is_shard_failure = 1", "shard_failure", 1.5),
        Event("gc_overhead", "is_gc_overhead = 1", "gc_overhead", 2.0),
        Event("disk_watermark", "is_high_disk_watermark = 1", "disk_watermark", 1.0),
        Event("master_election", "is_master_election = 1", "master_election", 1.0),
        Event("connection_error", "is_connection_error = 1", "connection_error", 2.0),
        Event("error_burst", "is_error = 1", "error_burst", 2.0),
    ],
}
# ---- fixed values: windows (name, minutes) and the threshold of each counter in them ----
WINDOWS = [("short", 15), ("medium", 60), ("long", 360)]
THRESHOLDS = {
    "auth_failure": (50, 150, 500), "error_burst": (100, 300, 1000), "slow_query": (30, 80, 200),
    "collscan": (20, 60, 150), "drop_operation": (3, 5, 10), "oom": (1, 3, 5), "failed_login": (50, 150, 500),
    "connection_error": (30, 80, 200), "permission_error": (10, 30, 80), "high_severity": (5, 15, 40),
    "ag_error": (3, 10, 30), "fdhost_crash": (2, 5, 15), "circuit_breaker": (3, 10, 30), "shard_failure": (5, 15, 50),
    "gc_overhead": (10, 30, 100), "disk_watermark": (3, 10, 30), "master_election": (3, 5, 10),
}
WEIGHTS = "case severity_level when 'CRITICAL' then 3.0D when 'HIGH' then 2.0D when 'MEDIUM' then 1.0D when 'LOW' then 0.5D else 1.0D end"


def with_age(df: DataFrame) -> DataFrame:
    """Adds `age_us` before the newest line of the host and the length of the host's log, `span_us`."""
    us = micros(F.col("ts"))
    ends = df.groupBy("host").agg(F.max(us).alias("_newest"), F.min(us).alias("_oldest"))
    out = attach(df, ends, ["host"])
    return out.withColumns({"age_us": F.col("_newest") - us, "span_us": F.col("_newest") - F.col("_oldest")}).drop(
        "_newest", "_oldest")


def window_counts(df: DataFrame, events: list[Event], windows=WINDOWS) -> DataFrame:
    """One row per (host, window, event): counts inside and outside the window, lines, anomalies, their weight."""
    aged = with_age(df)
    bad = F.col("prediction") == -1
    cells = []
    for name, minutes in windows:
        inside = F.col("age_us") <= minutes * MINUTE
        lines = F.count_if(inside)
        shared = [F.lit(name).alias("window"), F.lit(minutes).alias("minutes"), lines.alias("lines"),
                  (F.count(F.lit(1)) - lines).alias("lines_outside"), F.count_if(inside & bad).alias("anomalies"),
                  F.coalesce(F.sum(F.when(inside & bad, F.expr(WEIGHTS))), F.lit(0.0)).alias("weight"),
                  F.count_if(inside & bad & F.col("severity_level").isin("CRITICAL", "HIGH")).alias("severe")]
        for e in events:
            cells.append(F.struct(*shared, F.lit(e.name).alias("event"),
                                  F.count_if(inside & F.expr(e.condition)).alias("count"),
                                  F.count_if(~inside & F.expr(e.condition)).alias("count_outside")))
    return aged.groupBy("host").agg(F.max("span_us").alias("span_us"), F.array(*cells).alias("cells")).select(
        "host", "span_us", F.inline("cells"))


def judge(counts: DataFrame, events: list[Event], windows=WINDOWS, thresholds=THRESHOLDS) -> DataFrame:
    """Counts at or above their threshold, with severity, confidence, persistence and co-occurrence."""
    rows = [(w, e.name, float(thresholds[e.threshold_key][i]), e.multiplier) for i, (w, _) in enumerate(windows) for e in events]
    limits = counts.sparkSession.createDataFrame(rows, "window string, event string, threshold double, multiplier double")
    hit = counts.join(F.broadcast(limits), ["window", "event"]).filter(F.col("count") >= F.col("threshold"))
    c = F.col
    outside_minutes = F.greatest(c("span_us") / F.lit(float(MINUTE)) - c("minutes"), F.lit(1.0))
    base = F.when(c("lines_outside") >= 10, c("count_outside") / outside_minutes).otherwise(F.lit(0.0))
    hit = hit.withColumns({
        "exceed_ratio": c("count") / c("threshold"), "rate": c("count") / c("minutes"), "baseline_rate": base,
        "density": c("anomalies") / c("lines") * 100, "weighted_density": c("weight") / c("lines") * 100})
    usual = (c("baseline_rate") > 0) & (c("rate") / c("baseline_rate") < 1.2)
    supported = c("density") > 5
    strong = (c("density") > 0) & ((c("weighted_density") > 8) | (supported & (c("severe") >= 2)))
    hit = hit.withColumns({
        "_first": F.when((c("exceed_ratio") >= c("multiplier")) & ~usual, "CRITICAL").otherwise("WARNING"),
        "corroborated": supported, "strongly_corroborated": strong})
    boost = F.when(c("strongly_corroborated"), 0.15).when(c("corroborated"), 0.1).otherwise(0.0)
    confidence = F.least(F.round(F.least(F.lit(0.5) + (c("exceed_ratio") - 1) * 0.15, F.lit(0.85)) + boost, 3), F.lit(0.99))
    by_event, by_window = Window.partitionBy("host", "event"), Window.partitionBy("host", "window")
    return hit.withColumns({
        "confidence": confidence, "windows_hit": F.count(F.lit(1)).over(by_event), "events_in_window": F.count(F.lit(1)).over(by_window),
    }).withColumn("severity", F.when(
        (c("_first") == "CRITICAL") | c("corroborated") | c("strongly_corroborated") | (c("windows_hit") >= 2), "CRITICAL")
        .otherwise("WARNING")).drop("_first", "multiplier")


def samples(df: DataFrame, events: list[Event], windows=WINDOWS, message: str = "msg", n: int = 3) -> DataFrame:
    """The first n messages (200 characters) per host, window and event; only lines of the widest window are read."""
    aged = with_age(df).filter(F.col("age_us") <= max(m for _, m in windows) * MINUTE)
    fired = F.array_compact(F.array(*[
        F.when((F.col("age_us") <= m * MINUTE) & F.expr(e.condition), F.struct(F.lit(w).alias("window"), F.lit(e.name).alias("event")))
        for w, m in windows for e in events]))
    rows = aged.select("host", "ts", "log_id", F.substring(message, 1, 200).alias("m"), F.explode(fired).alias("f")).select(
        "host", "f.window", "f.event", "ts", "log_id", "m")
    first = top_n(rows, ["host", "window", "event"], [F.col("ts"), F.col("log_id")], n)
    return first.groupBy("host", "window", "event").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "log_id", "m"))), lambda x: x["m"]).alias("samples"))


#: A cooldown's chunk is so many cooldowns wide.
SPAN = 64


def _next(t: np.ndarray, far: int) -> np.ndarray:
    """For sorted times, the number of the first one at least `far` later."""
    return np.searchsorted(t, t + far)


def cooldown(alerts: DataFrame, keys: list[str], ts: str, minutes: int = 30, span: int = SPAN) -> DataFrame:
    """Rows (keys, kept_us): an alert is kept when the last kept one of its key is at least the cooldown ago.

    The kept alert depends on the one kept before, a recurrence. Times are cut into chunks of `span` cooldowns. What a
    chunk does to the last kept time before it is a step function over the alerts in its first cooldown, found for each
    chunk on its own; one pass over these steps, a small part of the alerts, hands the last kept time from chunk to
    chunk; then each chunk keeps its alerts on its own. Alerts without a time are never kept; times repeat once.
    """
    far = minutes * MINUTE
    wide, piece, kinds = far * span, [*keys, "_chunk"], dict(alerts.dtypes)
    shape = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    times = alerts.select(*keys, micros(F.col(ts)).alias("_us")).filter("_us is not null").distinct().withColumn(
        "_chunk", F.floor(F.col("_us") / F.lit(wide)))

    def steps(rows: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(rows["_us"].to_numpy())
        at = np.arange(len(t))
        end = np.where(_next(t, far) < len(t), _next(t, far), at)
        while (end[end] != end).any():
            end = end[end]
        first = np.searchsorted(t, rows["_chunk"].iloc[0] * wide + far) + 1  # whatever came before, one of these is next
        until, after = t[:first], t[end[:first]]
        edge = np.append(after[1:] != after[:-1], True)
        return rows.iloc[:1][piece].assign(until=[until[edge]], after=[after[edge]])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        key, last = None, None
        for batch in batches:
            came = []
            for r in batch.to_pylist():
                here = tuple(r[k] for k in keys)
                key, last = here, last if here == key else None
                came.append(last)
                i = 0 if last is None else bisect_left(r["until"], last + far)
                if i < len(r["until"]):
                    last = r["after"][i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(piece)], pa.array(came, pa.int64())], [*piece, "_last"])

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_us")
        t, last = rows["_us"].to_numpy(), rows["_last"].iloc[0]
        after, i, kept = _next(t, far), np.searchsorted(t, last + far), []
        while i < len(t):
            kept.append(i)
            i = after[i]
        return rows.iloc[kept][[*keys, "_us"]]

    found = times.groupBy(*piece).applyInPandas(steps, f"{shape}, _chunk bigint, until array<bigint>, after array<bigint>")
    handed = found.repartition(*keys).sortWithinPartitions(*piece).mapInArrow(walk, f"{shape}, _chunk bigint, _last bigint")
    known = null_safe(times, handed.withColumn("_last", F.coalesce("_last", F.lit(-2**62))), piece)
    return known.groupBy(*piece).applyInPandas(keep, f"{shape}, _us bigint").withColumnRenamed("_us", "kept_us")


def cooled(alerts: DataFrame, ts: str = "ts", minutes: int = 30) -> DataFrame:
    """Alerts (host, event, window, ts, severity) of a series of evaluations as they are sent: those in the cooldown of their
    (host, event, window) go first, and only then an event in two windows of one evaluation counts as persistent."""
    key = ["host", "event", "window"]
    kept = cooldown(alerts, key, ts, minutes).withColumnRenamed("kept_us", "_us")
    sent = null_safe(alerts.withColumn("_us", micros(F.col(ts))), kept, [*key, "_us"])
    several = sent.groupBy("host", "event", "_us").agg(F.count_distinct("window").alias("windows_hit"))
    out = null_safe(sent, several, ["host", "event", "_us"]).drop("_us")
    return out.withColumn("severity", F.when(F.col("windows_hit") >= 2, "CRITICAL").otherwise(F.col("severity")))

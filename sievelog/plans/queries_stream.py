"""Structured Streaming runs over the event files, read as they arrive, finished with availableNow."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievelog.functions import values as V
from sievelog.operators import features as FE, forest as FO
from sievelog.plans.queries_analysis import LINES_SQL
from sievelog.plans.queries_parse import LOGS
from sievelog.plans.registry import query
from sievelog.sources.store import scratch_dir
from sievelog.sources.views import MONGO_LOGS, table
from sievelog.streaming import jobs as J


def folders(spark, name):
    base = f"{scratch_dir(spark).rstrip('/')}/sievelog-{name}-{uuid.uuid4().hex}"
    return base + "/out", base + "/checkpoint"


def events(spark, d):
    return J.file_stream(spark, d, table(spark, d, "events").schema, glob="events.parquet")


def logs(spark, d):
    """The log view over the stream."""
    events(spark, d).createOrReplaceTempView("events")
    return spark.sql(MONGO_LOGS)


def arrivals(spark, d, batches=5, files=2):
    """The events as files that arrive one time slice after the other, so that a rate-limited stream takes several batches."""
    e = table(spark, d, "events")
    folder = folders(spark, "arrivals")[0]
    slot = _slot(e, batches)
    for i in range(batches):
        e.filter(slot == i).repartition(files).write.mode("append").parquet(folder)
    return J.file_stream(spark, folder, e.schema, files)


def _slot(e, batches):
    """Number of a row's time slice: slices of equal length over the whole table."""
    low, high = e.agg(F.min(V.micros(F.col("ts"))), F.max(V.micros(F.col("ts")))).first()
    return F.floor((V.micros(F.col("ts")) - low) * batches / F.lit(high - low + 1))


def arriving_logs(spark, d, batches=5):
    arrivals(spark, d, batches).createOrReplaceTempView("events")
    return spark.sql(MONGO_LOGS)


def land(df, name):
    out, ck = folders(df.sparkSession, name)
    J.run_available(df, out, ck)
    return df.sparkSession.read.schema(df.schema).parquet(out)


# append mode emits closed windows: those that end by the newest time less the lateness
@query("st02_tumbling", f"""{LOGS}, w AS (SELECT host, date_trunc('hour', ts) AS start, count(*) AS n FROM logs GROUP BY 1, 2)
SELECT host, epoch_us(start) AS start_us, n FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM logs) - INTERVAL 1 HOUR""")
def tumbling(spark, d):
    return land(J.tumbling_counts(logs(spark, d), ["host"]), "tumbling").select("host", V.micros(F.col("start")).alias("start_us"), "n")


def _sliding(name, minutes):
    @query(name, f"""{LOGS}, s AS (SELECT host, s, (epoch_us(ts) // 300000000 - k) * 300000000 AS start_us, ts FROM logs, (SELECT unnest(range({minutes // 5})) AS k) t)
SELECT host, start_us, count(*) AS lines, count(*) FILTER (WHERE s = 'E') AS errors FROM s WHERE start_us + {minutes * 60_000_000} <= (SELECT max(epoch_us(ts)) FROM logs) - 3600000000 GROUP BY 1, 2""")
    def sliding(spark, d):
        return land(J.sliding_counts(logs(spark, d), ["host"], {"errors": "s = 'E'"}, minutes), "sliding").select(
            "host", V.micros(F.col("start")).alias("start_us"), "lines", "errors")


_sliding("st03_sliding", 15)
_sliding("st03_sliding_hour", 60)
_sliding("st03_sliding_six_hours", 360)


@query("st04_session_bursts", f"""{LOGS}, g AS (SELECT host, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY host ORDER BY ts) < 600000000 THEN 0 ELSE 1 END AS brk FROM logs),
i AS (SELECT host, us, sum(brk) OVER (PARTITION BY host ORDER BY us) AS sid FROM g), r AS (SELECT host, sid, min(us) AS start_us, max(us) AS last_us, count(*) AS length FROM i GROUP BY 1, 2)
SELECT host, start_us, length FROM r WHERE last_us + 600000000 <= (SELECT max(epoch_us(ts)) FROM logs) - 3600000000""")
def session_bursts(spark, d):
    return land(J.bursts(logs(spark, d), ["host"], "10 minutes"), "bursts").select("host", V.micros(F.col("start")).alias("start_us"), "length")


@query("st04_login_bursts", f"""{LOGS}, a AS (SELECT * FROM logs WHERE c = 'ACCESS'),
g AS (SELECT host, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY host ORDER BY ts) < 1000000 THEN 0 ELSE 1 END AS brk FROM a),
i AS (SELECT host, us, sum(brk) OVER (PARTITION BY host ORDER BY us) AS sid FROM g), r AS (SELECT host, sid, min(us) AS start_us, max(us) AS last_us, count(*) AS length FROM i GROUP BY 1, 2)
SELECT host, start_us, length FROM r WHERE last_us + 1000000 <= (SELECT max(epoch_us(ts)) FROM a) - 3600000000""")
def login_bursts(spark, d):
    logins = logs(spark, d).filter("c = 'ACCESS'")
    return land(J.bursts(logins, ["host"]), "logins").select("host", V.micros(F.col("start")).alias("start_us"), "length")


@query("st05_repeats", f"""{LOGS} SELECT host, count(DISTINCT msg) AS lines, count(DISTINCT msg) AS messages FROM logs GROUP BY host""")
def repeats(spark, d):
    return land(J.without_repeats(logs(spark, d), ["host", "msg"]), "repeats").groupBy("host").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("msg").alias("messages"))


@query("st06_st14_cooldown", """WITH RECURSIVE a AS (SELECT DISTINCT 'host-' || CAST(user_id % 8 AS VARCHAR(9)) AS alert_key, (epoch_us(ts) // 300000000) * 300000000 AS t FROM events WHERE event_type = 'error'),
r AS (SELECT alert_key, min(t) AS t FROM a GROUP BY alert_key UNION ALL SELECT r.alert_key, (SELECT min(a.t) FROM a WHERE a.alert_key = r.alert_key AND a.t >= r.t + 43200000000) FROM r WHERE r.t IS NOT NULL)
SELECT alert_key, t AS kept_us FROM r WHERE t IS NOT NULL""")
def cooldown(spark, d):
    """Over five batches; the state of a key goes when its cooldown is over."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    e = arrivals(spark, d).filter("event_type = 'error'")
    alerts = e.select(F.concat(F.lit("host-"), (F.col("user_id") % 8).cast("string")).alias("alert_key"),
                      F.timestamp_micros(V.time_slice(F.col("ts"), 5)).alias("ts"))
    return land(J.cooled_alerts(alerts, 720), "cooldown").select("alert_key", "kept_us")


@query("st07_frequency_baseline", """SELECT 'user' AS kind, CAST(user_id AS VARCHAR) AS key, count(*) AS count FROM events GROUP BY user_id
UNION ALL SELECT 'type', event_type, count(*) FROM events GROUP BY event_type""")
def frequency_baseline(spark, d):
    out, ck = folders(spark, "baseline")
    J.run_batches(arrivals(spark, d), J.baseline_counter(out, {"user": F.col("user_id"), "type": F.col("event_type")}), ck)
    return J.read_baseline(spark, out)


@query("st08_fifo_buffer", f"""{LOGS}, r AS (SELECT host, log_id, row_number() OVER (PARTITION BY host ORDER BY ts DESC, log_id DESC) AS rn FROM logs) SELECT host, log_id FROM r WHERE rn <= 50""")
def fifo_buffer(spark, d):
    out, ck = folders(spark, "fifo")
    J.run_batches(arriving_logs(spark, d), J.fifo_writer(out, ["host"], 50), ck)
    return J.read_buffer(spark, out, ["host"]).select("host", "log_id")


# each batch of a host with 50 lines and more adds a model; every line of such a host gets a score and a vote
@query("st09_st10_online_models", f"""{LOGS}, b AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) - min(epoch_us(ts)) + 1 AS wide FROM events),
s AS (SELECT host, count(*) AS n FROM (SELECT host, floor(CAST((epoch_us(ts) - low) * 3 AS DOUBLE) / wide) AS slot FROM logs, b) x GROUP BY host, slot),
m AS (SELECT host, count(*) AS members FROM s WHERE n >= 50 GROUP BY host)
SELECT host, count(*) AS lines, COALESCE(any_value(members), 0) AS members, CASE WHEN any_value(members) IS NULL THEN 0 ELSE count(*) END AS scored,
 COALESCE(any_value(members), 0) * 100 AS trees, any_value(members) IS NOT NULL AS weighted, true AS in_range FROM logs LEFT JOIN m USING (host) GROUP BY host""")
def online_models(spark, d):
    """Models grown from three batches of the stream, then the stream scored with them, rules and severity on top."""
    names = ["is_error", "is_collscan", "query_duration_ms", "docs_examined_count", "attr_key_count", "hour_of_day"]
    model, ck = folders(spark, "mini")
    signals = lambda logs: FE.mongodb_line_features(logs).withColumn("extreme_burst_flag", F.lit(0))
    lines = signals(arriving_logs(spark, d, 3))
    J.run_batches(lines.select("host", "log_id", *[F.col(n).cast("double").alias(n) for n in names]), J.mini_model_writer(model, names), ck)
    models = J.ring(spark, model)
    empty = spark.createDataFrame([], f"host string, {FO.PACKED}, limit double, mean array<double>, std array<double>, member int, weight double")
    models = empty if models is None else models
    out, ck2 = folders(spark, "scored")
    J.run_batches(signals(logs(spark, d)), J.scoring_writer(out, models, names), ck2)
    per = models.groupBy("host").agg(F.count(F.lit(1)).alias("members"), F.sum("trees").alias("trees"), (F.abs(F.sum("weight") - 1) < 1e-9).alias("weighted"))
    score = F.col("model_score")
    facts = spark.read.parquet(out).groupBy("host").agg(
        F.count(F.lit(1)).alias("lines"), F.count(score).alias("scored"),
        F.every(F.coalesce(score.between(-1, 0), F.lit(True)) & F.col("prediction").isin(-1, 1) & F.col("severity_level").isNotNull()).alias("in_range"))
    return facts.join(per, "host", "left").select("host", "lines", F.coalesce("members", F.lit(0)).alias("members"), "scored",
                                                  F.coalesce("trees", F.lit(0)).alias("trees"), F.coalesce("weighted", F.lit(False)).alias("weighted"), "in_range")


@query("st11_sequence_features", f"""WITH {LINES_SQL}, w AS (SELECT host, log_id, epoch_us(ts) - epoch_us(lag(ts) OVER o) AS gap, row_number() OVER o AS seq FROM lines WINDOW o AS (PARTITION BY host ORDER BY ts, log_id)),
f AS (SELECT *, CAST(COALESCE(gap, 0) = 0 AS INTEGER) AS burst FROM w)
SELECT host, log_id, round(CAST(COALESCE(gap, 0) AS DOUBLE) / 1000000, 6) AS gap, round(avg(CAST(burst AS DOUBLE)) OVER (PARTITION BY host ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS density FROM f""")
def sequence_features(spark, d):
    out, ck = folders(spark, "sequence")
    J.run_batches(logs(spark, d), J.sequence_writer(spark, out, out.replace("/out", "/tails"), ["host"]), ck)
    return spark.read.parquet(out).select("host", "log_id", F.round("time_since_last_log", 6).alias("gap"), F.round("burst_density", 6).alias("density"))


@query("st13_history_enrichment", """WITH h AS (SELECT user_id % 8 AS host, count(*) AS past, round(avg(value), 6) AS mean_value FROM events GROUP BY 1)
SELECT event_id, user_id % 8 AS host, past, mean_value FROM events JOIN h ON h.host = user_id % 8 WHERE event_type = 'error'""")
def history_enrichment(spark, d):
    host = (F.col("user_id") % 8).alias("host")
    past = table(spark, d, "events").groupBy(host).agg(F.count(F.lit(1)).alias("past"), F.round(F.avg("value"), 6).alias("mean_value"))
    fresh = events(spark, d).filter("event_type = 'error'").select("event_id", host)
    return land(J.enriched(fresh, past, ["host"]), "enriched").select("event_id", "host", "past", "mean_value")


# rows are late by the watermark of the batch before: the third file's, by what the first has moved it to
@query("st12_late_rows", """WITH k AS (SELECT max(epoch_us(ts)) FILTER (WHERE event_id % 10 BETWEEN 1 AND 8) // 1000 * 1000 - 3600000000 AS mark FROM events)
SELECT count(*) AS rows, count(*) FILTER (WHERE event_id % 10 = 0 AND (epoch_us(ts) // 3600000000 + 1) * 3600000000 <= mark) AS dropped FROM events, k""")
def late_rows(spark, d):
    """Rows that arrive after their window has closed: dropped, and kept count of."""
    e = table(spark, d, "events")
    folder, ck = folders(spark, "late")
    for part in ("event_id % 10 BETWEEN 1 AND 8", "event_id % 10 = 9", "event_id % 10 = 0"):
        e.filter(part).coalesce(1).write.mode("append").parquet(folder)
    stream = J.file_stream(spark, folder, e.schema, 1)
    query = J.run_available(J.tumbling_counts(stream, ["event_id"]), folder + "-counts", ck)
    return J.late_rows_table(query, spark).agg(F.sum("rows").alias("rows"), F.sum("dropped").alias("dropped"))


# unmatched anomalies come out once the bound on their feedback has passed: two days, and the lateness, before the newest feedback
@query("st15_late_feedback", """WITH a AS (SELECT event_id, ts FROM events WHERE event_type = 'error'),
f AS (SELECT event_id, ts + INTERVAL 5 MINUTE AS fts FROM events WHERE event_type = 'error' AND event_id % 3 = 0),
w AS (SELECT least((SELECT max(ts) FROM a), (SELECT max(fts) FROM f)) - INTERVAL 1 HOUR AS mark)
SELECT a.event_id AS log_id, f.event_id IS NOT NULL AS matched FROM a LEFT JOIN f ON a.event_id = f.event_id, w
WHERE f.event_id IS NOT NULL OR date_trunc('millisecond', a.ts) + INTERVAL 2 DAY < date_trunc('millisecond', mark)""")
def late_feedback(spark, d):
    """Over five batches: feedback comes in files of its own, behind the anomalies."""
    a = arrivals(spark, d).filter("event_type = 'error'").select(F.col("event_id").alias("log_id"), "ts")
    f = arrivals(spark, d).filter("event_type = 'error' and event_id % 3 = 0").select(
        F.col("event_id").alias("f_log_id"), (F.col("ts") + F.expr("interval 5 minutes")).alias("feedback_ts"))
    return land(J.with_feedback(a, f, "2 days"), "feedback").select("log_id", F.col("f_log_id").isNotNull().alias("matched"))

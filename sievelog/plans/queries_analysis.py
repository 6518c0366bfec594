"""Analysis stages over the log view with a cheap deterministic score, so that oracle and result stay readable."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelog.functions import patterns as P, text as X, values as V
from sievelog.operators import analysis as A, features as FE
from sievelog.operators.lookup import attach
from sievelog.operators.sequence import newest, top_n
from sievelog.plans import oracle as O
from sievelog.plans.queries_detect import mssql_source
from sievelog.plans.registry import query
from sievelog.sources import views
from sievelog.sources.views import MONGO_LOGS, table

# the same scores in both engines: errors and high values are anomalies, the value column drives score and severity.
# The odd divisors keep means off exact rounding ties, which summation order would decide
SCORES = """CASE WHEN s = 'E' OR value > 100 THEN -1 ELSE 1 END AS prediction, -(value / 503.7) AS anomaly_score,
 least(value / 4.7, CAST(100 AS DOUBLE)) AS severity_score,
 CASE WHEN value / 4.7 >= 80 THEN 'CRITICAL' WHEN value / 4.7 >= 60 THEN 'HIGH' WHEN value / 4.7 >= 40 THEN 'MEDIUM'
  WHEN value / 4.7 >= 20 THEN 'LOW' ELSE 'INFO' END AS severity_level"""
VALUED = MONGO_LOGS.replace("SELECT event_id AS log_id, ts,", "SELECT event_id AS log_id, ts, value,", 1)
LINES_SQL = O.MONGO_LINES.replace(f"logs AS ({MONGO_LOGS})", f"logs AS (SELECT *, {SCORES} FROM ({VALUED}) v)", 1)
L = f"WITH {LINES_SQL}"
BAD = "prediction = -1"


def lines(spark, d):
    """Stateless features with the stand-in scores."""
    base = views.log_view(spark, d, f"SELECT *, {SCORES} FROM ({VALUED}) v")
    return FE.mongodb_line_features(base)


def r6(name: str, expr=None):
    return F.round(name if expr is None else expr, 6).alias(name)


@query("g07_g09_summary", f"""{L} SELECT host, count(*) AS total_logs, count(*) FILTER (WHERE {BAD}) AS n_anomalies,
 round(avg(CASE WHEN {BAD} THEN CAST(1 AS DOUBLE) ELSE 0 END) * 100, 6) AS anomaly_rate, round(min(anomaly_score), 6) AS score_min,
 round(max(anomaly_score), 6) AS score_max, round(avg(anomaly_score), 6) AS score_mean,
 round(stddev_pop(anomaly_score), 6) AS score_std, {', '.join(
    f"count(*) FILTER (WHERE {BAD} AND severity_level = '{lv}') AS sev_{lv.lower()}" for lv in A.LEVELS)} FROM lines GROUP BY host""")
def summary(spark, d):
    out = A.summary(lines(spark, d), ["host"])
    return out.select("host", "total_logs", "n_anomalies", *[r6(c) for c in (
        "anomaly_rate", "score_min", "score_max", "score_mean", "score_std")], *[f"sev_{lv.lower()}" for lv in A.LEVELS])


@query("g08_peak_hours", f"""{L}, h AS (SELECT host, hour_of_day, count(*) AS n FROM lines WHERE {BAD} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, hour_of_day) AS rn FROM h)
SELECT host, string_agg(CAST(hour_of_day AS VARCHAR), ',' ORDER BY rn) AS peaks FROM r WHERE rn <= 3 GROUP BY host""")
def peak_hours(spark, d):
    return A.peak_hours(lines(spark, d), ["host"]).select("host", F.concat_ws(",", "peak_hours").alias("peaks"))


@query("g10_performance_alerts", f"""{L}, a AS (
 {' UNION ALL '.join(f"SELECT host, log_id, '{n}' AS alert, CAST({v} AS DOUBLE) AS v FROM lines WHERE prediction = 1 AND {c}"
                     for n, (c, v) in A.PERFORMANCE_ALERTS.items())}),
i AS (SELECT *, row_number() OVER (PARTITION BY host, alert ORDER BY log_id) AS rn FROM a)
SELECT host, alert, count(*) AS count, round(avg(v), 6) AS mean_value, max(v) AS max_value,
 string_agg(CAST(log_id AS VARCHAR), ',' ORDER BY log_id) FILTER (WHERE rn <= 10) AS first_ids FROM i GROUP BY 1, 2""")
def performance_alerts(spark, d):
    flipped = lines(spark, d).withColumn("prediction", -F.col("prediction"))
    return A.performance_alerts(flipped, ["host"]).select(
        "host", "alert", "count", r6("mean_value"), "max_value", F.concat_ws(",", "first_ids").alias("first_ids"))


@query("g11_security_alerts", f"""{L}, a AS (
 {' UNION ALL '.join(f"SELECT host, log_id, '{n}' AS alert FROM lines WHERE {BAD} AND {c}"
                     for n, c in A.SECURITY_ALERTS['mongodb'].items())}),
i AS (SELECT *, row_number() OVER (PARTITION BY host, alert ORDER BY log_id) AS rn FROM a)
SELECT host, alert, count(*) AS count,
 string_agg(CAST(log_id AS VARCHAR), ',' ORDER BY log_id) FILTER (WHERE rn <= 10) AS first_ids FROM i GROUP BY 1, 2""")
def security_alerts(spark, d):
    return A.alert_counts(lines(spark, d), ["host"], A.SECURITY_ALERTS["mongodb"]).select(
        "host", "alert", "count", F.concat_ws(",", "first_ids").alias("first_ids"))


def _source_alerts(key, source, sql, build):
    @query(key, f"""WITH {sql}, a AS (
     {' UNION ALL '.join(f"SELECT host, log_id, '{n}' AS alert FROM lines WHERE {c}" for n, c in A.SECURITY_ALERTS[source].items())})
    SELECT host, alert, count(*) AS count, min(log_id) AS first_id FROM a GROUP BY 1, 2""")
    def run(spark, d):
        rows = build(spark, d).withColumn("prediction", F.lit(-1))
        return A.alert_counts(rows, ["host"], A.SECURITY_ALERTS[source]).select(
            "host", "alert", "count", F.element_at("first_ids", 1).alias("first_id"))


_source_alerts("g12_mssql_alerts", "mssql", O.MSSQL_LINES,
               lambda s, d: FE.mssql_line_features(FE.mssql_parse(mssql_source(s, d))))
_source_alerts("g12_es_alerts", "elasticsearch", O.ES_LINES,
               lambda s, d: FE.es_line_features(FE.es_parse(views.es_logs(s, d))))


@query("g13_component_rates", f"""{L} SELECT host, c, count(*) AS total_count, count(*) FILTER (WHERE {BAD}) AS anomaly_count,
 round(avg(CASE WHEN {BAD} THEN CAST(1 AS DOUBLE) ELSE 0 END) * 100, 6) AS anomaly_rate FROM lines GROUP BY 1, 2""")
def component_rates(spark, d):
    return A.component_rates(lines(spark, d), ["host"]).select("host", "c", "total_count", "anomaly_count", r6("anomaly_rate"))


@query("g32_dominant_patterns", f"""{L}, g AS (SELECT host, message_fingerprint AS fingerprint, count(*) AS count,
 round(avg(severity_score), 6) AS mean_severity, round(max(severity_score), 6) AS max_severity,
 min_by(substr(msg, 1, 200), log_id) AS sample, min_by(c, log_id) AS component FROM lines WHERE {BAD} AND message_fingerprint <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY count DESC, fingerprint) AS rn FROM g)
SELECT host, fingerprint, substr(fingerprint, 1, 120) AS shown, count, mean_severity, max_severity, sample, component FROM r WHERE rn <= 7""")
def dominant_patterns(spark, d):
    return A.dominant_patterns(lines(spark, d), ["host"]).select(
        "host", "fingerprint", "shown", "count", r6("mean_severity"), r6("max_severity"), "sample", "component")


@query("g33_hotspots", f"""{L}, g AS (SELECT c, count(*) FILTER (WHERE {BAD}) AS anomaly_count, count(*) AS total_count,
 round(avg(CASE WHEN {BAD} THEN CAST(1 AS DOUBLE) ELSE 0 END) * 100, 6) AS anomaly_rate FROM lines GROUP BY 1)
SELECT * FROM g ORDER BY anomaly_count DESC, c LIMIT 5""")
def hotspots(spark, d):
    return A.component_rates(lines(spark, d), []).select(
        "c", "anomaly_count", "total_count", r6("anomaly_rate")).orderBy(F.col("anomaly_count").desc(), "c").limit(5)


@query("g34_digest", f"""{L}, b AS (SELECT * FROM lines WHERE {BAD}),
p AS (SELECT CASE WHEN message_fingerprint = '' THEN c || ':' || substr(msg, 1, 40) ELSE message_fingerprint END AS k, count(*) AS n,
 round(max(severity_score), 6) AS max_score, max_by(substr(msg, 1, 200), (severity_score, -log_id)) AS sample FROM b GROUP BY 1)
SELECT * FROM (SELECT 'pattern' AS kind, k AS key, n, max_score, sample FROM p ORDER BY n DESC, k LIMIT 10) x
UNION ALL SELECT * FROM (SELECT 'component', c, count(*), round(max(severity_score), 6), NULL FROM b GROUP BY c ORDER BY 3 DESC, c LIMIT 10) y
UNION ALL SELECT 'severity', severity_level, count(*), round(max(severity_score), 6), NULL FROM b GROUP BY severity_level""")
def digest(spark, d):
    bad = lines(spark, d).filter(BAD)
    key = F.when(F.col("message_fingerprint") == "", F.concat_ws(":", "c", F.substring("msg", 1, 40))).otherwise(
        F.col("message_fingerprint"))
    none = F.lit(None).cast("string").alias("sample")
    agg = lambda kind, col: bad.groupBy(col.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("severity_score").alias("m"))
    shape = lambda df, kind, sample: df.select(F.lit(kind).alias("kind"), "key", "n", F.round("m", 6).alias("max_score"), sample)
    pattern = bad.groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.max("severity_score").alias("m"),
        F.max_by(F.substring("msg", 1, 200), F.struct("severity_score", -F.col("log_id"))).alias("sample"))
    top = lambda df: df.orderBy(F.col("n").desc(), "key").limit(10)
    return (shape(top(pattern), "pattern", F.col("sample"))
            .unionByName(shape(top(agg("component", F.col("c"))), "component", none))
            .unionByName(shape(agg("severity", F.col("severity_level")), "severity", none)))


@query("g36_a09_temporal", f"""{L}, h AS (SELECT host, hour_of_day, count(*) AS n FROM lines WHERE {BAD} GROUP BY 1, 2)
SELECT host, round(CAST(sum(CASE WHEN hour_of_day BETWEEN 9 AND 18 THEN n ELSE 0 END) AS DOUBLE) / sum(n) * 100, 6) AS work_share,
 round(CAST(sum(CASE WHEN hour_of_day BETWEEN 0 AND 5 THEN n ELSE 0 END) AS DOUBLE) / sum(n) * 100, 6) AS night_share,
 CAST(sum(CASE WHEN hour_of_day BETWEEN 9 AND 18 THEN n ELSE 0 END) * 100 > sum(n) * 60 AS INTEGER) AS work_heavy
FROM h GROUP BY host""")
def temporal(spark, d):
    out = A.temporal_patterns(A.hourly(lines(spark, d), ["host"]), ["host"])
    return out.select("host", r6("work_share"), r6("night_share"), F.col("is_work_heavy").cast("int").alias("work_heavy"))


@query("a08_a09_hour_sets", """WITH h AS (SELECT user_id, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2),
g AS (SELECT user_id, h, h - row_number() OVER (PARTITION BY user_id ORDER BY h) AS k FROM h),
runs AS (SELECT user_id, min(h) AS a, max(h) AS b FROM g GROUP BY user_id, k HAVING max(h) - min(h) >= 2)
SELECT user_id, string_agg(CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR), ',' ORDER BY a) AS runs FROM runs GROUP BY user_id""")
def hour_sets(spark, d):
    hours = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.hour("ts")).alias("hours"))
    return hours.select("user_id", F.concat_ws(",", V.hour_runs(F.col("hours"))).alias("runs")).filter("runs <> ''")


# ---- selections ----

@query("k02_ranked_anomalies", f"{L} SELECT log_id, host, round(severity_score, 6) AS severity_score FROM lines WHERE {BAD} ORDER BY severity_score DESC, log_id LIMIT 500")
def ranked_anomalies(spark, d):
    return lines(spark, d).filter(BAD).select("log_id", "host", r6("severity_score")).orderBy(
        F.col("severity_score").desc(), "log_id").limit(500)


_CRIT = f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY severity_score DESC, log_id) AS rn
 FROM lines WHERE {BAD} AND (severity_score > 40 OR {O.word_rule(P.CRITICAL_MESSAGES['mongodb'], 'msg')})) t WHERE rn <= 500),
critical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, message_fingerprint ORDER BY severity_score DESC, log_id)
 AS fr FROM best) t WHERE fr <= 5)"""


@query("e20_k04_critical_lines", f"{L}, {_CRIT} SELECT host, log_id, msg, round(severity_score, 6) AS severity_score FROM critical")
def critical_lines(spark, d):
    return A.critical_lines(lines(spark, d), ["host"]).select("host", "log_id", "msg", r6("severity_score"))


@query("e21_rescued_lines", f"""{L}, {_CRIT}, missed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY log_id) AS mr
 FROM lines WHERE {BAD} AND {O.word_rule(P.CRITICAL_MESSAGES['mongodb'], 'msg')}
 AND log_id NOT IN (SELECT log_id FROM critical)) t WHERE mr <= 100),
u AS (SELECT host, log_id, severity_score FROM critical UNION ALL SELECT host, log_id, severity_score FROM missed)
SELECT host, log_id, round(severity_score, 6) AS severity_score FROM (SELECT *, row_number() OVER
 (PARTITION BY host ORDER BY severity_score DESC, log_id) AS rn FROM u) t WHERE rn <= 500""")
def rescued_lines(spark, d):
    base = lines(spark, d)
    chosen = A.critical_lines(base, ["host"])
    return A.rescue_critical(base, chosen, ["host"], "mongodb", "msg").select("host", "log_id", r6("severity_score"))


@query("e22_false_positives", f"""{L}, {_CRIT}, rates AS (SELECT host, c, avg(CASE WHEN {BAD} THEN 100.0 ELSE 0 END) AS rate,
 count(*) AS n FROM lines GROUP BY 1, 2),
noisy AS (SELECT host, c FROM rates WHERE rate > 99.5 AND n > 100 AND c NOT IN ('COMMAND', 'REPL', 'CONTROL', 'NETWORK', 'STORAGE')),
kept AS (SELECT *, count(*) OVER (PARTITION BY host) AS total, row_number() OVER (PARTITION BY host, message_fingerprint
 ORDER BY severity_score DESC, log_id) AS fp_rank FROM critical k WHERE NOT EXISTS (SELECT 1 FROM noisy n WHERE n.host = k.host AND n.c = k.c)
 AND ({O.word_rule(P.CRITICAL_MESSAGES['mongodb'], 'msg')} OR contains(lower(msg), 'restart') OR severity_score > 30
 OR severity_level IN ('CRITICAL', 'HIGH', 'MEDIUM') OR (contains(lower(msg), 'slow query') AND severity_score > 45)))
SELECT host, log_id, round(severity_score, 6) AS severity_score FROM kept WHERE fp_rank <= greatest(3, floor(total * 15 / 100))""")
def false_positives(spark, d):
    base = lines(spark, d)
    out = A.filter_false_positives(A.critical_lines(base, ["host"]), A.component_rates(base, ["host"]), ["host"])
    return out.select("host", "log_id", r6("severity_score"))


@query("p17_j06_benign", f"""{L} SELECT c, CASE {' '.join(
    f"WHEN contains(lower(msg), lower({O.quoted(p)})) AND c = {O.quoted(c)} THEN {O.quoted(t)}"
    for _, p, c, t in [*P.BENIGN_SIGNATURES, (7, 'slow query', 'COMMAND', 'tracked elsewhere')])} END AS benign_reason, count(*) AS n
FROM lines GROUP BY 1, 2""")
def benign(spark, d):
    extended = [*P.BENIGN_SIGNATURES, (7, "slow query", "COMMAND", "tracked elsewhere")]
    return A.tag_benign(lines(spark, d), signatures=extended).groupBy("c", "benign_reason").agg(F.count(F.lit(1)).alias("n"))


SIGNATURES = """SELECT p_partkey AS "order", CASE p_partkey % 5 WHEN 0 THEN 'User ' || chr(39) || 'U' || CAST(p_partkey AS VARCHAR(9)) || chr(39)
  WHEN 1 THEN 'docsExamined":' || CAST(p_partkey AS VARCHAR(9)) WHEN 2 THEN 'Client: 10.0.0.' || CAST(p_partkey AS VARCHAR(9)) || ']'
  WHEN 3 THEN 'keysExamined":' || CAST(p_partkey * 7 AS VARCHAR(9)) ELSE CAST(p_partkey AS VARCHAR(9)) || '}' END AS pattern,
 CASE WHEN p_partkey % 5 IN (1, 3) AND p_partkey % 2 = 0 THEN 'QUERY' WHEN p_partkey % 7 = 0 THEN 'COMMAND' END AS component,
 'part ' || p_name AS reason FROM part"""


def signatures(spark, d):
    """One signature for each row of `part`."""
    k = F.col("p_partkey")
    text = k.cast("string")
    pattern = (F.when(k % 5 == 0, F.concat(F.lit("User 'U"), text, F.lit("'"))).when(k % 5 == 1, F.concat(F.lit('docsExamined":'), text))
               .when(k % 5 == 2, F.concat(F.lit("Client: 10.0.0."), text, F.lit("]"))).when(k % 5 == 3, F.concat(F.lit('keysExamined":'), (k * 7).cast("string")))
               .otherwise(F.concat(text, F.lit("}"))))
    component = F.when((k % 5).isin(1, 3) & (k % 2 == 0), "QUERY").when(k % 7 == 0, "COMMAND")
    return table(spark, d, "part").select(k.alias("order"), pattern.alias("pattern"), component.alias("component"),
                                          F.concat(F.lit("part "), "p_name").alias("reason"))


@query("j06_signature_table", f"""{L}, sig AS ({SIGNATURES}),
hit AS (SELECT log_id, arg_min(reason, "order") AS benign_reason, min("order") AS benign_order FROM lines JOIN sig
 ON contains(lower(msg), lower(pattern)) AND (component IS NULL OR component = c) GROUP BY 1)
SELECT c, benign_order, benign_reason, CAST(benign_order IS NOT NULL AS INTEGER) AS is_known_benign, count(*) AS n FROM lines LEFT JOIN hit USING (log_id) GROUP BY 1, 2, 3, 4""")
def signature_table(spark, d):
    rows = A.tag_by_table(lines(spark, d), signatures(spark, d), ["log_id"])
    return rows.groupBy("c", "benign_order", "benign_reason", F.col("is_known_benign").cast("int").alias("is_known_benign")).agg(F.count(F.lit(1)).alias("n"))


@query("k05_share_cap", f"""{L}, b AS (SELECT *, count(*) OVER (PARTITION BY host) AS total, row_number() OVER (PARTITION BY host,
 message_fingerprint ORDER BY severity_score DESC, log_id) AS fr FROM lines WHERE {BAD})
SELECT host, log_id FROM b WHERE fr <= greatest(3, floor(total * 15 / 100))""")
def share_cap(spark, d):
    return A.cap_share(lines(spark, d).filter(BAD), ["host"]).select("host", "log_id")


@query("w09_round_robin", f"""{L}, f AS (SELECT *, row_number() OVER (PARTITION BY host, message_fingerprint ORDER BY severity_score DESC, log_id) AS fr
 FROM lines WHERE {BAD}), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY fr, severity_score DESC, log_id) AS rn FROM f)
SELECT host, log_id FROM r WHERE rn <= 40""")
def round_robin(spark, d):
    return A.diverse_by_rank(lines(spark, d).filter(BAD), ["host"], 40).select("host", "log_id")


@query("w10_category_balance", f"""{L}, t AS (SELECT *, CASE WHEN c <> '' THEN c ELSE {O.ANOMALY_TYPE} END AS kind FROM lines WHERE {BAD}),
q AS (SELECT host, greatest(2, floor(75 / (count(DISTINCT kind) * 2))) AS quota FROM t GROUP BY host),
f AS (SELECT t.*, quota, row_number() OVER (PARTITION BY t.host, kind ORDER BY severity_score DESC, log_id) AS kr FROM t JOIN q ON t.host = q.host),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN kr > quota THEN 1 ELSE 0 END, severity_score DESC, log_id) AS rn FROM f)
SELECT host, log_id, kind FROM r WHERE rn <= 75""")
def category_balance(spark, d):
    typed = lines(spark, d).filter(BAD).withColumn("kind", F.when(F.col("c") != "", F.col("c")).otherwise(
        X.anomaly_type(F.col("msg"), F.col("c"), F.col("s"))))
    return A.diverse_by_category(typed, ["host"], "kind", 75).select("host", "log_id", "kind")


@query("p16_g39_chunks", f"""{L}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY severity_score DESC, log_id) AS rn
 FROM lines WHERE {BAD}) t),
k AS (SELECT host, CAST((rn - 1) // 20 AS INTEGER) AS chunk, severity_score, c,
 CAST(contains(lower(msg), 'failed') AS INTEGER) + CAST(contains(lower(msg), 'severity') AS INTEGER) AS hits FROM b)
SELECT host, chunk, round(least(CAST(100 AS DOUBLE), sum(hits) * 10 + count(*) FILTER (WHERE severity_score > 70) * 5 + count(DISTINCT c) * 2
 + max(10 - least(10, chunk)) + avg(severity_score) / 10), 6) AS relevance FROM k GROUP BY 1, 2
 QUALIFY row_number() OVER (PARTITION BY host ORDER BY least(CAST(100 AS DOUBLE), sum(hits) * 10 + count(*) FILTER (WHERE severity_score > 70) * 5 + count(DISTINCT c) * 2
 + max(10 - least(10, chunk)) + avg(severity_score) / 10) DESC, chunk) <= 50""")
def chunk_relevance(spark, d):
    bad = lines(spark, d).filter(BAD)
    return A.chunk_relevance(A.chunks(bad, ["host"]), ["host"], ["failed", "severity"]).select(
        "host", "chunk", r6("relevance"))


@query("p15_anomaly_page", f"""{L}, r AS (SELECT host, log_id, row_number() OVER (PARTITION BY host ORDER BY severity_score DESC, log_id) AS rn
 FROM lines WHERE {BAD}) SELECT host, log_id FROM r WHERE rn > 10 AND rn <= 30""")
def anomaly_page(spark, d):
    capped = top_n(lines(spark, d).filter(BAD), ["host"], A.by_severity(), 30).groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct(-F.col("severity_score"), "log_id"))).alias("a"))
    return capped.select("host", F.explode(F.slice("a", 11, 20)).alias("x")).select("host", F.col("x.log_id").alias("log_id"))


@query("p08_filtered_page", f"""{L}, m AS (SELECT log_id, host, c, severity_score, count(*) OVER () AS total FROM lines WHERE {BAD}
 AND host = 'node-3' AND ts >= TIMESTAMP '2024-01-04' AND ts < TIMESTAMP '2024-01-28' AND c = 'ACCESS' AND severity_score >= 5
 AND regexp_matches(msg, 'error|failed', 'i'))
SELECT log_id, round(severity_score, 6) AS severity_score, total FROM m ORDER BY severity_score DESC, log_id LIMIT 25 OFFSET 5""")
def filtered_page(spark, d):
    from sievelog.sources.readers import scan
    hits = scan(lines(spark, d).filter(BAD), "2024-01-04", "2024-01-28", ["node-3"], c="ACCESS").filter(
        (F.col("severity_score") >= 5) & X.search(F.col("msg"), "error|failed"))
    total = hits.agg(F.count(F.lit(1))).scalar()
    page = hits.select("log_id", r6("severity_score")).orderBy(F.col("severity_score").desc(), "log_id").offset(5).limit(25)
    return page.withColumn("total", total)


@query("k09_lowest_scores", f"""{L} SELECT log_id, {O.ANOMALY_TYPE} AS kind, round(anomaly_score, 6) AS anomaly_score, substr(msg, 1, 150) AS message
FROM lines ORDER BY lines.anomaly_score, log_id LIMIT 20""")
def lowest_scores(spark, d):
    rows = lines(spark, d).orderBy("anomaly_score", "log_id").limit(20)
    return rows.select("log_id", X.anomaly_type(F.col("msg"), F.col("c"), F.col("s")).alias("kind"), r6("anomaly_score"),
                       F.substring("msg", 1, 150).alias("message"))


@query("e32_risk_categories", f"""{L} SELECT CASE WHEN anomaly_score < -0.8 THEN 'critical' WHEN anomaly_score < -0.75 THEN 'high'
 WHEN anomaly_score < -0.7 THEN 'medium' ELSE 'low' END AS risk, count(*) AS n FROM lines GROUP BY 1""")
def risk_categories(spark, d):
    return lines(spark, d).groupBy(V.risk_category(F.col("anomaly_score")).alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query("m20_severity_levels", f"{L} SELECT severity_level, count(*) AS n FROM lines GROUP BY 1")
def severity_levels(spark, d):
    return lines(spark, d).groupBy(V.severity_level(F.col("severity_score")).alias("severity_level")).agg(
        F.count(F.lit(1)).alias("n"))


# ---- statistics of features ----

STAT_FEATURES = ["is_error", "is_collscan", "query_duration_ms", "docs_examined_count", "attr_key_count", "is_tenant_operation"]


@query("g04_feature_statistics", f"{L} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 'binary' AS kind, CAST(sum({c}) AS DOUBLE) AS count, round(avg({c}) * 100, 6) AS percentage, "
    f"CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lines"
    if c in ("is_error", "is_collscan") else
    f"SELECT '{c}', 'continuous', NULL, NULL, round(avg({c}), 6), round(stddev_samp({c}), 6), CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE) FROM lines"
    for c in STAT_FEATURES))
def feature_statistics(spark, d):
    return A.feature_statistics(lines(spark, d), STAT_FEATURES, P.MONGO_BINARY_FEATURES).select(
        "feature", "kind", "count", r6("percentage"), r6("mean"), r6("std"), "min", "max")


@query("g06_zero_variance", f"{L} SELECT feature FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, min({c}) = max({c}) AS k FROM lines" for c in STAT_FEATURES) + ") t WHERE k")
def zero_variance(spark, d):
    return A.zero_variance(lines(spark, d), STAT_FEATURES)


@query("m18_log_outliers", f"""{L}, p AS (SELECT log_id, ln(1 + query_duration_ms) AS v FROM lines WHERE query_duration_ms > 0),
st AS (SELECT avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM p)
SELECT log_id, round((v - m) / sd, 6) AS z FROM p, st WHERE n > 10 AND abs((v - m) / sd) > 2""")
def log_outliers(spark, d):
    pos = lines(spark, d).filter("query_duration_ms > 0").select("log_id", F.log1p("query_duration_ms").alias("v"))
    stats = pos.agg(F.struct(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"), F.count(F.lit(1)).alias("n")).alias("s")).scalar()
    out = pos.withColumn("st", stats).withColumn("z", (F.col("v") - F.col("st.m")) / F.col("st.sd"))
    return out.filter((F.col("st.n") > 10) & (F.abs("z") > 2)).select("log_id", r6("z"))


@query("m19_scaled_scores", f"""{L} SELECT log_id, round((anomaly_score - (SELECT min(anomaly_score) FROM lines))
 / ((SELECT max(anomaly_score) FROM lines) - (SELECT min(anomaly_score) FROM lines)), 6) AS scaled FROM lines""")
def scaled_scores(spark, d):
    base = lines(spark, d).select("log_id", "anomaly_score")
    lo, hi = base.agg(F.min("anomaly_score")).scalar(), base.agg(F.max("anomaly_score")).scalar()
    return base.select("log_id", r6("scaled", (F.col("anomaly_score") - lo) / (hi - lo)))


# ---- hosts ----

@query("g19_mssql_hosts", f"""WITH {O.MSSQL_LINES} SELECT host, count(*) AS total_logs, count(*) FILTER (WHERE is_successful_login = 1) AS succeeded,
 count(*) FILTER (WHERE is_failed_login = 1) AS failed, round(avg(CAST(is_failed_login AS DOUBLE)) * 100, 6) AS failed_ratio,
 max(epoch_us(ts)) AS latest_us FROM lines GROUP BY host""")
def mssql_hosts(spark, d):
    rows = FE.mssql_line_features(FE.mssql_parse(mssql_source(spark, d)))
    return A.hosts_report(rows, F.col("is_failed_login") == 1, F.col("is_successful_login") == 1).select(
        "host", "total_logs", "succeeded", "failed", r6("failed_ratio"), "latest_us")


@query("g20_active_hosts", f"{L} SELECT host, count(*) AS n FROM lines GROUP BY 1 ORDER BY n DESC, host LIMIT 100")
def active_hosts(spark, d):
    return A.active_hosts(views.mongo_logs(spark, d), "mongo|mng")


@query("g21_g42_hours", f"""{L}, h AS (SELECT host, date_trunc('hour', ts) AS hour, count(*) AS n FROM lines GROUP BY 1, 2),
g AS (SELECT host, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM h GROUP BY host)
SELECT g.host, epoch_us(g.hour) AS hour_us, COALESCE(n, 0) AS n FROM g LEFT JOIN h ON g.host = h.host AND g.hour = h.hour""")
def hours(spark, d):
    return A.filled_hours(views.mongo_logs(spark, d), ["host"]).select("host", V.micros(F.col("hour")).alias("hour_us"), "n")


MAPPING_SQL = """SELECT 'NODE-' || CAST(n_nationkey AS VARCHAR(9)) || '.internal' AS member, 'cluster-' || CAST(n_regionkey AS VARCHAR(9)) AS cluster_id,
 r_name AS display_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3"""


def mapping(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("nation")
    table(spark, d, "region").createOrReplaceTempView("region")
    return spark.sql(MAPPING_SQL)


@query("j01_cluster_map", f"""{L}, m AS ({MAPPING_SQL}) SELECT host, COALESCE(cluster_id, 'unmapped') AS cluster_id, display_name, count(*) AS n
FROM lines LEFT JOIN m ON upper(host) = replace(member, '.internal', '') GROUP BY 1, 2, 3""")
def cluster_map(spark, d):
    return A.map_clusters(views.mongo_logs(spark, d).select("host"), mapping(spark, d)).groupBy(
        "host", "cluster_id", "display_name").agg(F.count(F.lit(1)).alias("n"))


@query("j03_j04_cluster_hosts", f"""{L}, m AS (SELECT upper(replace(member, '.internal', '')) AS h, cluster_id FROM ({MAPPING_SQL}) t),
a AS (SELECT DISTINCT upper(host) AS h FROM lines)
SELECT 'active' AS kind, h FROM m WHERE h IN (SELECT h FROM a) UNION ALL
SELECT 'silent', h FROM m WHERE h NOT IN (SELECT h FROM a) UNION ALL SELECT 'unmapped', h FROM a WHERE h NOT IN (SELECT h FROM m)""")
def cluster_hosts(spark, d):
    m = mapping(spark, d).select(X.normalize_host(F.col("member")).alias("h"))
    a = views.mongo_logs(spark, d).select(X.normalize_host(F.col("host")).alias("h")).distinct()
    kind = lambda name, df: df.select(F.lit(name).alias("kind"), "h")
    return (kind("active", m.join(a, "h", "left_semi")).unionByName(kind("silent", m.join(a, "h", "left_anti")))
            .unionByName(kind("unmapped", a.join(m, "h", "left_anti"))))


@query("g27_d06_cluster_rollup", f"""{L}, m AS ({MAPPING_SQL}), x AS (SELECT lines.*, COALESCE(cluster_id, 'unmapped') AS cluster_id FROM lines
 LEFT JOIN m ON upper(host) = replace(member, '.internal', ''))
SELECT cluster_id, host, count(*) AS total_logs, count(*) FILTER (WHERE {BAD}) AS n_anomalies,
 round(avg(CASE WHEN {BAD} THEN CAST(1 AS DOUBLE) ELSE 0 END) * 100, 6) AS anomaly_rate FROM x
GROUP BY GROUPING SETS ((cluster_id, host), (cluster_id))""")
def cluster_rollup(spark, d):
    base = views.log_view(spark, d, f"SELECT *, {SCORES} FROM ({VALUED}) v")
    return A.cluster_rollup(A.map_clusters(base, mapping(spark, d))).select(
        "cluster_id", "host", "total_logs", "n_anomalies", r6("anomaly_rate"))


@query("j05_baseline_merge", f"""WITH {O.MSSQL_LINES}, b AS (SELECT client_ip, count(*) AS old FROM lines WHERE log_id % 2 = 0 GROUP BY 1),
n AS (SELECT client_ip, count(*) AS new FROM lines WHERE log_id % 3 = 0 GROUP BY 1)
SELECT COALESCE(b.client_ip, n.client_ip) AS client_ip, COALESCE(old, 0) + COALESCE(new, 0) AS count
FROM b FULL JOIN n ON b.client_ip = n.client_ip""")
def baseline_merge(spark, d):
    rows = FE.mssql_parse(mssql_source(spark, d))
    part = lambda k: rows.filter(F.col("log_id") % k == 0).groupBy("client_ip").agg(F.count(F.lit(1)).alias("count"))
    return FE.merged_baseline(part(3), part(2), ["client_ip"])


@query("j10_g01_value_counts", """WITH n AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_suppkey,
 count(*) OVER (PARTITION BY l_returnflag) AS flag_count, count(*) OVER (PARTITION BY l_suppkey) AS supp_count FROM lineitem)
SELECT l_returnflag, flag_count, CAST(sum(supp_count) AS BIGINT) AS supp_sum, count(*) FILTER (WHERE supp_count < 600) AS rare FROM n GROUP BY 1, 2""")
def value_counts(spark, d):
    from sievelog.operators.lookup import with_count
    li = table(spark, d, "lineitem").select("l_returnflag", "l_suppkey")
    both = with_count(with_count(li, ["l_returnflag"], "flag_count"), ["l_suppkey"], "supp_count")
    return both.groupBy("l_returnflag", "flag_count").agg(
        F.sum("supp_count").alias("supp_sum"), F.count_if(F.col("supp_count") < 600).alias("rare"))


@query("j11_nested_lookup", """SELECT c_custkey, count(o_orderkey) AS n_orders, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS order_keys
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def nested_lookup(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    nested = o.groupBy("c_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))
    out = table(spark, d, "customer").select("c_custkey").join(nested, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce(F.size("orders"), F.lit(0)).cast("bigint").alias("n_orders"),
                      F.when(F.col("orders").isNotNull(), F.concat_ws(",", "orders")).alias("order_keys"))


@query("g38_grouping", """SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1, 2""")
def grouping(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"),
        F.round(F.sum("o_totalprice"), 2).alias("total"))


# ---- sets ----

@query("d03_d04_duplicates", f"""{L}, s AS (SELECT DISTINCT host, epoch_us(ts) // 1800000000 AS slice, msg FROM lines)
SELECT host, count(*) AS distinct_messages FROM s GROUP BY host""")
def duplicates(spark, d):
    logs = views.mongo_logs(spark, d).withColumn("slice", V.time_slice(F.col("ts"), 30))
    return logs.dropDuplicates(["slice", "host", "msg"]).groupBy("host").agg(F.count(F.lit(1)).alias("distinct_messages"))


@query("d02_aligned_union", f"""{L} SELECT log_id, CAST(is_error AS DOUBLE) AS is_error, CASE WHEN log_id % 2 = 0 THEN CAST(query_duration_ms AS DOUBLE)
 ELSE CAST(0 AS DOUBLE) END AS query_duration_ms FROM lines""")
def aligned_union(spark, d):
    base = FE.feature_matrix(lines(spark, d), ["is_error", "query_duration_ms"], ["log_id"])
    old, new = base.filter("log_id % 2 = 0"), base.filter("log_id % 2 = 1").drop("query_duration_ms")
    return old.unionByName(new, allowMissingColumns=True).fillna(0.0, ["is_error", "query_duration_ms"])


@query("d05_fifo_buffer", f"""{L}, r AS (SELECT host, log_id, row_number() OVER (PARTITION BY host ORDER BY ts DESC, log_id DESC) AS rn FROM lines)
SELECT host, log_id FROM r WHERE rn <= 300""")
def fifo_buffer(spark, d):
    return newest(views.mongo_logs(spark, d), ["host"], "ts", "log_id", 300, 3_600_000_000).select("host", "log_id")


@query("d09_d10_merged_lists", """WITH a AS (SELECT event_id, ts, 'main' AS origin FROM events WHERE event_id % 3 <> 0),
b AS (SELECT CASE WHEN event_id % 5 = 0 THEN -event_id ELSE event_id END AS event_id, ts, 'file' AS origin FROM events WHERE event_id % 2 = 0)
SELECT event_id, origin FROM a UNION ALL SELECT event_id, origin FROM b WHERE event_id NOT IN (SELECT event_id FROM a) AND ts NOT IN (SELECT ts FROM a)""")
def merged_lists(spark, d):
    e = table(spark, d, "events")
    main = e.filter("event_id % 3 <> 0").select("event_id", "ts", F.lit("main").alias("origin"))
    other = e.filter("event_id % 2 = 0").select(
        F.when(F.col("event_id") % 5 == 0, -F.col("event_id")).otherwise(F.col("event_id")).alias("event_id"), "ts",
        F.lit("file").alias("origin"))
    fresh = other.join(main.select("event_id"), "event_id", "left_anti").join(main.select("ts"), "ts", "left_anti")
    return main.unionByName(fresh).select("event_id", "origin")


# ---- relational and search-engine reports ----

@query("g15_g17_logins", f"""WITH {O.MSSQL_LINES} SELECT host, CAST(sum(is_login_event) AS BIGINT) AS logins, CAST(sum(is_failed_login) AS BIGINT) AS failed,
 round(CAST(sum(is_failed_login) AS DOUBLE) / sum(is_login_event), 6) AS failed_ratio,
 CAST(sum(is_failed_login) * 5 > sum(is_login_event) AS INTEGER) AS is_concern, count(DISTINCT username) AS users,
 count(DISTINCT client_ip) AS clients, CAST(sum(is_local_client) AS BIGINT) AS local_connections FROM lines GROUP BY host""")
def logins(spark, d):
    rows = FE.mssql_line_features(FE.mssql_parse(mssql_source(spark, d)))
    ratio = F.sum("is_failed_login") / F.sum("is_login_event")
    return rows.groupBy("host").agg(
        F.sum("is_login_event").alias("logins"), F.sum("is_failed_login").alias("failed"), F.round(ratio, 6).alias("failed_ratio"),
        (ratio > 0.2).cast("int").alias("is_concern"), F.count_distinct("username").alias("users"),
        F.count_distinct("client_ip").alias("clients"), F.sum("is_local_client").alias("local_connections"))


@query("g16_failed_users", f"""WITH {O.MSSQL_LINES}, u AS (SELECT host, username, CAST(sum(is_failed_login) AS BIGINT) AS failed FROM lines GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY failed DESC, username) AS rn FROM u) SELECT host, username, failed FROM r WHERE rn <= 5""")
def failed_users(spark, d):
    rows = FE.mssql_line_features(FE.mssql_parse(mssql_source(spark, d)))
    users = rows.groupBy("host", "username").agg(F.sum("is_failed_login").alias("failed"))
    return top_n(users, ["host"], [F.col("failed").desc(), F.col("username")], 5)


@query("g18_error_log", f"""WITH {O.MSSQL_LINES}, e AS (SELECT error_number, count(*) AS n FROM lines WHERE error_number > 0 GROUP BY 1)
SELECT 'logtype' AS kind, logtype AS key, count(*) AS n FROM lines GROUP BY logtype UNION ALL
SELECT 'error', CAST(error_number AS VARCHAR), n FROM (SELECT * FROM e ORDER BY n DESC, error_number LIMIT 10) t UNION ALL
SELECT 'host_errors', host, count(*) FROM lines WHERE is_system_error = 1 GROUP BY host UNION ALL
SELECT 'night_logins', '', count(*) FROM lines WHERE is_night_login = 1 AND is_login_event = 1 AND is_service_account = 0 UNION ALL
SELECT 'high_severity', '', count(*) FROM lines WHERE is_high_severity_error = 1 UNION ALL
SELECT 'grok_failures', '', count(*) FROM lines WHERE is_grok_failure = 1""")
def error_log(spark, d):
    rows = FE.mssql_line_features(FE.mssql_parse(mssql_source(spark, d)))
    facts = F.array_compact(F.array(
        F.struct(F.lit("logtype").alias("kind"), F.col("logtype").alias("key")),
        F.when(F.col("error_number") > 0, F.struct(F.lit("error").alias("kind"), F.col("error_number").cast("string").alias("key"))),
        F.when(F.col("is_system_error") == 1, F.struct(F.lit("host_errors").alias("kind"), F.col("host").alias("key"))),
        *[F.when(F.expr(c), F.struct(F.lit(n).alias("kind"), F.lit("").alias("key"))) for n, c in {
            "night_logins": "is_night_login = 1 and is_login_event = 1 and is_service_account = 0",
            "high_severity": "is_high_severity_error = 1", "grok_failures": "is_grok_failure = 1"}.items()]))
    counts = rows.select(F.explode(facts).alias("f")).groupBy("f.kind", "f.key").agg(F.count(F.lit(1)).alias("n"))
    top = counts.filter("kind = 'error'").orderBy(F.col("n").desc(), F.col("key").cast("bigint")).limit(10)
    return counts.filter("kind <> 'error'").unionByName(top)


@query("g14_es_report", f"""WITH {O.ES_LINES}, b AS (SELECT *, is_error = 1 AS bad FROM lines),
k AS (SELECT logger_name, count(*) AS n FROM b GROUP BY 1)
SELECT 'role' AS kind, host_role AS key, count(*) AS n, count(*) FILTER (WHERE bad) AS anomalous FROM b GROUP BY host_role UNION ALL
SELECT 'level', log_level, count(*), count(*) FILTER (WHERE bad) FROM b GROUP BY log_level UNION ALL
{' UNION ALL '.join(f"SELECT 'pattern', '{c}', count(*), count(*) FILTER (WHERE bad) FROM b WHERE {c} = 1 HAVING count(*) > 0" for c in P.ES_FLAGS)}""")
def es_report(spark, d):
    rows = FE.es_line_features(FE.es_parse(views.es_logs(spark, d)))
    facts = F.array_compact(F.array(
        F.struct(F.lit("role").alias("kind"), F.col("host_role").alias("key")),
        F.struct(F.lit("level").alias("kind"), F.col("log_level").alias("key")),
        *[F.when(F.col(c) == 1, F.struct(F.lit("pattern").alias("kind"), F.lit(c).alias("key"))) for c in P.ES_FLAGS]))
    return rows.select("is_error", F.explode(facts).alias("f")).groupBy("f.kind", "f.key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_error") == 1).alias("anomalous"))


@query("g05_feature_summary", f"""WITH {O.MSSQL_LINES} SELECT count(*) AS total_logs, CAST(sum(is_failed_login) AS BIGINT) AS failed_logins,
 CAST(sum(is_successful_login) AS BIGINT) AS successful_logins, round(avg(CAST(is_failed_login AS DOUBLE)), 6) AS failed_ratio,
 count(DISTINCT client_ip) AS unique_ips, count(DISTINCT username) AS unique_users, CAST(sum(is_service_account) AS BIGINT) AS service_accounts,
 CAST(sum(is_domain_user) AS BIGINT) AS domain_users FROM lines""")
def feature_summary(spark, d):
    rows = FE.mssql_line_features(FE.mssql_parse(mssql_source(spark, d)))
    return rows.agg(
        F.count(F.lit(1)).alias("total_logs"), F.sum("is_failed_login").alias("failed_logins"),
        F.sum("is_successful_login").alias("successful_logins"), F.round(F.avg("is_failed_login"), 6).alias("failed_ratio"),
        F.count_distinct("client_ip").alias("unique_ips"), F.count_distinct("username").alias("unique_users"),
        F.sum("is_service_account").alias("service_accounts"), F.sum("is_domain_user").alias("domain_users"))

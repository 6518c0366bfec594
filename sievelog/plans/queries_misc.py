"""Field profiles, query performance, fleet metrics, maps, ad-hoc shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelog.operators import features as FE, profile as PR
from sievelog.operators.sequence import top_n, with_previous
from sievelog.plans.queries_analysis import LINES_SQL, lines, r6
from sievelog.plans.queries_detect import mssql_source
from sievelog.plans.queries_history import HISTORY_SQL, W, history, us
from sievelog.plans import oracle as O
from sievelog.plans.queries_parse import LOGS
from sievelog.plans.registry import query
from sievelog.sources import views
from sievelog.sources.views import table

_TYPE = "CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"
FIELDS_SQL = f"""{LOGS}, f AS (SELECT replace(t.fullkey, '$.', '') AS path, {_TYPE} AS type, t.atom FROM logs, json_tree(logs.attr) t WHERE t.key IS NOT NULL),
p AS (SELECT path, count(*) AS n, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM f GROUP BY 1)"""


@query("a12_a13_field_profile", f"""{FIELDS_SQL} SELECT path, n AS count, round(CAST(n AS DOUBLE) / (SELECT count(*) FROM logs), 6) AS fill_rate, types,
 CAST(n * 2 < (SELECT count(*) FROM logs) AS INTEGER) AS is_sparse FROM p""")
def field_profile(spark, d):
    out = PR.field_profile(views.mongo_logs(spark, d), "attr")
    return out.select("path", "count", r6("fill_rate"), F.concat_ws(",", "types").alias("types"), F.col("is_sparse").cast("int").alias("is_sparse"))


@query("a12_event_props_profile", """WITH f AS (SELECT replace(t.fullkey, '$.', '') AS path, count(*) AS n, count(DISTINCT t.atom) AS distinct_values
 FROM events, json_tree(events.props) t WHERE t.key IS NOT NULL GROUP BY 1) SELECT path, n AS count, round(CAST(n AS DOUBLE) / (SELECT count(*) FROM events), 6) AS fill_rate FROM f""")
def event_props_profile(spark, d):
    return PR.field_profile(table(spark, d, "events"), "props").select("path", "count", r6("fill_rate"))


#: A question that holds words of field names and, in its last word, an example value of a field that it doesn't name.
ASKED = "plan code micros shop.items"


@query("a14_found_fields", f"""{FIELDS_SQL}, e AS (SELECT path, value, row_number() OVER (PARTITION BY path ORDER BY n DESC, value) AS k
 FROM (SELECT path, atom ->> '$' AS value, count(*) AS n FROM f WHERE type NOT IN ('object', 'array', 'null') GROUP BY ALL))
SELECT path, n AS count FROM p WHERE {" OR ".join(f"contains(lower(path), '{w}')" for w in ASKED.split())}
 OR path IN (SELECT path FROM e WHERE k <= 3 AND value <> '' AND contains('{ASKED}', lower(value)))""")
def found_fields(spark, d):
    return PR.find_fields(PR.field_profile(views.mongo_logs(spark, d), "attr"), ASKED).select("path", "count")


_Q = f"""WITH {LINES_SQL}, q AS (SELECT log_id, raw_duration_ms AS ms, raw_docs_examined AS docs, raw_keys_examined AS keys, log_id % 2000 AS ret FROM lines WHERE raw_docs_examined > 0),
e AS (SELECT *, round(CASE WHEN keys > 0 THEN least(CAST(100 AS DOUBLE), CASE WHEN ret > 0 THEN CAST(ret AS DOUBLE) / docs * 100 ELSE 0 END + least(CAST(20 AS DOUBLE), CAST(keys AS DOUBLE) / docs * 20))
 ELSE CASE WHEN ret > 0 THEN CAST(ret AS DOUBLE) / docs * 100 ELSE 0 END * CAST(0.7 AS DOUBLE) END, 2) AS eff FROM q),
sc AS (SELECT *, CASE WHEN ms > 1000 THEN 0 WHEN ms > 500 THEN 10 WHEN ms > 100 THEN 20 ELSE 30 END + CASE WHEN docs > 0 AND keys = 0 THEN 0 WHEN keys > docs * 2 THEN 15 ELSE 25 END
 + CASE WHEN ret > 10000 THEN 5 WHEN ret > 1000 THEN 10 ELSE 15 END + CAST(round_even(least(CAST(30 AS DOUBLE), eff * CAST(0.3 AS DOUBLE)), 0) AS INTEGER) AS score FROM e)"""


@query("m15_m17_query_performance", f"""{_Q} SELECT CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair' WHEN score >= 30 THEN 'low' ELSE 'critical' END AS level,
 CASE WHEN keys = 0 THEN 95 WHEN ms > 100 THEN 30 ELSE 0 END AS saved_pct, count(*) AS n, CAST(sum(score) AS BIGINT) AS score_sum, round(sum(eff), 2) AS efficiency_sum FROM sc GROUP BY 1, 2""")
def query_performance(spark, d):
    q = lines(spark, d).filter("raw_docs_examined > 0").select(
        F.col("raw_duration_ms").alias("ms"), F.col("raw_docs_examined").alias("docs"), F.col("raw_keys_examined").alias("keys"), (F.col("log_id") % 2000).alias("ret"))
    q = q.withColumn("eff", PR.efficiency(F.col("ret"), F.col("docs"), F.col("keys")))
    q = q.withColumn("score", PR.performance_score(F.col("ms"), F.col("eff"), F.col("docs"), F.col("keys"), F.col("ret")))
    return q.groupBy(PR.performance_level(F.col("score")).alias("level"), PR.estimated_improvement(F.col("keys") == 0, F.col("ms")).alias("saved_pct")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("score_sum"), F.round(F.sum("eff"), 2).alias("efficiency_sum"))


@query("g37_fleet_metrics", """SELECT user_id % 8 AS server, count(*) FILTER (WHERE event_type <> 'error') AS online, count(*) FILTER (WHERE event_type = 'error') AS offline,
 round(avg(value), 6) AS avg_cpu, max(value) AS max_cpu, min(value) AS min_cpu FROM events GROUP BY 1""")
def fleet_metrics(spark, d):
    e = table(spark, d, "events").withColumn("server", F.col("user_id") % 8)
    return PR.fleet_summary(e, ["server"], "value", F.col("event_type") != "error").select("server", "online", "offline", r6("avg_cpu"), "max_cpu", "min_cpu")


@query("g37_top_processes", """SELECT server, event_id, value FROM (SELECT user_id % 8 AS server, event_id, value, row_number() OVER (PARTITION BY user_id % 8 ORDER BY value DESC, event_id) AS rn FROM events) t WHERE rn <= 5""")
def top_processes(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 8).alias("server"), "event_id", "value")
    return top_n(e, ["server"], [F.col("value").desc(), F.col("event_id")], 5)


@query("g40_context_relevance", f"""{W}, k AS (SELECT host, ts, n_anomalies, (SELECT max(ts) FROM history) AS ref FROM history),
s AS (SELECT host, ts, CASE WHEN host = 'node-3' THEN 50 ELSE CAST(contains(host, 'node') AS INTEGER) * 20 END
 + CASE WHEN epoch_us(ref) - epoch_us(ts) < 86400000000 THEN 10 * (1 - CAST(epoch_us(ref) - epoch_us(ts) AS DOUBLE) / 86400000000) ELSE 0 END + CASE WHEN n_anomalies > 0 THEN 10 ELSE 0 END AS relevance FROM k)
SELECT host, epoch_us(ts) AS ts_us, round(relevance, 6) AS relevance FROM s WHERE relevance > 0 ORDER BY s.relevance DESC, host, ts LIMIT 3""")
def context_relevance(spark, d):
    h = history(spark, d)
    return PR.context_relevance(h, h.agg(F.max("ts")).scalar(), "node-3", ["node"], 2).select("host", us(), r6("relevance"))


@query("a04_a07_maps", f"""WITH {LINES_SQL}, c AS (SELECT host, c, count(*) FILTER (WHERE prediction = -1) AS n FROM lines GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, c) AS rn FROM c WHERE n > 0)
SELECT host, CAST(sum(n) AS BIGINT) AS total, string_agg(c || '=' || CAST(n AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS top FROM r GROUP BY host""")
def maps(spark, d):
    rows = lines(spark, d).filter("prediction = -1").groupBy("host", "c").agg(F.count(F.lit(1)).alias("n"))
    m = rows.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("m"))
    ranked = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("c"))))
    top = F.transform(F.slice(ranked, 1, 3), lambda e: F.concat_ws("=", e["c"], -e["n"]))
    return m.select("host", F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.concat_ws(",", top).alias("top"))


@query("a05_severity_shares", f"""{W} SELECT host, epoch_us(ts) AS ts_us, round(CASE WHEN n_anomalies > 0 THEN CAST(sev_critical + sev_high AS DOUBLE) / n_anomalies * 100 END, 6) AS severe_pct FROM history""")
def severity_shares(spark, d):
    levels = ("critical", "high", "medium", "low", "info")
    m = F.create_map(*[x for lv in levels for x in (F.lit(lv.upper()), F.col(f"sev_{lv}"))])
    h = history(spark, d).withColumn("m", m)
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    severe = F.coalesce(F.col("m")["CRITICAL"], F.lit(0)) + F.coalesce(F.col("m")["HIGH"], F.lit(0))
    return h.select("host", us(), r6("severe_pct", F.when(total > 0, severe / total * 100)))


@query("a10_a11_unwind_project", """SELECT vec_id, CAST(idx AS INTEGER) AS position, round(CAST(x AS DOUBLE), 5) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS idx FROM embeddings) t WHERE x > 0.1""")
def unwind_project(spark, d):
    e = table(spark, d, "embeddings").drop("label")
    return e.select("vec_id", F.posexplode("embedding").alias("position", "x")).filter("x > 0.1").withColumn("x", F.round(F.col("x").cast("double"), 5))


@query("w02_login_gaps", f"""WITH {O.MSSQL_LINES}, w AS (SELECT host, log_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY host ORDER BY ts, log_id)) AS gap_us FROM lines WHERE is_login_event = 1)
SELECT host, log_id, round(COALESCE(CAST(gap_us AS DOUBLE) / 1000000, 0), 6) AS gap FROM w""")
def login_gaps(spark, d):
    rows = FE.mssql_line_features(FE.mssql_parse(mssql_source(spark, d)))
    out = with_previous(rows.select("host", "log_id", "ts", "is_login_event"), ["host"], "ts", "log_id", [],
                        {"prev_ts": F.when(F.col("is_login_event") == 1, F.col("ts"))})
    return out.filter("is_login_event = 1").select("host", "log_id", r6("gap", FE.gap_seconds()))


@query("w06_row_frame_ratio", f"""WITH {O.MSSQL_LINES} SELECT host, log_id, round(avg(CAST(is_failed_login AS DOUBLE)) OVER w, 6) AS ratio, count(*) OVER w AS n FROM lines
WINDOW w AS (PARTITION BY host ORDER BY ts, log_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)""")
def row_frame_ratio(spark, d):
    rows = FE.mssql_line_features(FE.mssql_parse(mssql_source(spark, d))).select("host", "log_id", "ts", "is_failed_login")
    out = FE.failed_login_rows(with_previous(rows, ["host"], "ts", "log_id", []), ["host"])
    return out.select("host", "log_id", r6("ratio", F.col("failed_login_ratio_1h")), F.col("login_count_1h").alias("n"))


@query("w05_trailing_hour", """WITH r AS (SELECT o_custkey % 3 AS k, epoch_us(o_orderdate) AS us, o_totalprice AS v FROM orders)
SELECT k, us, count(*) OVER w AS n, round(sum(v) OVER w, 2) AS total FROM r WINDOW w AS (PARTITION BY k ORDER BY us RANGE BETWEEN 863999999999 PRECEDING AND CURRENT ROW)""")
def trailing_span(spark, d):
    """Ten-day trailing totals over orders: three huge keys, a span far wider than a chunk."""
    from sievelog.functions.values import micros
    from sievelog.operators.sequence import trailing_sums
    o = table(spark, d, "orders").select((F.col("o_custkey") % 3).alias("k"), "o_orderdate", "o_totalprice")
    spans = trailing_sums(o, ["k"], "o_orderdate", {"n": F.lit(1).cast("bigint"), "total": F.col("o_totalprice")}, 864_000_000_000, 86_400_000_000)
    return o.withColumn("_us", micros(F.col("o_orderdate"))).join(spans, ["k", "_us"]).select("k", F.col("_us").alias("us"), "n", F.round("total", 2).alias("total"))

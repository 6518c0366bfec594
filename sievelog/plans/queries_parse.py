"""Parsing, scans, time and number expressions over the log views and text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelog.functions import patterns as P, text as X, values as V
from sievelog.operators import features as FE
from sievelog.plans import oracle as O
from sievelog.plans.queries_detect import mssql_source
from sievelog.plans.registry import query
from sievelog.sources import readers as RD, views
from sievelog.sources.views import ES_LOGS, MONGO_LOGS, MSSQL_LOGS, table

LOGS = f"WITH logs AS ({MONGO_LOGS})"
MS = f"WITH {O.MSSQL_LINES}"
ES = f"WITH {O.ES_LINES}"


@query("x01_fingerprint_mongodb", f"""{LOGS} SELECT {O.FP_MONGO} AS fingerprint, count(*) AS n FROM logs GROUP BY 1""")
def fingerprint_mongodb(spark, d):
    return views.mongo_logs(spark, d).groupBy(X.fingerprint_mongodb(F.col("msg")).alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("n"))


@query("x02_fingerprint_mssql", f"""WITH logs AS ({MSSQL_LOGS}) SELECT {O.FP_MSSQL} AS fingerprint, count(*) AS n
FROM logs GROUP BY 1""")
def fingerprint_mssql(spark, d):
    return views.mssql_logs(spark, d).groupBy(X.fingerprint_mssql(F.col("message")).alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("n"))


@query("x03_fingerprint_es", f"""WITH logs AS ({ES_LOGS}) SELECT {O.FP_ES} AS fingerprint, count(*) AS n
FROM logs GROUP BY 1""")
def fingerprint_es(spark, d):
    return views.es_logs(spark, d).groupBy(X.fingerprint_es(F.col("message")).alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("n"))


@query("x01_fingerprint_documents", f"""SELECT count(DISTINCT fp) AS distinct_fingerprints, count(*) AS docs,
 CAST(sum(length(fp)) AS BIGINT) AS chars FROM (SELECT
 trim(regexp_replace(regexp_replace(regexp_replace(text, '[0-9a-fA-F]{{24}}', '<ID>', 'g'), '[0-9]+', '<NUM>', 'g'),
 '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS fp FROM documents)""")
def fingerprint_documents(spark, d):
    fp = X.fingerprint_mongodb(F.col("text"))
    return views.spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select(fp.alias("fp")).agg(
        F.count_distinct("fp").alias("distinct_fingerprints"), F.count(F.lit(1)).alias("docs"),
        F.sum(F.length("fp")).alias("chars"))


@query("x04_human_messages", f"""{LOGS}, j AS (SELECT log_id, msg, json_extract_string(attr, '$.error.errmsg') AS e,
 json_extract_string(attr, '$.ns') AS ns, json_extract_string(attr, '$.durationMillis') AS ms,
 json_extract_string(attr, '$.planSummary') AS plan,
 TRY_CAST(json_extract_string(attr, '$.docsExamined') AS BIGINT) AS docs FROM logs)
SELECT log_id, CASE WHEN e IS NOT NULL THEN e
 WHEN starts_with(msg, 'Slow query') THEN 'Slow query on ''' || COALESCE(ns, 'unknown') || ''' took ' || COALESCE(ms, '0') || 'ms'
  || CASE WHEN plan = 'COLLSCAN' THEN ' - FULL TABLE SCAN detected (needs index)' WHEN plan = 'IXSCAN' THEN ' - using index'
   WHEN plan IS NOT NULL THEN ' - plan: ' || plan ELSE '' END
  || CASE WHEN docs > 0 THEN ' (scanned ' || format('{{:,}}', docs) || ' docs)' ELSE '' END
 WHEN starts_with(msg, 'CMD: ') AND contains(msg, 'dropIndexes') THEN 'Index dropped: unknown on collection ''unknown'''
 ELSE msg END AS message FROM j""")
def human_messages(spark, d):
    return views.mongo_logs(spark, d).select("log_id", RD.human_message(F.col("msg"), F.col("attr")).alias("message"))


@query("x07_error_text", f"""{LOGS} SELECT log_id, 'Error ' || json_extract_string(attr, '$.error.code') || ' ('
 || json_extract_string(attr, '$.error.codeName') || '): ' || json_extract_string(attr, '$.error.errmsg') AS error_text
FROM logs WHERE s = 'E'""")
def error_text(spark, d):
    return views.mongo_logs(spark, d).filter("s = 'E'").select("log_id", RD.error_text(F.col("attr")).alias("error_text"))


@query("x08_lifted_attributes", f"""{LOGS} SELECT json_extract_string(attr, '$.ns') AS namespace, count(*) AS n,
 CAST(sum(TRY_CAST(json_extract_string(attr, '$.durationMillis') AS BIGINT)) AS BIGINT) AS total_ms
FROM logs WHERE json_extract_string(attr, '$.ns') IS NOT NULL GROUP BY 1""")
def lifted_attributes(spark, d):
    v = F.try_parse_json("attr")
    rows = views.mongo_logs(spark, d).withColumn("v", v).select(
        F.try_variant_get("v", "$.ns", "string").alias("namespace"),
        F.try_variant_get("v", "$.durationMillis", "bigint").alias("ms"))
    return rows.filter("namespace is not null").groupBy("namespace").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total_ms"))


@query("x09_message_pairs", f"""SELECT event_id, 'v' || CAST(user_id AS VARCHAR(9)) AS last_user, event_type AS kind, 2 AS n_keys
FROM events""")
def message_pairs(spark, d):
    text = F.format_string('text user="x" kind="%s" then user="v%d" end', "event_type", "user_id")
    return table(spark, d, "events").withColumn("m", X.message_pairs(text)).select(
        "event_id", F.col("m")["user"].alias("last_user"), F.col("m")["kind"].alias("kind"), F.size("m").alias("n_keys"))


MS_COLS = ("log_id, client_ip, auth_type, username, logintype, failure_reason, database_name, error_number, "
           "error_severity, error_state, spid, local_time_text, logtype, log_level")


@query("x10_mssql_fields", f"{MS} SELECT {MS_COLS} FROM lines")
def mssql_fields(spark, d):
    return FE.mssql_parse(mssql_source(spark, d)).select(*MS_COLS.split(", "))


@query("s12_mssql_scan", f"""{MS} SELECT host, logtype, count(*) AS n, min(epoch_us(ts)) AS first_us FROM lines
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND host IN ('SQL1.internal', 'SQL2.internal')
 AND logintype = 'failed' GROUP BY 1, 2""")
def mssql_scan(spark, d):
    rows = RD.scan(mssql_source(spark, d), "2024-01-05", "2024-01-20", ["SQL1.internal", "SQL2.internal"],
                   logintype="failed")
    return FE.mssql_parse(rows).groupBy("host", "logtype").agg(
        F.count(F.lit(1)).alias("n"), F.min(V.micros(F.col("ts"))).alias("first_us"))


@query("s13_mssql_flags", f"""{MS} SELECT logtype, count(*) AS n, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in (
    'is_grok_failure', 'is_failed_login', 'is_successful_login', 'is_windows_auth', 'is_sql_auth', 'is_local_client',
    'is_service_account', 'is_domain_user', 'is_night_login', *P.MSSQL_FLAGS, 'is_high_severity_error',
    'is_system_error'))} FROM lines GROUP BY 1""")
def mssql_flags(spark, d):
    names = ("is_grok_failure", "is_failed_login", "is_successful_login", "is_windows_auth", "is_sql_auth",
             "is_local_client", "is_service_account", "is_domain_user", "is_night_login", *P.MSSQL_FLAGS,
             "is_high_severity_error", "is_system_error")
    return FE.mssql_line_features(FE.mssql_parse(mssql_source(spark, d))).groupBy("logtype").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names])


ES_COLS = ("log_id, parsed_timestamp, log_level, logger_name, node_name, message_text, event_code, logger_category, "
           "host_role, message_fingerprint")


@query("s15_es_fields", f"{ES} SELECT {ES_COLS} FROM lines")
def es_fields(spark, d):
    return FE.es_parse(views.es_logs(spark, d)).select(*ES_COLS.split(", "))


@query("s14_es_scan", f"""{ES} SELECT host, log_level, count(*) AS n FROM lines WHERE log_level IN ('ERROR', 'WARN')
 AND host IN ('esdt00', 'esms01') AND ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2""")
def es_scan(spark, d):
    rows = RD.scan(views.es_logs(spark, d), start="2024-01-10", hosts=["esdt00", "esms01"])
    return RD.scan(FE.es_parse(rows), log_level=["ERROR", "WARN"]).groupBy("host", "log_level").agg(
        F.count(F.lit(1)).alias("n"))


@query("x24_es_flags", f"""{ES} SELECT host_role, logger_category, {', '.join(
    f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('is_warn', 'is_error', *P.ES_FLAGS))} FROM lines GROUP BY 1, 2""")
def es_flags(spark, d):
    return FE.es_line_features(FE.es_parse(views.es_logs(spark, d))).groupBy("host_role", "logger_category").agg(
        *[F.sum(c).alias(c) for c in ("is_warn", "is_error", *P.ES_FLAGS)])


@query("f01_f10_message_flags", f"""WITH {O.MONGO_LINES} SELECT host, c, count(*) AS n, {', '.join(
    f'CAST(sum({n}) AS BIGINT) AS {n}' for n in (*P.MONGO_FLAGS, 'is_auth_success', 'is_reauthenticate', 'severity_W'))}
FROM lines GROUP BY 1, 2""")
def message_flags(spark, d):
    names = (*P.MONGO_FLAGS, "is_auth_success", "is_reauthenticate", "severity_W")
    return FE.message_flags(views.mongo_logs(spark, d)).groupBy("host", "c").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names])


@query("f01_flags_over_documents", "SELECT lang, " + ", ".join(
    f"CAST(sum({O.flag(O.hit('text', p, n in P.CASE_SENSITIVE))}) AS BIGINT) AS {n}" for n, p in P.MONGO_FLAGS.items()
    if n not in ("is_auth_failure", "is_fatal", "is_error")) + " FROM documents GROUP BY lang")
def flags_over_documents(spark, d):
    docs = views.spread(table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id").select(
        "lang", "text", F.lower("text").alias("low"))
    names = [n for n in P.MONGO_FLAGS if n not in ("is_auth_failure", "is_fatal", "is_error")]
    return docs.select("lang", *[
        X.flag(X.search(F.col("text"), P.MONGO_FLAGS[n], n in P.CASE_SENSITIVE, F.col("low"))).alias(n)
        for n in names]).groupBy("lang").agg(*[F.sum(n).alias(n) for n in names])


@query("f11_f12_component_flags", f"""WITH {O.MONGO_LINES} SELECT c, count(*) AS n, {', '.join(
    f'CAST(sum({n}) AS BIGINT) AS {n}' for n in (*P.COMPONENT_FLAGS, 'is_unknown_component', 'component_criticality_score'))}
FROM lines GROUP BY 1""")
def component_flags(spark, d):
    names = (*P.COMPONENT_FLAGS, "is_unknown_component", "component_criticality_score")
    return FE.component_flags(views.mongo_logs(spark, d)).groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names])


M_COLS = ("raw_duration_ms", "raw_docs_examined", "raw_keys_examined", "query_duration_ms", "docs_examined_count",
          "keys_examined_count", "txn_time_active_micros", "txn_time_inactive_micros", "is_long_transaction",
          "performance_score")


@query("m01_m05_numbers", f"""WITH {O.MONGO_LINES} SELECT log_id, {', '.join(M_COLS)}, round(txn_wait_ratio, 6) AS txn_wait_ratio
FROM lines""")
def numbers(spark, d):
    logs = FE.message_flags(views.mongo_logs(spark, d))
    return FE.numeric_features(logs).select("log_id", *M_COLS, F.round("txn_wait_ratio", 6).alias("txn_wait_ratio"))


@query("a01_a02_attr_keys", f"""WITH {O.MONGO_LINES} SELECT has_error_key, attr_key_count, has_many_attrs, count(*) AS n
FROM lines GROUP BY 1, 2, 3""")
def attr_keys(spark, d):
    return FE.attr_features(views.mongo_logs(spark, d)).groupBy("has_error_key", "attr_key_count", "has_many_attrs").agg(
        F.count(F.lit(1)).alias("n"))


@query("x26_anomaly_types", f"{LOGS} SELECT {O.ANOMALY_TYPE} AS anomaly_type, count(*) AS n FROM logs GROUP BY 1")
def anomaly_types(spark, d):
    kind = X.anomaly_type(F.col("msg"), F.col("c"), F.col("s"))
    return views.mongo_logs(spark, d).groupBy(kind.alias("anomaly_type")).agg(F.count(F.lit(1)).alias("n"))


@query("x28_mssql_categories", f"""{MS} SELECT {O.case([(O.word_rule(r, 'message'), O.quoted(n)) for n, r in P.MSSQL_CATEGORIES],
 "CASE WHEN error_severity >= 17 THEN 'high_severity_error' ELSE lower(logtype) END")} AS category, count(*) AS n
FROM lines GROUP BY 1""")
def mssql_categories(spark, d):
    kind = X.mssql_category(F.col("message"), F.col("logtype"), F.col("error_severity"))
    return FE.mssql_parse(mssql_source(spark, d)).groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("x29_critical_messages", f"""SELECT 'mongodb' AS source, count(*) AS n FROM ({MONGO_LOGS}) l
 WHERE {O.word_rule(P.CRITICAL_MESSAGES['mongodb'], 'msg')}
UNION ALL SELECT 'mssql', count(*) FROM ({MSSQL_LOGS}) l WHERE {O.word_rule(P.CRITICAL_MESSAGES['mssql'], 'message')}
UNION ALL SELECT 'elasticsearch', count(*) FROM ({ES_LOGS}) l
 WHERE {O.word_rule(P.CRITICAL_MESSAGES['elasticsearch'], 'message')}""")
def critical_messages(spark, d):
    parts = [(views.mongo_logs(spark, d).select(F.lit("mongodb").alias("source"), F.col("msg").alias("m"))),
             (views.mssql_logs(spark, d).select(F.lit("mssql").alias("source"), F.col("message").alias("m"))),
             (views.es_logs(spark, d).select(F.lit("elasticsearch").alias("source"), F.col("message").alias("m")))]
    hits = [p.filter(X.is_critical_message(F.col("m"), s)) for p, s in zip(parts, ("mongodb", "mssql", "elasticsearch"))]
    return hits[0].unionByName(hits[1]).unionByName(hits[2]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("x27_first_words", f"""{LOGS} SELECT split_part(trim(msg), ' ', 1) AS category, count(*) AS n FROM logs GROUP BY 1""")
def first_words(spark, d):
    return views.mongo_logs(spark, d).groupBy(X.first_word(F.col("msg")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("x30_token_counts", """SELECT lang, count(*) AS docs, CAST(sum(CAST(length(text) // 3 AS BIGINT)) AS BIGINT) AS tokens
FROM documents GROUP BY lang""")
def token_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(X.approx_tokens(F.col("text"))).alias("tokens"))


@query("x31_truncations", f"""{LOGS} SELECT log_id, substr(msg, 1, 1000) AS message, substr(msg, 1, 200) AS sample,
 substr({O.FP_MONGO}, 1, 120) AS fingerprint FROM logs""")
def truncations(spark, d):
    return views.mongo_logs(spark, d).select(
        "log_id", F.substring("msg", 1, 1000).alias("message"), F.substring("msg", 1, 200).alias("sample"),
        F.substring(X.fingerprint_mongodb(F.col("msg")), 1, 120).alias("fingerprint"))


_LIB = {k: v for k, v in P.PATTERN_LIBRARY.items()}


@query("p10_pattern_library_logs", f"""{LOGS}, h AS (SELECT unnest([{', '.join(
    f"CASE WHEN {O.hit('msg', p)} THEN {O.quoted(n)} END" for n, p in _LIB.items())}]) AS pattern FROM logs)
SELECT pattern, count(*) AS n FROM h WHERE pattern IS NOT NULL GROUP BY 1""")
def pattern_library_logs(spark, d):
    return views.mongo_logs(spark, d).select(F.explode(X.pattern_hits(F.col("msg"))).alias("pattern")).groupBy(
        "pattern").agg(F.count(F.lit(1)).alias("n"))


@query("p11_match_counts", """SELECT role, CAST(sum(len(regexp_extract_all(text, '(?i)error|fail|data'))) AS BIGINT) AS matches,
 CAST(sum(length(regexp_replace(text, '(error|fail|data)', '<mark>\\1</mark>', 'gi'))) AS BIGINT) AS marked_chars
FROM conversations GROUP BY role""")
def match_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").groupBy("role").agg(
        F.sum(X.count_matches(t, "error|fail|data")).cast("bigint").alias("matches"),
        F.sum(F.length(X.highlight(t, "error|fail|data"))).alias("marked_chars"))


@query("j02_hostnames", f"""WITH logs AS ({MSSQL_LOGS}) SELECT host,
 upper(regexp_replace(host, {O.quoted(P.HOST_SUFFIXES)}, '')) AS host_norm, count(*) AS n FROM logs GROUP BY 1, 2""")
def hostnames(spark, d):
    return views.mssql_logs(spark, d).groupBy("host", X.normalize_host(F.col("host")).alias("host_norm")).agg(
        F.count(F.lit(1)).alias("n"))


# ---- scans ----

TEXT_VALUE = """strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(extract(millisecond FROM ts) AS BIGINT) % 1000 AS VARCHAR), 3, '0')"""


def text_lines(spark, d):
    """The log view as raw lines: JSON entries, text entries and junk, by id."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    entry = F.to_json(F.struct(F.struct(F.concat(stamp, F.lit("Z")).alias("$date")).alias("t"), "s", "c",
                               F.lit("conn1").alias("ctx"), "msg", F.parse_json("attr").alias("attr"), "host"))
    line = F.concat(stamp, F.lit("+0000 "), "s", F.lit("  "), "c", F.lit("   [conn7] "), "msg")
    junk = F.concat(F.lit("{broken "), "msg")
    value = F.when(F.col("log_id") % 10 == 0, junk).when(F.col("log_id") % 2 == 0, entry).otherwise(line)
    return views.mongo_logs(spark, d).select("log_id", value.alias("value"))


@query("s01_s03_line_formats", f"""{LOGS} SELECT CASE WHEN log_id % 10 = 0 THEN 'rejected' WHEN log_id % 2 = 0 THEN 'json'
 ELSE 'text' END AS format, log_id, CASE WHEN log_id % 10 <> 0 THEN s END AS s, CASE WHEN log_id % 10 <> 0 THEN c END AS c,
 CASE WHEN log_id % 10 <> 0 THEN msg END AS msg,
 CASE WHEN log_id % 10 <> 0 THEN epoch_us(ts) // 1000 END AS ms,
 CASE WHEN log_id % 10 <> 0 THEN CASE WHEN log_id % 2 = 0 THEN 'conn1' ELSE 'conn7' END END AS ctx FROM logs""")
def line_formats(spark, d):
    return RD.parse_lines(text_lines(spark, d)).select(
        "format", "log_id", "s", "c", "msg", F.unix_millis("ts").alias("ms"), "ctx")


@query("s05_servers_by_file", """SELECT server, count(*) AS n FROM (SELECT CASE user_id % 5
 WHEN 0 THEN 'mongodb01n' || CAST(user_id % 3 AS VARCHAR(9)) WHEN 1 THEN 'dbserver' || CAST(100 + user_id % 7 AS VARCHAR(9))
 WHEN 2 THEN 'mongo' || CAST(user_id % 4 AS VARCHAR(9)) WHEN 3 THEN 'mongodbn' || CAST(user_id % 2 AS VARCHAR(9)) END AS server
 FROM events) t GROUP BY 1""")
def servers_by_file(spark, d):
    u = F.col("user_id")
    name = (F.when(u % 5 == 0, F.format_string("MONGODB01N%d.log", u % 3))
            .when(u % 5 == 1, F.format_string("mongod.log.DBSERVER%d", 100 + u % 7))
            .when(u % 5 == 2, F.format_string("upload_mongo%d.txt", u % 4))
            .when(u % 5 == 3, F.format_string("MongodbN%d.json", u % 2)).otherwise("unknown.log"))
    return table(spark, d, "events").groupBy(X.server_from_name(name).alias("server")).agg(F.count(F.lit(1)).alias("n"))


@query("s06_servers_by_content", """SELECT event_type AS file_name, CASE WHEN event_type = 'error' THEN NULL
 ELSE 'mongo' || CAST(min_by(user_id, (ts, event_id)) % 50 AS VARCHAR(9)) END AS server
FROM events GROUP BY event_type""")
def servers_by_content(spark, d):
    e = table(spark, d, "events")
    name = F.format_string("MONGO%d.local", F.col("user_id") % 50)
    rows = e.select(
        F.col("event_type").alias("file_name"), "ts", F.col("event_id").alias("log_id"),
        F.when(F.col("event_type") == "view", name).otherwise("unknown").alias("host"),
        F.when(F.col("event_type") == "signup", "Process Details").otherwise("text").alias("msg"),
        F.when(F.col("event_type") != "error", F.to_json(F.struct(F.concat(name, F.lit(":27017")).alias("host"))))
        .alias("attr"))
    return RD.server_from_content(rows)


@query("s07_newest_logs", f"""{LOGS} SELECT log_id, host, s, msg FROM logs WHERE host IN ('node-1', 'node-2')
 AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25' ORDER BY ts DESC, log_id DESC LIMIT 500""")
def newest_logs(spark, d):
    rows = RD.scan(views.mongo_logs(spark, d), "2024-01-03", "2024-01-25", ["node-1", "node-2"])
    return RD.newest_first(rows, 500).select("log_id", "host", "s", "msg")


@query("s08_time_slices", f"""{LOGS} SELECT host, (epoch_us(ts) // 14400000000) * 14400000000 AS slice_start, count(*) AS n
FROM logs GROUP BY 1, 2""")
def time_slices(spark, d):
    width = V.slice_minutes(30 * 24)
    return views.mongo_logs(spark, d).groupBy("host", V.time_slice(F.col("ts"), width).alias("slice_start")).agg(
        F.count(F.lit(1)).alias("n"))


@query("s09_keyset_page", f"""{LOGS} SELECT log_id, host, msg FROM logs WHERE (ts, log_id) > (TIMESTAMP '2024-01-12', 5)
ORDER BY ts, log_id LIMIT 1000""")
def keyset_page(spark, d):
    return RD.keyset_page(views.mongo_logs(spark, d), ("2024-01-12 00:00:00", 5), 1000).select("log_id", "host", "msg")


@query("s10_exploded_messages", f"""{LOGS} SELECT log_id, message FROM (SELECT log_id, unnest(CASE WHEN log_id % 3 = 0 THEN [msg, msg]
 WHEN log_id % 3 = 1 THEN [msg, 'second line', 'second line'] ELSE [msg] END) AS message FROM logs) t GROUP BY 1, 2""")
def exploded_messages(spark, d):
    m, i = F.col("msg"), F.col("log_id")
    two, pad = F.lit("second line"), F.lit("  second line ")
    arr = F.when(i % 3 == 0, F.array(m, m)).when(i % 3 == 1, F.array(m, two, pad)).otherwise(F.array(m, F.lit(" ")))
    return RD.explode_messages(views.mongo_logs(spark, d).select("log_id", arr.alias("message")))


@query("s11_nested_entries", f"{LOGS} SELECT log_id, s, c, msg FROM logs")
def nested_entries(spark, d):
    logs = views.mongo_logs(spark, d)
    outer = logs.select("log_id", F.when(F.col("log_id") % 2 == 0, F.to_json(F.struct("s", "c", "msg")))
                        .otherwise(F.col("msg")).alias("m"), "s", "c", "msg")
    inner = outer.withColumn("e", RD.unwrap_nested(F.col("m")))
    return inner.select("log_id", F.coalesce("e.s", "s").alias("s"), F.coalesce("e.c", "c").alias("c"),
                        F.coalesce("e.msg", "m").alias("msg"))


@query("s16_profiler_rows", """SELECT event_id, 'W' AS s, 'QUERY' AS c,
 'Slow query: ' || event_type || ' on shop.t' || CAST(user_id % 5 AS VARCHAR(9)) || ' took '
  || CAST(CAST(FLOOR(value * 10) AS BIGINT) AS VARCHAR(20)) || 'ms' AS msg FROM events""")
def profiler_rows(spark, d):
    e = table(spark, d, "events").select(
        "event_id", "ts", F.col("event_type").alias("op"), F.format_string("shop.t%d", F.col("user_id") % 5).alias("ns"),
        F.floor(F.col("value") * 10).cast("bigint").alias("millis"), F.col("props").alias("command"))
    parsed = RD.profiler_rows(e.withColumn("command", F.to_json(F.struct("event_id"))))
    return parsed.select(F.get_json_object(F.get_json_object("attr", "$.command"), "$.event_id").cast("bigint")
                         .alias("event_id"), "s", "c", "msg")


@query("p14_slow_queries", f"""WITH {O.MONGO_LINES} SELECT log_id, host, c, raw_duration_ms, raw_docs_examined, msg FROM lines
WHERE raw_duration_ms >= 1000 ORDER BY ts DESC, log_id DESC LIMIT 10""")
def slow_queries(spark, d):
    rows = FE.numeric_features(views.mongo_logs(spark, d).withColumn("is_collscan", F.lit(0))).filter("raw_duration_ms >= 1000")
    return RD.newest_first(rows, 10).select("log_id", "host", "c", "raw_duration_ms", "raw_docs_examined", "msg")


# ---- time ----

@query("t01_mixed_timestamps", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE epoch_us(ts) // 1000 END AS ms FROM events""")
def mixed_timestamps(spark, d):
    i = F.col("event_id")
    fmt = lambda f: F.date_format("ts", f)
    text = (F.when(i % 4 == 0, fmt("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(i % 4 == 1, fmt("yyyy-MM-dd'T'HH:mm:ss,SSS"))
            .when(i % 4 == 2, fmt("yyyy-MM-dd HH:mm:ss.SSS")).otherwise("yesterday"))
    return table(spark, d, "events").select("event_id", F.unix_millis(V.parse_timestamp(text)).alias("ms"))


@query("t02_t04_calendar", """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
 CAST(hour(ts + INTERVAL 3 HOUR) AS INTEGER) AS local_hour,
 CAST(hour(ts) BETWEEN 8 AND 17 AND isodow(ts) < 6 AS INTEGER) AS is_business_hours,
 CAST(hour(ts + INTERVAL 3 HOUR) < 6 AS INTEGER) AS is_night FROM events""")
def calendar(spark, d):
    ts, local = F.col("ts"), V.local_time(F.col("ts"))
    return table(spark, d, "events").select(
        "event_id", F.hour(ts).alias("hour_of_day"), V.is_weekend(ts).alias("is_weekend"), F.hour(local).alias("local_hour"),
        V.is_business_hours(ts).alias("is_business_hours"), V.is_night(local).alias("is_night"))


@query("t05_t08_buckets", """SELECT strftime(ts, '%Y-%m-%dT%H:00') AS hour_bucket, strftime(ts, '%Y-%m-%d') AS day_bucket,
 strftime(ts, '%H') AS hour_label, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def buckets(spark, d):
    ts = F.col("ts")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "events").groupBy(
        V.bucket_label(ts, 2).alias("hour_bucket"), V.bucket_label(ts, 7).alias("day_bucket"),
        V.hour_label(iso).alias("hour_label")).agg(F.count(F.lit(1)).alias("n"))


@query("t06_relative_ranges", """WITH r AS (SELECT max(ts) AS ref FROM events)
SELECT CAST(count(*) FILTER (WHERE ts >= ref - INTERVAL 1 HOUR) AS BIGINT) AS last_hour,
 count(*) FILTER (WHERE ts >= ref - INTERVAL 24 HOUR) AS last_day, count(*) FILTER (WHERE ts >= ref - INTERVAL 168 HOUR) AS last_week,
 count(*) FILTER (WHERE ts >= ref - INTERVAL 720 HOUR) AS last_month FROM events, r""")
def relative_ranges(spark, d):
    e = table(spark, d, "events")
    ref = e.agg(F.max("ts")).scalar()
    return e.select("ts", ref.alias("ref")).agg(*[
        F.count_if(V.since(F.col("ts"), F.col("ref"), k)).alias(k) for k in V.RELATIVE_HOURS])


# ---- predicates and pages ----

@query("p04_p07_noise_mongodb", f"""WITH {O.MONGO_LINES} SELECT host, CAST(count(*) FILTER (WHERE is_reauthenticate = 0
 AND is_normal_replication = 0) AS BIGINT) AS kept, round((1 - avg(CASE WHEN is_reauthenticate = 0 AND is_normal_replication = 0
 THEN CAST(1 AS DOUBLE) ELSE 0 END)) * 100, 6) AS reduction_pct FROM lines GROUP BY host""")
def noise_mongodb(spark, d):
    lines = FE.message_flags(views.mongo_logs(spark, d))
    keep = (F.col("is_reauthenticate") == 0) & (F.col("is_normal_replication") == 0)
    rate = lines.groupBy("host").agg(F.round(FE.reduction_rate(keep), 6).alias("reduction_pct"))
    kept = FE.noise_filter(lines, "mongodb").groupBy("host").agg(F.count(F.lit(1)).alias("kept"))
    return rate.join(kept, "host")


@query("p05_noise_mssql", f"""{MS} SELECT host, count(*) AS kept FROM lines
WHERE NOT (is_service_account = 1 AND is_successful_login = 1) GROUP BY 1""")
def noise_mssql(spark, d):
    lines = FE.mssql_line_features(FE.mssql_parse(mssql_source(spark, d)))
    return FE.noise_filter(lines, "mssql", True).groupBy("host").agg(F.count(F.lit(1)).alias("kept"))


@query("p06_noise_es", f"""{ES} SELECT host, count(*) AS kept FROM lines
WHERE NOT (is_deprecation = 1 AND is_warn = 0 AND is_error = 0) GROUP BY 1""")
def noise_es(spark, d):
    lines = FE.es_line_features(FE.es_parse(views.es_logs(spark, d)))
    return FE.noise_filter(lines, "elasticsearch").groupBy("host").agg(F.count(F.lit(1)).alias("kept"))


@query("p02_aligned_schema", f"""WITH {O.MONGO_LINES} SELECT host, log_id, CAST(is_fatal AS DOUBLE) AS is_fatal,
 CAST(0 AS DOUBLE) AS not_there, CAST(query_duration_ms AS DOUBLE) AS query_duration_ms FROM lines""")
def aligned_schema(spark, d):
    lines = FE.mongodb_line_features(views.mongo_logs(spark, d))
    return FE.align_schema(lines, ["is_fatal", "not_there", "query_duration_ms"])


@query("p03_schema_report", f"""SELECT 'gone' AS missing, 'value' AS extra, round(CAST(2 AS DOUBLE) / 3, 6) AS mismatch_ratio,
 'critical' AS grade, count(*) AS lines FROM events""")
def schema_report(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    lines = e.agg(F.count(F.lit(1))).scalar()
    return FE.schema_report(e, ["event_id", "user_id", "gone"], []).select(
        F.concat_ws(",", "missing").alias("missing"), F.concat_ws(",", "extra").alias("extra"),
        F.round("mismatch_ratio", 6).alias("mismatch_ratio"), "grade", lines.alias("lines"))


@query("p09_ui_filter", f"""{LOGS} SELECT log_id, host, s, c, msg FROM logs WHERE c IN ('ACCESS', 'COMMAND') AND s IN ('E', 'I')
 AND host IN ('node-1', 'node-3', 'node-5') AND (contains(lower(msg), 'slow') OR regexp_matches(msg, 'severity: 1[5-9]', 'i'))""")
def ui_filter(spark, d):
    rows = RD.scan(views.mongo_logs(spark, d), hosts=["node-1", "node-3", "node-5"], c=["ACCESS", "COMMAND"], s=["E", "I"])
    text = F.lower("msg").contains("slow") | X.search(F.col("msg"), "severity: 1[5-9]")
    return rows.filter(text).select("log_id", "host", "s", "c", "msg")


@query("p18_p19_ad_hoc", """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
WHERE o_totalprice >= 1000 AND o_orderstatus IN ('O', 'F') AND NOT (o_orderpriority = '5-LOW') AND o_orderdate IS NOT NULL
 AND regexp_matches(o_orderpriority, '^[12]') ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def ad_hoc(spark, d):
    o = table(spark, d, "orders")
    keep = ((F.col("o_totalprice") >= 1000) & F.col("o_orderstatus").isin("O", "F") & ~(F.col("o_orderpriority") == "5-LOW")
            & F.col("o_orderdate").isNotNull() & F.col("o_orderpriority").rlike("^[12]"))
    return o.filter(keep).select("o_orderkey", "o_totalprice", "o_orderpriority").orderBy(
        F.col("o_totalprice").desc(), "o_orderkey").limit(100)

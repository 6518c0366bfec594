"""Building blocks of the oracle SQL: plain window and CASE formulations of the same semantics."""

from __future__ import annotations

from sievelog.functions import patterns as P
from sievelog.operators import rules as R, severity as S
from sievelog.sources.views import ES_LOGS, MONGO_LOGS, MSSQL_LOGS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hit(col: str, pattern: str, case_sensitive: bool = False) -> str:
    option = "" if case_sensitive else ", 'i'"
    return f"regexp_matches({col}, {quoted(pattern)}{option})"


def flag(cond: str) -> str:
    return f"CAST(COALESCE({cond}, FALSE) AS INTEGER)"


def in_list(col: str, values: list[str]) -> str:
    return f"{col} IN ({', '.join(map(quoted, values))})"


def case(pairs: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def replace_all(col: str, steps: list[tuple[str, str]]) -> str:
    for pattern, new in steps:
        col = f"regexp_replace({col}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return col


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def extract(col: str, pattern: str, group: int = 1) -> str:
    return f"NULLIF(regexp_extract({col}, {quoted(pattern)}, {group}), '')"


def extract_int(col: str, pattern: str, group: int = 1) -> str:
    return f"TRY_CAST({extract(col, pattern, group)} AS BIGINT)"


FP_MONGO = squeeze(replace_all("msg", [("[0-9a-fA-F]{24}", "<ID>"), ("\\d+", "<NUM>")]))
FP_MSSQL = replace_all("message", [
    ("\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}", "<IP>"), ("for user '[^']+'", "for user '<USER>'"),
    ("database '[^']+'", "database '<DB>'"), ("\\d{4}-\\d{2}-\\d{2}\\s+\\d{2}:\\d{2}:\\d{2}\\.\\d+", "<TS>"),
    ("\\b\\d+\\b", "<NUM>")])
FP_ES = squeeze(replace_all("message", [
    ("\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}", "<IP>"), ("[0-9a-fA-F]{8,}", "<ID>"),
    ("\\b[\\w-]+-\\d{4}\\.\\d{2}\\.\\d{2}\\b", "<INDEX>"), ("\\b\\d+\\b", "<NUM>")]))


def _mongo_flags() -> str:
    out = []
    for name, pattern in P.MONGO_FLAGS.items():
        cond = hit("msg", pattern, name in P.CASE_SENSITIVE)
        if name == "is_auth_failure":
            cond = f"{cond} OR msg = {quoted(P.AUTH_FAILURE_TEXT)}"
        elif name == "is_fatal":
            cond = f"{cond} AND NOT {hit('msg', P.MONGO_FLAGS['is_normal_replication'])}"
        elif name == "is_error":
            cond = f"{cond} OR s = 'E'"
        out.append(f"{flag(cond)} AS {name}")
    out += [f"{flag('msg = ' + quoted(P.AUTH_SUCCESS_TEXT))} AS is_auth_success",
            f"{flag('msg = ' + quoted(P.REAUTHENTICATE_TEXT))} AS is_reauthenticate",
            f"{flag(chr(115) + ' = ' + quoted('W'))} AS severity_W"]
    out += [f"{flag(in_list('c', v))} AS {n}" for n, v in P.COMPONENT_FLAGS.items()]
    out.append(f"{flag('c IS NULL OR ' + in_list('c', P.UNKNOWN_COMPONENTS))} AS is_unknown_component")
    return ", ".join(out)


def _number(name: str, msg: bool = True) -> str:
    tries = [f"TRY_CAST(json_extract_string(attr, '$.{name}') AS BIGINT)"]
    if msg:
        tries.append(extract_int("msg", f'"{name}":([0-9]+)'))
    return f"COALESCE({', '.join(tries)}, 0)"


CRITICALITY = " + ".join(f"{n} * {w}" for n, w in P.CRITICALITY_WEIGHTS.items())

MONGO_LINES = f"""logs AS ({MONGO_LOGS}),
line0 AS (SELECT *, {FP_MONGO} AS message_fingerprint, CAST(hour(ts) AS INTEGER) AS hour_of_day,
 CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, {_mongo_flags()},
 {_number('durationMillis')} AS raw_duration_ms, {_number('docsExamined')} AS raw_docs_examined,
 {_number('keysExamined')} AS raw_keys_examined, {_number('timeActiveMicros', False)} AS raw_txn_active,
 {_number('timeInactiveMicros', False)} AS txn_time_inactive_micros,
 CAST(list_contains(json_keys(attr), 'error') AS INTEGER) AS has_error_key,
 CAST(len(json_keys(attr)) AS INTEGER) AS attr_key_count FROM logs),
lines AS (SELECT *, {CRITICALITY} AS component_criticality_score,
 CAST(attr_key_count > 5 AS INTEGER) AS has_many_attrs,
 least(raw_duration_ms, 60000) AS query_duration_ms, least(raw_docs_examined, 1000000) AS docs_examined_count,
 least(raw_keys_examined, 1000000) AS keys_examined_count, least(raw_txn_active, 30000000) AS txn_time_active_micros,
 CASE WHEN raw_txn_active > 0 THEN CAST(txn_time_inactive_micros AS DOUBLE) / least(raw_txn_active, 30000000)
  ELSE CAST(0 AS DOUBLE) END AS txn_wait_ratio,
 CAST(least(raw_duration_ms, 60000) > 100 AS INTEGER) AS is_long_transaction,
 CASE WHEN is_collscan = 1 THEN least(raw_docs_examined, 1000000) * 2
  ELSE greatest(0, least(raw_docs_examined, 1000000) - least(raw_keys_examined, 1000000)) END AS performance_score
 FROM line0)"""

MONGO_FEATURES = f"""{MONGO_LINES},
seq0 AS (SELECT *, row_number() OVER w AS seq,
 COALESCE(epoch_us(ts) - epoch_us(lag(ts) OVER w), 0) AS gap_us,
 CAST(row_number() OVER w = 1 OR c IS DISTINCT FROM lag(c) OVER w AS INTEGER) AS component_changed,
 count(*) OVER (PARTITION BY host, c) AS component_count, count(*) OVER (PARTITION BY host) AS scope_total,
 count(*) OVER (PARTITION BY host, s, c) AS combo_count, count(*) OVER (PARTITION BY host, msg) AS msg_count,
 count(*) OVER (PARTITION BY host, message_fingerprint) AS fingerprint_count
 FROM lines WINDOW w AS (PARTITION BY host ORDER BY ts, log_id)),
seq1 AS (SELECT *, CAST(gap_us AS DOUBLE) / 1000000 AS time_since_last_log,
 CAST(gap_us > 0 AND gap_us < 100000 AS INTEGER) AS log_burst_flag,
 CAST(gap_us = 0 AS INTEGER) AS extreme_burst_flag,
 CAST(dense_rank() OVER (PARTITION BY host ORDER BY component_count DESC, c) - 1 AS INTEGER) AS component_encoded,
 s || '_' || c AS severity_component_combo, CAST(combo_count < 100 AS INTEGER) AS is_rare_combo,
 CAST(component_count < 100 AS INTEGER) AS is_rare_component, CAST(msg_count < 100 AS INTEGER) AS is_rare_message,
 CAST(component_count AS DOUBLE) / scope_total AS component_frequency_ratio,
 CAST(component_count * 2 > scope_total AS INTEGER) AS is_dominant_component,
 CAST(fingerprint_count AS DOUBLE) / scope_total AS fingerprint_frequency_ratio,
 CAST(fingerprint_count * 5 > scope_total AS INTEGER) AS is_dominant_message FROM seq0),
features AS (SELECT *, avg(CAST(extreme_burst_flag AS DOUBLE)) OVER (PARTITION BY host ORDER BY seq
 ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS burst_density FROM seq1)"""


def _mssql_class() -> str:
    return case([(hit("message", pat, cs), quoted(name)) for name, pat, cs in P.MSSQL_CLASSES], "'Unknown'")


MSSQL_LINES = f"""logs AS ({MSSQL_LOGS}),
parsed AS (SELECT log_id, ts, host, user_id, message, tags,
 CAST(contains(tags, '_grokparsefailure') AS INTEGER) AS is_grok_failure,
 CASE WHEN contains(tags, '_grokparsefailure') THEN {_mssql_class()} ELSE COALESCE(logtype, 'Unknown') END AS logtype,
 COALESCE(logintype, {extract('message', P.MSSQL_LOGIN_STATUS)}, 'unknown') AS logintype,
 trim(COALESCE({extract('message', P.MSSQL_CLIENT_IP)}, 'unknown')) AS client_ip,
 COALESCE({extract('message', P.MSSQL_AUTH)}, 'unknown') AS auth_type,
 COALESCE({extract('message', P.MSSQL_USER)}, 'unknown') AS username,
 COALESCE({extract('message', P.MSSQL_DATABASE)}, 'unknown') AS database_name,
 COALESCE({extract_int('message', P.MSSQL_ERROR, 1)}, 0) AS error_number,
 COALESCE({extract_int('message', P.MSSQL_ERROR, 2)}, 0) AS error_severity,
 COALESCE({extract_int('message', P.MSSQL_ERROR, 3)}, 0) AS error_state,
 COALESCE({extract_int('message', P.MSSQL_SPID)}, 0) AS spid,
 COALESCE({extract('message', P.MSSQL_TIMESTAMP)}, '') AS local_time_text,
 {FP_MSSQL} AS message_fingerprint FROM logs),
lines AS (SELECT *, CASE WHEN logintype = 'failed' THEN trim({extract('message', P.MSSQL_REASON)}) END AS failure_reason,
 CASE WHEN error_severity >= 20 THEN 'fatal' WHEN error_severity >= 17 THEN 'error' WHEN error_severity >= 11
  THEN 'warning' WHEN error_severity > 0 THEN 'info' ELSE 'unknown' END AS log_level,
 CAST(hour(ts + INTERVAL 3 HOUR) AS INTEGER) AS hour_of_day,
 CAST(isodow(ts + INTERVAL 3 HOUR) >= 6 AS INTEGER) AS is_weekend,
 CAST(hour(ts + INTERVAL 3 HOUR) BETWEEN 8 AND 17 AND isodow(ts + INTERVAL 3 HOUR) < 6 AS INTEGER) AS is_business_hours,
 CAST(hour(ts + INTERVAL 3 HOUR) < 6 AS INTEGER) AS is_night_login,
 CAST(lower(logtype) = 'logon' AS INTEGER) AS is_login_event,
 CAST(logintype = 'failed' AS INTEGER) AS is_failed_login, CAST(logintype = 'succeeded' AS INTEGER) AS is_successful_login,
 CAST(auth_type = 'Windows' AS INTEGER) AS is_windows_auth, CAST(auth_type = 'SQL Server' AS INTEGER) AS is_sql_auth,
 {flag(in_list('client_ip', P.LOCAL_CLIENTS))} AS is_local_client,
 {flag(hit('username', P.SERVICE_ACCOUNT))} AS is_service_account,
 CAST(contains(username, chr(92)) AS INTEGER) AS is_domain_user,
 {', '.join(f"{flag(hit('message', p))} AS {n}" for n, p in P.MSSQL_FLAGS.items())},
 CAST(error_severity AS INTEGER) AS error_severity_level, CAST(error_severity >= 17 AS INTEGER) AS is_high_severity_error,
 {flag(in_list('logtype', P.SYSTEM_ERROR_TYPES))} AS is_system_error FROM parsed)"""

MSSQL_FEATURES = f"""{MSSQL_LINES},
seq0 AS (SELECT *, row_number() OVER w AS seq, COALESCE(epoch_us(ts) - epoch_us(lag(ts) OVER w), 0) AS gap_us,
 max(CASE WHEN is_login_event = 1 THEN epoch_us(ts) END)
  OVER (PARTITION BY host ORDER BY ts, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_login_us,
 count(*) OVER (PARTITION BY host, client_ip) AS client_ip_frequency,
 count(*) OVER (PARTITION BY host, username) AS username_frequency,
 count(*) OVER h AS login_count_1h, avg(CAST(is_failed_login AS DOUBLE)) OVER h AS failed_login_ratio_1h
 FROM lines WINDOW w AS (PARTITION BY host ORDER BY ts, log_id),
 h AS (PARTITION BY host ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)),
seq1 AS (SELECT *, CAST(gap_us AS DOUBLE) / 1000000 AS time_since_last_log,
 CASE WHEN is_login_event = 1 THEN CAST(COALESCE(epoch_us(ts) - prev_login_us, 0) AS DOUBLE) / 1000000
  ELSE CAST(0 AS DOUBLE) END AS time_since_last_login,
 CAST(is_login_event = 1 AND gap_us > 0 AND gap_us < 1000000 AS INTEGER) AS login_burst_flag,
 CAST(is_login_event = 1 AND gap_us < 100000 AS INTEGER) AS extreme_burst_flag,
 CAST(client_ip_frequency < 100 AS INTEGER) AS is_rare_client_ip,
 CAST(username_frequency < 100 AS INTEGER) AS is_rare_username FROM seq0),
features AS (SELECT *, avg(CAST(extreme_burst_flag AS DOUBLE)) OVER (PARTITION BY host ORDER BY seq
 ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS burst_density FROM seq1)"""


def _es_logger() -> str:
    pairs = []
    for name, words, how in P.ES_LOGGER_CLASSES:
        tests = [f"contains(lower(logger_name), {quoted(w)})" if how == "contains"
                 else f"starts_with(lower(logger_name), {quoted(w)})" for w in words]
        pairs.append((" OR ".join(tests), quoted(name)))
    return f"CASE WHEN logger_name = '' THEN 'unknown' ELSE {case(pairs, quoted('other'))} END"


_J = "json_extract_string(CASE WHEN starts_with(message, '{') THEN message END, '$.\"%s\"')"


def _es_part(i: int, key: str, default: str, upper: bool = False) -> str:
    part = f"trim(regexp_extract(message, {quoted(P.ES_LINE)}, {i}))"
    json = f"COALESCE({_J % key}, {quoted(default)})"
    if upper:
        part, json = f"upper({part})", f"upper(trim({json}))"
    miss = "trim(message)" if i == 5 else quoted(default)
    return (f"CASE WHEN starts_with(message, '{{') THEN {json} "
            f"WHEN {hit('message', P.ES_LINE, True)} THEN {part} ELSE {miss} END")


ES_LINES = f"""logs AS ({ES_LOGS}),
parsed AS (SELECT *, {_es_part(1, '@timestamp', '')} AS parsed_timestamp,
 {_es_part(2, 'log.level', 'UNKNOWN', True)} AS log_level, {_es_part(3, 'log.logger', '')} AS logger_name,
 {_es_part(4, 'elasticsearch.node.name', '')} AS node_name, {_es_part(5, 'message', '')} AS message_text,
 COALESCE({_J % 'event.code'}, '') AS event_code, {FP_ES} AS message_fingerprint,
 {case([(f"contains(upper(host), {quoted(k)})", quoted(r)) for r, k in P.ES_HOST_ROLES], "'unknown'")} AS host_role
 FROM logs),
lines AS (SELECT *, {_es_logger()} AS logger_category, CAST(hour(ts) AS INTEGER) AS hour_of_day,
 CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
 CAST(hour(ts) BETWEEN 8 AND 17 AND isodow(ts) < 6 AS INTEGER) AS is_business_hours,
 CAST(log_level = 'WARN' AS INTEGER) AS is_warn, CAST(log_level IN ('ERROR', 'CRITICAL') AS INTEGER) AS is_error,
 CAST({_es_logger()} = 'cluster' AS INTEGER) AS is_cluster_logger,
 CAST({_es_logger()} = 'index' AS INTEGER) AS is_index_logger,
 CAST({_es_logger()} = 'transport' AS INTEGER) AS is_transport_logger,
 {', '.join(f"{flag(hit('message', p))} AS {n}" for n, p in P.ES_FLAGS.items() if n != 'is_deprecation')},
 {flag(hit('message', P.ES_FLAGS['is_deprecation']) + " OR contains(log_level, 'DEPRECAT') OR "
       + hit('event_dataset', 'deprecation'))} AS is_deprecation FROM parsed)"""

ES_FEATURES = f"""{ES_LINES},
seq0 AS (SELECT *, row_number() OVER w AS seq, COALESCE(epoch_us(ts) - epoch_us(lag(ts) OVER w), 0) AS gap_us,
 CAST(count(*) OVER (PARTITION BY host, logger_name) < 50 AS INTEGER) AS is_rare_logger
 FROM lines WINDOW w AS (PARTITION BY host ORDER BY ts, log_id)),
seq1 AS (SELECT *, CAST(gap_us AS DOUBLE) / 1000000 AS time_since_last_log,
 CAST(gap_us < 100000 AS INTEGER) AS extreme_burst_flag FROM seq0),
features AS (SELECT *, avg(CAST(extreme_burst_flag AS DOUBLE)) OVER (PARTITION BY host ORDER BY seq
 ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS burst_density FROM seq1)"""

FEATURES = {"mongodb": MONGO_FEATURES, "mssql": MSSQL_FEATURES, "elasticsearch": ES_FEATURES}


def scored(source: str) -> str:
    """CTE chain ending in `ruled` and `scored`: all lines start as normal with score 0, rules override."""
    rules = R.RULES[source]
    name = case([(r.condition, quoted(r.name)) for r in rules], "NULL")
    weight = case([(r.condition, f"CAST({r.severity} AS DOUBLE)") for r in rules], "NULL")
    origin, table, default, signals, hours = S.PROFILES[source]
    origin_points = case([(f"{origin} = {quoted(k)}", str(v)) for k, v in table.items()], str(default))
    signal_points = " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in signals)
    hour_points = case([(c, str(p)) for c, p in hours], "0")
    return f"""{FEATURES[source]},
ruled AS (SELECT *, {name} AS rule_hit, {weight} AS rule_severity FROM features),
judged AS (SELECT *, CASE WHEN rule_hit IS NULL THEN 1 ELSE -1 END AS prediction,
 CASE WHEN rule_hit IS NULL THEN CAST(0 AS DOUBLE) ELSE -rule_severity END AS anomaly_score FROM ruled),
scored0 AS (SELECT *, least(CAST(100 AS DOUBLE), greatest(CAST(0 AS DOUBLE), abs(anomaly_score) * 40 + {origin_points}
 + least(40, {signal_points}) + {hour_points} + CASE WHEN rule_hit IS NULL THEN 0 ELSE 20 END)) AS severity_score
 FROM judged),
scored AS (SELECT *, CASE WHEN severity_score >= 80 THEN 'CRITICAL' WHEN severity_score >= 60 THEN 'HIGH'
 WHEN severity_score >= 40 THEN 'MEDIUM' WHEN severity_score >= 20 THEN 'LOW' ELSE 'INFO' END AS severity_level
 FROM scored0)"""


def word_rule(alternatives: list[list[str]], msg: str, component: str = "''", severity: str = "''") -> str:
    def test(word: str) -> str:
        if word.startswith("c:"):
            return f"lower({component}) = {quoted(word[2:])}"
        if word.startswith("s:"):
            return f"{severity} = {quoted(word[2:])}"
        return f"contains(lower({msg}), {quoted(word)})"
    return "(" + " OR ".join("(" + " AND ".join(map(test, alt)) + ")" for alt in alternatives) + ")"


ANOMALY_TYPE = case([(word_rule(r, "msg", "c", "s"), quoted(n)) for n, r in P.ANOMALY_TYPES], "'unknown'")

"""Severity 0-100 of one line: model score, place of origin, signals, hour, rule bonus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sievelog.functions.values import severity_level

PEAK_HOURS = [8, 9, 10, 17, 18, 19]

# ---- fixed values: points for the origin of a line ----
COMPONENT_POINTS = {"REPL": 20, "ACCESS": 18, "STORAGE": 15, "COMMAND": 12, "NETWORK": 10, "QUERY": 8, "INDEX": 8,
                    "TXN": 15, "-": 5}
LOGTYPE_POINTS = {"Error": 18, "Deadlock": 18, "Memory": 18, "Logon": 15, "FDHost": 12, "Backup": 8, "Unknown": 10,
                  "Startup": 12, "Recovery": 10, "Info": 5}
LEVEL_POINTS = {"CRITICAL": 20, "ERROR": 20, "WARN": 12, "INFO": 5, "DEBUG": 3, "TRACE": 2, "UNKNOWN": 8}

# ---- fixed values: points for signals, summed and capped at 40 ----
MONGODB_SIGNALS = [
    ("raw_docs_examined > 1500000", 40), ("is_fatal = 1", 30), ("is_replication_issue = 1", 35),
    ("is_long_transaction = 1 and raw_duration_ms > 5000", 30), ("is_out_of_memory = 1", 28),
    ("is_memory_limit = 1", 25), ("is_shutdown = 1 or is_restart = 1", 25), ("is_drop_operation = 1", 25),
    ("raw_keys_examined > 50000", 15), ("is_collscan = 1 and raw_docs_examined > 100000", 20),
    ("is_collscan = 1 and raw_docs_examined <= 100000", 12), ("is_assertion = 1", 22), ("is_slow_query = 1", 8),
]
MSSQL_SIGNALS = [
    ("is_availability_group_error = 1", 35), ("is_database_access_error = 1", 30),
    ("is_failed_login = 1 and login_burst_flag = 1", 35), ("is_permission_error = 1", 25),
    ("is_connection_error = 1", 22), ("is_failed_login = 1 and login_burst_flag = 0", 20),
    ("extreme_burst_flag = 1 and burst_density > 0.5", 18), ("is_rare_client_ip = 1 and is_service_account = 0", 15),
    ("is_high_severity_error = 1", 20), ("is_fdhost_crash = 1", 10), ("is_grok_failure = 1", 8),
]
ES_SIGNALS = [
    ("is_oom_error = 1", 40), ("is_circuit_breaker = 1", 35), ("is_master_election = 1", 35),
    ("is_shard_failure = 1", 30), ("is_high_disk_watermark = 1", 28), ("is_node_event = 1", 25),
    ("is_connection_error = 1", 22), ("is_gc_overhead = 1", 20), ("is_slow_log = 1", 15),
    ("is_shard_relocation = 1", 12), ("is_exception = 1", 10), ("is_high_cpu = 1", 10),
]
# ---- fixed values: points for the hour, first match wins, last entry is the rest ----
PEAK = "hour_of_day in (8, 9, 10, 17, 18, 19)"
MONGODB_HOURS = [(PEAK, 10), ("hour_of_day between 0 and 5", 5), ("true", 7)]
MSSQL_HOURS = [("is_night_login = 1 and is_weekend = 1", 10), ("is_night_login = 1", 8), ("is_weekend = 1", 7),
               (PEAK, 6), ("true", 3)]
ES_HOURS = [("is_business_hours = 1", 10), ("is_weekend = 1", 7), (PEAK, 8), ("true", 4)]

PROFILES = {
    "mongodb": ("c", COMPONENT_POINTS, 5, MONGODB_SIGNALS, MONGODB_HOURS),
    "mssql": ("logtype", LOGTYPE_POINTS, 8, MSSQL_SIGNALS, MSSQL_HOURS),
    "elasticsearch": ("log_level", LEVEL_POINTS, 8, ES_SIGNALS, ES_HOURS),
}


def points(pairs: dict[str, int], value: Column, default: int) -> Column:
    out = None
    for name, score in pairs.items():
        out = F.when(value == name, score) if out is None else out.when(value == name, score)
    return out.otherwise(default)


def score_severity(df: DataFrame, source: str) -> DataFrame:
    """Adds severity_score and severity_level; the bonus goes to lines a rule overrode."""
    origin, table, default, signals, hours = PROFILES[source]
    signal_sum = reduce(lambda a, b: a + b, [F.when(F.expr(c), p).otherwise(0) for c, p in signals])
    hour = None
    for cond, p in hours:
        hour = F.when(F.expr(cond), p) if hour is None else hour.when(F.expr(cond), p)
    bonus = F.when(F.col("rule_hit").isNotNull(), 20).otherwise(0)
    total = (F.abs("anomaly_score") * 40 + points(table, F.col(origin), default)
             + F.least(F.lit(40), signal_sum) + hour + bonus)
    df = df.withColumn("severity_score", F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)).cast("double"))
    return df.withColumn("severity_level", severity_level(F.col("severity_score")))

"""Expert rules: an ordered table of named conditions that overrides what a model calls normal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    """One rule; `condition` is SQL over the enriched line. Users extend a list of these."""

    name: str
    severity: float
    condition: str
    description: str


# ---- fixed values: rules per source, first match wins ----
MONGODB = [
    Rule("system_failure", 1.0, "is_fatal = 1 or is_out_of_memory = 1 or is_shutdown = 1", "system failure"),
    Rule("memory_crisis", 0.95, "is_out_of_memory = 1 or is_memory_limit = 1", "memory crisis"),
    Rule("massive_scan", 1.0, "raw_docs_examined > 1000000", "more than a million documents scanned"),
    Rule("performance_critical", 0.85, "is_collscan = 1 and raw_docs_examined > 100000", "heavy collection scan"),
    Rule("inefficient_index", 0.85, "raw_keys_examined > 10000 and raw_docs_examined > 10000 and "
         "raw_keys_examined > raw_docs_examined * 2", "index reads twice the documents it finds"),
    Rule("long_transaction", 0.90, "c = 'TXN' and raw_duration_ms > 3000", "transaction above three seconds"),
    Rule("replication_risk", 0.90, "is_replication_issue = 1", "replication integrity risk"),
    Rule("memory_pressure", 0.88, "is_memory_limit = 1 or (is_wiredtiger_event = 1 and severity_W = 1)",
         "memory or cache pressure"),
    Rule("error_burst", 0.90, "is_error = 1 and extreme_burst_flag = 1", "errors in a burst"),
    Rule("security_alert", 0.88, "is_drop_operation = 1 or is_assertion = 1", "drop or assertion"),
    Rule("post_restart_errors", 0.85, "is_restart = 1", "around a restart"),
]
MSSQL = [
    Rule("brute_force_attempt", 0.95, "is_failed_login = 1 and login_burst_flag = 1", "rapid failed logins"),
    Rule("credential_stuffing", 0.92, "is_failed_login = 1 and is_rare_client_ip = 0 and is_rare_username = 1",
         "rare user failing from a common address"),
    Rule("after_hours_login", 0.85, "is_successful_login = 1 and is_night_login = 1 and is_service_account = 0",
         "night login of a person"),
    Rule("weekend_login", 0.80, "is_successful_login = 1 and is_weekend = 1 and is_service_account = 0 and "
         "is_local_client = 0", "remote weekend login of a person"),
    Rule("suspicious_service_account", 0.88, "is_service_account = 1 and is_local_client = 0 and "
         "is_rare_client_ip = 1", "service account from a rare address"),
    Rule("availability_group_crisis", 0.90, "is_availability_group_error = 1", "availability group error"),
    Rule("database_access_failure", 0.85, "is_database_access_error = 1", "database cannot be opened"),
    Rule("connection_crisis", 0.80, "is_connection_error = 1", "connection error"),
    Rule("mass_failed_logins", 0.90, "is_failed_login = 1 and failed_login_ratio_1h > 0.3",
         "many failed logins in the hour"),
    Rule("login_burst_storm", 0.85, "extreme_burst_flag = 1 and burst_density > 0.5", "login storm"),
    Rule("unparsed_critical_log", 0.82, "is_grok_failure = 1 and (is_availability_group_error = 1 or "
         "is_database_access_error = 1)", "critical line the shipper could not parse"),
    Rule("new_ip_for_user", 0.75, "is_successful_login = 1 and is_rare_client_ip = 1 and is_service_account = 0",
         "login from a rare address"),
    Rule("high_severity_error", 0.88, "is_high_severity_error = 1 and is_login_event = 0", "severity 17 or above"),
    Rule("fdhost_crash_storm", 0.65, "is_fdhost_crash = 1 and is_system_error = 1", "filter daemon crash"),
]
ELASTICSEARCH = [
    Rule("cluster_instability", 0.95, "is_master_election = 1 or (is_node_event = 1 and is_error = 1)",
         "election or node loss with errors"),
    Rule("memory_crisis", 0.95, "is_oom_error = 1 or is_circuit_breaker = 1", "heap exhausted"),
    Rule("disk_crisis", 0.90, "is_high_disk_watermark = 1 and is_error = 1", "disk watermark with errors"),
    Rule("disk_warning", 0.80, "is_high_disk_watermark = 1 and is_warn = 1", "disk watermark"),
    Rule("shard_failure", 0.88, "is_shard_failure = 1", "shard failure"),
    Rule("shard_relocation_storm", 0.82, "is_shard_relocation = 1 and extreme_burst_flag = 1", "shards moving in bursts"),
    Rule("gc_storm", 0.85, "is_gc_overhead = 1 and burst_density > 0.3", "frequent collection pauses"),
    Rule("gc_warning", 0.75, "is_gc_overhead = 1", "collection pause"),
    Rule("connection_storm", 0.82, "is_connection_error = 1 and extreme_burst_flag = 1", "connection errors in a burst"),
    Rule("error_burst", 0.85, "is_error = 1 and extreme_burst_flag = 1 and burst_density > 0.5", "errors in a burst"),
    Rule("node_event", 0.78, "is_node_event = 1", "node joined or left"),
]
RULES = {"mongodb": MONGODB, "mssql": MSSQL, "elasticsearch": ELASTICSEARCH}


def _chain(rules: list[Rule], value) -> Column:
    out = None
    for r in rules:
        out = F.when(F.expr(r.condition), value(r)) if out is None else out.when(F.expr(r.condition), value(r))
    return out


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule_hit and rule_severity of the first matching rule, on lines the model called normal (prediction 1);
    such a line becomes an anomaly whose score is at most minus the severity."""
    df = df.withColumn("rule_hit", F.when(F.col("prediction") == 1, _chain(rules, lambda r: F.lit(r.name))))
    weight = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.severity)])
    df = df.withColumn("rule_severity", F.when(F.col("rule_hit").isNotNull(), weight[F.col("rule_hit")]))
    hit = F.col("rule_hit").isNotNull()
    return df.withColumns({
        "prediction": F.when(hit, F.lit(-1)).otherwise(F.col("prediction")),
        "anomaly_score": F.when(hit, F.least(F.col("anomaly_score"), -F.col("rule_severity")))
        .otherwise(F.col("anomaly_score")),
    })


def rule_statistics(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Hits per rule with severity and description; rules that never fired count 0."""
    table = df.sparkSession.createDataFrame([(r.name, r.severity, r.description) for r in rules],
                                            "rule_name string, severity double, description string")
    hits = df.filter("rule_hit is not null").groupBy(F.col("rule_hit").alias("rule_name")).agg(
        F.count(F.lit(1)).alias("hits"))
    return table.join(F.broadcast(hits), "rule_name", "left").withColumn(
        "hits", F.coalesce("hits", F.lit(0).cast("bigint")))

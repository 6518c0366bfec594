"""From scored lines to analyses: summaries, distributions, alerts, hotspots, selections and filters.

Input lines carry prediction (-1 anomaly, 1 normal), anomaly_score, severity_score and severity_level. Every
grouping here combines map-side; lists keep a fixed number of ids through a partial top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievelog.functions import patterns as P, text as X, values as V
from sievelog.functions.substrings import candidates
from sievelog.operators.lookup import attach, null_safe
from sievelog.operators.sequence import top_n

LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
IS_ANOMALY = "prediction = -1"

# ---- fixed values: alert name -> condition on a line ----
SECURITY_ALERTS = {
    "mongodb": {
        "drop_operations": "is_drop_operation = 1", "out_of_memory": "is_out_of_memory = 1", "restarts": "is_restart = 1",
        "memory_limits": "is_memory_limit = 1", "shutdowns": "is_shutdown = 1", "assertions": "is_assertion = 1",
        "fatal_errors": "is_fatal = 1", "auth_failures": "is_auth_failure = 1"},
    "mssql": {
        "failed_logins": "is_failed_login = 1", "availability_group_errors": "is_availability_group_error = 1",
        "database_access_errors": "is_database_access_error = 1", "connection_errors": "is_connection_error = 1",
        "permission_errors": "is_permission_error = 1"},
    "elasticsearch": {
        "oom_errors": "is_oom_error = 1", "circuit_breakers": "is_circuit_breaker = 1",
        "disk_warnings": "is_high_disk_watermark = 1", "shard_failures": "is_shard_failure = 1",
        "node_events": "is_node_event = 1", "master_elections": "is_master_election = 1",
        "gc_events": "is_gc_overhead = 1", "connection_errors": "is_connection_error = 1"},
}
PERFORMANCE_ALERTS = {
    "collscans": ("is_collscan = 1", "docs_examined_count"), "slow_queries": ("is_slow_query = 1", "query_duration_ms"),
    "index_builds": ("is_index_build = 1", "query_duration_ms"), "high_doc_scans": ("is_high_doc_scan = 1", "docs_examined_count"),
}


def summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, rate, score range and severity levels per analysis."""
    bad = F.expr(IS_ANOMALY)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_logs"), F.count_if(bad).alias("n_anomalies"),
        (F.avg(bad.cast("int")) * 100).alias("anomaly_rate"),
        F.min("anomaly_score").alias("score_min"), F.max("anomaly_score").alias("score_max"),
        F.avg("anomaly_score").alias("score_mean"), F.stddev_pop("anomaly_score").alias("score_std"),
        *[F.count_if(bad & (F.col("severity_level") == lv)).alias(f"sev_{lv.lower()}") for lv in LEVELS])


def hourly(df: DataFrame, keys: list[str], hour: str = "hour_of_day") -> DataFrame:
    return df.filter(IS_ANOMALY).groupBy(*keys, hour).agg(F.count(F.lit(1)).alias("n"))


def peak_hours(df: DataFrame, keys: list[str], n: int = 3, hour: str = "hour_of_day") -> DataFrame:
    """The n busiest hours; equal counts by hour."""
    best = top_n(hourly(df, keys, hour), keys, [F.col("n").desc(), F.col(hour)], n)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), hour))),
                                               lambda s: s[hour]).alias("peak_hours"))


def component_rates(df: DataFrame, keys: list[str], component: str = "c") -> DataFrame:
    return df.groupBy(*keys, component).agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(F.expr(IS_ANOMALY)).alias("anomaly_count"),
        (F.avg(F.expr(IS_ANOMALY).cast("int")) * 100).alias("anomaly_rate"))


def alert_counts(df: DataFrame, keys: list[str], alerts: dict[str, str], ids: int = 10) -> DataFrame:
    """Anomalies per alert with the first ids in order. One line may raise several alerts."""
    fired = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in alerts.items()]))
    rows = df.filter(IS_ANOMALY).select(*keys, "log_id", F.explode(fired).alias("alert"))
    counts = rows.groupBy(*keys, "alert").agg(F.count(F.lit(1)).alias("count"))
    first = top_n(rows, [*keys, "alert"], [F.col("log_id")], ids).groupBy(*keys, "alert").agg(
        F.array_sort(F.collect_list("log_id")).alias("first_ids"))
    return counts.join(first, [*keys, "alert"])


def performance_alerts(df: DataFrame, keys: list[str], ids: int = 10) -> DataFrame:
    """As alert_counts, with mean and maximum of the alert's own number."""
    counts = alert_counts(df, keys, {n: c for n, (c, _) in PERFORMANCE_ALERTS.items()}, ids)
    long = F.array(*[F.when(F.expr(c), F.struct(F.lit(n).alias("alert"), F.col(v).cast("double").alias("v")))
                     for n, (c, v) in PERFORMANCE_ALERTS.items()])
    stats = (df.filter(IS_ANOMALY).select(*keys, F.explode(F.array_compact(long)).alias("x"))
             .groupBy(*keys, F.col("x.alert").alias("alert"))
             .agg(F.avg("x.v").alias("mean_value"), F.max("x.v").alias("max_value")))
    return counts.join(stats, [*keys, "alert"])


def dominant_patterns(df: DataFrame, keys: list[str], n: int = 7) -> DataFrame:
    """Fingerprints with most anomalies: count, mean severity, a sample message, a component, and the fingerprint cut to
    120 characters for show. Lines without a fingerprint form no pattern."""
    named = df.filter(IS_ANOMALY).filter(F.coalesce("message_fingerprint", F.lit("")) != "")
    groups = named.groupBy(*keys, F.col("message_fingerprint").alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("severity_score").alias("mean_severity"),
        F.max("severity_score").alias("max_severity"), F.min_by(F.substring("msg", 1, 200), "log_id").alias("sample"),
        F.min_by("c", "log_id").alias("component"))
    return top_n(groups, keys, [F.col("count").desc(), F.col("fingerprint")], n).withColumn("shown", F.substring("fingerprint", 1, 120))


def feature_statistics(df: DataFrame, features: list[str], binary: list[str]) -> DataFrame:
    """Count and share of 0/1 features, mean, deviation and range of the others; one pass, then unpivoted."""
    stats = lambda c: F.struct(
        F.lit(c).alias("feature"), F.lit("binary" if c in binary else "continuous").alias("kind"),
        (F.sum(c) if c in binary else F.lit(None)).cast("double").alias("count"),
        (F.avg(c) * 100 if c in binary else F.lit(None)).cast("double").alias("percentage"),
        (F.lit(None) if c in binary else F.avg(c)).cast("double").alias("mean"),
        (F.lit(None) if c in binary else F.stddev_samp(c)).cast("double").alias("std"),
        F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))
    return df.agg(F.array(*[stats(c) for c in features]).alias("a")).select(F.inline("a"))


def zero_variance(df: DataFrame, features: list[str]) -> DataFrame:
    """Features with a single value, by equal minimum and maximum."""
    one = lambda c: F.struct(F.lit(c).alias("feature"), F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias("constant"))
    return df.agg(F.array(*[one(c) for c in features]).alias("a")).select(F.inline("a")).filter("constant").select("feature")


# ---- selections ----

def by_severity() -> list[Column]:
    return [F.col("severity_score").desc(), F.col("log_id")]


def cap_per_fingerprint(df: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """At most n lines per fingerprint, most severe first; lines without fingerprint all stay."""
    has = F.coalesce("message_fingerprint", F.lit("")) != ""
    return top_n(df.filter(has), [*keys, "message_fingerprint"], by_severity(), n).unionByName(df.filter(~has))


def critical_lines(df: DataFrame, keys: list[str], source: str = "mongodb", message: str = "msg",
                   min_score: float = 40, cap: int = 500, per_fingerprint: int = 5) -> DataFrame:
    """Stage one: severe or critical by text, the most severe `cap` per analysis, then the fingerprint cap."""
    keep = (F.col("severity_score") > min_score) | X.is_critical_message(F.col(message), source)
    best = top_n(df.filter(IS_ANOMALY).filter(keep), keys, by_severity(), cap)
    return cap_per_fingerprint(best, keys, per_fingerprint)


def rescue_critical(df: DataFrame, chosen: DataFrame, keys: list[str], source: str, message: str, extra: int = 100,
                    cap: int = 500) -> DataFrame:
    """Adds up to `extra` lines (in log order) whose text is critical for the source, then caps by severity."""
    missed = df.filter(IS_ANOMALY).filter(X.is_critical_message(F.col(message), source)).join(
        chosen.select(*keys, "log_id"), [*keys, "log_id"], "left_anti")
    added = top_n(missed, keys, [F.col("log_id")], extra)
    return top_n(chosen.unionByName(added, allowMissingColumns=True), keys, by_severity(), cap)


def tag_benign(df: DataFrame, message: str = "msg", component: str = "c",
               signatures: list[tuple] = P.BENIGN_SIGNATURES) -> DataFrame:
    """Marks known noise with the reason of the first signature that fits. The signature list is a fixed short
    table, so it is a CASE and not a join; `tag_by_table` takes lists of any length."""
    low, comp = F.lower(message), F.col(component)
    reason = None
    for _, pattern, wanted, text in signatures:
        fits = low.contains(pattern.lower()) & (comp == wanted if wanted else F.lit(True))
        reason = F.when(fits, F.lit(text)) if reason is None else reason.when(fits, F.lit(text))
    return df.withColumn("benign_reason", reason).withColumn("is_known_benign", F.col("benign_reason").isNotNull())


def first_signatures(df: DataFrame, signatures: DataFrame, keys: list[str], message: str = "msg", component: str = "c") -> DataFrame:
    """(keys, benign_order, benign_reason) of the rows that a signature (order, pattern, component, reason) fits: the message
    holds the pattern in any case, and the component is the same or the signature names none. The first by order wins,
    equal orders go by pattern and reason.

    All patterns are looked for in one pass over a message (`substrings.candidates`), and what may be one meets the signatures
    by a hash join on the whole pattern and its component, so work grows with text and matches: neither with lines times
    signatures, nor with signatures that have parts in common. Signatures are read while the plan is built, and again by
    it. The empty pattern is in every message; a null pattern, or a null message, fits nothing. `keys` name a row; rows that
    repeat them share the first reason of all.
    """
    known = signatures.filter("pattern is not null").groupBy(
        F.lower("pattern").alias("_pattern"), F.col("component").alias("_component")).agg(
        F.min(F.struct("order", F.col("reason").alias("reason"))).alias("_sign"))
    rows = df.select(*keys, F.lower(message).alias("_text"), F.col(component).alias("_c")).filter("_text is not null")
    held = rows.select(*keys, "_c", F.explode(candidates(known.drop("_sign"), F.col("_text"), F.col("_c"))).alias("_held"))
    named = held.select(*keys, F.col("_held.text").cast("string").alias("_part"), F.when(F.col("_held.own"), F.col("_c")).alias("_of"))
    hits = named.join(known, (F.col("_part") == F.col("_pattern")) & F.col("_of").eqNullSafe(F.col("_component")))
    best = hits.groupBy(*keys).agg(F.min(F.struct("_sign.order", "_pattern", "_sign.reason")).alias("_first"))
    return best.select(*keys, F.col("_first.order").alias("benign_order"), F.col("_first.reason").alias("benign_reason"))


def tag_by_table(df: DataFrame, signatures: DataFrame, keys: list[str], message: str = "msg", component: str = "c") -> DataFrame:
    """`tag_benign` with the signatures of a table, of any number: adds benign_order, benign_reason and is_known_benign."""
    found = first_signatures(df, signatures, keys, message, component)
    return null_safe(df, found, keys, "left").withColumn("is_known_benign", F.col("benign_order").isNotNull())


def filter_false_positives(df: DataFrame, rates: DataFrame, keys: list[str], max_rows: int = 2000,
                           max_share: float = 0.15) -> DataFrame:
    """Stage two on critical lines: components that are nearly all anomalous go (five protected ones stay), a line
    needs a critical text, score or level, and one fingerprint keeps at most max(3, 15 %) of the rest."""
    noisy = rates.filter((F.col("anomaly_rate") > 99.5) & (F.col("total_count") > 100)
                         & ~F.col("c").isin(P.PROTECTED_COMPONENTS)).select(*keys, "c")
    rows = tag_benign(df).join(noisy, [*keys, "c"], "left_anti")
    low, score = F.lower("msg"), F.col("severity_score")
    text = (X.is_critical_message(F.col("msg"), "mongodb") | low.contains("restart")
            | (low.contains("slow query") & (score > 45)))
    kept = top_n(rows.filter(text | (score > 30) | F.col("severity_level").isin("CRITICAL", "HIGH", "MEDIUM")),
                 keys, by_severity(), max_rows)
    return cap_share(kept, keys, max_share)


def cap_share(df: DataFrame, keys: list[str], max_share: float = 0.15, at_least: int = 3) -> DataFrame:
    """One fingerprint keeps at most max(at_least, share of its analysis); input is one capped list per analysis."""
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys, "message_fingerprint").orderBy(*by_severity()))
    limit = F.greatest(F.lit(at_least), F.floor(F.col("_total") * max_share))
    return (df.withColumn("_total", total).withColumn("_rank", rank)
            .filter((F.col("_rank") <= limit) | (F.coalesce("message_fingerprint", F.lit("")) == ""))
            .drop("_total", "_rank"))


def diverse_by_rank(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Round robin over fingerprints: all best lines, then all second best, and so on."""
    rank = F.row_number().over(Window.partitionBy(*keys, "message_fingerprint").orderBy(*by_severity()))
    ranked = df.withColumn("_fp_rank", rank).filter(F.col("_fp_rank") <= limit)
    return top_n(ranked, keys, [F.col("_fp_rank"), *by_severity()], limit).drop("_fp_rank")


def diverse_by_category(df: DataFrame, keys: list[str], category: str, limit: int) -> DataFrame:
    """Every category gets max(2, limit / (2 * categories)) lines, the rest fills up by severity."""
    cats = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.greatest(F.lit(2), F.floor(F.lit(limit) / (F.count(F.lit(1)) * 2))).alias("_quota"))
    rank = F.row_number().over(Window.partitionBy(*keys, category).orderBy(*by_severity()))
    ranked = df.withColumn("_cat_rank", rank).filter(F.col("_cat_rank") <= limit)
    flagged = attach(ranked, cats, keys).withColumn("_extra", (F.col("_cat_rank") > F.col("_quota")).cast("int"))
    return top_n(flagged, keys, [F.col("_extra"), *by_severity()], limit).drop("_cat_rank", "_quota", "_extra")


def chunks(df: DataFrame, keys: list[str], size: int = 20) -> DataFrame:
    """Chunk number by severity order of a capped list."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by_severity()))
    return df.withColumn("chunk", F.floor((rank - 1) / F.lit(size)).cast("int"))


def chunk_relevance(df: DataFrame, keys: list[str], words: list[str], best: int = 50) -> DataFrame:
    """Relevance of each chunk to the words, capped at 100; the best chunks in their original order."""
    hits = sum([F.lower("msg").contains(w.lower()).cast("int") for w in words], F.lit(0))
    recency = F.lit(10) - F.least(F.lit(10), F.col("chunk"))
    score = (F.sum(hits) * 10 + F.count_if(F.col("severity_score") > 70) * 5 + F.count_distinct("c") * 2
             + F.max(recency) + F.avg("severity_score") / 10)
    scored = df.groupBy(*keys, "chunk").agg(F.least(F.lit(100.0), score).alias("relevance"))
    return top_n(scored, keys, [F.col("relevance").desc(), F.col("chunk")], best).orderBy(*keys, "chunk")


def temporal_patterns(hours: DataFrame, keys: list[str], hour: str = "hour_of_day") -> DataFrame:
    """Working-hour and night shares, and the smallest period that holds 80 % of the anomalies in one residue."""
    total = F.sum("n")
    share = lambda lo, hi: F.sum(F.when(F.col(hour).between(lo, hi), F.col("n")).otherwise(0)) / total * 100
    parts = {k: [F.sum(F.when(F.col(hour) % k == r, F.col("n")).otherwise(0)) for r in range(k)]
             for k in (2, 3, 4, 6, 8, 12)}
    period = F.coalesce(*[F.when(F.greatest(*p) / total >= 0.8, F.lit(k)) for k, p in parts.items()])
    return hours.groupBy(*keys).agg(share(9, 18).alias("work_share"), share(0, 5).alias("night_share"),
                                    period.alias("period_hours")).withColumns({
        "is_work_heavy": F.col("work_share") > 60, "is_night_heavy": F.col("night_share") > 30})


def hosts_report(df: DataFrame, failed: Column, ok: Column) -> DataFrame:
    """Lines, outcomes and newest line per host."""
    return df.groupBy("host").agg(
        F.count(F.lit(1)).alias("total_logs"), F.count_if(ok).alias("succeeded"), F.count_if(failed).alias("failed"),
        (F.avg(failed.cast("int")) * 100).alias("failed_ratio"), F.max(V.micros(F.col("ts"))).alias("latest_us"))


def active_hosts(df: DataFrame, pattern: str | None = None, n: int = 100) -> DataFrame:
    """Hosts by line count; a name pattern applies only when some host fits it."""
    counts = df.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    if pattern is not None:
        counts = counts.withColumn("_fits", X.search(F.col("host"), pattern))
        any_fit = counts.agg(F.max("_fits")).scalar()
        counts = counts.filter(F.col("_fits") | ~any_fit).drop("_fits")
    return counts.orderBy(F.col("n").desc(), "host").limit(n)


def filled_hours(df: DataFrame, keys: list[str]) -> DataFrame:
    """Lines per hour with the empty hours between first and last as 0."""
    hours = df.groupBy(*keys, F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = hours.groupBy(*keys).agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select(
        *keys, F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    return grid.join(hours, [*keys, "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


# ---- hosts and clusters ----

def map_clusters(hosts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cluster, display name and environment of every host; what no mapping names is 'unmapped'."""
    keyed = hosts.withColumn("host_norm", X.normalize_host(F.col("host")))
    dim = mapping.withColumn("host_norm", X.normalize_host(F.col("member"))).drop("member")
    return attach(keyed, dim, ["host_norm"]).withColumn("cluster_id", F.coalesce("cluster_id", F.lit("unmapped")))


def cluster_rollup(lines: DataFrame) -> DataFrame:
    """Totals per host and per cluster in one pass; cluster rows have host null."""
    return lines.rollup("cluster_id", "host").agg(
        F.count(F.lit(1)).alias("total_logs"), F.count_if(F.expr(IS_ANOMALY)).alias("n_anomalies"),
        (F.avg(F.expr(IS_ANOMALY).cast("int")) * 100).alias("anomaly_rate")).filter("cluster_id is not null")


def severity_order(level: Column, order: list[str] = ["CRITICAL", "WARNING", "INFO", "OK"]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), level)

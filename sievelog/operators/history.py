"""The history of analyses: building it, and the questions dashboards ask of it.

One row per (host, source_type, ts). A host has a bounded number of analyses (one per run within the retention),
so windows by host are safe here; they would not be over log lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievelog.operators import analysis as A

RISK = {"CRITICAL": 3, "WARNING": 2, "INFO": 1, "OK": 0}


def build_history(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Analyses from scored lines: summary, severity counts, alert counts, peak hours, anomalies by component."""
    bad = F.expr(A.IS_ANOMALY)
    base = A.summary(lines, keys)
    counts = lines.groupBy(*keys).agg(
        F.count_if(bad & (F.col("is_auth_failure") == 1)).alias("auth_failures"),
        F.count_if(F.col("is_collscan") == 1).alias("collscans"),
        F.count_if(F.col("is_slow_query") == 1).alias("slow_queries"),
        F.count_if(F.col("is_drop_operation") == 1).alias("drop_operations"))
    parts = A.component_rates(lines, keys).filter("anomaly_count > 0").groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "anomaly_count")))).alias("components"))
    peaks = A.peak_hours(lines, keys)
    return base.join(counts, keys).join(parts, keys, "left").join(peaks, keys, "left")


def latest_per_key(df: DataFrame, keys: list[str], ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Newest record of every key, by one map-side combined aggregate."""
    order = F.struct(ts, *([tie] if tie else []))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def last_n(df: DataFrame, keys: list[str], n: int = 10, ts: str = "ts") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ts).desc()))
    return df.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def previous_baseline(df: DataFrame, keys: list[str], value: str, ts: str = "ts") -> Column:
    """Most recent non-null value before the record."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, True).over(w)


def history_page(df: DataFrame, start=None, end=None, host: str | None = None, min_rate: float | None = None,
                 skip: int = 0, limit: int = 50) -> DataFrame:
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast(df.schema["ts"].dataType))
    if end is not None:
        df = df.filter(F.col("ts") < F.lit(end).cast(df.schema["ts"].dataType))
    if host is not None:
        df = df.filter(F.col("host") == host)
    if min_rate is not None:
        df = df.filter(F.col("anomaly_rate") >= min_rate)
    return df.orderBy(F.col("ts").desc(), "host").offset(skip).limit(limit)


def statistics(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("analyses"), F.sum("n_anomalies").alias("anomalies"), F.sum("total_logs").alias("logs"),
        F.round(F.avg("anomaly_rate"), 2).alias("avg_rate"), F.round(F.max("anomaly_rate"), 2).alias("max_rate"),
        F.count_distinct("host").alias("hosts"))


def recent_metrics(df: DataFrame, n: int = 10) -> DataFrame:
    """Sums and rates over the newest n analyses of every host."""
    return last_n(df, ["host"], n).groupBy("host").agg(
        F.sum("n_anomalies").alias("anomalies"), F.sum("total_logs").alias("logs"),
        (F.sum("n_anomalies") / F.sum("total_logs") * 100).alias("rate"),
        (F.lit(100) - F.sum("n_anomalies") / F.sum("total_logs") * 100).alias("normal_rate"))


def ensemble_weights(df: DataFrame, keys: list[str], ts: str, keep: int = 10) -> DataFrame:
    """Weight of every model of a key: each new model enters with 1, older ones decay by 0.9, all renormalised.
    In closed form the k-th newest has (1/1.9)(0.9/1.9)^k and the oldest (0.9/1.9)^(m-1); the newest `keep` stay."""
    w = Window.partitionBy(*keys)
    age = F.row_number().over(w.orderBy(F.col(ts).desc())) - 1
    raw = F.when(F.col("age") == F.col("models") - 1, F.pow(F.lit(0.9 / 1.9), F.col("age"))).otherwise(
        F.pow(F.lit(0.9 / 1.9), F.col("age")) / F.lit(1.9))
    aged = df.withColumn("age", age).withColumn("models", F.count(F.lit(1)).over(w)).withColumn("_raw", raw)
    return (aged.filter(F.col("age") < keep).withColumn("weight", F.col("_raw") / F.sum("_raw").over(w))
            .drop("_raw", "models"))


# ---- retention ----

def drop_expired(df: DataFrame, ref: Column, days: int, ts: str = "ts") -> DataFrame:
    """Rows within the retention; the filter is on the partition column's source, so old partitions are skipped."""
    return df.filter(F.col(ts) >= ref - F.make_dt_interval(days=F.lit(days)))


def keep_versions(df: DataFrame, keys: list[str], n: int, version: str = "version", active: str = "is_active") -> DataFrame:
    """Newest n versions per key; the active one always stays."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(version).desc()))
    return df.withColumn("_r", rank).filter((F.col("_r") <= n) | F.col(active)).drop("_r")


def trim_oldest(df: DataFrame, ts: str, tie: str, share: float = 0.2, chunk_micros: int = 10_000_000) -> DataFrame:
    """Drops the oldest share of rows exactly: whole time chunks by their running count, only the chunk on the
    border is ranked."""
    from sievelog.functions.values import micros
    rows = df.withColumn("_chunk", F.coalesce(F.floor(micros(F.col(ts)) / F.lit(chunk_micros)), F.lit(-1)))
    per = rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    total = per.agg(F.floor(F.sum("_n") * share)).scalar()
    # one row per ten seconds of log: the running count is one ordered pass over that small table
    older = F.coalesce(F.sum("_n").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = per.withColumn("_older", older).withColumn("_drop", total)
    kept = rows.join(edges.filter(F.col("_older") + F.col("_n") > F.col("_drop")), "_chunk")
    whole = kept.filter(F.col("_older") >= F.col("_drop"))
    rank = F.row_number().over(Window.partitionBy("_chunk").orderBy(ts, tie))
    border = (kept.filter(F.col("_older") < F.col("_drop")).withColumn("_r", rank)
              .filter(F.col("_r") > F.col("_drop") - F.col("_older")).drop("_r"))
    return whole.unionByName(border).drop("_chunk", "_n", "_older", "_drop")


# ---- prediction alerts ----

def alert_summary(df: DataFrame) -> DataFrame:
    """(source, severity) cells and the grand total, by grouping sets."""
    return df.groupingSets([[F.col("alert_source"), F.col("max_severity")], []], F.col("alert_source"), F.col("max_severity")).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("has_alerts")).alias("with_alerts"),
        F.max("ts").alias("latest"), F.grouping_id().alias("level"))


def alert_series(df: DataFrame, bucket: Column, sources: list[str]) -> DataFrame:
    """Checks and alerts per bucket, one pair of columns per source, and the bucket totals."""
    return df.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("has_alerts")).alias("alerts"),
        *[F.count_if(F.col("alert_source") == s).alias(f"{s}_checks") for s in sources],
        *[F.count_if((F.col("alert_source") == s) & F.col("has_alerts")).alias(f"{s}_alerts") for s in sources])


def server_overview(df: DataFrame) -> DataFrame:
    """Checks, alert rate, severities, last check and risk level per server, worst first."""
    out = df.groupBy("host").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("has_alerts")).alias("alerts"),
        (F.avg(F.col("has_alerts").cast("int")) * 100).alias("alert_rate"),
        F.count_if(F.col("max_severity") == "CRITICAL").alias("criticals"),
        F.count_if(F.col("max_severity") == "WARNING").alias("warnings"),
        F.max("ts").alias("last_check"), F.max(_rank(F.col("max_severity"))).alias("worst"))
    level = (F.when(F.col("criticals") > 0, "CRITICAL").when(F.col("warnings") > 0, "WARNING")
             .when(F.col("alerts") > 0, "INFO").otherwise("OK"))
    return out.withColumn("risk_level", level).orderBy(F.col("worst").desc(), F.col("alerts").desc(), "host")


def _rank(level: Column) -> Column:
    out = None
    for name, value in RISK.items():
        out = F.when(level == name, value) if out is None else out.when(level == name, value)
    return out.otherwise(0)


def alerts_page(df: DataFrame, ref: Column, days: int, host: str | None = None, source: str | None = None,
                only_alerts: bool = False, limit: int = 50) -> DataFrame:
    rows = drop_expired(df, ref, days)
    if host is not None:
        rows = rows.filter(F.col("host") == host)
    if source is not None:
        rows = rows.filter(F.col("alert_source") == source)
    if only_alerts:
        rows = rows.filter("has_alerts")
    return rows.orderBy(F.col("ts").desc(), "host", "alert_source").limit(limit)


def combined_insight(df: DataFrame) -> DataFrame:
    """Risk per server from its latest alerts by source: the worst one, raised when several sources agree
    (two give at least WARNING, three CRITICAL)."""
    agreeing = F.count_distinct(F.when(F.col("has_alerts"), F.col("alert_source")))
    out = df.groupBy("host").agg(F.max(_rank(F.col("max_severity"))).alias("worst"), agreeing.alias("sources_alerting"))
    boosted = F.greatest("worst", F.when(F.col("sources_alerting") >= 3, 3).when(F.col("sources_alerting") >= 2, 2).otherwise(0))
    return out.withColumn("risk_level", F.element_at(F.array(*map(F.lit, ["OK", "INFO", "WARNING", "CRITICAL"])), boosted + 1))


# ---- feedback ----

def feedback_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Precision of confirmed anomalies; confidence grows with the number of labels."""
    tp = F.count_if(F.col("label") == "true_positive")
    fp = F.count_if(F.col("label") == "false_positive")
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        tp.alias("true_positives"), fp.alias("false_positives"), (tp / n).alias("precision"), (fp / n).alias("fp_rate"),
        F.when(n >= 50, "high").when(n >= 20, "medium").when(n >= 5, "low").otherwise("very_low").alias("confidence"))

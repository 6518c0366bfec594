"""Signals of the three log sources. Flags are fused into one projection; counts, order and trailing spans
come from the shared lookup and sequence operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievelog.functions import patterns as P, text as X, values as V
from sievelog.operators.lookup import attach
from sievelog.operators.sequence import rolling_mean, trailing_sums, with_previous

HOUR = 3_600_000_000


# ---- document-database source ----

def message_flags(df: DataFrame) -> DataFrame:
    """All 0/1 flags that look at one line only."""
    msg, s = F.col("msg"), F.col("s")
    df = df.withColumn("_low", F.lower(msg))
    hit = {n: X.search(msg, p, n in P.CASE_SENSITIVE, F.col("_low")) for n, p in P.MONGO_FLAGS.items()}
    hit["is_auth_failure"] = hit["is_auth_failure"] | (msg == P.AUTH_FAILURE_TEXT)
    hit["is_fatal"] = hit["is_fatal"] & ~hit["is_normal_replication"]
    hit["is_error"] = hit["is_error"] | (s == "E")
    hit["is_auth_success"] = msg == P.AUTH_SUCCESS_TEXT
    hit["is_reauthenticate"] = msg == P.REAUTHENTICATE_TEXT
    hit["severity_W"] = s == "W"
    return df.withColumns({n: X.flag(e) for n, e in hit.items()}).drop("_low")


def component_flags(df: DataFrame) -> DataFrame:
    c = F.col("c")
    flags = {n: X.flag(c.isin(v)) for n, v in P.COMPONENT_FLAGS.items()}
    flags["is_unknown_component"] = X.flag(c.isNull() | c.isin(P.UNKNOWN_COMPONENTS))
    score = reduce(lambda a, b: a + b, [flags[n] * w for n, w in P.CRITICALITY_WEIGHTS.items()])
    return df.withColumns({**flags, "component_criticality_score": score})


def numeric_features(df: DataFrame) -> DataFrame:
    """Numbers from the attribute object or the message. The uncapped values stay beside the capped ones:
    rules read `raw_*`, the model reads the capped columns."""
    df = df.withColumn("_attr", F.try_parse_json(F.col("attr")))
    attr, msg = F.col("_attr"), F.col("msg")
    texts = [msg] + ([F.col("raw_log")] if "raw_log" in df.columns else [])
    df = df.withColumns({
        "raw_duration_ms": V.metric_of(attr, texts, "durationMillis"),
        "raw_docs_examined": V.metric_of(attr, [msg], "docsExamined"),
        "raw_keys_examined": V.metric_of(attr, [msg], "keysExamined"),
        "raw_txn_active": V.metric_of(attr, [], "timeActiveMicros"),
        "txn_time_inactive_micros": V.metric_of(attr, [], "timeInactiveMicros"),
    })
    cap = lambda raw, name: F.least(F.col(raw), F.lit(P.CAPS[name]).cast("bigint"))
    df = df.withColumns({
        "query_duration_ms": cap("raw_duration_ms", "query_duration_ms"),
        "docs_examined_count": cap("raw_docs_examined", "docs_examined_count"),
        "keys_examined_count": cap("raw_keys_examined", "keys_examined_count"),
        "txn_time_active_micros": cap("raw_txn_active", "txn_time_active_micros"),
    })
    return df.withColumns({
        "txn_wait_ratio": V.ratio(F.col("txn_time_inactive_micros"), F.col("txn_time_active_micros")),
        "is_long_transaction": X.flag(F.col("query_duration_ms") > 100),
        "performance_score": V.performance_score(
            F.col("is_collscan"), F.col("docs_examined_count"), F.col("keys_examined_count")),
    }).drop("_attr")


def attr_features(df: DataFrame) -> DataFrame:
    """Keys of the attribute object; single-quoted objects are read as well, other text counts as empty."""
    strict = F.json_object_keys("attr")
    loose = F.map_keys(F.from_json("attr", "map<string,string>", {"allowSingleQuotes": "true"}))
    keys = F.coalesce(strict, loose, F.array().cast("array<string>"))
    return df.withColumn("_keys", keys).withColumns({
        "has_error_key": F.array_contains("_keys", "error").cast("int"),
        "attr_key_count": F.size("_keys"),
        "has_many_attrs": (F.size("_keys") > 5).cast("int"),
    }).drop("_keys")


def message_hash(msg: Column) -> Column:
    """128 bits that stand for a message in counts and joins; null for null."""
    return F.unhex(F.md5(msg.cast("binary")))


def frequency_features(df: DataFrame, scope: list[str], rare: int = 100, base: DataFrame | None = None) -> DataFrame:
    """Counts per scope (one server by default) written back to every line. Counts are taken over `base`, the
    lines before any join, so that counting rescans three columns and not the whole chain.

    (severity, component) pairs give component counts, totals and ranks in one small table. Messages are counted by
    their 128-bit hash, so that no text is shuffled, and only the frequent ones are looked up: at most lines/rare rows,
    whatever the number of distinct messages. Without a column `message_hash` the hash is taken here. A line without a
    message is not rare.
    """
    pair = Window.partitionBy(*scope, "c")
    every = Window.partitionBy(*scope)
    base = df if base is None else base
    df, base = (d if "message_hash" in d.columns else d.withColumn("message_hash", message_hash(F.col("msg"))) for d in (df, base))
    combos = (base.groupBy(*scope, "s", "c").agg(F.count(F.lit(1)).alias("combo_count"))
              .withColumn("component_count", F.sum("combo_count").over(pair))
              .withColumn("scope_total", F.sum("combo_count").over(every))
              .withColumn("component_encoded", F.dense_rank().over(
                  Window.partitionBy(*scope).orderBy(F.col("component_count").desc(), "c")) - 1))
    common = (base.groupBy(*scope, "message_hash").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") >= rare)
              .select(*scope, "message_hash", F.lit(1).alias("_common")))
    prints = base.groupBy(*scope, "message_fingerprint").agg(F.count(F.lit(1)).alias("fingerprint_count"))
    out = attach(df, combos, [*scope, "s", "c"])
    out = attach(out, common, [*scope, "message_hash"])
    out = attach(out, prints, [*scope, "message_fingerprint"])
    share = lambda n: F.col(n).cast("double") / F.col("scope_total")
    return out.withColumns({
        "severity_component_combo": F.concat_ws("_", "s", "c"),
        "is_rare_combo": X.flag(F.col("combo_count") < rare),
        "is_rare_component": X.flag(F.col("component_count") < rare),
        "component_encoded": F.coalesce("component_encoded", F.lit(0)),
        "component_frequency_ratio": F.coalesce(share("component_count"), F.lit(0.0)),
        "is_dominant_component": X.flag(share("component_count") > 0.5),
        "fingerprint_frequency_ratio": F.coalesce(share("fingerprint_count"), F.lit(0.0)),
        "is_dominant_message": X.flag(share("fingerprint_count") > 0.2),
        "is_rare_message": X.flag(F.col("_common").isNull() & F.col("message_hash").isNotNull()),
    }).drop("_common", "message_hash", "combo_count", "component_count", "scope_total", "fingerprint_count")


def gap_seconds(ts: str = "ts", before: str = "prev_ts") -> Column:
    gap = V.micros(F.col(ts)) - V.micros(F.col(before))
    return F.coalesce(gap / F.lit(1e6).cast("double"), F.lit(0.0).cast("double"))


def sequence_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """Gap to the line before, burst flags, density over the last 100 lines, component change."""
    out = with_previous(df, keys, "ts", "log_id", ["ts", "c"]).withColumn("time_since_last_log", gap_seconds())
    gap = F.col("time_since_last_log")
    out = out.withColumns({
        "log_burst_flag": X.flag((gap > 0) & (gap < 0.1)),
        "extreme_burst_flag": X.flag(gap == 0),
        "component_changed": X.flag((F.col("seq") == 1) | ~F.col("c").eqNullSafe(F.col("prev_c"))),
    })
    return rolling_mean(out, keys, "extreme_burst_flag", 100, "burst_density").drop("prev_ts", "prev_c")


def time_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"hour_of_day": F.hour("ts"), "is_weekend": V.is_weekend(F.col("ts"))})


def mongodb_line_features(df: DataFrame) -> DataFrame:
    """Every signal that needs one line only: stateless, so it also runs on a stream."""
    df = df.withColumn("host", F.coalesce("host", F.lit("unknown")))
    df = df.withColumn("message_fingerprint", X.fingerprint_mongodb(F.col("msg")))
    return attr_features(numeric_features(component_flags(message_flags(time_features(df)))))


def mongodb_features(df: DataFrame, keys: list[str] = ["host"], rare: int = 100) -> DataFrame:
    lines = mongodb_line_features(df).withColumn("message_hash", message_hash(F.col("msg")))
    return frequency_features(sequence_features(lines, keys), keys, rare, lines)


# ---- relational-database source ----

def mssql_parse(df: DataFrame) -> DataFrame:
    """Structured fields where the shipper parsed the line; otherwise fields from the message."""
    msg = F.col("message")
    failed = F.array_contains(F.col("tags"), P.GROK_FAILURE_TAG)
    either = lambda name, parsed: (
        F.coalesce(F.col(name), parsed) if name in df.columns else parsed)
    df = df.withColumns({
        "is_grok_failure": X.flag(failed),
        "logtype": F.when(failed, X.mssql_class(msg)).otherwise(F.coalesce(F.col("logtype"), F.lit("Unknown"))),
        "logintype": either("logintype", X.extract(msg, P.MSSQL_LOGIN_STATUS, default="unknown")),
        "client_ip": either("client_ip", X.mssql_client_ip(msg)),
        "auth_type": either("auth_type", X.extract(msg, P.MSSQL_AUTH, default="unknown")),
        "username": either("username", X.extract(msg, P.MSSQL_USER, default="unknown")),
        "database_name": X.extract(msg, P.MSSQL_DATABASE, default="unknown"),
        "error_number": X.extract_int(msg, P.MSSQL_ERROR, 1),
        "error_severity": X.extract_int(msg, P.MSSQL_ERROR, 2),
        "error_state": X.extract_int(msg, P.MSSQL_ERROR, 3),
        "spid": X.extract_int(msg, P.MSSQL_SPID),
        "local_time_text": X.extract(msg, P.MSSQL_TIMESTAMP, default=""),
        "message_fingerprint": X.fingerprint_mssql(msg),
    })
    level = F.col("log_level") if "log_level" in df.columns else F.lit(None).cast("string")
    return df.withColumns({
        "failure_reason": F.when(F.col("logintype") == "failed", F.trim(X.extract(msg, P.MSSQL_REASON))),
        "log_level": X.mssql_level(F.col("error_severity"), level),
    })


def mssql_line_features(df: DataFrame, utc_offset_hours: int = 3) -> DataFrame:
    msg, user, client = F.col("message"), F.col("username"), F.col("client_ip")
    local = V.local_time(F.col("ts"), utc_offset_hours)
    return df.withColumn("_low", F.lower(msg)).withColumns({
        "hour_of_day": F.hour(local), "is_weekend": V.is_weekend(local),
        "is_business_hours": V.is_business_hours(local), "is_night_login": V.is_night(local),
        "is_login_event": X.flag(F.lower("logtype") == "logon"),
        "is_failed_login": X.flag(F.col("logintype") == "failed"),
        "is_successful_login": X.flag(F.col("logintype") == "succeeded"),
        "is_windows_auth": X.flag(F.col("auth_type") == "Windows"),
        "is_sql_auth": X.flag(F.col("auth_type") == "SQL Server"),
        "is_local_client": X.flag(client.isin(P.LOCAL_CLIENTS)),
        "is_service_account": X.flag(X.search(user, P.SERVICE_ACCOUNT)),
        "is_domain_user": X.flag(user.contains("\\")),
        **{n: X.flag(X.search(msg, p, lowered=F.col("_low"))) for n, p in P.MSSQL_FLAGS.items()},
        "error_severity_level": F.col("error_severity").cast("int"),
        "is_high_severity_error": X.flag(F.col("error_severity") >= 17),
        "is_system_error": X.flag(F.col("logtype").isin(P.SYSTEM_ERROR_TYPES)),
    }).drop("_low")


def key_frequency(df: DataFrame, scope: list[str], key: str, name: str, baseline: DataFrame | None = None,
                  base: DataFrame | None = None) -> DataFrame:
    """Lines per key in this batch (`base`) plus what a stored baseline (key, count) has seen before."""
    counts = (df if base is None else base).groupBy(*scope, key).agg(F.count(F.lit(1)).alias(name))
    if baseline is not None:
        old = baseline.select(*scope, F.col("key").alias(key), F.col("count").alias("_old"))
        counts = counts.join(old, [*scope, key], "left").select(
            *scope, key, (F.col(name) + F.coalesce("_old", F.lit(0))).cast("bigint").alias(name))
    return attach(df, counts, [*scope, key]).withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def merged_baseline(counts: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Stored counts plus batch counts; keys seen on one side only count as zero on the other."""
    old = baseline.select(*keys, F.col("count").alias("_old"))
    new = counts.select(*keys, F.col("count").alias("_new"))
    total = F.coalesce("_old", F.lit(0)) + F.coalesce("_new", F.lit(0))
    return old.join(new, keys, "full_outer").select(*keys, total.cast("bigint").alias("count"))


def failed_login_hour(df: DataFrame, keys: list[str], base: DataFrame | None = None) -> DataFrame:
    """Lines and share of failed logins in the trailing hour."""
    spans = trailing_sums(df if base is None else base, keys, "ts",
                          {"_n": F.lit(1).cast("bigint"), "_f": F.col("is_failed_login").cast("bigint")}, HOUR)
    joined = df.withColumn("_us", V.micros(F.col("ts"))).join(spans, [*keys, "_us"], "left")
    return joined.withColumns({
        "login_count_1h": F.coalesce("_n", F.lit(0)).cast("bigint"),
        "failed_login_ratio_1h": V.ratio(F.coalesce("_f", F.lit(0)), F.coalesce("_n", F.lit(0))),
    }).drop("_us", "_n", "_f")


def login_bursts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps to the line and to the login before (0 on other lines), burst flags on logins, density over 100 lines."""
    out = with_previous(df, keys, "ts", "log_id", ["ts"],
                        {"prev_login": F.when(F.col("is_login_event") == 1, F.col("ts"))})
    out = out.withColumns({
        "time_since_last_log": gap_seconds(),
        "time_since_last_login": F.when(F.col("is_login_event") == 1, gap_seconds("ts", "prev_login"))
        .otherwise(F.lit(0.0).cast("double")),
    })
    gap, login = F.col("time_since_last_log"), F.col("is_login_event") == 1
    out = out.withColumns({
        "login_burst_flag": X.flag(login & (gap > 0) & (gap < 1.0)),
        "extreme_burst_flag": X.flag(login & (gap < 0.1)),
    }).drop("prev_ts", "prev_login")
    return rolling_mean(out, keys, "extreme_burst_flag", 100, "burst_density")


def failed_login_rows(df: DataFrame, keys: list[str], rows: int = 1000) -> DataFrame:
    """Fallback for lines without a usable time: share and count over the last `rows` lines by arrival."""
    out = rolling_mean(df, keys, "is_failed_login", rows, "failed_login_ratio_1h")
    return out.withColumn("login_count_1h", F.least(F.col("seq"), F.lit(rows)).cast("bigint"))


def mssql_features(df: DataFrame, keys: list[str] = ["host"], rare: int = 100,
                   baseline: DataFrame | None = None) -> DataFrame:
    """`baseline` holds (kind, keys..., key, count) with kind ip or username."""
    lines = mssql_line_features(mssql_parse(df.withColumn("host", F.coalesce("host", F.lit("unknown")))))
    side = lambda kind: None if baseline is None else baseline.filter(F.col("kind") == kind)
    out = failed_login_hour(login_bursts(lines, keys), keys, lines)
    out = key_frequency(out, keys, "client_ip", "client_ip_frequency", side("ip"), lines)
    out = key_frequency(out, keys, "username", "username_frequency", side("username"), lines)
    return out.withColumns({"is_rare_client_ip": X.flag(F.col("client_ip_frequency") < rare),
                            "is_rare_username": X.flag(F.col("username_frequency") < rare)})


# ---- search-engine source ----

def es_parse(df: DataFrame) -> DataFrame:
    """Bracketed lines and JSON deprecation lines to the same columns. `message` is the first array element."""
    json = X.es_deprecation(F.col("message"))
    df = df.withColumn("_json", json)
    line = X.es_line(F.col("message"))
    return df.withColumns({
        **{n: F.coalesce(F.col(f"_json.{n}"), e) for n, e in line.items()},
        "event_code": F.coalesce("_json.event_code", F.lit("")),
        "message_fingerprint": X.fingerprint_es(F.col("message")),
    }).drop("_json").withColumns({
        "logger_category": X.es_logger_class(F.col("logger_name")),
        "host_role": X.es_host_role(F.col("host")),
    })


def es_line_features(df: DataFrame) -> DataFrame:
    msg, level = F.col("message"), F.upper(F.trim("log_level"))
    df = df.withColumn("_low", F.lower(msg))
    flags = {n: X.flag(X.search(msg, p, lowered=F.col("_low"))) for n, p in P.ES_FLAGS.items()}
    dataset = F.col("event_dataset") if "event_dataset" in df.columns else F.lit("")
    flags["is_deprecation"] = X.flag((flags["is_deprecation"] == 1) | level.contains("DEPRECAT")
                                     | X.search(dataset, "deprecation"))
    return df.withColumns({
        "hour_of_day": F.hour("ts"), "is_weekend": V.is_weekend(F.col("ts")),
        "is_business_hours": V.is_business_hours(F.col("ts")),
        "is_warn": X.flag(level == "WARN"), "is_error": X.flag(level.isin("ERROR", "CRITICAL")),
        **{f"is_{k}_logger": X.flag(F.col("logger_category") == k) for k in ("cluster", "index", "transport")},
        **flags,
    }).drop("_low")


def es_features(df: DataFrame, keys: list[str] = ["host"], rare: int = 50) -> DataFrame:
    lines = es_line_features(es_parse(df.withColumn("host", F.coalesce("host", F.lit("unknown")))))
    out = with_previous(lines, keys, "ts", "log_id", ["ts"]).withColumn("time_since_last_log", gap_seconds())
    gap = F.col("time_since_last_log")
    out = out.withColumn("extreme_burst_flag", X.flag((gap >= 0) & (gap < 0.1))).drop("prev_ts")
    out = rolling_mean(out, keys, "extreme_burst_flag", 100, "burst_density")
    out = key_frequency(out, keys, "logger_name", "_logger_count", base=lines)
    return out.withColumn("is_rare_logger", X.flag(F.col("_logger_count") < rare)).drop("_logger_count")


# ---- model matrix ----

def feature_matrix(df: DataFrame, features: list[str], ids: list[str] = ["host", "log_id"]) -> DataFrame:
    """Configured features that exist and are numeric, nulls as 0, beside the row ids."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() not in
               ("string", "array", "map", "struct", "timestamp", "timestamp_ntz", "date", "binary", "variant")}
    chosen = [n for n in features if n in numeric]
    return df.select(*ids, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0).cast("double")).alias(n) for n in chosen])


def align_schema(df: DataFrame, names: list[str], ids: list[str] = ["host", "log_id"]) -> DataFrame:
    """Exactly the columns a stored model knows, in its order: missing as 0.0, extra dropped."""
    zero = F.lit(0.0).cast("double")
    cols = [F.coalesce(F.col(n).cast("double"), zero) if n in df.columns else zero for n in names]
    return df.select(*ids, *[c.alias(n) for c, n in zip(cols, names)])


def schema_report(df: DataFrame, names: list[str], ids: list[str] = ["host", "log_id"]) -> DataFrame:
    """Missing and extra features against a stored schema, with the mismatch share and its grade."""
    have = [c for c in df.columns if c not in ids]
    want_arr, have_arr = F.array(*map(F.lit, names)), F.array(*map(F.lit, have))
    base = df.sparkSession.range(1).select(F.array_except(want_arr, have_arr).alias("missing"),
                                           F.array_except(have_arr, want_arr).alias("extra"))
    share = (F.size("missing") + F.size("extra")) / F.lit(float(max(len(names), 1)))
    return base.select("missing", "extra", share.alias("mismatch_ratio"),
                       F.when(share > 0.5, "critical").when(share > 0.2, "significant").when(share > 0, "minor")
                       .otherwise("none").alias("grade"))


def noise_filter(df: DataFrame, source: str, drop_service_logins: bool = False) -> DataFrame:
    """Routine lines out: reauthentication and replication, service logins when asked, deprecation notes."""
    if source == "mongodb":
        return df.filter((F.col("is_reauthenticate") == 0) & (F.col("is_normal_replication") == 0))
    if source == "mssql":
        if not drop_service_logins:
            return df
        return df.filter(~((F.col("is_service_account") == 1) & (F.col("is_successful_login") == 1)))
    return df.filter(~((F.col("is_deprecation") == 1) & (F.col("is_warn") == 0) & (F.col("is_error") == 0)))


def reduction_rate(kept: Column) -> Column:
    """Percent of lines a filter removes; an aggregate over the unfiltered lines."""
    return (F.lit(1.0).cast("double") - F.avg(kept.cast("int"))) * 100

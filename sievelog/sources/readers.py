"""Reading the three log layouts. Files are read with the built-in line and JSON readers, so large files are
split by Spark; parsing is column work on the lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sievelog.functions import text as X, values as V

MONGO_JSON = ("t struct<`$date`: string>, s string, c string, ctx string, msg string, attr string, host string, "
              "_bad string")
# ---- fixed value: text line layout (timestamp, severity, component, context, message) ----
TEXT_LINE = (r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}[+-]\d{4})\s+([IWEF])\s+(\S+)\s+\[([^\]]+)\]\s+(.*)")
TEXT_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSxx"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files (text or JSON, also mixed) with the server the file name points to."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))
    return lines.withColumn("file_server", X.server_from_name(F.col("file_name")))


def parse_lines(df: DataFrame) -> DataFrame:
    """Routes every line by its own shape: `{` opens a JSON entry, the rest is text. `format` is json, text or
    rejected; nothing is dropped here."""
    entry = F.from_json("value", MONGO_JSON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = df.withColumn("_json", F.when(F.ltrim("value").startswith("{"), entry))
    is_json = F.col("_json").isNotNull() & F.col("_json._bad").isNull() & F.col("_json.t").isNotNull()
    is_text = F.col("value").rlike(TEXT_LINE)
    part = lambda i: F.regexp_extract("value", TEXT_LINE, i)
    pick = lambda field, i: F.when(F.col("format") == "json", F.col(f"_json.{field}")).when(
        F.col("format") == "text", part(i))
    df = df.withColumn("format", F.when(is_json, "json").when(is_text, "text").otherwise("rejected"))
    return df.withColumns({
        "ts": F.when(F.col("format") == "json", V.parse_timestamp(F.col("_json.t.$date"))).when(
            F.col("format") == "text", F.try_to_timestamp(part(1), F.lit(TEXT_TIME))),
        "s": pick("s", 2), "c": pick("c", 3), "ctx": pick("ctx", 4), "msg": pick("msg", 5),
        "attr": F.when(F.col("format") == "json", F.coalesce("_json.attr", F.lit("{}"))).when(
            F.col("format") == "text", F.to_json(X.message_pairs(part(5)))),
        "host": F.col("_json.host"),
    }).drop("_json")


def read_mongodb_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and the rejected lines."""
    rows = parse_lines(read_lines(spark, path))
    good = rows.filter("format <> 'rejected'")
    host = F.coalesce(F.col("host"), F.col("file_server"), F.lit("unknown"))
    return good.withColumn("host", host), rows.filter("format = 'rejected'").select("value", "file_name")


def scan(df: DataFrame, start: str | None = None, end: str | None = None, hosts: list[str] | None = None,
         **equals) -> DataFrame:
    """Range, host and equality filters; all of them reach the Parquet scan. On a table partitioned by day (`dt`) the
    range also prunes folders."""
    bound = lambda text: F.lit(text).cast(df.schema["ts"].dataType)
    by_day = "dt" in df.columns
    if start is not None:
        df = df.filter(F.col("ts") >= bound(start))
        df = df.filter(F.col("dt") >= F.to_date(bound(start))) if by_day else df
    if end is not None:
        df = df.filter(F.col("ts") < bound(end))
        df = df.filter(F.col("dt") <= F.to_date(bound(end))) if by_day else df
    if hosts:
        df = df.filter(F.col("host").isin(hosts))
    for name, value in equals.items():
        df = df.filter(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return df


def newest_first(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.col("ts").desc(), F.col("log_id").desc()).limit(limit)


def keyset_page(df: DataFrame, after: tuple | None, size: int) -> DataFrame:
    """The next page after the (ts, log_id) of the last row seen; stable while new rows arrive."""
    if after is not None:
        ts = F.lit(after[0]).cast(df.schema["ts"].dataType)
        df = df.filter((F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("log_id") > after[1])))
    return df.orderBy("ts", "log_id").limit(size)


def explode_messages(df: DataFrame, message: str = "message") -> DataFrame:
    """One row per distinct trimmed message of an array; empty messages are left out."""
    trimmed = F.array_distinct(F.filter(F.transform(message, lambda m: F.trim(m)), lambda m: m != ""))
    return df.withColumn(message, F.explode(trimmed))


def unwrap_nested(msg: Column) -> Column:
    """The entry inside a message that is itself a JSON entry, else null."""
    return F.from_json(F.when(F.ltrim(msg).startswith("{"), msg), "t struct<`$date`: string>, s string, c string, "
                       "ctx string, msg string, attr string")


def profiler_rows(df: DataFrame) -> DataFrame:
    """Profiler entries (ts, ns, op, millis, command) as log rows."""
    return df.select(
        "ts", F.lit("W").alias("s"), F.lit("QUERY").alias("c"), F.lit("profiler").alias("ctx"),
        F.format_string("Slow query: %s on %s took %dms", "op", "ns", "millis").alias("msg"),
        F.to_json(F.struct("ns", F.col("millis").alias("durationMillis"), "command")).alias("attr"))


def server_from_content(df: DataFrame) -> DataFrame:
    """Server per file: the earliest usable host column, then attr.host, then the process details line."""
    first = lambda c: F.lower(F.element_at(F.split(c, "[.:]"), 1))
    by_host = X.server_from_name(first(F.col("host")))
    by_attr = X.server_from_name(first(F.get_json_object("attr", "$.host")))
    named = df.withColumns({"_h": by_host, "_a": by_attr,
                            "_p": F.when(F.col("msg") == "Process Details", by_attr)})
    earliest = lambda n: F.min_by(n, F.when(F.col(n).isNotNull(), F.struct("ts", "log_id")))
    return named.groupBy("file_name").agg(F.coalesce(earliest("_h"), earliest("_a"), earliest("_p")).alias("server"))


# ---- human message of an entry ----

def human_message(msg: Column, attr: Column) -> Column:
    """Error text, failed command, slow query, command and error layouts, else the plain message."""
    at = lambda path: F.get_json_object(attr, path)
    plan = at("$.planSummary")
    slow = F.concat(
        F.format_string("Slow query on '%s' took %sms", F.coalesce(at("$.ns"), F.lit("unknown")),
                        F.coalesce(at("$.durationMillis"), F.lit("0"))),
        F.when(plan == "COLLSCAN", " - FULL TABLE SCAN detected (needs index)").when(plan == "IXSCAN", " - using index")
        .when(plan.isNotNull() & (plan != "unknown"), F.concat(F.lit(" - plan: "), plan)).otherwise(""),
        F.when(at("$.docsExamined").cast("bigint") > 0,
               F.concat(F.lit(" (scanned "), F.format_number(at("$.docsExamined").cast("bigint"), 0), F.lit(" docs)")))
        .otherwise(""))
    space = F.coalesce(at("$.namespace"), F.lit("unknown"))
    command = (
        F.when(msg.contains("dropIndexes"), F.format_string(
            "Index dropped: %s on collection '%s'", F.coalesce(at("$.indexes"), F.lit("unknown")), space))
        .when(msg.contains("createIndex"), F.format_string("Index created on collection '%s'", space))
        .otherwise(F.format_string("Command executed: %s on '%s'", F.regexp_replace(msg, "CMD: ", ""),
                                   F.coalesce(at("$.namespace"), at("$.ns"), F.lit("unknown")))))
    failed = F.format_string(
        "Command '%s' failed: %s",
        F.coalesce(at("$.command.find"), at("$.command.insert"), at("$.command.update"), F.lit("unknown")),
        F.coalesce(at("$.error"), F.lit("")))
    usable = (msg != "") & (msg != "Checking authorization failed")
    return F.coalesce(
        at("$.error.errmsg"), at("$.error.message"),
        F.when(at("$.command").isNotNull() & at("$.error").isNotNull(), failed),
        F.when(usable & msg.startswith("Slow query"), slow),
        F.when(usable & msg.startswith("CMD: "), command),
        F.when(usable & F.lower(msg).contains("error") & at("$.error").startswith("{"), error_text(attr)),
        F.nullif(msg, F.lit("")), F.lit("No detailed message available"))


def error_text(attr: Column) -> Column:
    at = lambda path: F.get_json_object(attr, path)
    return F.format_string("Error %s (%s): %s", F.coalesce(at("$.error.code"), F.lit("Unknown")),
                           F.coalesce(at("$.error.codeName"), F.lit("Unknown")),
                           F.coalesce(at("$.error.errmsg"), at("$.error.message"), F.lit("")))

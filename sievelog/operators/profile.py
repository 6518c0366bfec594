"""Field profile of semi-structured columns and query-performance scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sievelog.operators.sequence import top_n


_LEVEL = "array<struct<path:string,type:string,v:variant>>"
_FOUND = "array<struct<path:string,type:string,value:string>>"


def _kind(v: Column) -> Column:
    shape = F.schema_of_variant(v)
    return (F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string")
            .when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").otherwise("number"))


def fields(df: DataFrame, json: str, depth: int | None = None) -> DataFrame:
    """One row per field occurrence: dotted path, type, text value. Objects are opened as deep as they go, or to `depth`
    levels if given; arrays are one field. What is no JSON object, null too, has no fields.

    Each document is walked on its own within one expression: a step opens the objects of one level, and a document takes
    as many steps as it has opening braces at most. So the table is scanned once, and nothing runs while the plan is built.
    """
    text = F.col(json)
    braces = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))
    most = braces if depth is None else F.least(braces, F.lit(depth))

    def members(prefix: Column, v: Column) -> Column:
        """What an object holds, null for anything else."""
        entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        return F.transform(entries, lambda e: F.struct(F.concat(prefix, e["key"]).alias("path"), _kind(e["value"]).alias("type"), e["value"].alias("v")))

    def shown(state: Column) -> Column:
        return F.concat(state["found"], F.transform(state["level"], lambda e: F.struct(
            e["path"].alias("path"), e["type"].alias("type"),
            F.when(~e["type"].isin("object", "array"), F.try_variant_get(e["v"], "$", "string")).alias("value")))).cast(_FOUND)

    def step(state: Column) -> Column:
        below = F.transform(F.filter(state["level"], lambda e: e["type"] == "object"), lambda e: members(F.concat(e["path"], F.lit(".")), e["v"]))
        return F.struct(shown(state).alias("found"), F.flatten(below).cast(_LEVEL).alias("level"))

    start = F.struct(F.array().cast(_FOUND).alias("found"), members(F.lit(""), F.try_parse_json(text)).cast(_LEVEL).alias("level"))
    steps = F.array_repeat(F.lit(0), F.greatest(most - 1, F.lit(0)).cast("int"))
    walked = F.aggregate(steps, start, lambda state, _: F.when(F.size(state["level"]) > 0, step(state)).otherwise(state), shown)
    return df.select(F.explode(walked).alias("_f")).select("_f.*")


def field_profile(df: DataFrame, json: str, depth: int | None = None, examples: int = 3) -> DataFrame:
    """Per path: occurrences, share of documents that have it, types, the most frequent of them, whether it mixes types,
    sample values."""
    found = fields(df, json, depth)
    total = df.agg(F.count(F.lit(1))).scalar()
    types = found.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))
    shape = types.groupBy("path").agg(F.sum("n").alias("count"), F.array_sort(F.collect_set("type")).alias("types"),
                                     F.min_by("type", F.struct(-F.col("n"), "type")).alias("primary_type"))
    values = found.filter("value is not null").groupBy("path", "value").agg(F.count(F.lit(1)).alias("n"))
    best = top_n(values, ["path"], [F.col("n").desc(), F.col("value")], examples).groupBy("path").agg(
        F.array_sort(F.collect_list("value")).alias("examples"))
    out = shape.join(best, "path", "left").withColumn("total", total)
    return out.select("path", "count", (F.col("count") / F.col("total")).alias("fill_rate"), "types", "primary_type", (F.size("types") > 1).alias("is_mixed"),
                      (F.col("count") / F.col("total") < 0.5).alias("is_sparse"), F.array_contains("types", "object").alias("is_nested"), "examples")


def find_fields(profile: DataFrame, asked: str) -> DataFrame:
    """Paths that a question is about: a word of the text is in the path's name, or one of its example values is in the
    text."""
    low = asked.lower()
    named = reduce(lambda a, b: a | b, [F.lower("path").contains(w) for w in low.split()], F.lit(False))
    shown = F.exists(F.coalesce("examples", F.array().cast("array<string>")), lambda x: (x != "") & F.lit(low).contains(F.lower(x)))
    return profile.filter(named | shown)


# ---- query performance over a table of execution statistics ----

def efficiency(returned: Column, examined: Column, keys: Column) -> Column:
    """Percent of examined documents returned, plus up to 20 for index use, times 0.7 without an index."""
    basic = F.when(returned > 0, returned / examined * 100).otherwise(F.lit(0.0))
    with_index = F.least(F.lit(100.0), basic + F.least(F.lit(20.0), keys / examined * 20))
    return F.round(F.when(examined == 0, 100.0).when(keys > 0, with_index).otherwise(basic * 0.7), 2)


def performance_score(millis: Column, eff: Column, examined: Column, keys: Column, returned: Column) -> Column:
    """Time (30), efficiency (30), index (25) and result size (15)."""
    time = F.when(millis > 1000, 0).when(millis > 500, 10).when(millis > 100, 20).otherwise(30)
    index = F.when((examined > 0) & (keys == 0), 0).when(keys > examined * 2, 15).otherwise(25)
    size = F.when(returned > 10000, 5).when(returned > 1000, 10).otherwise(15)
    return (time + F.bround(F.least(F.lit(30.0), eff * 0.3), 0).cast("int") + index + size).cast("int")


def performance_level(score: Column) -> Column:
    return (F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "fair").when(score >= 30, "low").otherwise("critical"))


def estimated_improvement(is_collscan: Column, millis: Column) -> Column:
    """Percent saved by an index on a full scan, or by general tuning of a slow query."""
    return F.when(is_collscan, 95).when(millis > 100, 30).otherwise(0)


# ---- fleet metrics ----

def fleet_summary(metrics: DataFrame, keys: list[str], cpu: str, online: Column) -> DataFrame:
    return metrics.groupBy(*keys).agg(F.count_if(online).alias("online"), F.count_if(~online).alias("offline"),
                                      F.avg(cpu).alias("avg_cpu"), F.max(cpu).alias("max_cpu"), F.min(cpu).alias("min_cpu"))


def context_relevance(history: DataFrame, ref: Column, host: str | None, words: list[str], problem_words: int, k: int = 3) -> DataFrame:
    """Past analyses closest to a question: same host 50, host keyword 20 each, recency up to 10, 5 per problem word
    when it found anomalies."""
    hours = (F.unix_micros(ref.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(3.6e9)
    keyword = sum([F.lower("host").contains(w.lower()).cast("int") for w in words], F.lit(0)) * 20
    place = F.when(F.col("host") == host, 50).otherwise(keyword) if host else keyword
    score = (place + F.when(hours < 24, F.lit(10.0) * (F.lit(1.0) - hours / 24)).otherwise(0.0)
             + F.when(F.col("n_anomalies") > 0, 5 * problem_words).otherwise(0))
    return history.withColumn("relevance", score).filter("relevance > 0").orderBy(F.col("relevance").desc(), "host", "ts").limit(k)

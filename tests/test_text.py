"""Pattern search and parsing on hand-made lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sievelog.functions import patterns as P, text as X, values as V
from sievelog.sources import readers as RD

WORDS = ["auth", "failed", "Authentication", "OOM", "oom", "COLLSCAN", "index", "build", "starting", "mongod", 'durationMillis":1234', 'docsExamined":99999',
         'docsExamined":123', "node", "left", "joined", "transport", "exception", "Data too large", "[gc]", "spent [1s] collecting in the last", "took[", "took",
         "removed {", "database", "not accessible", "TCP Provider", "error", "java.lang.OutOfMemoryError", "CMD: drop", "$match", "x", "restart", "shutdown"]


@pytest.mark.parametrize("table", ["MONGO_FLAGS", "MSSQL_FLAGS", "ES_FLAGS"])
def test_search_equals_regex(spark, table):
    rng = random.Random(3)
    lines = [" ".join(rng.choices(WORDS, k=rng.randint(1, 5))) for _ in range(400)]
    flags = getattr(P, table)
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    got = df.select("t", *[X.search(F.col("t"), p, n in P.CASE_SENSITIVE).alias(n) for n, p in flags.items()]).collect()
    for row in got:
        for n, p in flags.items():
            assert row[n] == bool(re.search(p, row["t"], 0 if n in P.CASE_SENSITIVE else re.I)), (n, row["t"])


def test_null_message_has_no_flags(spark):
    row = spark.createDataFrame([(None,)], "t string").select(X.flag(X.search(F.col("t"), "a|b.*c")).alias("f"), X.fingerprint_mongodb(F.col("t")).alias("p")).first()
    assert row["f"] == 0 and row["p"] == ""


def test_first_match_order(spark):
    rows = spark.createDataFrame([("Login failed for user 'a' out of memory",), ("deadlock victim, out of memory",), ("nothing",)], "m string")
    assert [r[0] for r in rows.select(X.mssql_class(F.col("m"))).collect()] == ["Logon", "Deadlock", "Unknown"]


def test_single_quoted_attributes(spark):
    from sievelog.operators.features import attr_features
    rows = spark.createDataFrame([("{'error': 1, 'b': 2}",), ('{"a": {"error": 1}}',), ("garbage",), (None,)], "attr string")
    assert [tuple(r)[1:] for r in attr_features(rows).collect()] == [(1, 2, 0), (0, 1, 0), (0, 0, 0), (0, 0, 0)]


def test_human_message(spark):
    rows = spark.createDataFrame([
        ("Slow query", '{"ns":"a.b","durationMillis":1500,"planSummary":"COLLSCAN","docsExamined":1234567}'),
        ("CMD: dropIndexes", '{"namespace":"a.b","indexes":"i1"}'),
        ("anything", '{"command":{"find":"c"},"error":"boom"}'),
        ("Checking authorization failed", '{"x":1}')], "m string, a string")
    got = [r[0] for r in rows.select(RD.human_message(F.col("m"), F.col("a"))).collect()]
    assert got == ["Slow query on 'a.b' took 1500ms - FULL TABLE SCAN detected (needs index) (scanned 1,234,567 docs)",
                   "Index dropped: i1 on collection 'a.b'", "Command 'c' failed: boom", "Checking authorization failed"]


def test_series(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 100.0],), ([5.0],), ([1.0, 1.0, 1.0, 1.0, 1.0, 9.0, 9.0, 9.0],)], "v array<double>")
    df = df.withColumns({"mean": V.series_mean(F.col("v")), "std": V.series_std(F.col("v"))})
    out = V.robust_baseline(df, "v").select("centre", "spread", V.cusum_changes(F.col("v"), F.col("mean"), F.col("std")).alias("c")).collect()
    assert (out[0]["centre"], out[0]["spread"]) == (2.5, 1.0)
    assert (out[1]["centre"], out[1]["spread"]) == (5.0, 0.0)
    assert V.slice_minutes(24) == 30 and V.slice_minutes(100) == 60 and V.slice_minutes(1000) == 240


def test_hour_runs(spark):
    df = spark.createDataFrame([([1, 2, 3, 7, 8, 20, 21, 22, 23],), ([5],)], "h array<int>")
    assert [r[0] for r in df.select(V.hour_runs(F.col("h"))).collect()] == [["1-3", "20-23"], []]

"""Files in and out, stores, retention."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sievelog.operators import analysis as A, rules as R
from sievelog.sources import readers as RD, store as ST


def test_mixed_files(spark, tmp_path):
    good = {"t": {"$date": "2024-01-01T00:00:00.500Z"}, "s": "E", "c": "REPL", "ctx": "x", "msg": "hello", "attr": {"error": {"code": 1}}}
    (tmp_path / "mongod.log.DBSERVER005").write_text("\n".join([
        json.dumps(good), "{broken", '2025-06-22T06:25:06.125+0300 I  ACCESS   [conn1] failed user="bob" code="7"', "junk"]) + "\n")
    (tmp_path / "other.log").write_text(json.dumps({**good, "host": "mongodb01n2.local"}) + "\n")
    rows, rejects = RD.read_mongodb_files(spark, str(tmp_path))
    got = {(r["host"], r["format"]): r for r in rows.collect()}
    assert set(got) == {("dbserver005", "json"), ("dbserver005", "text"), ("mongodb01n2.local", "json")}
    text = got[("dbserver005", "text")]
    assert text["ts"] == datetime(2025, 6, 22, 3, 25, 6, 125000) and json.loads(text["attr"]) == {"user": "bob", "code": "7"}
    assert json.loads(got[("dbserver005", "json")]["attr"]) == {"error": {"code": 1}}
    assert {r["value"] for r in rejects.collect()} == {"{broken", "junk"}


def test_scan_filters_reach_parquet(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), f"h{i % 3}") for i in range(50)]
    ST.save_partitioned(spark.createDataFrame(rows, "log_id int, ts timestamp, host string"), str(tmp_path / "t"))
    df = RD.scan(spark.read.parquet(str(tmp_path / "t")), "2024-01-02", "2024-01-03", ["h1"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "PartitionFilters: [isnotnull(dt" in plan
    assert df.count() == 8
    first = RD.keyset_page(spark.read.parquet(str(tmp_path / "t")), None, 10).collect()
    second = RD.keyset_page(spark.read.parquet(str(tmp_path / "t")), (str(first[-1]["ts"]), first[-1]["log_id"]), 10).collect()
    assert [r["log_id"] for r in second] == list(range(10, 20))


def test_export_and_expiry(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", datetime(2024, 1, 1)), (2, "b, c", datetime(2024, 1, 2))], "log_id int, msg string, ts timestamp")
    ST.export(df, str(tmp_path / "j"))
    ST.export(df, str(tmp_path / "c"), "csv")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert {r["msg"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {"a", "b, c"}
    assert ST.with_expiry(df, 90).first()["ttl_date"] == datetime(2024, 3, 31)


def test_repeated_batch_counts_once(spark, tmp_path):
    batch = spark.createDataFrame([("ip", "1", 5)], "kind string, key string, count bigint")
    for batch_id in (0, 1, 1):
        ST.upsert_counts(spark, str(tmp_path / "b"), batch, batch_id)
    assert ST.read_counts(spark, str(tmp_path / "b"), ["kind", "key"]).first()["count"] == 10


def test_materialise_reads_back(spark):
    df = ST.materialise(spark.range(10).withColumn("x", F.col("id") * 2), "unit")
    assert df.count() == 10 and "Parquet" in df._jdf.queryExecution().executedPlan().toString() or "parquet" in df._jdf.queryExecution().executedPlan().toString()


def test_rules_only_override_normal_lines_and_first_wins(spark):
    rules = [R.Rule("one", 0.5, "x > 1", "first"), R.Rule("two", 0.9, "x > 0", "second")]
    df = spark.createDataFrame([(2, 1, -0.1), (1, 1, -0.95), (2, -1, -0.2), (0, 1, -0.3)], "x int, prediction int, anomaly_score double")
    got = [(r["rule_hit"], r["prediction"], r["anomaly_score"]) for r in R.apply_rules(df, rules).collect()]
    assert got == [("one", -1, -0.5), ("two", -1, -0.95), (None, -1, -0.2), (None, 1, -0.3)]


def test_filter_keeps_plus_removed(spark):
    rows = [(i, "h", "OTHER" if i < 200 else "COMMAND", f"shutdown {i % 4}", f"fp{i % 4}", -1, -0.5, 50.0 - i / 100, "MEDIUM") for i in range(300)]
    df = spark.createDataFrame(rows, "log_id int, host string, c string, msg string, message_fingerprint string, prediction int, anomaly_score double, severity_score double, severity_level string")
    kept = A.filter_false_positives(df, A.component_rates(df, ["host"]), ["host"])
    assert {r["c"] for r in kept.collect()} == {"COMMAND"}
    assert kept.groupBy("message_fingerprint").count().agg(F.max("count")).first()[0] == 15

"""Field profiles at any depth and dominant patterns by the whole fingerprint."""

import json
import random

from pyspark.sql import functions as F

from sievelog.operators import analysis as A, profile as PR


def test_six_levels(spark):
    df = spark.createDataFrame([('{"a":{"b":{"c":{"d":{"e":{"f":1}}}}}}',), ('{"a":"x"}',), (None,)], "j string")
    got = {r["path"]: r for r in PR.field_profile(df, "j").collect()}
    assert got["a.b.c.d.e.f"]["types"] == ["number"] and got["a"]["is_mixed"] and got["a"]["primary_type"] == "object"
    assert PR.fields(df.limit(0), "j").count() == 0


def _walk(prefix, value):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}
    for k, v in value.items():
        yield prefix + k, kind.get(type(v), "number"), json.dumps(v) if isinstance(v, (bool, int, float)) else v if isinstance(v, str) else None
        if isinstance(v, dict):
            yield from _walk(f"{prefix}{k}.", v)


def test_fields_equal_a_walk_of_each_document(spark):
    rng = random.Random(3)

    def made(depth):
        kinds = [lambda: rng.randint(-9, 9), lambda: rng.choice(["", "x{", "y"]), lambda: None, lambda: rng.random() < 0.5, lambda: [1, {"in": {"side": 1}}]]
        return {k: made(depth - 1) if depth and rng.random() < 0.5 else rng.choice(kinds)() for k in rng.sample("abcdef", rng.randint(0, 4))}

    docs = [made(rng.randint(0, 9)) for _ in range(200)]
    odd = [None, "", "nope{", "[{\"a\": 1}]", "5", "\"{\"", "{}", "{\"a\": 1"]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs] + [(o,) for o in odd], "j string").repartition(4)
    got = sorted((tuple(r) for r in PR.fields(df, "j").collect()), key=str)
    assert got == sorted((f for d in docs for f in _walk("", d)), key=str) and max(p.count(".") for p, *_ in got) > 3
    assert PR.fields(df, "j", 2).agg(F.max(F.size(F.split("path", "[.]")))).first()[0] == 2


def test_fields_scan_once_and_run_nothing_early(spark, tmp_path):
    deep = "{\"k\":" * 40 + "1" + "}" * 40
    spark.createDataFrame([(deep,)], "j string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    found = PR.fields(df, "j")
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == list(before)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert found.count() == 40 and found.filter("type = 'number'").first()["path"].count(".") == 39


def test_asked_fields(spark):
    df = spark.createDataFrame([('{"plan":"COLLSCAN","ns":"shop.orders","n":1}',)], "j string")
    ask = lambda text: {r["path"] for r in PR.find_fields(PR.field_profile(df, "j"), text).collect()}
    assert ask("why is shop.orders slow") == {"ns"} and "plan" in ask("which plan")


def test_long_fingerprints_stay_apart(spark):
    rows = [("h", i, "x" * 130 + str(i % 2), "m", "C", 50.0) for i in range(8)] + [("h", 9, "", "m", "C", 50.0)]
    df = spark.createDataFrame(rows, "host string, log_id long, message_fingerprint string, msg string, c string, severity_score double")
    out = A.dominant_patterns(df.withColumn("prediction", F.lit(-1)), ["host"]).collect()
    assert [r["count"] for r in out] == [4, 4] and {len(r["shown"]) for r in out} == {120}


def test_found_fields_are_searched_with_examples(spark, monkeypatch):
    from sievelog.plans import queries_misc as Q
    seen, real = [], Q.PR.find_fields
    monkeypatch.setattr(Q.PR, "find_fields", lambda profile, asked: seen.append(profile.filter("size(examples) > 0").count()) or real(profile, asked))
    Q.found_fields(spark, "/root/testdata/sf0.001")
    assert seen[0] > 0

"""Streams against the batch result, restarts, late rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sievelog.operators import features as FE
from sievelog.streaming import jobs as J


def write(spark, path, rows):
    spark.createDataFrame(rows, "log_id bigint, ts timestamp, host string, c string").coalesce(1).write.mode("append").parquet(path)


def make(n, start=0, step=7):
    base = datetime(2024, 1, 1)
    return [(i, base + timedelta(seconds=step * (i // 2)), "hot" if i % 4 else "cold", "xy"[i % 2]) for i in range(start, start + n)]


def test_sequence_over_batches_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    each = J.sequence_writer(spark, out, str(tmp_path / "tails"), ["host"])
    for part in range(3):
        write(spark, src, make(150, part * 150))
        stream = J.file_stream(spark, src, spark.read.parquet(src).schema)
        J.run_batches(stream, each, str(tmp_path / "ck"))
    cols = ["log_id", "time_since_last_log", "extreme_burst_flag", "component_changed", "burst_density"]
    streamed = {tuple(r) for r in spark.read.parquet(out).select(cols).collect()}
    batch = {tuple(r) for r in FE.sequence_features(spark.read.parquet(src), ["host"]).select(cols).collect()}
    assert len(streamed) == 450 and streamed == batch


def test_restart_gives_no_duplicates(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    write(spark, src, make(40))
    schema = spark.read.parquet(src).schema
    for _ in range(2):
        J.run_available(J.file_stream(spark, src, schema).select("log_id", "host"), out, ck)
    write(spark, src, make(10, 40))
    J.run_available(J.file_stream(spark, src, schema).select("log_id", "host"), out, ck)
    assert sorted(r["log_id"] for r in spark.read.parquet(out).collect()) == list(range(50))


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    write(spark, src, make(10))
    schema = spark.read.parquet(src).schema
    run = lambda: J.run_available(J.tumbling_counts(J.file_stream(spark, src, schema, 1), ["host"], "1 minute", "1 minute"), out, ck)
    run()
    write(spark, src, [(100, datetime(2024, 1, 2), "hot", "x")])
    run()
    write(spark, src, [(101, datetime(2024, 1, 1), "hot", "x")])
    query = run()
    assert J.dropped_late_rows(query) >= 1
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] == 10


def test_repeats_within_the_watermark(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    write(spark, src, make(40, step=1))
    stream = J.file_stream(spark, src, spark.read.parquet(src).schema)
    J.run_available(J.without_repeats(stream, ["host", "c"]), out, ck)
    assert spark.read.parquet(out).count() == spark.read.parquet(src).select("host", "c").distinct().count()


# ---- state that rolls and expires ----

def stored(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*.parquet"))


def test_counts_roll_and_repeat(spark, tmp_path):
    path, each = tmp_path / "state", J.baseline_counter(str(tmp_path / "state"), {"host": F.col("host")}, parts=4)
    want, most = {}, 0
    for b in range(6):
        rows = make(20, b * 20) if b % 3 else [(b, datetime(2024, 1, 1), f"only-{b}", "x")]
        df = spark.createDataFrame(rows, "log_id bigint, ts timestamp, host string, c string")
        for _ in range(2 if b == 3 else 1):  # a repeated batch changes nothing
            each(df, b)
        for r in rows:
            want[r[2]] = want.get(r[2], 0) + 1
        most = max(most, len({p.split("/part")[0] + p.split("/")[1] for p in stored(path)}))
        assert {r["key"]: r["count"] for r in J.read_baseline(spark, str(path)).collect()} == want
    assert most <= 8  # two folders a part, whatever the number of batches
    untouched = J.RollingState(spark, str(path), ["kind", "key"], 4).folders()
    assert len({b[0] for b in untouched.values()}) > 1  # parts that a batch does not touch are not rewritten
    each(spark.createDataFrame([], "log_id bigint, ts timestamp, host string, c string"), 9)
    assert {r["key"]: r["count"] for r in J.read_baseline(spark, str(path)).collect()} == want


def test_unfinished_batches_are_not_read(spark, tmp_path):
    path = tmp_path / "state"
    each = J.fifo_writer(str(path), ["host"], 3, parts=2)
    each(spark.createDataFrame(make(40), "log_id bigint, ts timestamp, host string, c string"), 0)
    before = sorted(map(tuple, J.read_buffer(spark, str(path), ["host"]).collect()))
    assert len(before) == 6
    each(spark.createDataFrame(make(40, 40), "log_id bigint, ts timestamp, host string, c string"), 1)
    after = sorted(map(tuple, J.read_buffer(spark, str(path), ["host"]).collect()))
    (path / "batch=1" / "_SUCCESS").unlink()
    assert sorted(map(tuple, J.read_buffer(spark, str(path), ["host"]).collect())) == before
    each(spark.createDataFrame(make(40, 40), "log_id bigint, ts timestamp, host string, c string"), 1)
    assert sorted(map(tuple, J.read_buffer(spark, str(path), ["host"]).collect())) == after != before


def test_a_ring_keeps_the_newest_models(spark, tmp_path):
    import numpy as np
    rng, path = np.random.default_rng(3), str(tmp_path / "ring")
    each = J.mini_model_writer(path, ["a", "b"], trees=2, samples=32, keep=3)
    for b in range(5):
        rows = [("steady", i, float(rng.normal(5 * b)), float(rng.normal())) for i in range(60)]
        rows += [("early", i, float(rng.normal()), 0.0) for i in range(60)] if b < 1 else [("early", 1, 0.0, 0.0)]
        each(spark.createDataFrame(rows, "host string, log_id bigint, a double, b double"), b)
    models = {(r["host"], r["member"]): r for r in J.ring(spark, path, 3).collect()}
    assert sorted(m for h, m in models if h == "steady") == [2, 3, 4] and sorted(m for h, m in models if h == "early") == [0]
    weights = [models["steady", m]["weight"] for m in (4, 3, 2)]
    assert abs(sum(weights) - 1) < 1e-9 and weights[0] > weights[1] > weights[2]
    assert models["steady", 4]["mean"][0] > 18 > 12 > models["steady", 2]["mean"][0]  # each with the scaler of its own batch


def test_state_of_a_cooldown_expires(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    start, sizes = datetime(2024, 1, 1), []
    for b in range(4):
        rows = [(k, start + timedelta(hours=6 * b, minutes=m)) for k in (f"batch-{b}", f"also-{b}") for m in (0, 10, 40)]
        spark.createDataFrame(rows, "alert_key string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
        stream = J.file_stream(spark, src, spark.read.parquet(src).schema)
        sizes += J.state_rows(J.run_available(J.cooled_alerts(stream, 30), out, ck))
    kept = spark.read.parquet(out).groupBy("alert_key").count().collect()
    assert len(kept) == 8 and {r["count"] for r in kept} == {2}
    assert max(sizes) <= 8 and sizes[-1] <= 4  # state of two batches' keys and their timers at most

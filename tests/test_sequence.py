"""Chunked ordered operators against brute force, with one key holding most rows and pieces of a few rows."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievelog.operators import features as FE, history as H, lookup as L, sequence as Q


@pytest.fixture(scope="module")
def frame():
    rng = random.Random(7)
    rows, start = [], datetime(2024, 1, 1)
    for i in range(600):
        host = "hot" if rng.random() < 0.7 else rng.choice(["a", "b"])
        rows.append((i, start + timedelta(seconds=rng.choice([0, 1, 5, 40, 700]) * rng.randint(0, 60)), host, rng.randint(0, 1), rng.choice("xy")))
    return pd.DataFrame(rows, columns=["log_id", "ts", "host", "flag", "c"]).sort_values(["host", "ts", "log_id"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).repartition(5)


def by_id(sdf, *cols):
    return sdf.select("log_id", *cols).toPandas().set_index("log_id").sort_index()


def test_previous_and_position(df, frame):
    out = by_id(Q.with_previous(df, ["host"], "ts", "log_id", ["ts", "c"], {"last_flag": F.when(F.col("flag") == 1, F.col("log_id"))}, 60_000_000),
                "seq", "prev_c", "last_flag")
    g = frame.groupby("host")
    want = frame.assign(seq=g.cumcount() + 1, prev_c=g["c"].shift(), f=frame["log_id"].where(frame["flag"] == 1))
    want["last_flag"] = want.groupby("host")["f"].transform(lambda s: s.ffill().shift())
    want = want.set_index("log_id").sort_index()
    assert (out["seq"] == want["seq"]).all()
    assert (out["prev_c"].fillna("-") == want["prev_c"].fillna("-")).all()
    assert (out["last_flag"].fillna(-1) == want["last_flag"].fillna(-1)).all()


@pytest.mark.parametrize("block", [13, 50, 100_000])
def test_rolling_mean(df, frame, block):
    seq = Q.with_previous(df, ["host"], "ts", "log_id", [], None, 60_000_000)
    out = by_id(Q.rolling_mean(seq, ["host"], "flag", 10, "m", block), "m")
    want = frame.assign(m=frame.groupby("host")["flag"].transform(lambda s: s.rolling(10, min_periods=1).mean())).set_index("log_id").sort_index()
    assert len(out) == len(frame)
    assert ((out["m"] - want["m"]).abs() < 1e-9).all()


def test_trailing_sums(spark, df, frame):
    span = 300_000_000
    out = Q.trailing_sums(df, ["host"], "ts", {"n": F.lit(1).cast("bigint"), "f": F.col("flag").cast("bigint")}, span, 60_000_000).toPandas()
    got = {(h, u): (n, f) for h, u, n, f in out[["host", "_us", "n", "f"]].itertuples(index=False)}
    us = (frame["ts"] - pd.Timestamp("1970-01-01")) // pd.Timedelta(microseconds=1)
    for host, t in {(h, u) for h, u in zip(frame["host"], us)}:
        inside = (frame["host"] == host) & (us > t - span) & (us <= t)
        assert got[(host, t)] == (inside.sum(), frame.loc[inside, "flag"].sum())


@pytest.mark.parametrize("span, chunk", [(300_000_000, 60_000_000), (300_000_000, 70_000_000), (300_000_000, 10**9), (7_000_003, 60_000_000), (7_000_003, 1_000_000)])
def test_trailing_sums_of_any_span(spark, df, frame, span, chunk):
    parts = Q.span_chunks(span, chunk)
    assert span % parts == 0
    out = Q.trailing_sums(df, ["host"], "ts", {"n": F.lit(1).cast("bigint"), "f": F.when(F.col("flag") == 1, F.col("flag") / 8)}, span, chunk).toPandas()
    got = {(h, u): (n, f) for h, u, n, f in out[["host", "_us", "n", "f"]].itertuples(index=False)}
    us = (frame["ts"] - pd.Timestamp("1970-01-01")) // pd.Timedelta(microseconds=1)
    places = {(h, u) for h, u in zip(frame["host"], us)}
    assert len(out) == len(places)
    for host, t in places:
        inside = (frame["host"] == host) & (us > t - span) & (us <= t)
        n, f = got[(host, t)]
        flags = frame.loc[inside, "flag"].sum()
        assert n == inside.sum() and (pd.isna(f) if flags == 0 else f == flags / 8)


def test_trailing_sums_do_not_drift(spark):
    """A long key of fractions after lines of a huge value: what lies outside a span leaves no trace in its sum."""
    n, second = 60_000, 1_000_000
    value = F.when(F.col("id") < 500, F.lit(1e17)).otherwise(F.lit(0.1))
    rows = spark.range(n, numPartitions=6).select(F.lit("hot").alias("host"), F.timestamp_micros(F.col("id") * second).alias("ts"), value.alias("v"))
    out = Q.trailing_sums(rows, ["host"], "ts", {"v": F.col("v")}, 600 * second, 60 * second)
    late = out.filter(F.col("_us") >= 1100 * second).agg(F.min("v"), F.max("v"), F.count("v")).first()
    assert abs(late[0] - 60) < 1e-9 and abs(late[1] - 60) < 1e-9 and late[2] == n - 1100


def test_trailing_sums_without_times(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("a", datetime(2024, 1, 1), 4), (None, datetime(2024, 1, 1), 8)], "host string, ts timestamp, v long")
    out = {(r["host"], r["_us"] is None): r["v"] for r in Q.trailing_sums(rows, ["host"], "ts", {"v": F.col("v")}, 600_000_000).collect()}
    assert out == {("a", True): 3, ("a", False): 4, (None, False): 8}
    assert Q.trailing_sums(rows.limit(0), ["host"], "ts", {"v": F.col("v")}, 600_000_000).count() == 0


def test_newest(df, frame):
    out = Q.newest(df, ["host"], "ts", "log_id", 37, 60_000_000).toPandas()
    want = frame.groupby("host").tail(37)
    assert sorted(out["log_id"]) == sorted(want["log_id"])


def test_trim_oldest(df, frame):
    out = H.trim_oldest(df, "ts", "log_id", 0.2, 60_000_000).toPandas()
    want = frame.sort_values(["ts", "log_id"]).iloc[int(len(frame) * 0.2):]
    assert sorted(out["log_id"]) == sorted(want["log_id"])


def test_lookup_above_the_broadcast_bound(df, frame):
    counts = df.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    joined = L.attach(df, counts, ["host"])
    assert joined.count() == len(frame)
    assert L.attach(df, counts, ["host"]).agg(F.sum("n")).first()[0] == joined.agg(F.sum("n")).first()[0]


def test_lines_without_time_or_host_stay(spark):
    rows = spark.createDataFrame([(1, None, None, "c", "m", "I", "{}"), (2, datetime(2024, 1, 1), "h", "c", "m", "I", None)],
                                 "log_id int, ts timestamp, host string, c string, msg string, s string, attr string")
    assert FE.mongodb_features(rows).count() == 2


def test_null_keys_keep_their_lines(spark):
    rows = [(None if i % 3 else "a", datetime(2024, 1, 1, 0, i % 60), i, i) for i in range(120)]
    df = spark.createDataFrame(rows, "host string, ts timestamp, log_id long, v long")
    out = Q.with_previous(df, ["host"], "ts", "log_id", ["v"])
    assert out.count() == 120 and out.filter("host IS NULL").agg({"seq": "max"}).first()[0] == 80
    assert Q.newest(df, ["host"], "ts", "log_id", 50).count() == 90
    assert Q.trailing_sums(df, ["host"], "ts", {"n": F.lit(1)}, 60_000_000).filter("host IS NULL").count() > 0


# ---- pieces of bounded size ----

def crowd(spark, n):
    """One host with all lines in one second, half of them at one microsecond; another without times; a quiet one."""
    start = F.timestamp_micros(F.lit(1_704_067_200_000_000))
    ids = spark.range(n, numPartitions=4).withColumnRenamed("id", "log_id")
    late = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.when(F.col("log_id") % 2 == 0, 500).otherwise(F.col("log_id") * 37 % 1_000_000))
    hot = ids.select(F.lit("hot").alias("host"), late.alias("ts"), "log_id")
    lost = ids.select(F.lit(None).cast("string").alias("host"), F.lit(None).cast("timestamp").alias("ts"), (F.col("log_id") + n).alias("log_id"))
    quiet = ids.limit(10).select(F.lit("quiet").alias("host"), start.alias("ts"), (F.col("log_id") + 2 * n).alias("log_id"))
    return hot.unionByName(lost).unionByName(quiet)


def test_no_piece_is_above_its_rows(spark):
    n, most = 40_000, 1000
    cut = Q.pieces(crowd(spark, n), ["host"], "ts", "log_id", piece_rows=most)
    sizes = cut.groupBy("host", "_chunk", "_slot").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "log_id")).alias("a"), F.max(F.struct("ts", "log_id")).alias("b")).collect()
    assert max(r["n"] for r in sizes) <= most and sum(r["n"] for r in sizes) == 2 * n + 10
    assert len(sizes) <= 5 * n / most
    for host in ("hot", None):
        rows = sorted((r for r in sizes if r["host"] == host), key=lambda r: (r["_chunk"], r["_slot"]))
        key = lambda x: (x["ts"] is not None, x["ts"], x["log_id"]) if x["ts"] else (False, x["log_id"])
        assert len(rows) > 30 and all(key(a["b"]) < key(b["a"]) for a, b in zip(rows, rows[1:]))


def test_order_over_split_pieces(spark):
    n = 6000
    df = crowd(spark, n)
    got = Q.with_previous(df, ["host"], "ts", "log_id", ["log_id"], {"last_even": F.when(F.col("log_id") % 2 == 0, F.col("log_id"))}, piece_rows=100)
    pdf = got.filter("host = 'hot'").toPandas().sort_values(["ts", "log_id"])
    assert pdf["seq"].tolist() == list(range(1, n + 1))
    assert pdf["prev_log_id"].iloc[1:].tolist() == pdf["log_id"].iloc[:-1].tolist()
    even = pdf["log_id"].where(pdf["log_id"] % 2 == 0).ffill().shift()
    assert (pdf["last_even"].fillna(-1) == even.fillna(-1)).all()
    top = Q.newest(df, ["host"], "ts", "log_id", 777, piece_rows=100)
    assert sorted(r["log_id"] for r in top.filter("host = 'hot'").collect()) == sorted(pdf["log_id"].tail(777))


def test_pieces_of_an_empty_table(spark):
    assert Q.with_previous(crowd(spark, 10).limit(0), ["host"], "ts", "log_id", ["log_id"]).count() == 0


def test_messages_are_counted_by_hash(spark):
    """Frequent, rare and missing messages, a null host too; no text of a message in an exchange of the counts."""
    rows = [(h, "I", "C", m) for h in ("hot", None) for m, n in [("often", 120), ("99 times", 99), ("x" * 5000, 100), ("", 100), (None, 150)] for _ in range(n)]
    df = spark.createDataFrame(rows, "host string, s string, c string, msg string").withColumn("message_fingerprint", F.lit("f"))
    out = FE.frequency_features(df.filter("host IS NOT NULL"), ["host"])
    assert "message_hash" not in out.columns and out.count() == 569
    flags = {r["msg"]: r["is_rare_message"] for r in out.select("msg", "is_rare_message").distinct().collect()}
    assert flags == {"often": 0, "99 times": 1, "x" * 5000: 0, "": 0, None: 0}
    plan = FE.frequency_features(df, ["host"]).select("host", "is_rare_message")._jdf.queryExecution().executedPlan().toString()
    assert "message_hash" in plan and not any("msg#" in line for line in plan.splitlines() if "hashpartitioning" in line)

"""Continuous versions of the stateful behaviours, on file sources and with event-time state.

Keys may be very hot, so per-line work never keeps one state per host. State is held per window, per alert key,
or as small tables that a micro-batch joins; ordered features run the chunked batch operator on each micro-batch
plus the tail rows of the batch before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from sievelog.operators import features as FE, forest as FO, history as H, rules as R, severity as S
from sievelog.operators.sequence import newest, top_n
from sievelog.sources.store import materialise

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000, glob: str | None = None) -> DataFrame:
    """Parquet files as they arrive; event time as TIMESTAMP, which watermarks need."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append", partition_by: list[str] | None = None) -> StreamingQuery:
    """Processes what is there now into Parquet and stops; on a cluster use a processing-time trigger instead."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    query = df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


# ---- windows ----

def tumbling_counts(stream: DataFrame, keys: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Closed windows only; lines later than the watermark are dropped and counted by the query progress."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), *keys, "n")


def sliding_counts(stream: DataFrame, keys: list[str], events: dict[str, str], minutes: int = 15, slide: int = 5, late: str = "1 hour") -> DataFrame:
    """Event counts in overlapping windows."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes", f"{slide} minutes").alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("lines"), *[F.count_if(F.expr(c)).alias(n) for n, c in events.items()]).select(
        F.col("w.start").alias("start"), *keys, "lines", *events)


def bursts(stream: DataFrame, keys: list[str], gap: str = "1 second", late: str = "1 hour") -> DataFrame:
    """Runs of lines whose gaps stay under the session gap."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("length")).select(
        F.col("w.start").alias("start"), *keys, "length")


def without_repeats(stream: DataFrame, keys: list[str], late: str = "30 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def dropped_late_rows(query: StreamingQuery) -> int:
    """Lines the watermark dropped, over the progress reports the query still holds."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


# ---- cooldown ----

class Cooldown(StatefulProcessor):
    """Per alert key, the time of the last alert let through. Alerts within a batch are taken in event time. A timer drops
    the state once the watermark has passed the cooldown: whatever still comes is let through anyway."""

    def __init__(self, minutes: int) -> None:
        self.micros = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for pdf in rows for t in pdf["us"])
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for t in times:
            if last is None or t - last >= self.micros:
                kept.append(t)
                last = t
        if kept:
            self.last.update((int(last),))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self.over(last))
        yield pd.DataFrame({"alert_key": [key[0]] * len(kept), "kept_us": kept})

    def over(self, last: int) -> int:
        """The millisecond after which the cooldown of an alert is over."""
        return (int(last) + self.micros) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.over(self.last.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield pd.DataFrame({"alert_key": pd.Series([], dtype="object"), "kept_us": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def cooled_alerts(alerts: DataFrame, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Input (alert_key, ts): alerts, not log lines. Also the per-host pause between analyses, with the host as key.
    Alerts later than the watermark are dropped and counted by the query progress. Needs the RocksDB state store."""
    timed = alerts.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("alert_key").transformWithStateInPandas(
        Cooldown(minutes), outputStructType="alert_key string, kept_us bigint", outputMode="Append", timeMode="EventTime")


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows of state after each batch of a query."""
    return [sum(int(op["numRowsTotal"]) for op in p["stateOperators"]) for p in query.recentProgress]


# ---- joins ----

def enriched(stream: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """New analyses beside the stored summary of their host (stream-static)."""
    return stream.join(history, keys, "left")


def with_feedback(anomalies: DataFrame, feedback: DataFrame, within: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Anomalies with feedback that arrives later, up to a bound; unmatched ones come out once the bound passed."""
    a = anomalies.withWatermark("ts", late)
    f = feedback.withWatermark("feedback_ts", late)
    same = (F.col("log_id") == F.col("f_log_id")) & (F.col("feedback_ts") >= F.col("ts")) & (F.col("feedback_ts") <= F.col("ts") + F.expr(f"interval {within}"))
    return a.join(f, same, "leftOuter")


# ---- micro-batch tables ----

def batch_table(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


class RollingState:
    """A table that micro-batches fold into. Rows lie in `parts` hash parts of their key; a batch reads the parts it
    touches, merges them with its own rows and writes them to its own folder, `batch=b/part=p`. The newest folder of a part
    holds the part. Of each part the folder before that stays too, so that a repeated batch starts from the same state and
    writes the same rows; older ones go. A reader sees finished batches only, at most one folder a part."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], parts: int = 16) -> None:
        self.spark, self.path, self.keys, self.parts = spark, path.rstrip("/"), keys, parts

    def _files(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def folders(self, before: int | None = None) -> dict[int, list[int]]:
        """For each part the finished batches that hold it, newest first."""
        fs, place = self._files()
        found: dict[int, list[int]] = {}
        for folder in fs.listStatus(place) if fs.exists(place) else []:
            batch = int(folder.getPath().getName().removeprefix("batch="))
            inside = [x.getPath().getName() for x in fs.listStatus(folder.getPath())]
            if "_SUCCESS" in inside and (before is None or batch < before):
                for name in inside:
                    if name.startswith("part="):
                        found.setdefault(int(name.removeprefix("part=")), []).append(batch)
        return {part: sorted(batches, reverse=True) for part, batches in found.items()}

    def read(self, before: int | None = None, parts: list[int] | None = None) -> DataFrame | None:
        paths = [f"{self.path}/batch={b[0]}/part={p}" for p, b in sorted(self.folders(before).items()) if parts is None or p in parts]
        return self.spark.read.parquet(*paths) if paths else None

    def fold(self, rows: DataFrame, batch_id: int, merge: Callable[[DataFrame], DataFrame]) -> None:
        """`merge` gets the old rows of the touched parts and the new ones, and returns what stays of them."""
        part = F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")
        fresh = materialise(rows, "fresh")  # read for the parts it touches and for its rows
        touched = [r["part"] for r in fresh.select(part.alias("part")).distinct().collect()]  # at most `parts` numbers
        old = self.read(batch_id, touched) if touched else None
        both = fresh if old is None else old.unionByName(fresh)
        merge(both).withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(batch_table(self.path, batch_id))
        fs, _ = self._files()
        for number, batches in self.folders(batch_id + 1).items():
            for b in batches[2:]:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{batch_table(self.path, b)}/part={number}"), True)


def baseline_counter(path: str, keys: dict[str, Column], parts: int = 16) -> Callable[[DataFrame, int], None]:
    """Counts per (kind, key) over all batches so far; `read_baseline` reads them."""
    def each(batch: DataFrame, batch_id: int) -> None:
        cells = F.array(*[F.struct(F.lit(k).alias("kind"), e.cast("string").alias("key")) for k, e in keys.items()])
        counts = batch.select(F.explode(cells).alias("x")).groupBy("x.kind", "x.key").agg(F.count(F.lit(1)).alias("count"))
        RollingState(batch.sparkSession, path, ["kind", "key"], parts).fold(
            counts, batch_id, lambda rows: rows.groupBy("kind", "key").agg(F.sum("count").alias("count")))
    return each


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return RollingState(spark, path, ["kind", "key"]).read()


def fifo_writer(path: str, keys: list[str], n: int, parts: int = 16) -> Callable[[DataFrame, int], None]:
    """The newest n rows per key over all batches so far; `read_buffer` reads them."""
    def each(batch: DataFrame, batch_id: int) -> None:
        RollingState(batch.sparkSession, path, keys, parts).fold(
            newest(batch, keys, "ts", "log_id", n), batch_id, lambda rows: newest(rows, keys, "ts", "log_id", n))
    return each


def read_buffer(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return RollingState(spark, path, keys).read()


def late_rows_table(query: StreamingQuery, spark: SparkSession) -> DataFrame:
    """(batch, rows, dropped): what each batch of a query read and what its watermark dropped, as rows to keep."""
    rows = [(int(p["batchId"]), int(p["numInputRows"]), sum(int(op.get("numRowsDroppedByWatermark", 0)) for op in p["stateOperators"]))
            for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch bigint, rows bigint, dropped bigint")


def sequence_writer(spark: SparkSession, out: str, tails: str, keys: list[str], carry: int = 100) -> Callable[[DataFrame, int], None]:
    """Gap, burst and density features in event order across batches. Each batch is joined by the last `carry` lines
    per key of the batch before (the most any feature looks back), runs the chunked operator, and keeps its own tail."""
    def each(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.withColumn("_new", F.lit(True))
        rows = fresh
        if batch_id > 0:
            rows = fresh.unionByName(spark.read.parquet(batch_table(tails, batch_id - 1)).withColumn("_new", F.lit(False)))
        rows = materialise(rows, "batch")
        done = FE.sequence_features(rows, keys).filter("_new").drop("_new", "seq")
        done.write.mode("overwrite").parquet(batch_table(out, batch_id))
        newest(rows.drop("_new"), keys, "ts", "log_id", carry).write.mode("overwrite").parquet(batch_table(tails, batch_id))
    return each


def mini_model_writer(path: str, features: list[str], trees: int = 100, samples: int = 256, keep: int = 10) -> Callable[[DataFrame, int], None]:
    """A ring of small forests per host: each batch adds one, with its own scaler and threshold, for every host with enough
    rows; beyond `keep` a host's oldest goes. A model is one row."""
    def each(batch: DataFrame, batch_id: int) -> None:
        grown = FO.member(materialise(batch.select("host", "log_id", *features), "batch"), features, batch_id, trees, samples)
        RollingState(batch.sparkSession, path, ["host"]).fold(grown, batch_id, lambda rows: top_n(rows, ["host"], [F.desc("member")], keep))
    return each


def ring(spark: SparkSession, path: str, keep: int = 10) -> DataFrame | None:
    """The models of each host with their weights: the newest most, older ones less by 0.9 a batch."""
    models = RollingState(spark, path, ["host"]).read()
    return None if models is None else H.ensemble_weights(models, ["host"], "member", keep).drop("age", "models")


def scoring_writer(out: str, models: DataFrame, features: list[str], source: str = "mongodb") -> Callable[[DataFrame, int], None]:
    """Vote of a host's models, rules and severity for the lines of a batch."""
    def each(batch: DataFrame, batch_id: int) -> None:
        scored = FO.score_members(FE.align_schema(batch, features), models, features)
        joined = batch.join(scored, ["host", "log_id"]).withColumn("model_score", F.col("anomaly_score"))  # rules change the other
        S.score_severity(R.apply_rules(joined, R.RULES[source]), source).write.mode("overwrite").parquet(batch_table(out, batch_id))
    return each

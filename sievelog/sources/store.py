"""Tables written and read back: analyses, alerts, exports, and the run-scoped scratch tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelog.operators import analysis as A
from sievelog.operators.sequence import top_n


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. A local folder serves only a local master, where
    driver and executors are one process; elsewhere a missing name is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(scratch_dir, "local"):
        scratch_dir.local = tempfile.mkdtemp(prefix="sievelog-")
    return scratch_dir.local


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows once as a Parquet table in the scratch folder and reads them back: lineage ends here, lost
    executors reread the table, and later steps prune its columns."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/sievelog-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def capped_anomalies(lines: DataFrame, keys: list[str], cap: int = 100) -> DataFrame:
    """The most severe `cap` anomalies of each analysis as one array, with a flag when more were found."""
    bad = lines.filter(A.IS_ANOMALY)
    total = bad.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    kept = top_n(bad, keys, A.by_severity(), cap).groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct((-F.col("severity_score")).alias("order"), "log_id", "severity_score", "severity_level",
                 F.substring("msg", 1, 1000).alias("message")))).alias("anomalies"))
    return kept.join(total, keys).withColumn("is_truncated", F.col("_n") > cap).drop("_n")


def normalise_layout(df: DataFrame, fields: tuple[str, ...] = ("n_anomalies", "total_logs")) -> DataFrame:
    """Old nested and new flat analyses to one layout."""
    return df.withColumns({f: F.coalesce(F.col(f), F.col(f"data.summary.{f}")) for f in fields}).drop("data")


def save_partitioned(df: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """One folder per day, lines of a day spread over tasks by hash so that a busy day is not one file."""
    day = F.to_date(F.col(ts).cast("timestamp"))
    df.withColumn("dt", day).write.mode(mode).partitionBy("dt").parquet(path)


def with_expiry(df: DataFrame, days: int = 90, ts: str = "ts") -> DataFrame:
    return df.withColumn("ttl_date", F.col(ts) + F.make_dt_interval(days=F.lit(days)))


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    """Critical anomalies of one analysis as JSON or CSV with a header."""
    if kind == "csv":
        df.write.mode("errorifexists").option("header", True).csv(path)
    else:
        df.write.mode("errorifexists").json(path)


def upsert_counts(spark: SparkSession, path: str, batch: DataFrame, batch_id: int) -> None:
    """Adds a batch of (kind, key, count) to a baseline folder once: a batch replaces only its own folder, so a
    repeated batch changes nothing."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_counts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("count").alias("count"))

"""Evaluation of labels against predictions, pseudo labels, and feature redundancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# ---- fixed values: flags that label a line as anomaly, with their confidence ----
LABEL_FLAGS = [("is_fatal", 1.0), ("is_out_of_memory", 1.0), ("is_shutdown", 0.9), ("is_drop_operation", 0.85),
               ("is_assertion", 0.8), ("is_memory_limit", 0.8)]
STATISTICAL = ["query_duration_ms", "docs_examined_count", "keys_examined_count", "performance_score"]


def pseudo_labels(lines: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Label and confidence of each line: rule flags, heavy scans, log-scale outliers; normal replication is a sure
    negative unless the line is an outlier. Returns all lines; `kept` marks those confident enough to evaluate on."""
    stats = lines.agg(*[F.struct(
        F.avg(F.log1p(c)).alias("m"), F.stddev_pop(F.log1p(c)).alias("sd"), F.count_if(F.col(c) > 0).alias("n")).alias(c) for c in STATISTICAL])
    packed = stats.select(F.struct(*STATISTICAL)).scalar()
    df = lines.withColumn("_s", packed)
    outlier = None
    for c in STATISTICAL:
        z = F.abs((F.log1p(c) - F.col(f"_s.{c}.m")) / (F.col(f"_s.{c}.sd") + F.lit(1e-10)))
        test = (F.col(f"_s.{c}.n") > 10) & (z > 3)
        outlier = test if outlier is None else outlier | test
    ruled = F.greatest(*[F.when(F.col(f) == 1, F.lit(v)).otherwise(0.0) for f, v in LABEL_FLAGS],
                       F.when((F.col("is_collscan") == 1) & (F.col("docs_examined_count") > 100000), 0.75).otherwise(0.0))
    df = df.withColumns({"_rule": ruled, "_out": outlier})
    normal = F.col("is_normal_replication") == 1
    base = F.when(normal, 0.95).otherwise(F.col("_rule"))
    return df.withColumns({
        "label": F.when(F.col("_out"), 1).when(normal, 0).when(F.col("_rule") > 0, 1).otherwise(0),
        "label_confidence": F.when(F.col("_out"), F.greatest(base, F.lit(0.6))).otherwise(base),
    }).withColumn("kept", F.col("label_confidence") > min_confidence).drop("_s", "_rule", "_out")


def classifier_metrics(df: DataFrame, keys: list[str], truth: Column, flagged: Column) -> DataFrame:
    """Confusion counts and the usual rates; undefined rates are 0."""
    counts = df.groupBy(*keys).agg(
        F.count_if(truth & flagged).alias("tp"), F.count_if(~truth & flagged).alias("fp"),
        F.count_if(~truth & ~flagged).alias("tn"), F.count_if(truth & ~flagged).alias("fn"))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = counts.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "accuracy": share(tp + tn, tp + tn + fp + fn),
                              "fpr": share(fp, fp + tn), "fnr": share(fn, fn + tp),
                              "mcc": share(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))})
    out = out.withColumn("f1", share(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("rating", F.when(F.col("f1") >= 0.8, "EXCELLENT").when(F.col("f1") >= 0.6, "GOOD").when(
        F.col("f1") >= 0.4, "FAIR").otherwise("POOR"))


def roc_auc(df: DataFrame, truth: Column, score: Column, pieces: int = 256) -> DataFrame:
    """Area under the curve by rank sums, ties at half. Rows collapse to distinct scores; those are cut into pieces of
    about equal size at score quantiles, so a narrow score range does not end in one task. The only ordered pass
    without a key has one row per piece."""
    points = df.select(score.cast("double").alias("x"), truth.alias("y")).groupBy("x").agg(
        F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    cuts = points.agg(F.percentile_approx("x", [i / pieces for i in range(1, pieces)], 10 * pieces)).scalar()
    points = points.withColumn("_cuts", cuts)
    points = points.withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col("x")))).drop("_cuts")
    per = points.groupBy("_piece").agg(F.sum("neg").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("_piece", before.alias("_before"))
    inside = Window.partitionBy("_piece").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_before") + F.coalesce(F.sum("neg").over(inside), F.lit(0))
    ranked = points.join(per, "_piece").withColumn("_below", below)
    return ranked.agg((F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"),
                      F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def correlated_pairs(df: DataFrame, features: list[str], limit: float = 0.9) -> DataFrame:
    """Pairs of features with |r| above the limit; one pass of partial correlation aggregates."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    cells = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.corr(a, b).alias("r")) for a, b in pairs])
    return df.agg(cells.alias("p")).select(F.inline("p")).filter(F.abs("r") > limit)


def tail_agreement(a: DataFrame, b: DataFrame, share: float = 0.02, accuracy: int = 10000) -> DataFrame:
    """Rows in the lowest share of each scoring, rows in both, and their agreement."""
    cut = lambda df: df.agg(F.percentile_approx("anomaly_score", F.lit(share), accuracy)).scalar()
    low_a, low_b = a.filter(F.col("anomaly_score") < cut(a)), b.filter(F.col("anomaly_score") < cut(b))
    both = low_a.select("host", "log_id", F.lit(1).alias("a")).join(
        low_b.select("host", "log_id", F.lit(1).alias("b")), ["host", "log_id"], "full_outer")
    n_a, n_b = F.count("a"), F.count("b")
    return both.agg(n_a.alias("tail_a"), n_b.alias("tail_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"),
                    (F.least(n_a, n_b) / F.greatest(n_a, n_b)).alias("consistency"))


def buffer_health(buffer: DataFrame, low: float = 0.01, high: float = 0.2) -> DataFrame:
    """Samples and anomaly share of every host's buffer, with a grade."""
    ratio = F.avg((F.col("prediction") == -1).cast("int"))
    return buffer.groupBy("host").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("prediction") == -1).alias("anomaly_samples"), ratio.alias("anomaly_ratio"),
        F.when(F.count(F.lit(1)) < 100, "too_small").when((ratio < low) | (ratio > high), "skewed").otherwise("healthy").alias("grade"))


# ---- fixed values: source, critical rate, warning rate, critical count, high count that warns ----
RISK_LIMITS = [("mongodb", 15.0, 8.0, 3, 3), ("mssql", 12.0, 6.0, 2, 2), ("elasticsearch", 10.0, 5.0, 1, 2)]


def risk_signal(summary: DataFrame) -> DataFrame:
    """Risk of an analysis by the limits of its source_type (those of the document database when unknown)."""
    names = ("_cr", "_wr", "_cc", "_hc")
    pick = lambda i: F.coalesce(*[F.when(F.col("source_type") == r[0], F.lit(r[i])) for r in RISK_LIMITS], F.lit(RISK_LIMITS[0][i]))
    df = summary.withColumns({n: pick(i) for i, n in enumerate(names, 1)})
    rate, critical, high = F.col("anomaly_rate"), F.col("sev_critical"), F.col("sev_high")
    risk = (F.when((critical >= F.col("_cc")) | (rate > F.col("_cr")), "CRITICAL")
            .when((critical >= 1) | (high >= F.col("_hc")) | (rate > F.col("_wr")), "WARNING").when(F.col("n_anomalies") > 0, "INFO").otherwise("OK"))
    direction = F.when(rate > 10, "elevated").when(rate > 5, "moderate").when(rate < 2, "low").otherwise("stable")
    return df.withColumns({"risk": risk, "risk_direction": direction}).drop(*names)

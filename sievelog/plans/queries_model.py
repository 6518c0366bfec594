"""Forest, drift, importance and evaluation. `lineitem` stands for a wide feature table with three very large keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelog.operators import analysis as A, evaluate as E, features as FE, forest as FO
from sievelog.plans import oracle as O
from sievelog.plans.queries_analysis import BAD, LINES_SQL, lines, r6
from sievelog.plans.queries_history import HISTORY_SQL, history
from sievelog.plans.registry import query
from sievelog.sources import views
from sievelog.sources.store import materialise
from sievelog.sources.views import table

FEATURES = ["quantity", "price", "discount", "tax", "day"]
MATRIX_SQL = """SELECT l_returnflag AS host, l_orderkey * 8 + l_linenumber AS log_id, l_quantity AS quantity, l_extendedprice AS price,
 l_discount AS discount, l_tax AS tax, CAST(day(l_shipdate) AS DOUBLE) AS day FROM lineitem"""
L = f"WITH {LINES_SQL}"


def matrix(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(MATRIX_SQL)


@query("e01_scaling", f"""WITH m AS ({MATRIX_SQL}) SELECT host, log_id, {', '.join(
    f"round(({f} - avg({f}) OVER (PARTITION BY host)) / stddev_pop({f}) OVER (PARTITION BY host), 5) AS {f}" for f in FEATURES)} FROM m""")
def scaling(spark, d):
    m = matrix(spark, d)
    out = FO.scale(m, FO.fit_scaler(m, FEATURES), FEATURES)
    return out.select("host", "log_id", *[F.round(f, 5).alias(f) for f in FEATURES])


@query("e03_e05_e11_training_plan", """WITH n AS (SELECT user_id AS host, count(*) AS n FROM events GROUP BY 1)
SELECT host, n AS rows, CAST(CASE WHEN n < 500 THEN least(n, 256) WHEN n < 2000 THEN greatest(least(floor(n * 0.8), 512), 64) ELSE 512 END AS INTEGER) AS sample_size,
 round(CAST(CASE WHEN n < 500 THEN 0.10 WHEN n < 2000 THEN 0.075 ELSE 0.05 END AS DOUBLE), 6) AS contamination, CASE WHEN n >= 50 THEN 'SUCCESS' ELSE 'SKIPPED' END AS status FROM n""")
def training_plan(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("host"))
    return FO.plan(rows).select("host", "rows", "sample_size", r6("contamination"), "status")


TREES, SAMPLES, SLICE = 300, 512, 15_000


def _fitted(spark, d):
    m = matrix(spark, d)
    return m, materialise(FO.fit(m, FEATURES, TREES, SAMPLES), "forest")


@query("e02_forest_nodes")
def forest_nodes(spark, d):
    _, nodes = _fitted(spark, d)
    return nodes.groupBy("host").agg(F.count_distinct("tree").alias("trees"), F.count(F.lit(1)).alias("nodes"),
                                     F.max("samples").alias("samples"), r6("mean_path", F.avg(F.when(F.col("feature") < 0, F.col("path")))))


@query("e04_forest_predictions")
def forest_predictions(spark, d):
    m, nodes = _fitted(spark, d)
    scored = materialise(FO.score(m, nodes, FEATURES, SLICE), "scores")
    out = FO.predict(scored, FO.thresholds(scored, FO.plan(m)))
    return out.select("host", "log_id", r6("anomaly_score"), "prediction")


@query("e06_global_fallback")
def global_fallback(spark, d):
    m = matrix(spark, d)
    own = FO.fit(m.filter("host = 'N'"), FEATURES, TREES, SAMPLES)
    nodes = materialise(own.unionByName(FO.fit_global(m, FEATURES, trees=TREES, samples=SAMPLES)), "forest")
    return FO.score(m, nodes, FEATURES, SLICE).groupBy("host").agg(
        F.count(F.lit(1)).alias("rows"), F.count("anomaly_score").alias("scored"), r6("mean_score", F.avg("anomaly_score")))


@query("e07_e08_ensemble")
def ensemble(spark, d):
    """Three batch models, weighted by age, voting on every row."""
    m = matrix(spark, d)
    votes, rows = None, []
    for batch in range(3):
        part = m.filter(F.pmod(F.col("log_id"), F.lit(3)) == batch)
        nodes = materialise(FO.fit(part, FEATURES, TREES, SAMPLES, seed=42 + batch), "forest")
        scored = FO.score(m, nodes, FEATURES, SLICE)
        scored = materialise(scored, "scores")
        member = FO.predict(scored, FO.thresholds(scored, FO.plan(m))).withColumn("member", F.lit(batch))
        votes = member if votes is None else votes.unionByName(member)
        rows += [(h, batch, w) for h in ("A", "N", "R") for w in [(0.9 ** (2 - batch))]]
    weights = spark.createDataFrame(rows, "host string, member int, weight double")
    out = FO.ensemble(votes, weights)
    return out.groupBy("host", "prediction").agg(F.count(F.lit(1)).alias("rows"), r6("mean_score", F.avg("anomaly_score")))


@query("e09_feature_drift", f"""WITH m AS ({MATRIX_SQL}), a AS (SELECT host, {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}' for f in FEATURES)} FROM m WHERE log_id % 2 = 0 GROUP BY host),
b AS (SELECT host, {', '.join(f'avg({f} * 1.5) AS n_{f}' for f in FEATURES)} FROM m WHERE log_id % 2 = 1 GROUP BY host)
{' UNION ALL '.join(f"SELECT a.host, '{f}' AS feature, round(abs(n_{f} - m_{f}) / sqrt(s_{f} * s_{f} + 1e-10), 5) AS z FROM a JOIN b ON a.host = b.host" for f in FEATURES)}""")
def feature_drift(spark, d):
    m = matrix(spark, d)
    new = m.filter("log_id % 2 = 1").select("host", "log_id", *[(F.col(f) * 1.5).alias(f) for f in FEATURES])
    out = FO.feature_drift(new, FO.fit_scaler(m.filter("log_id % 2 = 0"), FEATURES), FEATURES)
    return out.select("host", "feature", F.round("z", 5).alias("z"))


@query("e09_e10_drift_report", f"""WITH m AS ({MATRIX_SQL}) SELECT host, round(abs(avg(CASE WHEN quantity > 30 THEN CAST(1 AS DOUBLE) ELSE 0 END) - 0.05), 6) AS average_drift,
 CASE WHEN abs(avg(CASE WHEN quantity > 30 THEN CAST(1 AS DOUBLE) ELSE 0 END) - 0.05) > 0.5 THEN 'retrain'
  WHEN abs(avg(CASE WHEN quantity > 30 THEN CAST(1 AS DOUBLE) ELSE 0 END) - 0.05) > 0.3 THEN 'incremental' ELSE 'keep' END AS action FROM m GROUP BY host""")
def drift_report(spark, d):
    m = matrix(spark, d)
    predicted = m.withColumn("prediction", F.when(F.col("quantity") > 30, -1).otherwise(1))
    drifted = FO.feature_drift(m, FO.fit_scaler(m, FEATURES), FEATURES)
    return FO.drift_report(predicted, F.lit(0.05), drifted).select("host", r6("average_drift"), "action")


@query("e23_e24_importance")
def importance(spark, d):
    m = matrix(spark, d)
    nodes = materialise(FO.fit(m, FEATURES, TREES, SAMPLES), "forest")
    out = FO.permutation_importance(m, nodes, FEATURES)
    return out.select("host", "feature", r6("importance"), "grade")


@query("e25_feature_selection")
def feature_selection(spark, d):
    m = matrix(spark, d)
    small = FEATURES[:3]
    a = materialise(FO.score(m, FO.fit(m, FEATURES, TREES, SAMPLES), FEATURES, SLICE), "scores")
    b = materialise(FO.score(m, FO.fit(m, small, TREES, SAMPLES), small, SLICE), "scores")
    return E.tail_agreement(a, b).select("tail_a", "tail_b", "shared", r6("consistency"))


@query("g35_correlated_pairs", f"""WITH m AS ({MATRIX_SQL}) SELECT * FROM ({' UNION ALL '.join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 5) AS r FROM m" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:])}) t WHERE abs(r) > 0.0005""")
def correlated_pairs(spark, d):
    return E.correlated_pairs(matrix(spark, d), FEATURES, 0.0005).select("feature_a", "feature_b", F.round("r", 5).alias("r"))


@query("e26_pseudo_labels", f"""{L}, z AS (SELECT *, {' OR '.join(
    f"(count(CASE WHEN {c} > 0 THEN 1 END) OVER () > 10 AND abs((ln(1 + {c}) - avg(ln(1 + {c})) OVER ()) / (stddev_pop(ln(1 + {c})) OVER () + 1e-10)) > 3)"
    for c in E.STATISTICAL)} AS outlier, greatest({', '.join(f"CASE WHEN {f} = 1 THEN CAST({v} AS DOUBLE) ELSE 0 END" for f, v in E.LABEL_FLAGS)},
 CASE WHEN is_collscan = 1 AND docs_examined_count > 100000 THEN CAST(0.75 AS DOUBLE) ELSE 0 END) AS ruled FROM lines),
k AS (SELECT *, CASE WHEN outlier THEN 1 WHEN is_normal_replication = 1 THEN 0 WHEN ruled > 0 THEN 1 ELSE 0 END AS label,
 CASE WHEN outlier THEN greatest(CASE WHEN is_normal_replication = 1 THEN 0.95 ELSE ruled END, 0.6) WHEN is_normal_replication = 1 THEN CAST(0.95 AS DOUBLE) ELSE ruled END AS conf FROM z)
SELECT label, round(conf, 4) AS label_confidence, CAST(conf > 0.7 AS INTEGER) AS kept, count(*) AS n FROM k GROUP BY 1, 2, 3""")
def pseudo_labels(spark, d):
    return E.pseudo_labels(lines(spark, d)).groupBy("label", F.round("label_confidence", 4).alias("label_confidence"), F.col("kept").cast("int").alias("kept")).agg(
        F.count(F.lit(1)).alias("n"))


_PR = "CAST({0} AS DOUBLE) / nullif({1}, 0)"


@query("g30_e27_metrics", f"""WITH f AS (SELECT lang, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fp,
 count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fn FROM labels JOIN documents USING (doc_id) GROUP BY lang),
r AS (SELECT *, COALESCE({_PR.format('tp', 'tp + fp')}, 0) AS precision, COALESCE({_PR.format('tp', 'tp + fn')}, 0) AS recall,
 COALESCE({_PR.format('tp + tn', 'tp + tn + fp + fn')}, 0) AS accuracy, COALESCE({_PR.format('fp', 'fp + tn')}, 0) AS fpr, COALESCE({_PR.format('fn', 'fn + tp')}, 0) AS fnr,
 COALESCE((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM f),
g AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)
SELECT lang, tp, fp, tn, fn, {', '.join(f'round({x}, 6) AS {x}' for x in ('precision', 'recall', 'accuracy', 'fpr', 'fnr', 'mcc', 'f1'))},
 CASE WHEN f1 >= 0.8 THEN 'EXCELLENT' WHEN f1 >= 0.6 THEN 'GOOD' WHEN f1 >= 0.4 THEN 'FAIR' ELSE 'POOR' END AS rating FROM g""")
def metrics(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    out = E.classifier_metrics(rows, ["lang"], F.col("quality") == 0, F.col("toxic") == 1)
    return out.select("lang", "tp", "fp", "tn", "fn", *[r6(x) for x in ("precision", "recall", "accuracy", "fpr", "fnr", "mcc", "f1")], "rating")


@query("g31_roc_auc", """WITH p AS (SELECT value AS x, event_type = 'error' AS y FROM events), r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM p),
s AS (SELECT sum(CASE WHEN y THEN rk ELSE 0 END) AS rs, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM r)
SELECT round((rs - CAST(pos AS DOUBLE) * (pos + 1) / 2) / (CAST(pos AS DOUBLE) * neg), 6) AS auc, pos AS positives, neg AS negatives FROM s""")
def auc(spark, d):
    return E.roc_auc(table(spark, d, "events"), F.col("event_type") == "error", F.col("value")).select(r6("auc"), "positives", "negatives")


@query("e28_buffer_health", f"""{L} SELECT host, count(*) AS samples, count(*) FILTER (WHERE {BAD}) AS anomaly_samples, round(avg(CASE WHEN {BAD} THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS anomaly_ratio,
 CASE WHEN count(*) < 100 THEN 'too_small' WHEN avg(CASE WHEN {BAD} THEN CAST(1 AS DOUBLE) ELSE 0 END) < 0.01 OR avg(CASE WHEN {BAD} THEN CAST(1 AS DOUBLE) ELSE 0 END) > 0.2 THEN 'skewed' ELSE 'healthy' END AS grade FROM lines GROUP BY host""")
def buffer_health(spark, d):
    base = views.log_view(spark, d, f"SELECT * FROM ({_scored_view()}) v")
    return E.buffer_health(base).select("host", "samples", "anomaly_samples", r6("anomaly_ratio"), "grade")


def _scored_view():
    from sievelog.plans.queries_analysis import SCORES, VALUED
    return f"SELECT *, {SCORES} FROM ({VALUED}) x"


@query("e29_e30_risk", f"""WITH {HISTORY_SQL}, t AS (SELECT *, CASE host WHEN 'node-1' THEN 'mssql' WHEN 'node-2' THEN 'elasticsearch' ELSE 'mongodb' END AS source_type FROM history),
k AS (SELECT *, CASE source_type WHEN 'mssql' THEN 12 WHEN 'elasticsearch' THEN 10 ELSE 15 END AS cr, CASE source_type WHEN 'mssql' THEN 6 WHEN 'elasticsearch' THEN 5 ELSE 8 END AS wr,
 CASE source_type WHEN 'mssql' THEN 2 WHEN 'elasticsearch' THEN 1 ELSE 3 END AS cc, CASE source_type WHEN 'mongodb' THEN 3 ELSE 2 END AS hc FROM t)
SELECT host, epoch_us(ts) AS ts_us, CASE WHEN sev_critical >= cc OR anomaly_rate > cr THEN 'CRITICAL' WHEN sev_critical >= 1 OR sev_high >= hc OR anomaly_rate > wr THEN 'WARNING' WHEN n_anomalies > 0 THEN 'INFO' ELSE 'OK' END AS risk,
 CASE WHEN anomaly_rate > 10 THEN 'elevated' WHEN anomaly_rate > 5 THEN 'moderate' WHEN anomaly_rate < 2 THEN 'low' ELSE 'stable' END AS risk_direction FROM k""")
def risk(spark, d):
    h = history(spark, d).withColumn("source_type", F.when(F.col("host") == "node-1", "mssql").when(F.col("host") == "node-2", "elasticsearch").otherwise("mongodb"))
    from sievelog.functions.values import micros
    return E.risk_signal(h).select("host", micros(F.col("ts")).alias("ts_us"), "risk", "risk_direction")

"""Feature pipelines, rules, severity and the stages behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sievelog.functions import patterns as P, text as X
from sievelog.operators import features as FE, rules as R, severity as S
from sievelog.operators.sequence import top_n
from sievelog.plans import oracle as O
from sievelog.plans.registry import query
from sievelog.sources import views


def mssql_source(spark: SparkSession, d: str) -> DataFrame:
    return views.mssql_logs(spark, d).withColumn("tags", F.split("tags", ","))


SOURCES = {"mongodb": views.mongo_logs, "mssql": mssql_source, "elasticsearch": views.es_logs}
BUILD = {"mongodb": FE.mongodb_features, "mssql": FE.mssql_features, "elasticsearch": FE.es_features}
MATRIX = {"mongodb": P.MONGO_FEATURES, "mssql": P.MSSQL_FEATURES, "elasticsearch": P.ES_FEATURES}


def features(spark: SparkSession, d: str, source: str) -> DataFrame:
    return BUILD[source](SOURCES[source](spark, d))


def scored(spark: SparkSession, d: str, source: str = "mongodb") -> DataFrame:
    """All lines as normal with score 0, then rules and severity: detection without a model."""
    base = features(spark, d, source).withColumns({"prediction": F.lit(1), "anomaly_score": F.lit(0.0).cast("double")})
    return S.score_severity(R.apply_rules(base, R.RULES[source]), source)


def _rounded(cols: list[str], kinds: dict[str, str]):
    return [F.round(c, 6).alias(c) if kinds.get(c) == "double" else F.col(c) for c in cols]


def _register_features(source: str, key: str):
    names = MATRIX[source]
    cols = ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)

    @query(key, f"WITH {O.FEATURES[source]} SELECT host, log_id, {cols} FROM features")
    def run(spark, d):
        return FE.feature_matrix(features(spark, d, source), names).select(
            "host", "log_id", *[F.round(n, 6).alias(n) for n in names])


_register_features("mongodb", "f22_mongodb_features")
_register_features("mssql", "f23_mssql_features")
_register_features("elasticsearch", "f24_es_features")

TOP_LINES = ["host", "log_id", "s", "c", "msg", "rule_hit", "severity_score", "severity_level"]


@query("k03_top_critical_lines", f"""WITH {O.scored('mongodb')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY severity_score DESC, log_id) AS rn
 FROM scored WHERE prediction = -1)
SELECT host, log_id, s, c, msg, rule_hit, round(severity_score, 6) AS severity_score, severity_level
FROM ranked WHERE rn <= 50""")
def top_critical_lines(spark, d):
    anomalies = scored(spark, d).filter("prediction = -1")
    best = top_n(anomalies, ["host"], [F.col("severity_score").desc(), F.col("log_id")], 50)
    return best.select(*TOP_LINES[:6], F.round("severity_score", 6).alias("severity_score"), "severity_level")


def _register_rules(source: str, rule_key: str, severity_key: str):
    @query(rule_key, f"""WITH {O.scored(source)},
    names AS (SELECT * FROM (VALUES {', '.join(f"({O.quoted(r.name)}, CAST({r.severity} AS DOUBLE))" for r in R.RULES[source])})
     AS t(rule_name, severity)),
    hits AS (SELECT rule_hit, count(*) AS hits FROM scored WHERE rule_hit IS NOT NULL GROUP BY rule_hit)
    SELECT rule_name, severity, COALESCE(hits, 0) AS hits FROM names LEFT JOIN hits ON rule_hit = rule_name""")
    def rule_hits(spark, d):
        return R.rule_statistics(scored(spark, d, source), R.RULES[source]).select("rule_name", "severity", "hits")

    @query(severity_key, f"""WITH {O.scored(source)}
    SELECT host, log_id, prediction, round(anomaly_score, 6) AS anomaly_score, rule_hit,
     round(severity_score, 6) AS severity_score, severity_level FROM scored""")
    def severity(spark, d):
        return scored(spark, d, source).select(
            "host", "log_id", "prediction", F.round("anomaly_score", 6).alias("anomaly_score"), "rule_hit",
            F.round("severity_score", 6).alias("severity_score"), "severity_level")


_register_rules("mongodb", "e12_mongodb_rules", "e17_mongodb_severity")
_register_rules("mssql", "e13_mssql_rules", "e18_mssql_severity")
_register_rules("elasticsearch", "e14_es_rules", "e19_es_severity")

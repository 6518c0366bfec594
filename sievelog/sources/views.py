"""Log views over an `events` table: the same SELECT runs in Spark SQL and in an ANSI-SQL oracle.

They map a generic event stream to the three log layouts, so that every operator can be run over
whole tables of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MONGO_LOGS = """
SELECT event_id AS log_id, ts, 'node-' || CAST(user_id % 8 AS VARCHAR(9)) AS host, user_id,
 CASE event_type WHEN 'error' THEN 'E' WHEN 'signup' THEN 'W' ELSE 'I' END AS s,
 CASE event_type WHEN 'error' THEN 'ACCESS' WHEN 'purchase' THEN 'COMMAND' WHEN 'view' THEN 'QUERY'
  WHEN 'click' THEN 'NETWORK' ELSE CASE WHEN event_id % 7 = 0 THEN 'TXN' ELSE 'REPL' END END AS c,
 CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'Authentication failed'
  WHEN event_type = 'error' AND event_id % 41 = 0 THEN 'Out of memory: cannot allocate memory for eviction'
  WHEN event_type = 'error' THEN 'Error: ' || CAST(17000 + event_id % 5 AS VARCHAR(9)) || ', Severity: '
   || CAST(10 + event_id % 12 AS VARCHAR(9)) || ', State: 1.'
  WHEN event_type = 'purchase' AND event_id % 29 = 0 THEN 'CMD: dropIndexes on collection shop.orders'
  WHEN event_type = 'purchase' THEN 'Slow query {"durationMillis":' || CAST(CAST(FLOOR(value * 100) AS BIGINT) AS VARCHAR(20))
   || ',"docsExamined":' || CAST(event_id * 37 % 200000 AS VARCHAR(9))
   || ',"keysExamined":' || CAST(event_id * 91 % 300000 AS VARCHAR(9)) || '}'
  WHEN event_type = 'view' AND event_id % 23 = 0 THEN 'mongod starting after restart'
  WHEN event_type = 'view' THEN 'planSummary: COLLSCAN "docsExamined":' || CAST(event_id * 53 % 2000000 AS VARCHAR(9))
  WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'Applied op 65f0a1b2c3d4e5f60718293a in heartbeat'
  WHEN event_type = 'signup' THEN 'Login failed for user ''u' || CAST(user_id AS VARCHAR(9))
   || '''. Reason: Password mismatch. [CLIENT: 10.0.0.' || CAST(user_id % 250 AS VARCHAR(9)) || ']'
  WHEN event_id % 11 = 0 THEN 'Client has attempted to reauthenticate as a single user'
  ELSE 'connection reset by peer' END AS msg,
 CASE WHEN event_type = 'error' THEN '{"error":{"code":' || CAST(event_id % 20 AS VARCHAR(9))
   || ',"codeName":"Code' || CAST(event_id % 20 AS VARCHAR(9)) || '","errmsg":"not authorized on db'
   || CAST(event_id % 4 AS VARCHAR(9)) || '"}}'
  WHEN event_type = 'purchase' THEN '{"ns":"shop.orders","planSummary":"IXSCAN","durationMillis":'
   || CAST(CAST(FLOOR(value * 100) AS BIGINT) AS VARCHAR(20)) || ',"docsExamined":'
   || CAST(event_id * 37 % 200000 AS VARCHAR(9)) || ',"keysExamined":' || CAST(event_id * 91 % 300000 AS VARCHAR(9))
   || ',"timeActiveMicros":' || CAST(event_id % 5000 AS VARCHAR(9)) || ',"timeInactiveMicros":'
   || CAST(event_id * 7 % 90000 AS VARCHAR(9)) || '}'
  WHEN event_type = 'view' THEN '{"ns":"shop.items","planSummary":"COLLSCAN","nReturned":'
   || CAST(event_id % 100 AS VARCHAR(9)) || '}'
  ELSE props END AS attr
FROM events
"""

MSSQL_LOGS = """
SELECT event_id AS log_id, ts, 'SQL' || CAST(user_id % 6 AS VARCHAR(9)) || '.internal' AS host, user_id,
 CASE WHEN event_type = 'signup' THEN 'Login failed for user ''u' || CAST(user_id AS VARCHAR(9))
   || '''. Reason: Password did not match that for the login provided. [CLIENT: 10.0.0.'
   || CAST(user_id % 250 AS VARCHAR(9)) || ']'
  WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'Login succeeded for user ''SVC_app'
   || CAST(user_id % 3 AS VARCHAR(9))
   || '''. Connection made using SQL Server authentication. [CLIENT: <local machine>]'
  WHEN event_type = 'click' THEN 'Login succeeded for user ''CORP' || chr(92) || 'u' || CAST(user_id AS VARCHAR(9))
   || '''. Connection made using Windows authentication. [CLIENT: 10.1.0.' || CAST(user_id % 40 AS VARCHAR(9)) || ']'
  WHEN event_type = 'error' AND event_id % 6 = 0
   THEN 'The fulltext filter daemon host process has stopped abnormally.'
  WHEN event_type = 'error' AND event_id % 6 = 1
   THEN 'Database ''db1'' of availability group ''ag1'' is not accessible for queries.'
  WHEN event_type = 'error' AND event_id % 6 = 2 THEN 'Cannot open database ''db' || CAST(event_id % 9 AS VARCHAR(9))
   || ''' requested by the login.'
  WHEN event_type = 'error' THEN '2024-01-15 10:20:30.45 spid' || CAST(event_id % 90 AS VARCHAR(9)) || 's Error: '
   || CAST(17000 + event_id % 5 AS VARCHAR(9)) || ', Severity: ' || CAST(10 + event_id % 12 AS VARCHAR(9)) || ', State: '
   || CAST(event_id % 3 AS VARCHAR(9)) || '.'
  WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'Transaction chosen as deadlock victim'
  WHEN event_type = 'purchase' AND event_id % 5 = 1 THEN 'EXECUTE permission denied on object ''p1'''
  WHEN event_type = 'purchase' THEN 'BACKUP DATABASE completed: backed up ' || CAST(event_id AS VARCHAR(20)) || ' pages'
  WHEN event_id % 5 = 0 THEN 'Starting up database ''db' || CAST(event_id % 9 AS VARCHAR(9)) || '''.'
  WHEN event_id % 5 = 1 THEN 'insufficient memory in resource pool'
  WHEN event_id % 5 = 2 THEN 'TCP Provider: network error, connection forcibly closed'
  ELSE 'Configuration option changed from ' || CAST(event_id % 7 AS VARCHAR(9)) END AS message,
 CASE WHEN event_type IN ('error', 'purchase', 'view') THEN 'beats,_grokparsefailure' ELSE 'beats' END AS tags,
 CASE WHEN event_type IN ('signup', 'click') THEN 'Logon' ELSE NULL END AS logtype,
 CASE event_type WHEN 'signup' THEN 'failed' WHEN 'click' THEN 'succeeded' ELSE NULL END AS logintype
FROM events
"""

ES_LOGS = """
SELECT event_id AS log_id, ts,
 CASE user_id % 5 WHEN 0 THEN 'esdt0' WHEN 1 THEN 'esms0' WHEN 2 THEN 'escr0' WHEN 3 THEN 'esrw0' ELSE 'esxx0' END
  || CAST(user_id % 3 AS VARCHAR(9)) AS host, user_id,
 CASE WHEN event_type = 'signup' AND event_id % 4 = 0
   THEN '{"@timestamp":"2024-01-10T00:00:00Z","log.level":"warn","log.logger":"o.e.d.x.Deprecation","event.code":"code'
    || CAST(event_id % 6 AS VARCHAR(9)) || '","message":"deprecated setting ' || CAST(event_id % 6 AS VARCHAR(9)) || '"}'
  WHEN event_type = 'signup' AND event_id % 4 = 1 THEN 'plain text without brackets ' || CAST(event_id % 10 AS VARCHAR(9))
  ELSE '[2024-01-10T10:00:' || CASE WHEN event_id % 60 < 10 THEN '0' ELSE '' END || CAST(event_id % 60 AS VARCHAR(9)) || ',000]['
   || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN ' ELSE 'INFO ' END || ']['
   || CASE event_id % 9 WHEN 0 THEN 'o.e.c.r.a.DiskThresholdMonitor' WHEN 1 THEN 'o.e.i.e.Engine'
    WHEN 2 THEN 'o.e.t.TcpTransport' WHEN 3 THEN 'o.e.m.j.JvmGcMonitorService' WHEN 4 THEN 'o.e.d.Coordinator'
    WHEN 5 THEN 'o.e.x.s.Security' WHEN 6 THEN 'o.e.n.Node' WHEN 7 THEN 'o.e.g.Gateway' ELSE 'custom.Logger' END
   || '] [es-' || CAST(user_id % 3 AS VARCHAR(9)) || '] '
   || CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'java.lang.OutOfMemoryError: heap'
    WHEN event_type = 'error' AND event_id % 4 = 1 THEN 'CircuitBreakingException: Data too large ' || CAST(event_id AS VARCHAR(20))
    WHEN event_type = 'error' AND event_id % 4 = 2 THEN 'shard failed on logs-2024.01.' || CAST(10 + event_id % 20 AS VARCHAR(9))
    WHEN event_type = 'error' THEN 'connection reset from 10.2.0.' || CAST(user_id % 250 AS VARCHAR(9))
    WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'flood stage disk watermark exceeded'
    WHEN event_type = 'purchase' AND event_id % 3 = 1 THEN '[gc] overhead, spent [700ms] collecting in the last [1s]'
    WHEN event_type = 'purchase' THEN 'node es-' || CAST(user_id % 3 AS VARCHAR(9)) || ' left the cluster'
    WHEN event_type = 'view' AND event_id % 4 = 0 THEN 'elected-as-master term ' || CAST(event_id % 100 AS VARCHAR(9))
    WHEN event_type = 'view' AND event_id % 4 = 1 THEN 'relocating shard to node 5f3a9c7b12de'
    WHEN event_type = 'view' THEN 'took[2s] slowlog query'
    ELSE 'hot_threads: high cpu on worker' END END AS message,
 CASE WHEN event_type = 'signup' THEN 'elasticsearch.deprecation' ELSE 'elasticsearch.server' END AS event_dataset
FROM events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table that scans as fewer pieces than there are cores (one small file) is spread by its id before costly
    per-line work; a table with enough splits is left as scanned, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def log_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    spread(table(spark, sf_dir, "events"), "event_id").createOrReplaceTempView("events")
    return spark.sql(sql)


def mongo_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_view(spark, sf_dir, MONGO_LOGS)


def mssql_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_view(spark, sf_dir, MSSQL_LOGS)


def es_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_view(spark, sf_dir, ES_LOGS)

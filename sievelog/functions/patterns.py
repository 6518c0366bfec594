"""The regexes, word lists and weights results depend on, stated as plain text.

All flag patterns are searched case-insensitively unless they are listed in CASE_SENSITIVE.
They stay inside the regex subset shared by Java and RE2, so an oracle can run the same text.
"""

# ---- fixed values: document-database server log flags (searched in msg) ----
MONGO_FLAGS = {
    "is_auth_failure": "AuthenticationFailed|authentication failed|auth.*failed",
    "is_drop_operation": "CMD: drop|dropIndexes|dropDatabase|drop collection|dropCollection",
    "is_aggregate_operation": "CMD: aggregate|command.*aggregate|pipeline|\\$match|\\$group|\\$lookup|\\$unwind",
    "is_admin_operation": "CMD: listCollections|listIndexes|dbStats|collStats|serverStatus|replSetGetStatus|isMaster|hello",
    "is_bulk_operation": "CMD: bulkWrite|bulk|insertMany|updateMany|deleteMany|findAndModify",
    "is_aborted_transaction": "abortTransaction|transaction.*abort|abort.*transaction",
    "is_collscan": "COLLSCAN",
    "is_index_build": "Index build|index.*build.*starting",
    "is_slow_query": "Slow query|durationMillis\":[1-9][0-9]{3,}",
    "is_high_doc_scan": "docsExamined\":[1-9][0-9]{4,}",
    "is_shutdown": "shutdown|dbexit",
    "is_assertion": "assert|BSONObjectTooLarge",
    "is_normal_replication": (
        "Applied op|AppliedOp|applying batch|oplog replay|replSetMemberState|Primary has changed|"
        "replica set member state|heartbeat|election|member is now in state PRIMARY|"
        "member is now in state SECONDARY"
    ),
    "is_fatal": "fatal|Out of memory|OOM|OutOfMemory|memory allocation failed",
    "is_error": "\"s\":\"E\"",
    "is_replication_issue": (
        "Cannot select sync source|ReplCoordExtern|replication lag|rollback|too stale to catch up|"
        "oplog overflow|sync source.*not ahead|replSet.*member.*not reachable"
    ),
    "is_out_of_memory": (
        "Out of memory|OOM|OutOfMemory|memory allocation failed|cannot allocate memory|tcmalloc|jemalloc"
    ),
    "is_restart": "restart|starting.*mongod|mongod.*starting|Recovering journal|STARTUP2",
    "is_memory_limit": (
        "memory limit exceeded|exceeded memory limit|memory threshold|WiredTiger cache|cache overflow|eviction"
    ),
}
CASE_SENSITIVE = {"is_high_doc_scan", "is_error"}
AUTH_FAILURE_TEXT = "Checking authorization failed"
AUTH_SUCCESS_TEXT = "Authentication succeeded"
REAUTHENTICATE_TEXT = "Client has attempted to reauthenticate as a single user"

# ---- fixed values: document-database component groups ----
COMPONENT_FLAGS = {
    "is_wiredtiger_recovery": ["WTRECOV"],
    "is_wiredtiger_checkpoint": ["WTCHKPT"],
    "is_wiredtiger_event": ["WTRECOV", "WTCHKPT", "WT"],
    "is_storage_event": ["STORAGE"],
    "is_tenant_operation": ["TENANT_M"],
    "is_ftdc_event": ["FTDC"],
    "is_async_io_event": ["ASIO"],
    "is_index_event": ["INDEX"],
    "is_recovery_event": ["RECOVERY"],
    "is_network_component": ["NETWORK", "CONNPOOL", "ASIO"],
    "is_security_component": ["ACCESS", "SECURITY"],
    "is_replication_component": ["REPL", "ELECTION", "ROLLBACK"],
    "is_storage_component": ["STORAGE", "WTRECOV", "WTCHKPT", "WT", "JOURNAL"],
    "is_control_component": ["CONTROL", "INITSYNC"],
}
UNKNOWN_COMPONENTS = ["-", "", "UNKNOWN"]
CRITICALITY_WEIGHTS = {
    "is_security_component": 3, "is_storage_component": 2, "is_replication_component": 2,
    "is_network_component": 1, "is_unknown_component": 1,
}

# ---- fixed values: model features per source, in model order ----
MONGO_FEATURES = [
    "severity_W", "component_encoded", "is_rare_component", "is_rare_combo", "has_error_key", "is_auth_failure",
    "is_drop_operation", "is_aggregate_operation", "is_bulk_operation", "is_aborted_transaction", "is_rare_message",
    "extreme_burst_flag", "burst_density", "component_changed", "hour_of_day", "is_weekend", "attr_key_count",
    "has_many_attrs", "is_collscan", "is_index_build", "is_slow_query", "is_high_doc_scan", "is_shutdown",
    "is_assertion", "is_fatal", "is_error", "is_replication_issue", "is_out_of_memory", "is_restart",
    "is_memory_limit", "query_duration_ms", "docs_examined_count", "keys_examined_count", "is_long_transaction",
    "performance_score", "is_wiredtiger_recovery", "is_wiredtiger_checkpoint", "is_wiredtiger_event",
    "is_storage_event", "is_async_io_event", "is_index_event", "is_recovery_event", "is_unknown_component",
    "is_network_component", "is_security_component", "is_replication_component", "is_storage_component",
    "is_control_component", "component_criticality_score", "txn_time_active_micros", "txn_time_inactive_micros",
    "txn_wait_ratio",
]
MSSQL_FEATURES = [
    "is_login_event", "is_failed_login", "is_successful_login", "is_local_client", "is_windows_auth", "is_sql_auth",
    "is_service_account", "is_domain_user", "is_grok_failure", "is_permission_error", "hour_of_day", "is_weekend",
    "is_business_hours", "is_night_login", "is_availability_group_error", "is_database_access_error",
    "is_connection_error", "time_since_last_log", "time_since_last_login", "login_burst_flag", "extreme_burst_flag",
    "burst_density", "client_ip_frequency", "is_rare_client_ip", "username_frequency", "is_rare_username",
    "failed_login_ratio_1h", "login_count_1h", "error_severity_level", "is_high_severity_error", "is_system_error",
    "is_fdhost_crash",
]
ES_FEATURES = [
    "hour_of_day", "is_weekend", "is_business_hours", "time_since_last_log", "is_warn", "is_error", "is_deprecation",
    "is_cluster_logger", "is_index_logger", "is_transport_logger", "is_rare_logger", "is_exception",
    "is_circuit_breaker", "is_oom_error", "is_connection_error", "is_shard_failure", "is_slow_log", "is_gc_overhead",
    "is_high_disk_watermark", "is_high_cpu", "is_node_event", "is_master_election", "is_shard_relocation",
    "extreme_burst_flag", "burst_density",
]
MONGO_BINARY_FEATURES = [
    "severity_W", "is_rare_component", "is_rare_combo", "has_error_key", "is_auth_failure", "is_drop_operation",
    "is_aggregate_operation", "is_admin_operation", "is_bulk_operation", "is_aborted_transaction", "is_rare_message",
    "extreme_burst_flag", "is_weekend", "component_changed", "has_many_attrs", "is_collscan", "is_index_build",
    "is_slow_query", "is_high_doc_scan", "is_shutdown", "is_assertion", "is_fatal", "is_error",
    "is_replication_issue", "is_out_of_memory", "is_restart", "is_memory_limit",
]
CAPS = {
    "query_duration_ms": 60000, "docs_examined_count": 1000000, "keys_examined_count": 1000000,
    "txn_time_active_micros": 30000000,
}

# ---- fixed values: relational-database error log ----
MSSQL_CLIENT_IP = r"\[CLIENT:\s*([^\]]+)\]"
MSSQL_LOGIN_STATUS = "Login (succeeded|failed) for user"
MSSQL_USER = "for user '([^']+)'"
MSSQL_REASON = r"Reason:\s*(.+?)(?:\s*\[CLIENT:|$)"
MSSQL_AUTH = "Connection made using (SQL Server|Windows) authentication"
MSSQL_DATABASE = "database '([^']+)'"
MSSQL_ERROR = r"Error:\s*(\d+),\s*Severity:\s*(\d+),\s*State:\s*(\d+)"
MSSQL_SPID = r"spid(\d+)s?"
MSSQL_TIMESTAMP = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)"
MSSQL_FLAGS = {
    "is_availability_group_error": "availability group|not accessible for queries|AlwaysOn",
    "is_database_access_error": "Failed to open.*database|database.*not accessible|Cannot open database",
    "is_connection_error": (
        "connection.*failed|cannot connect|connection timeout|TCP Provider.*error|network error|"
        "transport-level error|connection.*forcibly closed|login timeout"
    ),
    "is_permission_error": (
        "permission was denied|access is denied|not authorized|EXECUTE permission|permission denied|"
        "server principal.*cannot access|does not have permission"
    ),
    "is_fdhost_crash": (
        "fulltext filter daemon host.*stopped abnormally|FDHost.*stopped|"
        "full-text filter daemon host process has been successfully started"
    ),
}
# first match wins, top to bottom
MSSQL_CLASSES = [
    ("Logon", "Login (succeeded|failed) for user", True),
    ("FDHost", MSSQL_FLAGS["is_fdhost_crash"], False),
    ("Deadlock", r"deadlock victim|Error:\s*1205,|deadlock detected", False),
    ("Memory", r"memory pressure|Error:\s*701,|Error:\s*802,|out of memory|insufficient memory|memory grant", False),
    ("Error", MSSQL_FLAGS["is_availability_group_error"], False),
    ("Error", MSSQL_FLAGS["is_database_access_error"], False),
    ("Backup", r"BACKUP\s+(DATABASE|LOG)|backed up|restore completed|RESTORE\s+(DATABASE|LOG)", False),
    ("Startup", (
        "Starting up database|Server is listening on|SQL Server is starting|Recovery is complete|"
        "Service Broker manager has started"), False),
    ("Error", MSSQL_ERROR, True),
]
SERVICE_ACCOUNT = r"^APP_|^SQL\.|^SVC_|^SYSTEM$|^sa$|^NT AUTHORITY|^NT SERVICE"
LOCAL_CLIENTS = ["<local machine>", "localhost", "127.0.0.1"]
SYSTEM_ERROR_TYPES = ["Error", "Deadlock", "Memory", "FDHost"]
GROK_FAILURE_TAG = "_grokparsefailure"

# ---- fixed values: search-engine server log ----
ES_LINE = r"(?s)^\[([^\]]+)\]\[([^\]]+)\]\[([^\]]+)\]\s*\[([^\]]+)\]\s*(.*)"
ES_FLAGS = {
    "is_gc_overhead": (
        r"\[gc\]|JvmGcMonitorService|GC overhead|garbage collector|spent \[.+\] collecting in the last|overhead"),
    "is_circuit_breaker": "CircuitBreakingException|circuit breaker|Data too large",
    "is_oom_error": "OutOfMemoryError|out of memory",
    "is_high_disk_watermark": "disk watermark|flood stage|low disk|DiskThresholdMonitor|disk usage",
    "is_shard_failure": (
        "shard failed|unassigned shard|ShardNotFoundException|AllocationFailed|failed to execute|shard not available"),
    "is_node_event": r"node.*joined|node.*left|node.*disconnected|NodeDisconnectedException|removed \{",
    "is_master_election": (
        "master not discovered|elected-as-master|no master|MasterNotDiscoveredException|master changed|"
        "no known master node|not_master_exception"),
    "is_slow_log": r"slowlog|took\[",
    "is_connection_error": (
        "ConnectException|ConnectionClosed|connect timed out|NodeNotConnectedException|connection reset|"
        "transport.*exception|ChannelClosedException"),
    "is_exception": r"Exception|Caused by|at org\.elasticsearch|Throwable",
    "is_shard_relocation": "relocating|shard started|unassigned|IndexShardRelocatedException|moving shard",
    "is_high_cpu": "high cpu|cpu usage|process cpu|hot_threads|cpu time|blocked for",
    "is_deprecation": "deprecat",
}
# ordered; "contains" rows test anywhere in the lower-cased logger, the others its start
ES_LOGGER_CLASSES = [
    ("cluster", ["o.e.c.", "o.e.cluster."], "prefix"),
    ("index", ["o.e.i.", "o.e.indices.", "o.e.index."], "prefix"),
    ("transport", ["o.e.t.", "o.e.transport."], "prefix"),
    ("gc", ["gc"], "contains"),
    ("discovery", ["o.e.d.", "o.e.discovery."], "prefix"),
    ("xpack", ["o.e.x."], "prefix"),
    ("action", ["o.e.a.", "o.e.action."], "prefix"),
    ("node", ["o.e.n.", "o.e.node."], "prefix"),
    ("gateway", ["o.e.g.", "o.e.gateway."], "prefix"),
    ("plugin", ["o.e.p.", "o.e.plugins."], "prefix"),
]
ES_HOST_ROLES = [("data", "DT"), ("master", "MS"), ("coordinating", "CR"), ("worker", "RW")]

# ---- fixed values: server names found in file names, tried in this order ----
SERVER_NAME_PATTERNS = [
    r"(mongodb\d+n\d+)", r"(dbmng\d+)", r"(mongodbn\d+)", r"(drmongodbn\d+)", r"(mongo\d+)", r"(dbserver\d+)",
    r"(testmongodb\d+)", r"(devmongodb\d+)",
]
HOST_SUFFIXES = r"(\.local|\.internal|\.example\.com)$"

# ---- fixed values: anomaly type rules, first match wins. Each rule is a list of alternatives; every
# alternative is a list of tests that must all hold. "word" tests the lower-cased message, "c:x" the
# lower-cased component, "s:X" the severity. ----
ANOMALY_TYPES = [
    ("auth_failure", [["authentication failed"], ["unauthorized"]]),
    ("drop_operation", [["drop", "collection"], ["drop", "index"]]),
    ("index_build", [["createindex"], ["index build"]]),
    ("index_drop", [["dropindex"]]),
    ("collection_scan", [["collscan"], ["collection scan"]]),
    ("high_doc_scan", [["docsexamined", "high"], ["docsexamined", "10000"], ["docsexamined", "50000"]]),
    ("slow_query", [["slow"], ["took"], ["ms"]]),
    ("aggregation_issue", [["aggregate"], ["pipeline"]]),
    ("out_of_memory", [["out of memory"], ["oom"]]),
    ("connection_limit", [["too many connections"], ["connection limit"]]),
    ("assertion_failure", [["assert"]]),
    ("replication_issue", [["c:repl"], ["oplog"], ["replication"]]),
    ("replica_set_issue", [["election"], ["primary"], ["secondary"]]),
    ("storage_operation", [["compact"], ["reindex"]]),
    ("storage_sync", [["journal"], ["checkpoint"]]),
    ("shutdown", [["shutdown"]]),
    ("service_restart", [["restart"]]),
    ("fatal_error", [["fatal"], ["s:F"]]),
    ("connection_drop", [["connection", "drop"], ["connection", "closed"]]),
    ("network_issue", [["c:network"], ["socket"]]),
    ("error", [["s:E"], ["error"]]),
    ("warning", [["s:W"], ["warning"]]),
    ("query_issue", [["c:query"]]),
]
# same form, for the relational-database category; falls back to the component
MSSQL_CATEGORIES = [
    ("failed_login", [["login failed"], ["authentication failed"]]),
    ("successful_login", [["login succeeded"]]),
    ("availability_group", [["availability group"], ["not accessible"]]),
    ("database_access", [["database"]]),
    ("permission_error", [["permission"], ["access denied"]]),
    ("connection_error", [["connection"], ["socket"]]),
    ("fdhost_crash", [["fulltext filter daemon"], ["fdhost"]]),
    ("deadlock", [["deadlock"]]),
    ("memory_error", [["memory"]]),
]
# a message is critical when any alternative holds (same form)
CRITICAL_MESSAGES = {
    "mongodb": [["drop", "collection"], ["drop", "index"], ["authentication failed"], ["fatal"], ["out of memory"],
                ["oom"], ["assertion"], ["shutdown"]],
    "mssql": [["login failed"], ["authentication failed"], ["not accessible"], ["availability group"],
              ["cannot open database"], ["permission denied"], ["access denied"], ["brute force"],
              ["sql injection"]],
    "elasticsearch": [["outofmemoryerror"], ["circuitbreakingexception"], ["master not discovered"],
                      ["flood stage"], ["shard failed"], ["unassigned"], ["node left"], ["node disconnected"],
                      ["data too large"]],
}
# ---- fixed values: known benign signatures, order, pattern (any case), component, reason ----
BENIGN_SIGNATURES = [
    (1, "privileges on resource", "ACCESS", "Monitoring/exporter privilege check noise"),
    (2, "serverStatus", "COMMAND", "Routine serverStatus polling by monitoring tools"),
    (3, "replSetGetStatus", "COMMAND", "Routine replica set health check by monitoring tools"),
    (4, "isMaster", "COMMAND", "Driver topology discovery handshake"),
    (5, "hello", "COMMAND", "Driver hello handshake (MongoDB 5.0+)"),
    (6, "Refreshing the RSM with current topology", "CONNPOOL", "Normal connection pool topology refresh"),
]
# ---- fixed values: components that are never taken for noise ----
PROTECTED_COMPONENTS = ["COMMAND", "REPL", "CONTROL", "NETWORK", "STORAGE"]

# ---- fixed values: search pattern library, name -> regex (case-insensitive) ----
PATTERN_LIBRARY = {
    "errors.general": "error|exception|failed",
    "errors.timeout": r"(error|exception).*\b(timeout|timed out)\b",
    "errors.critical": "fatal|critical|emergency",
    "errors.stack_trace": r"stack trace|stacktrace|\tat \w+",
    "errors.memory": "out of memory|oom|memory exhausted",
    "errors.null_pointer": "null pointer|nullpointer|npe",
    "errors.assertion": r"assertion (failed|error)|assert\s+\w+\s+failed",
    "performance.slow_ms": r"\d{3,}ms",
    "performance.slow_query": r"slow query|query.*slow|took \d+ms",
    "performance.seconds": r"\d+\.\d+s|\d+ seconds?|\d+sec",
    "performance.resource": "high (cpu|memory|disk)|load average",
    "performance.queue": "queue (full|overflow)|backlog|throttl",
    "security.authentication": "authentication (failed|error)|auth.*fail|login.*fail",
    "security.authorization": "unauthorized|forbidden|access denied",
    "security.tls": "ssl|tls|certificate.*error|cert.*invalid",
    "security.attack": "sql injection|xss|csrf|injection attack",
    "mongodb.replica_set": "replica.*set|replication|oplog",
    "mongodb.primary_change": r"primary.*chang|election|step(ping)? down",
    "mongodb.cursor": "cursor.*timeout|cursor.*kill|cursor exceeded",
    "mongodb.index": "index|createIndex|dropIndex",
    "mongodb.sharding": "shard|sharding|chunk migration",
    "mongodb.storage": "journal|checkpoint|fsync",
    "network.connection": "connection (refused|reset|timeout|closed)",
    "network.socket": "socket|tcp|udp",
    "network.dns": "dns|resolve|hostname",
    "network.port": r"port \d+|:\d{4,5}",
    "network.failure": "network.*error|net.*fail|io.*exception",
}

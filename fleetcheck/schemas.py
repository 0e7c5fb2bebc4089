"""Canonical schemas of the catalog snapshot views the checks read.

One dataset per (engine, view); every row carries the envelope
``instance_id, engine, snapshot_ts``. Version-specific fields are nullable
and older collections are aligned with ``unionByName(allowMissingColumns)``.
Counters that can exceed 2^63 are DECIMAL(38,0) / DECIMAL(20,0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ENVELOPE = "instance_id string, engine string, snapshot_ts timestamp"

FINDINGS = ("instance_id string, engine string, snapshot_ts timestamp, check_id string, object_key string, "
            "metric double, metric_text string, threshold double, is_abnormal boolean, priority string, advice string")

D38 = "decimal(38,0)"

VIEWS: dict[str, dict[str, str]] = {
    "oracle": {
        "database": "dbid bigint, name string, db_unique_name string, database_role string, open_mode string, "
                    "log_mode string, flashback_on string, created_ts timestamp, platform_name string",
        "instance": "inst_id int, instance_name string, host_name string, version string, startup_ts timestamp, "
                    "status string, archiver string",
        "pdbs": "con_id int, name string, open_mode string",
        "osstat": f"inst_id int, stat_name string, value {D38}",
        "settings": "inst_id int, name string, value string, unit string",
        "version_banner": "banner string",
        "registry": "comp_id string, comp_name string, version string, status string, modified_ts timestamp",
        "patches": "action_ts timestamp, action string, version string, patch_id bigint, comments string",
        "resource_limit": "inst_id int, resource_name string, current_utilization bigint, max_utilization bigint, "
                          "initial_allocation string, limit_value string",
        "controlfiles": "name string, block_size bigint, file_size_blks bigint",
        "controlfile_records": "type string, records_total bigint, records_used bigint",
        "redo_logs": "group_no int, thread int, bytes bigint, status string, member string, type string, sequence bigint",
        "log_history": "thread int, sequence bigint, first_ts timestamp",
        "archived_log": "thread int, sequence bigint, first_ts timestamp, blocks bigint, block_size bigint, "
                        "applied string, dest_id int, standby_dest string",
        "objects": "con_id int, owner string, object_name string, object_type string, status string, "
                   "created_ts timestamp, oracle_maintained string, tablespace_name string",
        "tablespaces": "tablespace_name string, contents string, total_bytes bigint, used_bytes bigint, n_files int",
        "data_files": "tablespace_name string, file_name string, bytes bigint, maxbytes bigint, autoextensible string",
        "temp_files": "tablespace_name string, file_name string, bytes bigint",
        "free_space": "tablespace_name string, bytes bigint",
        "tablespace_usage_hist": "tablespace_id int, tablespace_name string, snap_id bigint, rtime string, "
                                 "tablespace_size bigint, tablespace_usedsize bigint, block_size bigint",
        "sequences": f"sequence_owner string, sequence_name string, last_number {D38}, max_value {D38}, cycle_flag string",
        "recyclebin": "con_id int, owner string, object_name string, space_blocks bigint, block_size bigint",
        "segments": "owner string, segment_name string, segment_type string, tablespace_name string, "
                    "partition_name string, bytes bigint",
        "partitions": "table_owner string, table_name string, partition_name string, partition_position int, "
                      "interval string, composite string, high_value string, high_value_raw binary",
        "sesstat": f"inst_id int, sid bigint, stat_name string, value {D38}",
        "fk_columns": "owner string, table_name string, constraint_name string, column_name string, position int",
        "index_columns": "index_owner string, index_name string, table_owner string, table_name string, "
                         "column_name string, column_position int",
        "sysaux_occupants": "occupant_name string, schema_name string, space_usage_kbytes bigint",
        "hwm_stats": "name string, highwater double, last_value double",
        "users": "username string, account_status string, expiry_ts timestamp, created_ts timestamp, "
                 "default_tablespace string, profile string, oracle_maintained string, password_hash string",
        "default_pwd_users": "username string",
        "default_pwd_hashes": "username string, password_hash string",
        "role_privs": "grantee string, granted_role string",
        "profiles": "profile string, resource_name string, resource_type string, limit_value string",
        "tab_statistics": "owner string, table_name string, num_rows bigint, stale_stats string, last_analyzed timestamp",
        "directories": "owner string, directory_name string, directory_path string",
        "db_links": "owner string, db_link string, username string, host string, created_ts timestamp",
        "jobs": "job bigint, log_user string, what string, broken string, failures int, next_ts timestamp",
        "scheduler_jobs": "owner string, job_name string, enabled string, state string, last_start_ts timestamp, "
                          "next_run_ts timestamp",
        "scheduler_running": "owner string, job_name string, session_id bigint",
        "job_log": "owner string, log_id bigint, job_name string, status string, log_ts timestamp, error bigint",
        "job_run_details": "log_id bigint, actual_start_ts timestamp, run_duration_s bigint, error bigint, additional_info string",
        "autotask_clients": "client_name string, status string",
        "autotask_windows": "window_name string, window_next_time timestamp, window_active string, "
                            "optimizer_stats string, segment_advisor string, sql_tune_advisor string",
        "autotask_history": "client_name string, window_name string, window_start_ts timestamp, job_status string, "
                            "job_duration_s bigint",
        "archive_dest_status": "dest_id int, dest_name string, status string, database_mode string, "
                               "recovery_mode string, gap_status string, error string",
        "backup_jobs": "session_key bigint, input_type string, status string, start_ts timestamp, end_ts timestamp, "
                       "output_bytes bigint",
        "datapump_jobs": "owner_name string, job_name string, operation string, state string",
        "alert_log": "originating_ts timestamp, message_text string, problem_key string, message_level int",
        "asm_clients": "group_number int, instance_name string, db_name string, status string",
        "asm_attributes": "group_number int, name string, value string",
        "asm_diskgroups": "group_number int, name string, state string, type string, total_mb bigint, free_mb bigint, "
                          "offline_disks int",
        "snapshots": "instance_number int, snap_id bigint, begin_ts timestamp, end_ts timestamp, startup_ts timestamp",
        "wr_control": "snap_interval_min double, retention_days double, snap_interval interval day to second, "
                      "retention interval day to second",
        "sysstat": f"instance_number int, snap_id bigint, stat_name string, value {D38}",
        "time_model": f"instance_number int, snap_id bigint, stat_name string, value {D38}",
        "system_event": f"instance_number int, snap_id bigint, event_name string, wait_class string, "
                        f"total_waits {D38}, total_waits_fg {D38}, time_waited_us {D38}, time_waited_us_fg {D38}, "
                        f"total_waits_bg {D38}, time_waited_us_bg {D38}",
        "waitstat": f"instance_number int, snap_id bigint, class string, wait_count {D38}",
        "librarycache": f"instance_number int, snap_id bigint, namespace string, pins {D38}, pinhits {D38}",
        "latch": f"instance_number int, snap_id bigint, latch_name string, gets {D38}, misses {D38}",
        "sqlstat": "instance_number int, snap_id bigint, sql_id string, module string, elapsed_delta bigint, "
                   "cpu_delta bigint, iowait_delta bigint, exec_delta bigint",
        "sqltext": "sql_id string, sql_text string",
        "sysmetric": "instance_number int, snap_id bigint, metric_name string, average double, maxval double",
        "resource_limit_hist": "instance_number int, snap_id bigint, resource_name string, current_utilization bigint",
        "check_errors": "check_name string, error string",
    },
    "mysql": {
        "variables": "name string, value string",
        "status": "name string, value string",
        "tables": "table_schema string, table_name string, table_type string, storage_engine string, table_collation string, "
                  "table_rows bigint, data_length bigint, index_length bigint, data_free bigint, "
                  "auto_increment decimal(20,0), update_ts timestamp, create_options string",
        "columns": "table_schema string, table_name string, column_name string, column_type string, extra string, "
                   "character_set_name string, collation_name string",
        "statistics": "table_schema string, table_name string, index_name string, non_unique int, seq_in_index int, "
                      "column_name string",
        "constraints": "table_schema string, table_name string, constraint_name string, constraint_type string",
        "key_column_usage": "table_schema string, table_name string, constraint_name string, column_name string, "
                            "ordinal_position int, referenced_table_name string",
        "processlist": "id bigint, user string, host string, db string, command string, time bigint, state string, "
                       "info string",
        "innodb_trx": "trx_id string, trx_state string, trx_started timestamp, trx_mysql_thread_id bigint, "
                      "trx_query string, trx_wait_started timestamp",
        "data_lock_waits": "requesting_trx_id string, blocking_trx_id string",
        "lock_waits": "waiting_thread bigint, waiting_query string, blocking_thread bigint, blocking_query string, "
                      "wait_age_s bigint",
        "replica_status": "channel string, source_host string, io_running string, sql_running string, "
                          "seconds_behind bigint, last_error string",
        "users": "user string, host string, plugin string, auth_empty boolean, password_expired string, "
                 "password_lifetime int, password_last_changed timestamp, account_locked string",
        "digest_stats": "schema_name string, digest_text string, count_star bigint, sum_timer_wait decimal(38,0), "
                        "avg_timer_wait decimal(38,0), sum_rows_examined bigint",
        "wait_summary": "event_name string, count_star bigint, sum_timer_wait decimal(38,0)",
        "schemata": "schema_name string, default_character_set string, default_collation string",
        "routines": "routine_schema string, routine_name string, routine_type string",
        "triggers": "trigger_schema string, trigger_name string",
        "events": "event_schema string, event_name string",
        "views": "table_schema string, table_name string",
        "binlogs": "log_name string, file_size bigint",
        "replica_hosts": "server_id bigint, host string, port int",
        "group_members": "member_id string, member_host string, member_port int, member_state string, member_role string",
        "plugins": "plugin_name string, plugin_status string",
        "host_summary": "host string, current_connections bigint, total_connections bigint",
        "binlog_events": "event_name string, count_star bigint, sum_number_of_bytes bigint",
    },
    "postgres": {
        "settings": "name string, setting string, unit string, source string",
        "facts": "name string, value string",
        "databases": "datname string, owner string, encoding string, collate string, size_bytes bigint, "
                     "age_xid bigint, connections bigint, conn_limit int",
        "tables": "schemaname string, relname string, relkind string, size_bytes bigint, age_xid bigint, "
                  "n_live_tup bigint, n_dead_tup bigint, last_vacuum_ts timestamp, last_autovacuum_ts timestamp, "
                  "relpages bigint, reltuples double",
        "objects": "schemaname string, relname string, relkind string",
        "functions": "schemaname string, proname string",
        "tablespaces": "spcname string, location string, size_bytes bigint, owner string",
        "activity": "pid bigint, datname string, usename string, state string, query string, query_start timestamp, "
                    "backend_type string, wait_event string",
        "locks": "pid bigint, granted boolean, locktype string, database bigint, relation bigint, page int, "
                 "tuple int, virtualxid string, transactionid string, classid bigint, objid bigint, objsubid int",
        "replication": "client_addr string, application_name string, state string, sent_lsn string, "
                       "replay_lsn string, sync_state string",
        "archiver": "archived_count bigint, failed_count bigint, last_archived_ts timestamp, last_failed_ts timestamp",
        "column_stats": "schemaname string, tablename string, attname string, null_frac double, avg_width int",
        "index_usage": "schemaname string, relname string, indexrelname string, idx_scan bigint, size_bytes bigint, "
                       "is_unique boolean, is_primary boolean",
        "extensions": "extname string, extversion string, schema string, description string",
        "database_stats": "datname string, blks_read bigint, blks_hit bigint, xact_commit bigint, "
                          "xact_rollback bigint, deadlocks bigint, temp_bytes bigint",
        "bgwriter": "checkpoints_timed bigint, checkpoints_req bigint, maxwritten_clean bigint, "
                    "buffers_backend bigint, num_timed bigint, num_requested bigint",
        "roles": "rolname string, rolsuper boolean, rolcreaterole boolean, rolcreatedb boolean, rolcanlogin boolean, "
                 "rolreplication boolean, rolvaliduntil timestamp",
        "hba_rules": "line_number int, type string, database array<string>, user_name array<string>, "
                     "address string, auth_method string",
    },
    "sqlserver": {
        "facts": "name string, value string",
        "files": "database_name string, file_name string, type_desc string, filegroup string, size_pages bigint, "
                 "used_pages bigint, max_size_pages bigint",
        "sessions": "session_id bigint, database_name string, login_name string, status string, host_name string",
        "requests": "session_id bigint, database_name string, status string, command string, start_ts timestamp, "
                    "blocking_session_id bigint, wait_type string, wait_time_ms bigint, sql_text string",
        "jobs": "job_id string, name string, enabled int",
        "job_history": "job_id string, step_id int, run_status int, run_date int, run_time int, run_duration int, "
                       "message string",
        "job_schedules": "job_id string, schedule_id int",
        "schedules": "schedule_id int, name string",
        "availability_groups": "group_id string, ag_name string",
        "availability_replicas": "group_id string, replica_id string, replica_server string",
        "replica_states": "replica_id string, role_desc string, synchronization_health string",
        "database_replica_states": "replica_id string, database_name string, synchronization_state string",
        "ag_replicas": "ag_name string, replica_server string, role_desc string, synchronization_state string, "
                       "synchronization_health string, database_name string",
        "log_space_usage": "database_id int, total_bytes bigint, used_bytes bigint, used_pct double",
        "log_space": "database_name string, log_size_mb double, log_used_pct double, is_current boolean",
        "index_physical": "database_name string, schema_name string, table_name string, index_name string, "
                          "frag_pct double, page_count bigint",
        "wait_stats": "wait_type string, waiting_tasks bigint, wait_time_ms bigint, signal_wait_ms bigint",
        "databases": "database_name string, database_id int, recovery_model string, state string, "
                     "create_ts timestamp, size_mb double, log_reuse_wait string",
        "backups": "database_name string, type string, start_ts timestamp, finish_ts timestamp, size_bytes bigint, "
                   "device string",
        "configurations": "name string, value_in_use string",
        "io_file_stats": "database_name string, file_name string, type_desc string, reads bigint, writes bigint, "
                         "stall_read_ms bigint, stall_write_ms bigint, size_mb double",
        "tempdb_space": "file_name string, total_pages bigint, unallocated_pages bigint",
        "objects": "database_name string, schema_name string, object_name string, type_desc string",
        "query_stats": "query_hash string, execution_count bigint, total_worker_time bigint, "
                       "total_elapsed_time bigint, total_logical_reads bigint, sql_text string, sql_handle string",
        "sql_texts": "sql_handle string, text string",
        "missing_indexes": "database_name string, table_name string, equality_columns string, "
                           "inequality_columns string, included_columns string, user_seeks bigint, "
                           "user_scans bigint, avg_total_user_cost double, avg_user_impact double",
        "tables": "database_name string, schema_name string, table_name string, has_pk boolean, row_count bigint, "
                  "data_kb bigint, index_kb bigint",
        "key_constraints": "database_name string, schema_name string, table_name string, constraint_name string, type string",
        "error_log": "log_ts timestamp, process_info string, text string",
        "db_users": "database_name string, user_name string, type_desc string, role_name string",
    },
    "host": {
        "os_text": "path string, text string",
        "log_lines": "source string, line_no bigint, line string",
        "files": "path string, name string, size_bytes bigint",
    },
    "report": {
        "report_html": "path string, html string",
    },
}


# Views of a container database: their rows carry the container beside the instance (NULL before there were any).
for _v in ("registry", "patches", "tablespaces", "data_files", "temp_files", "tablespace_usage_hist", "sequences", "segments", "partitions",
           "users", "default_pwd_users", "role_privs", "profiles", "tab_statistics", "directories", "db_links", "jobs", "scheduler_jobs",
           "scheduler_running", "job_log", "autotask_clients", "autotask_windows", "autotask_history", "datapump_jobs"):
    VIEWS["oracle"][_v] += ", con_id int"


def schema(engine: str, view: str) -> StructType:
    return StructType.fromDDL(f"{ENVELOPE}, {VIEWS[engine][view]}")


def empty_views(spark: SparkSession, engine: str) -> dict[str, DataFrame]:
    """Empty, correctly typed views (plan resolution tests, dry runs)."""
    return {v: spark.createDataFrame([], schema(engine, v)) for v in VIEWS[engine]}

"""More table-driven verdict rows (at / over the threshold, filtered rows)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetcheck.plans.checks import base
from fleetcheck.schemas import schema

AS_OF = dt.datetime(2024, 1, 31)
T = dt.datetime(2024, 1, 30, 6)
MB = 1024 ** 2
GiB = 1024 ** 3
DAY = dt.timedelta(days=1)


def st(name, value, inst="i"):
    return {"instance_id": inst, "name": name, "value": str(value)}


CASES = [
    ("O10", "oracle", {"instance": [{"inst_id": 1, "archiver": "STARTED", "startup_ts": AS_OF - 3 * DAY},
                                    {"inst_id": 2, "archiver": "FAILED", "startup_ts": AS_OF - 3 * DAY}]},
     "inst_id", {1: False, 2: True}),
    ("O28", "oracle", {"segments": [{"owner": "A", "segment_name": "t1", "segment_type": "TABLE", "bytes": 10241 * MB},
                                    {"owner": "A", "segment_name": "t2", "segment_type": "TABLE PARTITION",
                                     "partition_name": "p1", "bytes": 102401 * MB},
                                    {"owner": "A", "segment_name": "t3", "segment_type": "TABLE", "bytes": 10240 * MB},
                                    {"owner": "A", "segment_name": "i1", "segment_type": "INDEX", "bytes": 99999 * MB}]},
     "segment_name", {"t1": False, "t2": True}),
    ("O29", "oracle", {"segments": [{"owner": "A", "segment_name": "i1", "segment_type": "INDEX", "bytes": 102400 * MB},
                                    {"owner": "A", "segment_name": "i2", "segment_type": "INDEX", "bytes": 102401 * MB}]},
     "segment_name", {"i1": False, "i2": True}),
    ("O33", "oracle", {"objects": [{"owner": "X", "object_name": "DBMS_CORE_INTERNAL", "object_type": "PROCEDURE"},
                                   {"owner": "X", "object_name": "DBMS_SUPPORT_INTERNAL1", "object_type": "TRIGGER"},
                                   {"owner": "X", "object_name": "DBMS_STATS", "object_type": "PACKAGE"}]},
     "object_name", {"DBMS_CORE_INTERNAL": True, "DBMS_SUPPORT_INTERNAL1": True}),
    ("O34", "oracle", {"segments": [
        {"segment_name": "WRH$_A", "segment_type": "TABLE", "tablespace_name": "SYSAUX", "bytes": 32768 * MB},
        {"segment_name": "WRH$_B", "segment_type": "TABLE", "tablespace_name": "SYSAUX", "bytes": 32767 * MB},
        {"segment_name": "OTHER", "segment_type": "TABLE", "tablespace_name": "SYSAUX", "bytes": 99999 * MB}]},
     "segment_name", {"WRH$_A": True, "WRH$_B": False}),
    ("O35", "oracle", {"sysaux_occupants": [{"occupant_name": "a", "space_usage_kbytes": 100 * 1024},
                                            {"occupant_name": "b", "space_usage_kbytes": 101 * 1024},
                                            {"occupant_name": "c", "space_usage_kbytes": 32768 * 1024}]},
     "occupant_name", {"b": False, "c": True}),
    ("O39", "oracle", {"users": [{"username": "SCOTT", "account_status": "OPEN"},
                                 {"username": "HR", "account_status": "EXPIRED & LOCKED"},
                                 {"username": "APP", "account_status": "OPEN"}],
                       "default_pwd_users": [{"username": "SCOTT"}, {"username": "HR"}]},
     "username", {"SCOTT": True}),
    ("O42", "oracle", {"users": [
        {"username": "LATE", "account_status": "OPEN", "oracle_maintained": "N", "default_tablespace": "SYSTEM",
         "created_ts": dt.datetime(2020, 1, 3)},
        {"username": "SAME", "account_status": "OPEN", "oracle_maintained": "N", "default_tablespace": "SYSTEM",
         "created_ts": dt.datetime(2020, 1, 1, 12)},
        {"username": "OK", "account_status": "OPEN", "oracle_maintained": "N", "default_tablespace": "USERS",
         "created_ts": dt.datetime(2021, 1, 1)},
        {"username": "SYS", "account_status": "OPEN", "oracle_maintained": "Y"}],
                       "database": [{"created_ts": dt.datetime(2020, 1, 1)}]},
     "username", {"LATE": True, "SAME": False, "OK": False}),
    ("O45", "oracle", {"profiles": [
        {"profile": "DEFAULT", "resource_name": "PASSWORD_LIFE_TIME", "limit_value": "180"},
        {"profile": "DEFAULT", "resource_name": "SESSIONS_PER_USER", "limit_value": "UNLIMITED"},
        {"profile": "DEFAULT", "resource_name": "FAILED_LOGIN_ATTEMPTS", "limit_value": "10"},
        {"profile": "UNUSED", "resource_name": "IDLE_TIME", "limit_value": "5"}],
                       "users": [{"username": "APP", "account_status": "OPEN", "profile": "DEFAULT"}]},
     "resource_name", {"PASSWORD_LIFE_TIME": True, "SESSIONS_PER_USER": False, "FAILED_LOGIN_ATTEMPTS": False}),
    ("O56", "oracle", {"archive_dest_status": [{"dest_id": 1, "status": "VALID", "gap_status": "NO GAP"},
                                               {"dest_id": 2, "status": "VALID", "gap_status": "RESOLVABLE GAP"},
                                               {"dest_id": 3, "status": "ERROR", "error": "ORA-12541"},
                                               {"dest_id": 4, "status": "INACTIVE", "gap_status": "X"}]},
     "dest_id", {1: False, 2: True, 3: True}),
    ("O57", "oracle", {"backup_jobs": [
        {"session_key": 1, "input_type": "DB FULL", "status": "COMPLETED", "start_ts": T},
        {"session_key": 2, "input_type": "DB INCR", "status": "FAILED", "start_ts": T},
        {"session_key": 3, "input_type": "DB FULL", "status": "FAILED", "start_ts": AS_OF - 15 * DAY},
        {"session_key": 4, "input_type": "ARCHIVELOG", "status": "FAILED", "start_ts": T}]},
     "session_key", {1: False, 2: True}),
    ("O58", "oracle", {"datapump_jobs": [{"job_name": "a", "state": "NOT RUNNING"}, {"job_name": "b", "state": "EXECUTING"}]},
     "job_name", {"a": False, "b": True}),
    ("O63", "oracle", {"snapshots": [{"instance_number": 1, "snap_id": s} for s in range(1001)]
                       + [{"instance_id": "j", "instance_number": 1, "snap_id": s} for s in range(1000)]},
     "instance_id", {"i": True, "j": False}),
    ("M02", "mysql", {"variables": [st("max_connections", 100), st("max_connections", 100, "j")],
                      "status": [st("Threads_connected", 80), st("Max_used_connections", 80),
                                 st("Threads_connected", 10, "j"), st("Max_used_connections", 81, "j")]},
     "instance_id", {"i": False, "j": True}),
    ("M03", "mysql", {"variables": [st("slow_query_log", "ON"), st("slow_query_log", "ON", "j"),
                                    st("slow_query_log", "OFF", "k")],
                      "status": [st("Slow_queries", 100), st("Slow_queries", 101, "j"), st("Slow_queries", 0, "k")]},
     "instance_id", {"i": False, "j": True, "k": True}),
    ("M06", "mysql", {"variables": [st("server_id", 1), st("server_id", 2, "j"), st("server_id", 3, "k")],
                      "replica_status": [
                          {"channel": "", "io_running": "Yes", "sql_running": "Yes", "seconds_behind": 60},
                          {"instance_id": "j", "channel": "", "io_running": "Yes", "sql_running": "Yes",
                           "seconds_behind": 61}]},
     "instance_id", {"i": False, "j": True, "k": False}),
    ("M09", "mysql", {"users": [{"user": "a", "plugin": "mysql_native_password", "auth_empty": True},
                                {"user": "b", "plugin": "caching_sha2_password", "auth_empty": True,
                                 "password_expired": "N"},
                                {"user": "c", "plugin": "mysql_native_password", "auth_empty": False,
                                 "password_expired": "Y"}]}, "user", {"a": True, "b": False, "c": True}),
    ("M11", "mysql", {"tables": [{"table_schema": "big", "table_name": "t", "data_length": 102400 * MB, "index_length": MB},
                                 {"table_schema": "ok", "table_name": "t", "data_length": 102399 * MB, "index_length": MB}]},
     "table_schema", {"big": True, "ok": False}),
    ("M13", "mysql", {"processlist": [{"id": 1, "command": "Query", "time": 300, "info": "select 1"},
                                      {"id": 2, "command": "Query", "time": 301, "info": "select 2"},
                                      {"id": 3, "command": "Sleep", "time": 9999},
                                      {"id": 4, "command": "Query", "time": 999, "info": "SHOW PROCESSLIST"}]},
     "id", {1: False, 2: True}),
    ("M15", "mysql", {"tables": [{"table_schema": "a", "table_name": "nopk", "table_type": "BASE TABLE"},
                                 {"table_schema": "a", "table_name": "pk", "table_type": "BASE TABLE"},
                                 {"table_schema": "a", "table_name": "v", "table_type": "VIEW"}],
                      "constraints": [{"table_schema": "a", "table_name": "pk", "constraint_type": "PRIMARY KEY"}]},
     "table_name", {"nopk": True}),
    ("M21", "mysql", {"status": [st("Innodb_row_lock_time_avg", 500), st("Innodb_deadlocks", 0),
                                 st("Innodb_buffer_pool_wait_free", 0), st("Innodb_log_waits", 0), st("Uptime", 10),
                                 st("Innodb_row_lock_time_avg", 501, "j"), st("Uptime", 10, "j")]},
     "instance_id", {"i": False, "j": True}),
    ("M23", "mysql", {"digest_stats": [{"digest_text": "a", "avg_timer_wait": Decimal(10 ** 12), "sum_timer_wait": Decimal(1),
                                        "count_star": 1},
                                       {"digest_text": "b", "avg_timer_wait": Decimal(10 ** 12 + 10 ** 7),
                                        "sum_timer_wait": Decimal(2), "count_star": 1}]},
     "digest_text", {"a": False, "b": True}),
    ("M26", "mysql", {"status": [st("Binlog_cache_use", 100), st("Binlog_cache_disk_use", 10),
                                 st("Binlog_cache_use", 100, "j"), st("Binlog_cache_disk_use", 11, "j")]},
     "instance_id", {"i": False, "j": True}),
    ("M27", "mysql", {"lock_waits": [{"waiting_thread": 1, "wait_age_s": 10}, {"waiting_thread": 2, "wait_age_s": 11}]},
     "waiting_thread", {1: False, 2: True}),
    ("M29", "mysql", {"variables": [st("gtid_mode", "ON"), st("enforce_gtid_consistency", "OFF")]},
     "name", {"gtid_mode": False, "enforce_gtid_consistency": True}),
    ("M34", "mysql", {"group_members": [{"member_host": "a", "member_state": "ONLINE"},
                                        {"member_host": "b", "member_state": "RECOVERING"}]},
     "member_host", {"a": False, "b": True}),
    ("M36", "mysql", {"status": [st("Innodb_buffer_pool_reads", 1), st("Innodb_buffer_pool_read_requests", 100),
                                 st("Innodb_buffer_pool_wait_free", 0),
                                 st("Innodb_buffer_pool_reads", 2, "j"), st("Innodb_buffer_pool_read_requests", 100, "j")]},
     "instance_id", {"i": False, "j": True}),
    ("M39", "mysql", {"key_column_usage": [
        {"table_schema": "a", "table_name": "c", "constraint_name": "fk1", "column_name": "p", "ordinal_position": 1,
         "referenced_table_name": "p"},
        {"table_schema": "a", "table_name": "c", "constraint_name": "fk2", "column_name": "q", "ordinal_position": 1,
         "referenced_table_name": "q"}],
                      "statistics": [{"table_schema": "a", "table_name": "c", "index_name": "ix", "seq_in_index": 1,
                                      "column_name": "p"}]},
     "constraint_name", {"fk2": True}),
    ("M40", "mysql", {"status": [st("Innodb_history_list_length", 100000), st("Innodb_history_list_length", 100001, "j")],
                      "variables": []}, "instance_id", {"i": False, "j": True}),
    ("M41", "mysql", {"status": [st("Threads_running", 50), st("Threads_running", 51, "j")], "variables": []},
     "instance_id", {"i": False, "j": True}),
    ("M42", "mysql", {"status": [st("Innodb_deadlocks", 0), st("Innodb_deadlocks", 1, "j")],
                      "variables": [st("innodb_print_all_deadlocks", "ON"), st("innodb_print_all_deadlocks", "ON", "j")]},
     "instance_id", {"i": False, "j": True}),
    ("M43", "mysql", {"host_summary": [{"host": "a", "current_connections": 50}, {"host": "b", "current_connections": 51}],
                      "variables": [st("max_connections", 100)]}, "host", {"a": False, "b": True}),
    ("P05", "postgres", {"tables": [{"schemaname": "s", "relname": "a", "relkind": "r", "age_xid": 5 * 10 ** 8},
                                    {"schemaname": "s", "relname": "b", "relkind": "r", "age_xid": 5 * 10 ** 8 + 1},
                                    {"schemaname": "s", "relname": "i", "relkind": "i", "age_xid": 10 ** 9}]},
     "relname", {"a": False, "b": True}),
    ("P10", "postgres", {"tables": [
        {"schemaname": "s", "relname": "old", "n_dead_tup": 10001, "last_autovacuum_ts": AS_OF - 8 * DAY},
        {"schemaname": "s", "relname": "fresh", "n_dead_tup": 10001, "last_vacuum_ts": AS_OF - DAY},
        {"schemaname": "s", "relname": "few", "n_dead_tup": 10000, "last_vacuum_ts": AS_OF - 30 * DAY},
        {"schemaname": "s", "relname": "never", "n_dead_tup": 20000}]},
     "relname", {"old": True, "fresh": False, "few": False, "never": True}),
    ("P12", "postgres", {"archiver": [{"failed_count": 0, "last_failed_ts": AS_OF - 2 * DAY},
                                      {"instance_id": "j", "failed_count": 1},
                                      {"instance_id": "k", "failed_count": 0,
                                       "last_failed_ts": AS_OF - dt.timedelta(hours=1)}]},
     "instance_id", {"i": False, "j": True, "k": True}),
    ("P14", "postgres", {"index_usage": [
        {"schemaname": "s", "relname": "t", "indexrelname": "unused", "idx_scan": 0, "is_unique": False, "is_primary": False},
        {"schemaname": "s", "relname": "t", "indexrelname": "used", "idx_scan": 5, "is_unique": False, "is_primary": False},
        {"schemaname": "s", "relname": "t", "indexrelname": "pk", "idx_scan": 0, "is_unique": True, "is_primary": True}]},
     "indexrelname", {"unused": True, "used": False}),
    ("P17", "postgres", {"databases": [{"datname": "a", "size_bytes": 100 * GiB}, {"datname": "b", "size_bytes": 100 * GiB + 1}]},
     "datname", {"a": False, "b": True}),
    ("P23", "postgres", {"index_usage": [
        {"schemaname": "s", "relname": "t", "indexrelname": "small", "idx_scan": 0, "size_bytes": MB, "is_unique": False,
         "is_primary": False},
        {"schemaname": "s", "relname": "t", "indexrelname": "big", "idx_scan": 0, "size_bytes": MB + 1, "is_unique": False,
         "is_primary": False}]}, "indexrelname", {"small": False, "big": True}),
    ("P24", "postgres", {"database_stats": [{"datname": "a", "deadlocks": 0}, {"datname": "b", "deadlocks": 1}]},
     "datname", {"a": False, "b": True}),
    ("S06", "sqlserver", {"ag_replicas": [{"replica_server": "a", "synchronization_state": "SYNCHRONIZED",
                                           "synchronization_health": "HEALTHY"},
                                          {"replica_server": "b", "synchronization_state": "NOT SYNCHRONIZING",
                                           "synchronization_health": "NOT_HEALTHY"}]},
     "replica_server", {"a": False, "b": True}),
    ("S08", "sqlserver", {"index_physical": [{"index_name": "rebuild", "frag_pct": 31.0, "page_count": 1001},
                                             {"index_name": "reorg", "frag_pct": 11.0, "page_count": 1001},
                                             {"index_name": "small", "frag_pct": 50.0, "page_count": 1000},
                                             {"index_name": "fine", "frag_pct": 5.0, "page_count": 99999},
                                             {"index_name": "tiny", "frag_pct": 99.0, "page_count": 100}]},
     "index_name", {"rebuild": True, "reorg": False, "small": False, "fine": False}),
    ("S11", "sqlserver", {"configurations": [{"name": "xp_cmdshell", "value_in_use": "1"},
                                             {"name": "clr enabled", "value_in_use": "0"}],
                          "facts": [st("sa_enabled", 1), st("authentication_mode", "Windows Only")]},
     "name", {"xp_cmdshell": True, "clr enabled": False, "sa_enabled": True, "authentication_mode": False}),
    ("S12", "sqlserver", {"configurations": [{"name": "max server memory (MB)", "value_in_use": "2147483647"},
                                             {"name": "max degree of parallelism", "value_in_use": "0"}]},
     "name", {"max server memory (MB)": True, "max degree of parallelism": False}),
    ("S19", "sqlserver", {"missing_indexes": [
        {"table_name": "a", "avg_total_user_cost": 100.0, "avg_user_impact": 10.0, "user_seeks": 100, "user_scans": 0},
        {"table_name": "b", "avg_total_user_cost": 100.0, "avg_user_impact": 10.0, "user_seeks": 100, "user_scans": 1}]},
     "table_name", {"a": False, "b": True}),
    ("S20", "sqlserver", {"tables": [{"table_name": "nopk", "has_pk": False, "row_count": 5, "data_kb": 1, "index_kb": 0},
                                     {"table_name": "pk", "has_pk": True, "row_count": 5, "data_kb": 1, "index_kb": 0}]},
     "table_name", {"nopk": True}),
    ("S21", "sqlserver", {"tables": [{"table_name": "a", "data_kb": 10240 * 1024, "index_kb": 0},
                                     {"table_name": "b", "data_kb": 10240 * 1024, "index_kb": 1024}]},
     "table_name", {"a": False, "b": True}),
]


def _view(spark, engine, name, rows):
    sch = schema(engine, name)
    data = [tuple({"instance_id": "i", "engine": engine, "snapshot_ts": T, **r}.get(f.name) for f in sch.fields)
            for r in rows]
    return spark.createDataFrame(data, sch)


@pytest.mark.parametrize("cid,engine,views,key,expected", CASES, ids=[c[0] for c in CASES])
def test_boundary(spark, cid, engine, views, key, expected):
    v = {name: _view(spark, engine, name, rows) for name, rows in views.items()}
    ctx = base.Ctx(spark, v, F.lit(AS_OF).cast("timestamp"))
    got = {r[key]: r["is_abnormal"] for r in base.REGISTRY[cid].fn(ctx).collect()}
    assert got == expected


def test_host_text_verdicts(spark):
    dump = "\n".join(["crsstat", "ora.db  ONLINE  ONLINE  node1", "ora.lsnr  OFFLINE  OFFLINE", "",
                      "thp", "[always] madvise never", "", "hba", "# comment", "host all all 0.0.0.0/0 trust",
                      "host all all 10.0.0.0/8 scram-sha-256", ""])
    v = {"os_text": _view(spark, "host", "os_text", [{"path": "p", "text": dump}])}
    ctx = base.Ctx(spark, v, F.lit(AS_OF).cast("timestamp"))
    h2 = {r.line.split()[0]: r.is_abnormal for r in base.REGISTRY["H02"].fn(ctx).collect()}
    assert h2 == {"ora.db": False, "ora.lsnr": True}
    h6 = [(r.section, r.is_abnormal) for r in base.REGISTRY["H06"].fn(ctx).collect()]
    assert h6 == [("thp", True)]
    h15 = {r.line.split()[-1]: r.is_abnormal for r in base.REGISTRY["H15"].fn(ctx).collect()}
    assert h15 == {"trust": True, "scram-sha-256": False}

"""Table-driven boundary rows for threshold checks: exactly at the threshold,
just over it, NULL metric, and a row the check's filter must drop."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetcheck.plans.checks import base
from fleetcheck.schemas import schema

AS_OF = dt.datetime(2024, 1, 31)
T = dt.datetime(2024, 1, 30, 6)
GB = 1024 ** 3
MB = 1024 ** 2

CASES = [
    # (check, engine, {view: rows}, key column, {key: is_abnormal})
    ("O17", "oracle", {"controlfiles": [{"name": "c1", "block_size": MB, "file_size_blks": 512},
                                        {"name": "c2", "block_size": MB, "file_size_blks": 513}],
                       "controlfile_records": []}, "name", {"c1": False, "c2": True}),
    ("O18", "oracle", {"redo_logs": [{"group_no": 1, "bytes": 100 * MB, "type": "ONLINE", "status": "CURRENT"},
                                     {"group_no": 2, "bytes": 101 * MB, "type": "ONLINE", "status": "ACTIVE"},
                                     {"group_no": 3, "bytes": MB, "type": "ONLINE", "status": "UNUSED"}]},
     "group_no", {1: True, 2: False}),
    ("O21", "oracle", {"objects": [{"owner": "A", "object_type": "VIEW", "status": "INVALID", "oracle_maintained": "N",
                                    "object_name": f"v{i}"} for i in range(51)]
                       + [{"owner": "B", "object_type": "VIEW", "status": "INVALID", "oracle_maintained": "N",
                           "object_name": f"v{i}"} for i in range(50)]
                       + [{"owner": "SYS", "object_type": "VIEW", "status": "INVALID", "oracle_maintained": "Y",
                           "object_name": "x"}]}, "owner", {"A": True, "B": False}),
    ("O26", "oracle", {"sequences": [
        {"sequence_name": "s50", "last_number": Decimal(50), "max_value": Decimal(100), "cycle_flag": "N"},
        {"sequence_name": "s80", "last_number": Decimal(80), "max_value": Decimal(100), "cycle_flag": "N"},
        {"sequence_name": "s49", "last_number": Decimal(49), "max_value": Decimal(100), "cycle_flag": "N"},
        {"sequence_name": "cyc", "last_number": Decimal(99), "max_value": Decimal(100), "cycle_flag": "Y"}]},
     "sequence_name", {"s50": False, "s80": True}),
    ("O27", "oracle", {"recyclebin": [{"object_name": f"o{i}", "space_blocks": 1, "block_size": 8192}
                                      for i in range(1000)]}, "instance_id", {"i": False}),
    ("O40", "oracle", {"users": [
        {"username": "u7", "account_status": "OPEN", "expiry_ts": AS_OF + dt.timedelta(days=7)},
        {"username": "u8", "account_status": "OPEN", "expiry_ts": AS_OF + dt.timedelta(days=8)},
        {"username": "u31", "account_status": "OPEN", "expiry_ts": AS_OF + dt.timedelta(days=31)},
        {"username": "never", "account_status": "OPEN"},
        {"username": "locked", "account_status": "LOCKED", "expiry_ts": AS_OF}]},
     "username", {"u7": True, "u8": False}),
    ("O41", "oracle", {"role_privs": [{"grantee": "SYSTEM", "granted_role": "DBA"}, {"grantee": "APP", "granted_role": "DBA"},
                                      {"grantee": "ETL", "granted_role": "EXP_FULL_DATABASE"},
                                      {"grantee": "GONE", "granted_role": "DBA"}],
                       "users": [{"username": u, "account_status": "OPEN"} for u in ("SYSTEM", "APP", "ETL")]
                       + [{"username": "GONE", "account_status": "LOCKED"}]},
     "grantee", {"SYSTEM": False, "APP": True, "ETL": False}),
    ("O47", "oracle", {"jobs": [{"job": 1, "broken": "Y"}, {"job": 2, "broken": "N"}]}, "job", {1: True, 2: False}),
    ("O62", "oracle", {"asm_diskgroups": [{"name": "DATA", "total_mb": 100, "free_mb": 10, "offline_disks": 0},
                                          {"name": "FRA", "total_mb": 100, "free_mb": 11, "offline_disks": 0},
                                          {"name": "OCR", "total_mb": 100, "free_mb": 90, "offline_disks": 1}]},
     "name", {"DATA": True, "FRA": False, "OCR": True}),
    ("O64", "oracle", {"wr_control": [{"snap_interval_min": 15.0, "retention_days": 60.0}]}, "instance_id", {"i": False}),
    ("M07", "mysql", {"tables": [{"table_schema": "a", "table_name": "t1", "data_length": 10240 * MB},
                                 {"table_schema": "a", "table_name": "t2", "data_length": 10241 * MB},
                                 {"table_schema": "mysql", "table_name": "user", "data_length": 99999 * MB}]},
     "table_name", {"t1": False, "t2": True}),
    ("M20", "mysql", {"status": [{"name": "Created_tmp_tables", "value": "100"},
                                 {"name": "Created_tmp_disk_tables", "value": "25"}]}, "instance_id", {"i": False}),
    ("M22", "mysql", {"tables": [
        {"table_schema": "a", "table_name": "f30", "data_length": 60 * MB, "index_length": 10 * MB, "data_free": 30 * MB},
        {"table_schema": "a", "table_name": "f31", "data_length": 59 * MB, "index_length": 10 * MB, "data_free": 31 * MB},
        {"table_schema": "a", "table_name": "small", "data_length": MB, "index_length": 0, "data_free": 10 * MB}]},
     "table_name", {"f30": False, "f31": True}),
    ("M35", "mysql", {"variables": [{"name": "innodb_redo_log_capacity", "value": str(256 * MB)}]},
     "instance_id", {"i": False}),
    ("M44", "mysql", {"status": [{"name": "Open_files", "value": "81"}, {"name": "Table_open_cache_overflows", "value": "0"}],
                      "variables": [{"name": "open_files_limit", "value": "100"}]}, "instance_id", {"i": True}),
    ("P03", "postgres", {"databases": [{"datname": "a", "age_xid": 10 ** 9}, {"datname": "b", "age_xid": 10 ** 9 + 1},
                                       {"datname": "c"}]}, "datname", {"a": False, "b": True, "c": False}),
    ("P06", "postgres", {"tables": [{"schemaname": "s", "relname": "t1", "size_bytes": 10 * GB},
                                    {"schemaname": "s", "relname": "t2", "size_bytes": 10 * GB + 1}]},
     "relname", {"t1": False, "t2": True}),
    ("P19", "postgres", {"database_stats": [{"datname": "a", "blks_read": 5, "blks_hit": 95},
                                            {"datname": "b", "blks_read": 6, "blks_hit": 94},
                                            {"datname": "c", "blks_read": 0, "blks_hit": 0}]},
     "datname", {"a": False, "b": True, "c": False}),
    ("P20", "postgres", {"bgwriter": [{"checkpoints_timed": 10, "checkpoints_req": 10, "maxwritten_clean": 0}]},
     "instance_id", {"i": False}),
    ("P22", "postgres", {"hba_rules": [{"line_number": 1, "auth_method": "trust", "database": ["all"], "user_name": ["all"]},
                                       {"line_number": 2, "auth_method": "scram-sha-256", "database": ["all"],
                                        "user_name": ["all"]}]}, "line_number", {1: True, 2: False}),
    ("S02", "sqlserver", {"files": [{"file_name": "f90", "size_pages": 100, "used_pages": 90},
                                    {"file_name": "f89", "size_pages": 100, "used_pages": 89}]},
     "file_name", {"f90": True, "f89": False}),
    ("S07", "sqlserver", {"log_space": [{"database_name": "a", "log_used_pct": 80.0},
                                        {"database_name": "b", "log_used_pct": 79.99}]},
     "database_name", {"a": True, "b": False}),
    ("S14", "sqlserver", {"io_file_stats": [
        {"file_name": "r50", "reads": 10, "stall_read_ms": 500, "writes": 0, "stall_write_ms": 0},
        {"file_name": "r51", "reads": 10, "stall_read_ms": 510, "writes": 1, "stall_write_ms": 1}]},
     "file_name", {"r50": False, "r51": True}),
    ("S15", "sqlserver", {"tempdb_space": [{"file_name": "t80", "total_pages": 100, "unallocated_pages": 20},
                                           {"file_name": "t81", "total_pages": 100, "unallocated_pages": 19}]},
     "file_name", {"t80": False, "t81": True}),
    ("S18", "sqlserver", {"query_stats": [{"query_hash": "q1", "execution_count": 1, "total_worker_time": 10 ** 7},
                                          {"query_hash": "q2", "execution_count": 1, "total_worker_time": 10 ** 7 + 1000}]},
     "query_hash", {"q1": False, "q2": True}),
    ("S22", "sqlserver", {"error_log": [{"log_ts": T, "text": "Error: 18456, Severity: 14, State: 8."},
                                        {"log_ts": T - dt.timedelta(hours=1), "text": "Login succeeded"},
                                        {"log_ts": T - dt.timedelta(hours=2), "text": "x Severity: 21 y"}]},
     "text300", {"Error: 18456, Severity: 14, State: 8.": True, "Login succeeded": False, "x Severity: 21 y": True}),
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

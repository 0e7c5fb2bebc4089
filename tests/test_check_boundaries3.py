"""Verdict rows for the remaining checks with a verdict column, including the
performance-history checks (snapshot pair -> deltas -> ratios / shares)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetcheck.plans.checks import base
from test_check_boundaries2 import AS_OF, CASES as _unused, DAY, MB, T, _view, st  # noqa: F401

H = dt.timedelta(hours=1)

CASES = [
    ("O23", "oracle", {"data_files": [
        {"tablespace_name": "USERS", "file_name": "u1", "bytes": 100, "maxbytes": 100, "autoextensible": "NO"},
        {"tablespace_name": "DATA", "file_name": "d1", "bytes": 100, "maxbytes": 1000, "autoextensible": "YES"}],
        "free_space": [{"tablespace_name": "USERS", "bytes": 5}, {"tablespace_name": "DATA", "bytes": 5}]},
     "tablespace_name", {"USERS": True, "DATA": False}),
    ("O31", "oracle", {"fk_columns": [
        {"owner": "A", "table_name": "C", "constraint_name": "fk_ok", "column_name": "P", "position": 1},
        {"owner": "A", "table_name": "C", "constraint_name": "fk_bad", "column_name": "Q", "position": 1}],
        "index_columns": [{"table_owner": "A", "table_name": "C", "column_name": "P", "column_position": 1}]},
     "constraint_name", {"fk_bad": True}),
    ("O32", "oracle", {"segments": [
        {"owner": "APP", "segment_name": "t", "segment_type": "TABLE", "tablespace_name": "SYSTEM"},
        {"owner": "SYS", "segment_name": "obj$", "segment_type": "TABLE", "tablespace_name": "SYSTEM"},
        {"owner": "APP", "segment_name": "u", "segment_type": "TABLE", "tablespace_name": "USERS"}],
        "users": [{"username": "APP", "oracle_maintained": "N"}, {"username": "SYS", "oracle_maintained": "Y"}]},
     "segment_name", {"t": True}),
    ("O51", "oracle", {"autotask_clients": [
        {"client_name": "auto optimizer stats collection", "status": "DISABLED"},
        {"client_name": "auto space advisor", "status": "ENABLED"},
        {"client_name": "sql tuning advisor", "status": "DISABLED"}]},
     "client_name", {"auto optimizer stats collection": True, "auto space advisor": True, "sql tuning advisor": False}),
    ("O54", "oracle", {"settings": [
        {"inst_id": 1, "name": "standby_file_management", "value": "MANUAL"},
        {"inst_id": 1, "name": "log_archive_dest_2", "value": "SERVICE=stby"},
        {"inst_id": 1, "name": "log_archive_dest_state_2", "value": "ENABLE"},
        {"inst_id": 1, "name": "log_archive_dest_3", "value": ""}]},
     "name", {"standby_file_management": True, "log_archive_dest_2": False}),
    ("O77", "oracle", {"check_errors": [{"check_name": "x", "error": "ORA-1"}]}, "check_name", {"x": True}),
    ("M04", "mysql", {"status": [st("Innodb_buffer_pool_reads", 5), st("Innodb_buffer_pool_read_requests", 100),
                                 st("Innodb_buffer_pool_reads", 6, "j"), st("Innodb_buffer_pool_read_requests", 100, "j")]},
     "instance_id", {"i": False, "j": True}),
    ("M05", "mysql", {"variables": [st("log_bin", "OFF"), st("binlog_format", "ROW")]},
     "name", {"log_bin": True, "binlog_format": False}),
    ("M08", "mysql", {"statistics": [
        {"table_schema": "a", "table_name": "t", "index_name": "x1", "seq_in_index": 1, "column_name": "c"},
        {"table_schema": "a", "table_name": "t", "index_name": "x2", "seq_in_index": 1, "column_name": "c"},
        {"table_schema": "a", "table_name": "t", "index_name": "x3", "seq_in_index": 1, "column_name": "d"}]},
     "index_name", {"x1": True, "x2": True}),
    ("M10", "mysql", {"variables": [st("log_bin", "ON"), st("log_bin", "OFF", "j")], "binlogs": []},
     "instance_id", {"i": False, "j": True}),
    ("M25", "mysql", {"tables": [{"table_schema": "a", "table_name": "l1", "table_type": "BASE TABLE",
                                  "table_collation": "latin1_swedish_ci"},
                                 {"table_schema": "a", "table_name": "u8", "table_type": "BASE TABLE",
                                  "table_collation": "utf8mb4_0900_ai_ci"}], "columns": []},
     "table_name", {"l1": True}),
    ("M30", "mysql", {"plugins": [{"plugin_name": "rpl_semi_sync_source", "plugin_status": "ACTIVE"},
                                  {"plugin_name": "rpl_semi_sync_replica", "plugin_status": "DISABLED"},
                                  {"plugin_name": "other", "plugin_status": "DISABLED"}],
                      "status": [], "variables": []},
     "plugin_name", {"rpl_semi_sync_source": False, "rpl_semi_sync_replica": True}),
    ("M32", "mysql", {"variables": [st("binlog_expire_logs_seconds", 86399), st("expire_logs_days", 7)], "binlogs": []},
     "name", {"binlog_expire_logs_seconds": True, "expire_logs_days": False}),
    ("M38", "mysql", {"tables": [
        {"table_schema": "a", "table_name": "old", "table_type": "BASE TABLE", "update_ts": AS_OF - 31 * DAY},
        {"table_schema": "a", "table_name": "recent", "table_type": "BASE TABLE", "update_ts": AS_OF - 30 * DAY},
        {"table_schema": "a", "table_name": "never", "table_type": "BASE TABLE"}]},
     "table_name", {"old": True, "never": True}),
    ("P13", "postgres", {"tables": [
        {"schemaname": "s", "relname": "bloated", "relkind": "r", "relpages": 20, "reltuples": 660.0},
        {"schemaname": "s", "relname": "fine", "relkind": "r", "relpages": 12, "reltuples": 660.0},
        {"schemaname": "s", "relname": "some", "relkind": "r", "relpages": 15, "reltuples": 660.0},
        {"schemaname": "s", "relname": "tiny", "relkind": "r", "relpages": 8, "reltuples": 1.0}],
        "column_stats": [{"schemaname": "s", "tablename": t, "attname": "c", "null_frac": 0.0, "avg_width": 100}
                         for t in ("bloated", "fine", "some", "tiny")]},
     "relname", {"bloated": True, "some": False}),
    ("P16", "postgres", {"archiver": [{"failed_count": 0}, {"instance_id": "j", "failed_count": 3}]},
     "instance_id", {"i": False, "j": True}),
    ("S04", "sqlserver", {"requests": [{"session_id": 60, "start_ts": AS_OF - dt.timedelta(seconds=301)},
                                       {"session_id": 61, "start_ts": AS_OF - dt.timedelta(seconds=120)},
                                       {"session_id": 62, "start_ts": AS_OF - dt.timedelta(seconds=30)},
                                       {"session_id": 10, "start_ts": AS_OF - DAY}]},
     "session_id", {60: True, 61: False}),
    ("H10", "host", {"log_lines": [{"source": "alert", "line_no": 1, "line": "2024-01-30T10:00:00 ORA-00600 internal"},
                                   {"source": "alert", "line_no": 2, "line": "2024-01-30T10:01:00 WARNING: slow"},
                                   {"source": "alert", "line_no": 3, "line": "2024-01-01T10:00:00 ORA-00600 old"}]},
     "line_no", {1: True, 2: False}),
]


@pytest.mark.parametrize("cid,engine,views,key,expected", CASES, ids=[c[0] for c in CASES])
def test_boundary(spark, cid, engine, views, key, expected):
    v = {name: _view(spark, engine, name, rows) for name, rows in views.items()}
    ctx = base.Ctx(spark, v, F.lit(AS_OF).cast("timestamp"))
    got = {r[key]: r["is_abnormal"] for r in base.REGISTRY[cid].fn(ctx).collect()}
    assert got == expected


def _perf_views(spark, per_inst):
    """per_inst: {instance: {"tm": {stat: delta}, "ss": {stat: delta}, "ev": {event: (time_us, waits)}}}"""
    snaps, tm, ss, ev, os = [], [], [], [], []
    for inst, d in per_inst.items():
        for sid, end in ((2, T - H), (3, T)):
            snaps.append({"instance_id": inst, "instance_number": 1, "snap_id": sid, "begin_ts": end - H, "end_ts": end,
                          "startup_ts": T - 10 * DAY})
            m = 0 if sid == 2 else 1
            tm += [{"instance_id": inst, "instance_number": 1, "snap_id": sid, "stat_name": k, "value": Decimal(v * m)}
                   for k, v in d.get("tm", {}).items()]
            ss += [{"instance_id": inst, "instance_number": 1, "snap_id": sid, "stat_name": k, "value": Decimal(v * m)}
                   for k, v in d.get("ss", {}).items()]
            ev += [{"instance_id": inst, "instance_number": 1, "snap_id": sid, "event_name": k, "wait_class": "User I/O",
                    "total_waits_fg": Decimal(w * m), "time_waited_us_fg": Decimal(t * m)}
                   for k, (t, w) in d.get("ev", {}).items()]
        os.append({"instance_id": inst, "inst_id": 1, "stat_name": "NUM_CPUS", "value": Decimal(2)})
    e = "oracle"
    return {"snapshots": _view(spark, e, "snapshots", snaps), "time_model": _view(spark, e, "time_model", tm),
            "sysstat": _view(spark, e, "sysstat", ss), "system_event": _view(spark, e, "system_event", ev),
            "osstat": _view(spark, e, "osstat", os)}


def test_perf_history_verdicts(spark):
    views = _perf_views(spark, {
        "i": {"tm": {"DB time": 5760 * 10 ** 6, "DB CPU": 100 * 10 ** 6, "parse time elapsed": 500 * 10 ** 6},
              "ss": {"physical reads": 10, "session logical reads": 100},
              "ev": {"db file sequential read": (1001 * 10 ** 6, 100), "log file sync": (1000 * 10 ** 6, 1)}},
        "j": {"tm": {"DB time": 5800 * 10 ** 6, "parse time elapsed": 1200 * 10 ** 6},
              "ss": {"physical reads": 11, "session logical reads": 100}},
    })
    ctx = base.Ctx(spark, views, F.lit(AS_OF).cast("timestamp"))
    o65 = {r.instance_id: (r.db_time_pct, r.is_abnormal) for r in base.REGISTRY["O65"].fn(ctx).collect()}
    assert o65 == {"i": (80.0, False), "j": (80.56, True)}
    o67 = {r.instance_id: (r.buffer_hit_pct, r.is_abnormal) for r in base.REGISTRY["O67"].fn(ctx).collect()}
    assert o67 == {"i": (90.0, False), "j": (89.0, True)}
    o68 = {r.event_name: (r.avg_ms, r.time_s, r.is_abnormal) for r in base.REGISTRY["O68"].fn(ctx).collect()
           if r.instance_id == "i"}
    assert o68 == {"db file sequential read": (10010.0, 1001.0, True), "log file sync": (1000000.0, 1000.0, False),
                   "DB CPU": (None, 100.0, False)}
    o69 = {(r.instance_id, r.stat_name): r.is_abnormal for r in base.REGISTRY["O69"].fn(ctx).collect()
           if r.stat_name == "parse time elapsed"}
    assert o69 == {("i", "parse time elapsed"): False, ("j", "parse time elapsed"): True}


def test_o68_10g_foreground_from_total_minus_background(spark):
    views = _perf_views(spark, {"i": {"tm": {"DB time": 10 ** 9}}})
    ev = []
    for sid, m in ((2, 0), (3, 1)):
        ev.append({"instance_number": 1, "snap_id": sid, "event_name": "log file sync", "wait_class": "Commit",
                   "total_waits": Decimal(30 * m), "total_waits_bg": Decimal(10 * m),
                   "time_waited_us": Decimal(3 * 10 ** 6 * m), "time_waited_us_bg": Decimal(10 ** 6 * m)})
    views["system_event"] = _view(spark, "oracle", "system_event", ev)
    ctx = base.Ctx(spark, views, F.lit(AS_OF).cast("timestamp"))
    r = {x.event_name: (x.time_us, x.waits, x.avg_ms) for x in base.REGISTRY["O68"].fn(ctx).collect()}
    assert r["log file sync"] == (Decimal(2 * 10 ** 6), Decimal(20), 100.0)

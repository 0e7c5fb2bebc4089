"""Registry checks on literal multi-instance, multi-snapshot catalog data:
red / normal / NULL / boundary rows, and the end-to-end findings + summary."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetcheck.plans import fleet
from fleetcheck.plans.checks import base
from fleetcheck.schemas import VIEWS, schema

AS_OF = "2024-01-31 00:00:00"
T1 = dt.datetime(2024, 1, 30, 6, 0)   # latest collection
T0 = dt.datetime(2024, 1, 29, 6, 0)   # an older collection that must be ignored


def view(spark, engine, name, rows, ts=T1):
    """rows: dicts with instance_id plus any view columns; the rest are NULL."""
    sch = schema(engine, name)
    data = []
    for r in rows:
        r = {"engine": engine, "snapshot_ts": r.pop("_ts", ts), **r}
        data.append(tuple(r.get(f.name) for f in sch.fields))
    return spark.createDataFrame(data, sch)


def ctx(spark, engine, views, **params):
    return base.Ctx(spark, views, F.lit(AS_OF).cast("timestamp"), params)


def run(c, cid):
    return base.REGISTRY[cid].fn(c)


def by(df, *cols):
    return {tuple(r[c] for c in cols[:-1]): r[cols[-1]] for r in df.collect()}


def test_oracle_checks(spark):
    e = "oracle"
    hist = []
    for h in range(24):  # instance a: 101 switches in hour 5 of one day (cell red), total 124
        hist += [{"instance_id": "a", "thread": 1, "sequence": len(hist) + m, "first_ts": dt.datetime(2024, 1, 30, h, 0, m % 60)}
                 for m in range(101 if h == 5 else 1)]
    v = {
        "log_history": view(spark, e, "log_history", hist),
        "tablespaces": view(spark, e, "tablespaces", [
            {"instance_id": "a", "tablespace_name": "USERS", "contents": "PERMANENT", "total_bytes": 100, "used_bytes": 90},
            {"instance_id": "a", "tablespace_name": "UNDO", "contents": "UNDO", "total_bytes": 100, "used_bytes": 99},
            {"instance_id": "b", "tablespace_name": "USERS", "contents": "PERMANENT", "total_bytes": 100, "used_bytes": 89},
            {"instance_id": "b", "tablespace_name": "EMPTY", "contents": "PERMANENT", "total_bytes": 0, "used_bytes": 0},
        ]).unionByName(view(spark, e, "tablespaces", [
            {"instance_id": "b", "tablespace_name": "OLD", "contents": "PERMANENT", "total_bytes": 10, "used_bytes": 10,
             "_ts": T0}])),
        "settings": view(spark, e, "settings", [
            {"instance_id": "a", "inst_id": 1, "name": "processes", "value": "300"},
            {"instance_id": "a", "inst_id": 1, "name": "cpu_count", "value": "4"},
            {"instance_id": "a", "inst_id": 1, "name": "parallel_max_servers", "value": "16"},
            {"instance_id": "b", "inst_id": 1, "name": "processes", "value": "500"},
            {"instance_id": "b", "inst_id": 1, "name": "statistics_level", "value": "ALL"},
            {"instance_id": "b", "inst_id": 1, "name": "spfile", "value": None},
        ]),
        "resource_limit": view(spark, e, "resource_limit", [
            {"instance_id": "a", "inst_id": 1, "resource_name": "processes", "current_utilization": 81,
             "max_utilization": 10, "initial_allocation": " 1000", "limit_value": " 100"},
            {"instance_id": "a", "inst_id": 1, "resource_name": "enqueue_locks", "current_utilization": 999,
             "max_utilization": 999, "initial_allocation": "UNLIMITED", "limit_value": "UNLIMITED"},
            {"instance_id": "b", "inst_id": 1, "resource_name": "sessions", "current_utilization": 80,
             "max_utilization": 50, "initial_allocation": " 1000", "limit_value": " 100"},
        ]),
    }
    c = ctx(spark, e, v)
    hm = run(c, "O19").collect()
    assert len(hm) == 1 and hm[0]["h05"] == 101 and hm[0]["red_cells"] == 1 and hm[0]["total"] == 124
    ts = by(run(c, "O22"), "instance_id", "tablespace_name", "is_abnormal")
    assert ts == {("a", "USERS"): True, ("a", "UNDO"): False, ("b", "USERS"): False, ("b", "EMPTY"): False}
    pa = by(run(c, "O15"), "instance_id", "name", "is_abnormal")
    assert pa == {("a", "processes"): True, ("a", "parallel_max_servers"): False, ("b", "processes"): False,
                  ("b", "statistics_level"): True, ("b", "spfile"): True}
    rl = by(run(c, "O16"), "instance_id", "resource_name", "is_abnormal")
    assert rl == {("a", "processes"): True, ("b", "sessions"): False}


def test_oracle_perf_history(spark):
    e = "oracle"
    snaps, stats = [], []
    for sid, start in [(1, 0), (2, 0), (3, 1), (4, 1)]:  # restart between snap 2 and 3
        snaps.append({"instance_id": "a", "instance_number": 1, "snap_id": sid,
                      "begin_ts": dt.datetime(2024, 1, 30, sid), "end_ts": dt.datetime(2024, 1, 30, sid + 1),
                      "startup_ts": dt.datetime(2024, 1, start + 1)})
    vals = {"parse count (hard)": [10, 20, 5, 5 + 3600 * 60], "user commits": [0, 100, 50, 50 + 3600]}
    for name, vs in vals.items():
        for sid, val in zip([1, 2, 3, 4], vs):
            stats.append({"instance_id": "a", "instance_number": 1, "snap_id": sid, "stat_name": name,
                          "value": Decimal(val)})
    c = ctx(spark, e, {"snapshots": view(spark, e, "snapshots", snaps), "sysstat": view(spark, e, "sysstat", stats)})
    lp = {r["stat_name"]: (r["per_sec"], r["is_abnormal"]) for r in run(c, "O66").collect()}
    assert lp == {"parse count (hard)": (60.0, True), "user commits": (1.0, False)}
    tr = {(r["stat_name"], r["snap_id"]): r["rate"] for r in run(c, "O75").collect()}
    assert tr[("user commits", 1)] == 0.0 and tr[("user commits", 4)] == 1.0


def test_mysql_checks(spark):
    e = "mysql"
    v = {
        "tables": view(spark, e, "tables", [
            {"instance_id": "m", "table_schema": "app", "table_name": "t1", "table_type": "BASE TABLE",
             "auto_increment": Decimal(4294967295 * 81 // 100)},
            {"instance_id": "m", "table_schema": "app", "table_name": "t2", "table_type": "BASE TABLE",
             "auto_increment": Decimal(100)},
            {"instance_id": "m", "table_schema": "app", "table_name": "t3", "table_type": "BASE TABLE",
             "auto_increment": Decimal("18446744073709551615")},
        ]),
        "columns": view(spark, e, "columns", [
            {"instance_id": "m", "table_schema": "app", "table_name": "t1", "column_name": "id",
             "column_type": "int(10) unsigned", "extra": "auto_increment"},
            {"instance_id": "m", "table_schema": "app", "table_name": "t2", "column_name": "id",
             "column_type": "tinyint(4)", "extra": "auto_increment"},
            {"instance_id": "m", "table_schema": "app", "table_name": "t3", "column_name": "id",
             "column_type": "bigint(20) unsigned", "extra": "auto_increment"},
        ]),
        "statistics": view(spark, e, "statistics", [
            {"instance_id": "m", "table_schema": "app", "table_name": "t1", "index_name": n, "seq_in_index": i + 1,
             "column_name": col} for n, cols in [("a", ["a"]), ("a_b", ["a", "b"]), ("ab_c", ["ab", "c"])]
            for i, col in enumerate(cols)]),
        "variables": view(spark, e, "variables", [
            {"instance_id": "m", "name": "sync_binlog", "value": "0"},
            {"instance_id": "m", "name": "innodb_flush_log_at_trx_commit", "value": "1"},
            {"instance_id": "m", "name": "log_bin", "value": "OFF"},
            {"instance_id": "m", "name": "binlog_format", "value": "ROW"},
        ]),
    }
    c = ctx(spark, e, v)
    ai = by(run(c, "M16"), "table_name", "is_abnormal")
    assert ai == {("t1",): True, ("t2",): False, ("t3",): True}
    red = run(c, "M17").collect()
    assert [(r["index_name"], r["first_covering"]) for r in red] == [("a", "a_b")]
    params = by(run(c, "M12"), "name", "is_abnormal")
    assert params == {("sync_binlog",): True, ("innodb_flush_log_at_trx_commit",): False, ("log_bin",): True,
                      ("binlog_format",): False}


def test_postgres_lock_and_replication(spark):
    e = "postgres"
    v = {
        "locks": view(spark, e, "locks", [
            {"instance_id": "p", "pid": 10, "granted": True, "locktype": "relation", "relation": 5},
            {"instance_id": "p", "pid": 11, "granted": False, "locktype": "relation", "relation": 5},
            {"instance_id": "p", "pid": 12, "granted": False, "locktype": "transactionid", "transactionid": "9"},
        ]),
        "activity": view(spark, e, "activity", [
            {"instance_id": "p", "pid": 10, "usename": "u", "query": "update t", "state": "idle in transaction"},
            {"instance_id": "p", "pid": 11, "usename": "v", "query": "select t for update", "state": "active",
             "query_start": dt.datetime(2024, 1, 30, 23, 54, 0)},
        ]),
        "replication": view(spark, e, "replication", [
            {"instance_id": "p", "client_addr": "10.0.0.2", "sent_lsn": "1/0", "replay_lsn": "0/F0000000"},
            {"instance_id": "p", "client_addr": "10.0.0.3", "sent_lsn": "1/0", "replay_lsn": "0/FF600000"},
        ]),
    }
    c = ctx(spark, e, v)
    lk = run(c, "P15").collect()
    assert [(r["waiter"], r["first_holder"], r["holder_query"]) for r in lk] == [(11, 10, "update t")]
    rep = by(run(c, "P11"), "client_addr", "is_abnormal")
    assert rep == {("10.0.0.2",): True, ("10.0.0.3",): False}
    slow = run(c, "P09").collect()
    assert [(r["pid"], r["is_abnormal"]) for r in slow] == [(11, True)]


def test_sqlserver_waits_and_backups(spark):
    e = "sqlserver"
    v = {
        "wait_stats": view(spark, e, "wait_stats", [
            {"instance_id": "s", "wait_type": "CXPACKET", "wait_time_ms": 600},
            {"instance_id": "s", "wait_type": "OTHER", "wait_time_ms": 400},
            {"instance_id": "s", "wait_type": "SLEEP_TASK", "wait_time_ms": 99999},
        ]),
        "databases": view(spark, e, "databases", [
            {"instance_id": "s", "database_name": "app", "recovery_model": "SIMPLE"},
            {"instance_id": "s", "database_name": "diff_only", "recovery_model": "FULL"},
            {"instance_id": "s", "database_name": "master", "recovery_model": "SIMPLE"},
        ]),
        "backups": view(spark, e, "backups", [
            {"instance_id": "s", "database_name": "app", "type": "D", "finish_ts": dt.datetime(2024, 1, 29)},
            {"instance_id": "s", "database_name": "diff_only", "type": "I", "finish_ts": dt.datetime(2024, 1, 29)},
        ]),
    }
    c = ctx(spark, e, v)
    w = {r["wait_type"]: (r["pct"], r["running_pct"], r["is_abnormal"]) for r in run(c, "S09").collect()}
    assert w == {"CXPACKET": (60.0, 60.0, True), "OTHER": (40.0, 100.0, False)}
    b = {(r["database_name"], r["kind"]) for r in run(c, "S10").collect()}
    assert ("diff_only", "no full backup") in b and ("master", "no full backup") not in b and ("app", "history") in b
    assert by(run(c, "S13"), "database_name", "is_abnormal") == {("app",): True, ("diff_only",): False,
                                                                 ("master",): False}


def test_host_dump_and_logs(spark):
    e = "host"
    dump = "\n".join(["cpuasge", "85", "", "freemem",
                      "              total        used        free      shared  buff/cache   available",
                      "Mem:       1000000      950000       50000          0           0           0",
                      "Swap:            0           0           0", "", "diskusage", "** db1:",
                      "Filesystem Type Size Used Avail Use% Mounted on",
                      "/dev/sda1 xfs 10G 9G 1G 90% /u01", "/dev/sda2 xfs 10G 1G 9G 10% /", ""])
    log = ["2024-01-29T10:00:00.1+08:00 0 [ERROR] [MY-1] disk full", "2024-01-29T11:00:00.1+08:00 0 [ERROR] [MY-1] disk full",
           "2024-01-30T10:00:00.1+08:00 0 [Warning] slow", "2023-12-01T10:00:00 0 [ERROR] old one"]
    v = {"os_text": view(spark, e, "os_text", [{"instance_id": "h", "path": "/x/os.txt", "text": dump}]),
         "log_lines": view(spark, e, "log_lines", [{"instance_id": "h", "source": "err.log", "line_no": i + 1,
                                                    "line": ln} for i, ln in enumerate(log)])}
    c = ctx(spark, e, v)
    assert run(c, "H03").collect()[0]["is_abnormal"] is True
    mem = run(c, "H04").collect()[0]
    assert (mem["mem_used_pct"], mem["swap_used_pct"], mem["is_abnormal"]) == (95.0, None, True)
    disk = by(run(c, "H05"), "host", "mount", "is_abnormal")
    assert disk == {("db1", "/u01"): True, ("db1", "/"): False}
    s = run(c, "H11").collect()
    assert [(r["message"], r["n_lines"], r["n_errors"], r["n_warnings"]) for r in s] == [
        ("[ERROR] [MY-1] disk full", 2, 2, 1)]


def test_findings_and_summary_end_to_end(spark):
    e = "oracle"
    ts = view(spark, e, "tablespaces", [
        {"instance_id": "a", "tablespace_name": "USERS", "contents": "PERMANENT", "total_bytes": 100, "used_bytes": 95},
        {"instance_id": "b", "tablespace_name": "USERS", "contents": "PERMANENT", "total_bytes": 100, "used_bytes": 5}])
    reg = view(spark, e, "registry", [{"instance_id": "a", "comp_id": "CATALOG", "status": "VALID"},
                                      {"instance_id": "b", "comp_id": "JAVAVM", "status": "INVALID"}])
    f, summary = fleet.fleet_summary(spark, {e: {"tablespaces": ts, "registry": reg}}, fleet.as_of_ts(AS_OF))
    got = {(r["instance_id"], r["check_id"]): (r["n_normal"], r["n_abnormal"], r["priority"]) for r in summary.collect()}
    assert got == {("a", "O22"): (0, 1, "high"), ("b", "O22"): (1, 0, "high"),
                   ("a", "O13"): (1, 0, "medium"), ("b", "O13"): (0, 1, "medium")}
    assert f.filter("is_abnormal").count() == 2


def test_version_gating_materialize_and_written_findings(spark, tmp_path):
    e = "oracle"
    ts = view(spark, e, "tablespaces", [
        {"instance_id": "a", "tablespace_name": "USERS", "contents": "PERMANENT", "total_bytes": 100, "used_bytes": 95}])
    st = view(spark, e, "tab_statistics", [{"instance_id": "a", "owner": "APP", "table_name": "T", "num_rows": 20000,
                                            "stale_stats": "YES"}])
    c11 = ctx(spark, e, {"tablespaces": ts, "tab_statistics": st}, version=11)
    res, _ = base.run_checks(c11, e)
    assert "O44" not in res and "O22" in res          # stale statistics is 12c+
    c12 = ctx(spark, e, {"tablespaces": ts, "tab_statistics": st}, version=12)
    c12.materialize()
    res, _ = base.run_checks(c12, e)
    assert res["O44"].count() == 1
    f, s = fleet.fleet_summary(spark, {e: {"tablespaces": ts}}, fleet.as_of_ts(AS_OF), out_path=str(tmp_path / "f"))
    assert {(r.check_id, r.n_abnormal) for r in s.collect()} == {("O22", 1)}


def test_oracle_10g_cursor_rules_and_partition_bound(spark):
    e = "oracle"
    settings = view(spark, e, "settings", [
        {"instance_id": "a", "inst_id": 1, "name": "open_cursors", "value": "300"},
        {"instance_id": "a", "inst_id": 1, "name": "session_cached_cursors", "value": "50"}])
    sesstat = view(spark, e, "sesstat", [
        {"instance_id": "a", "inst_id": 1, "sid": 1, "stat_name": "opened cursors current", "value": Decimal(200)},
        {"instance_id": "a", "inst_id": 1, "sid": 1, "stat_name": "session cursor cache count", "value": Decimal(50)},
        {"instance_id": "a", "inst_id": 1, "sid": 2, "stat_name": "session cursor cache count", "value": Decimal(30)}])
    c = ctx(spark, e, {"settings": settings, "sesstat": sesstat}, version=10)
    got = by(run(c, "O15"), "name", "is_abnormal")
    # open_cursors: 300*0.8=240 < 250 -> red; session_cached_cursors: 50*0.8=40 < 50 -> red
    assert got == {("open_cursors",): True, ("session_cached_cursors",): True}
    c12 = ctx(spark, e, {"settings": settings, "sesstat": sesstat}, version=12)
    assert run(c12, "O15").count() == 0   # 12c has no cursor rules
    parts = view(spark, e, "partitions", [
        {"instance_id": "a", "table_owner": "APP", "table_name": "T", "partition_name": f"P{i}",
         "partition_position": i, "high_value_raw": bytearray([120, 124, i, 1, 1, 1, 1])} for i in (1, 2, 3)])
    hv = run(ctx(spark, e, {"partitions": parts}), "O30").collect()
    assert [(r.partition_name, r.high_value) for r in hv] == [("P2", "2024-02-01 00:00:00")]


def test_more_oracle_verdicts(spark):
    e = "oracle"
    hist = []
    for d, used in [(27, 50), (28, 60), (29, 95)]:
        for hh, extra in [(8, 0), (20, 1)]:  # last snapshot of each day wins
            hist.append({"instance_id": "a", "tablespace_id": 1, "snap_id": d * 10 + hh, "block_size": 1,
                         "rtime": f"01/{d}/2024 {hh:02d}:00:00", "tablespace_size": 100,
                         "tablespace_usedsize": used + extra})
    inst = view(spark, e, "instance", [{"instance_id": "a", "startup_ts": dt.datetime(2024, 1, 1)}])
    jl = [{"instance_id": "a", "owner": "APP", "job_name": "J", "log_id": i, "status": s,
           "log_ts": dt.datetime(2024, 1, 30 - i)} for i, s in enumerate(["FAILED", "SUCCEEDED", "FAILED", "STOPPED",
                                                                         "FAILED", "FAILED"])]
    arch = [{"instance_id": "a", "thread": 1, "sequence": s, "applied": "YES" if s <= 10 else "NO"} for s in range(5, 17)]
    c = ctx(spark, e, {"tablespace_usage_hist": view(spark, e, "tablespace_usage_hist", hist), "instance": inst,
                       "job_log": view(spark, e, "job_log", jl), "archived_log": view(spark, e, "archived_log", arch),
                       "redo_logs": view(spark, e, "redo_logs", [{"instance_id": "a", "thread": 1, "sequence": s} for s in (19, 20)])})
    g = {r.day: (r.total, r.growth, r.used_pct, r.is_abnormal) for r in run(c, "O25").collect()}
    assert g["2024-01-29"] == (96, 35, 96.0, True) and g["2024-01-28"] == (61, 10, 61.0, False)
    assert g["2024-01-27"][1] is None
    fails = sorted(r.log_id for r in run(c, "O49").collect())
    assert fails == [0, 2, 3]  # non-success within 7 days, newest three per job
    gap = run(c, "O55").collect()[0]
    assert (gap.applied, gap.current, gap.gap, gap.is_abnormal) == (10, 20, 10, True)  # the redo log is ahead of what is archived


def test_oracle_top_sql(spark):
    e = "oracle"
    snaps = [{"instance_id": "a", "instance_number": 1, "snap_id": s, "begin_ts": dt.datetime(2024, 1, 30, s),
              "end_ts": dt.datetime(2024, 1, 30, s + 1), "startup_ts": dt.datetime(2024, 1, 1)} for s in (1, 2, 3)]
    sq = [{"instance_id": "a", "instance_number": 1, "snap_id": s, "sql_id": q, "elapsed_delta": el,
           "cpu_delta": el // 2, "iowait_delta": el // 4, "exec_delta": ex}
          for s, q, el, ex in [(1, "q0", 10**9, 1), (3, "slow", 130 * 10**6, 2), (3, "fast", 10**6, 100)]]
    tm = [{"instance_id": "a", "instance_number": 1, "snap_id": s, "stat_name": "DB time", "value": Decimal(v)}
          for s, v in [(1, 0), (2, 0), (3, 10**9)]]
    c = ctx(spark, e, {"snapshots": view(spark, e, "snapshots", snaps), "sqlstat": view(spark, e, "sqlstat", sq),
                       "time_model": view(spark, e, "time_model", tm)})
    got = {r.sql_id: (r.per_exec_s, r.pct_total, r.pct_cpu, r.is_abnormal) for r in run(c, "O70").collect()}
    # snap 1 is outside (begin, end] of the newest pair (2, 3)
    assert got == {"slow": (65.0, 13.0, 50.0, True), "fast": (0.01, 0.1, 50.0, False)}


def test_mysql_trx_and_password(spark):
    e = "mysql"
    trx = view(spark, e, "innodb_trx", [
        {"instance_id": "m", "trx_id": "t1", "trx_started": dt.datetime(2024, 1, 30, 23, 50), "trx_mysql_thread_id": 5},
        {"instance_id": "m", "trx_id": "t2", "trx_started": dt.datetime(2024, 1, 30, 23, 58), "trx_mysql_thread_id": 6}])
    pl = view(spark, e, "processlist", [{"instance_id": "m", "id": 5, "user": "app", "host": "h:1", "db": "d"}])
    users = view(spark, e, "users", [
        {"instance_id": "m", "user": "old", "host": "%", "password_last_changed": dt.datetime(2023, 1, 1),
         "account_locked": "N"},
        {"instance_id": "m", "user": "new", "host": "%", "password_last_changed": dt.datetime(2024, 1, 1),
         "account_locked": "N"},
        {"instance_id": "m", "user": "never", "host": "%", "account_locked": "N"}])
    var = view(spark, e, "variables", [{"instance_id": "m", "name": "default_password_lifetime", "value": "90"}])
    c = ctx(spark, e, {"innodb_trx": trx, "processlist": pl, "users": users, "variables": var})
    t = {r.trx_id: (r.elapsed_s, r.user, r.is_abnormal) for r in run(c, "M14").collect()}
    assert t == {"t1": (600, "app", True), "t2": (120, None, False)}
    p = by(run(c, "M37"), "user", "is_abnormal")
    assert p == {("old",): True, ("new",): False, ("never",): True, ("(global)",): False}


def test_postgres_roles_and_sqlserver_jobs(spark):
    roles = view(spark, "postgres", "roles", [
        {"instance_id": "p", "rolname": "postgres", "rolsuper": True, "rolcanlogin": True},
        {"instance_id": "p", "rolname": "etl", "rolsuper": True, "rolcanlogin": True},
        {"instance_id": "p", "rolname": "app", "rolsuper": False, "rolcanlogin": True,
         "rolvaliduntil": dt.datetime(2024, 1, 1)}])
    r = {x.rolname: (x.superuser, x.is_abnormal) for x in run(ctx(spark, "postgres", {"roles": roles}), "P21").collect()}
    assert r == {"postgres": ("YES", False), "etl": ("YES", True), "app": ("no", True)}
    e = "sqlserver"
    jobs = view(spark, e, "jobs", [{"instance_id": "s", "job_id": "j1", "name": "backup"},
                                   {"instance_id": "s", "job_id": "j2", "name": "never ran"}])
    hist = view(spark, e, "job_history", [
        {"instance_id": "s", "job_id": "j1", "step_id": 0, "run_status": 1, "run_date": 20240128, "run_time": 10000},
        {"instance_id": "s", "job_id": "j1", "step_id": 0, "run_status": 0, "run_date": 20240130, "run_time": 93000},
        {"instance_id": "s", "job_id": "j1", "step_id": 1, "run_status": 1, "run_date": 20240131, "run_time": 0}])
    req = view(spark, e, "requests", [
        {"instance_id": "s", "session_id": 60, "blocking_session_id": 0, "sql_text": "update x", "status": "running"},
        {"instance_id": "s", "session_id": 61, "blocking_session_id": 60, "wait_time_ms": 5000, "sql_text": "select x"}])
    c = ctx(spark, e, {"jobs": jobs, "job_history": hist, "requests": req})
    j = {x.name: (str(x.run_ts), x.last_status, x.is_abnormal) for x in run(c, "S05").collect()}
    assert j == {"backup": ("2024-01-30 09:30:00", "Failed", True), "never ran": ("None", "N/A", False)}
    b = run(c, "S17").collect()
    assert [(x.session_id, x.blocker_sql_text, x.blocker_status) for x in b] == [(61, "update x", "running")]


def test_tiers_priorities_and_rollup(spark):
    from fleetcheck.plans.checks import report
    assert base.REGISTRY["O70"].tier == "monthly" and base.REGISTRY["M17"].tier == "quarterly"
    weekly = {c.check_id for c in base.checks_for("oracle", "weekly")}
    assert "O22" in weekly and "O70" not in weekly
    assert len(base.checks_for(None, "quarterly")) == len(base.REGISTRY)
    pr = dict((c, p) for c, p, _ in report.PRIORITY_MAP)
    assert pr["O33"] == "high" and pr["O19"] == "low" and pr["O21"] == "medium"
    assert base.REGISTRY["O33"].priority == "high" and base.REGISTRY["O13"].priority == "medium"
    f = spark.createDataFrame([("a", "O22", True), ("a", "O19", True), ("a", "O21", True), ("a", "O33", False),
                               ("b", "O22", False)], "instance_id string, check_id string, is_abnormal boolean")
    r = report.priority_rollup(report.health_summary_of(f, spark))
    got = {(x.instance_id, x.priority): (x.n_abnormal_checks, x.check_ids) for x in r.collect()}
    assert got == {("a", "high"): (1, "O22"), ("a", "low"): (1, "O19"), ("a", "medium"): (1, "O21")}


def test_snapshot_store_roundtrip_with_partition_pruning(spark, tmp_path):
    from fleetcheck.sources import write_snapshots
    e = "oracle"
    root = str(tmp_path / "store")
    old = view(spark, e, "tablespaces", [{"instance_id": "a", "tablespace_name": "USERS", "contents": "PERMANENT",
                                          "total_bytes": 100, "used_bytes": 99, "_ts": dt.datetime(2023, 12, 1)}])
    new = view(spark, e, "tablespaces", [{"instance_id": "a", "tablespace_name": "USERS", "contents": "PERMANENT",
                                          "total_bytes": 100, "used_bytes": 10}])
    write_snapshots(old, f"{root}/{e}", "tablespaces")
    write_snapshots(new, f"{root}/{e}", "tablespaces")
    views = fleet.load_views(spark, root, e, since="2024-01-01")
    assert set(views) == {"tablespaces"}          # views never collected are skipped
    plan = views["tablespaces"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan and "2024-01-01" in plan
    f, s = fleet.fleet_summary(spark, {e: views}, fleet.as_of_ts(AS_OF))
    assert [(r.check_id, r.n_normal, r.n_abnormal) for r in s.collect()] == [("O22", 1, 0)]


def test_command_line_fleet_run(spark, tmp_path):
    from fleetcheck.__main__ import main
    from fleetcheck.sources import write_snapshots
    root = str(tmp_path / "store")
    write_snapshots(view(spark, "oracle", "tablespaces", [
        {"instance_id": "a", "tablespace_name": "USERS", "contents": "PERMANENT", "total_bytes": 100, "used_bytes": 95}]),
        f"{root}/oracle", "tablespaces")
    write_snapshots(view(spark, "mysql", "variables", [
        {"instance_id": "m", "name": "sync_binlog", "value": "0"}]), f"{root}/mysql", "variables")
    out = str(tmp_path / "out")
    res = main(["--root", root, "--as-of", AS_OF, "--out", out, "--engines", "oracle,mysql", "--materialize"])
    assert res["engines"] == ["mysql", "oracle"] and res["checks_abnormal"] >= 2
    pr = {(r.instance_id, r.priority): r.check_ids for r in spark.read.parquet(f"{out}/priorities").collect()}
    assert pr[("a", "high")] == "O22" and "M12" in pr[("m", "medium")]


def test_o32_version_variant(spark):
    e = "oracle"
    seg = view(spark, e, "segments", [{"instance_id": "a", "owner": "APP", "segment_name": "t", "segment_type": "TABLE",
                                       "tablespace_name": "SYSTEM"},
                                      {"instance_id": "a", "owner": "OUTLN", "segment_name": "o", "segment_type": "TABLE",
                                       "tablespace_name": "SYSTEM"}])
    users = view(spark, e, "users", [
        {"instance_id": "a", "username": "APP", "default_tablespace": "USERS"},          # 11g: no maintained flag
        {"instance_id": "a", "username": "OUTLN", "default_tablespace": "SYSTEM"}])
    got = [r.segment_name for r in run(ctx(spark, e, {"segments": seg, "users": users}, version=11), "O32").collect()]
    assert got == ["t"]
    assert not base.applies(base.REGISTRY["O77"], 10) and base.applies(base.REGISTRY["O77"], 12)


def test_oracle_10g_variants(spark):
    e = "oracle"
    rb = view(spark, e, "recyclebin", [{"instance_id": "a", "con_id": c, "owner": "A", "space_blocks": 128,
                                        "block_size": 8192} for c in (3, 4)])
    r11 = run(ctx(spark, e, {"recyclebin": rb}, version=11), "O02").collect()
    assert sorted((x.owner, x.n_objects) for x in r11) == [("A", 2), ("SUM", 2)]
    r12 = run(ctx(spark, e, {"recyclebin": rb}, version=12), "O02").collect()
    assert len(r12) == 4   # per container: A + SUM
    jobs = view(spark, e, "scheduler_jobs", [{"instance_id": "a", "job_name": "GATHER_STATS_JOB", "enabled": "FALSE"},
                                             {"instance_id": "a", "job_name": "AUTO_SPACE_ADVISOR_JOB", "enabled": "FALSE"}])
    c10 = ctx(spark, e, {"autotask_clients": view(spark, e, "autotask_clients", []), "scheduler_jobs": jobs}, version=10)
    assert by(run(c10, "O51"), "client_name", "is_abnormal") == {("GATHER_STATS_JOB",): True,
                                                                 ("AUTO_SPACE_ADVISOR_JOB",): False}


def test_o39_hash_variant(spark):
    e = "oracle"
    users = view(spark, e, "users", [{"instance_id": "a", "username": "SCOTT", "account_status": "OPEN",
                                      "password_hash": "F894844C34402B67"},
                                     {"instance_id": "a", "username": "HR", "account_status": "OPEN",
                                      "password_hash": "changed"}])
    known = view(spark, e, "default_pwd_hashes", [{"instance_id": "a", "username": "SCOTT", "password_hash": "F894844C34402B67"},
                                                  {"instance_id": "a", "username": "HR", "password_hash": "4C6D73C3E8B0F0DA"}])
    got = [r.username for r in run(ctx(spark, e, {"users": users, "default_pwd_hashes": known}, version=11), "O39").collect()]
    assert got == ["SCOTT"]


def test_o64_interval_columns(spark):
    e = "oracle"
    w = view(spark, e, "wr_control", [
        {"instance_id": "a", "snap_interval": dt.timedelta(minutes=10), "retention": dt.timedelta(days=8)},
        {"instance_id": "b", "snap_interval": dt.timedelta(hours=1), "retention": dt.timedelta(days=61)},
        {"instance_id": "c", "snap_interval": dt.timedelta(minutes=15), "retention": dt.timedelta(days=60)}])
    got = {r.instance_id: (r.snap_interval_min, r.retention_days, r.is_abnormal)
           for r in run(ctx(spark, e, {"wr_control": w}), "O64").collect()}
    assert got == {"a": (10.0, 8.0, True), "b": (60.0, 61.0, True), "c": (15.0, 60.0, False)}


def test_collect_views_into_store_then_check(spark, tmp_path):
    from fleetcheck.sources import collect_views
    root = str(tmp_path / "store")
    for inst, used in (("db1", 95), ("db2", 10)):
        ts = spark.createDataFrame([("USERS", "PERMANENT", 100, used, 1)],
                                   "tablespace_name string, contents string, total_bytes bigint, used_bytes bigint, "
                                   "n_files int")
        assert collect_views({"tablespaces": ts}, root, "oracle", inst, "2024-01-30 06:00:00") == ["tablespaces"]
    views = fleet.load_views(spark, root, "oracle")
    f, s = fleet.fleet_summary(spark, {"oracle": views}, fleet.as_of_ts(AS_OF))
    assert {(r.instance_id, r.n_abnormal) for r in s.collect()} == {("db1", 1), ("db2", 0)}


def test_isolated_run_records_failing_check(spark, tmp_path):
    from pyspark.sql import functions as F2
    e = "oracle"
    ts = view(spark, e, "tablespaces", [{"instance_id": "a", "tablespace_name": "USERS", "contents": "PERMANENT",
                                         "total_bytes": 100, "used_bytes": 95}])

    @base.check("Z99", e, "always_fails_at_runtime", ["tablespaces"], key=("tablespace_name",))
    def z99(ctx):
        return ctx.cur("tablespaces").withColumn("is_abnormal", F2.raise_error(F2.lit("boom")).isNull())

    try:
        errs = fleet.write_findings_isolated(spark, {e: {"tablespaces": ts}}, fleet.as_of_ts(AS_OF), str(tmp_path / "f"))
        got = {(r.check_name, "boom" in r.error) for r in errs.collect()}
        assert got == {("Z99", True)}
        f = spark.read.parquet(str(tmp_path / "f"))
        assert {(r.check_id, r.is_abnormal) for r in f.collect()} == {("O22", True)}
    finally:
        base.REGISTRY.pop("Z99", None)

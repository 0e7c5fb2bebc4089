"""Value assertions for checks without a verdict (scalars, rates, roll-ups,
trends, listings with logic)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from fleetcheck.plans.checks import base
from test_check_boundaries2 import AS_OF, DAY, MB, T, _view, st  # noqa: F401
from test_check_boundaries3 import _perf_views


def run(spark, engine, cid, views, **params):
    v = {name: _view(spark, engine, name, rows) for name, rows in views.items()}
    return base.REGISTRY[cid].fn(base.Ctx(spark, v, F.lit(AS_OF).cast("timestamp"), params)).collect()


def test_oracle_scalars_and_rollups(spark):
    r = run(spark, "oracle", "O03", {"instance": [
        {"inst_id": 2, "instance_name": "orcl2", "host_name": "db2", "version": "19.21.0.0.0", "startup_ts": T - DAY},
        {"inst_id": 1, "instance_name": "orcl1", "host_name": "db1", "version": "19.21.0.0.0", "startup_ts": T - 2 * DAY}]})
    assert [(x.hosts, x.instances, x.major_version, x.startup_ts) for x in r] == [("db1,db2", "orcl1,orcl2", 19, T - 2 * DAY)]
    r = run(spark, "oracle", "O02", {"recyclebin": [
        {"con_id": 3, "owner": "A", "space_blocks": 128, "block_size": 8192},
        {"con_id": 3, "owner": "B", "space_blocks": 256, "block_size": 8192}]})
    assert sorted((x.owner, x.size_mb, x.n_objects) for x in r) == [("A", 1.0, 1), ("B", 2.0, 1), ("SUM", 3.0, 2)]
    r = run(spark, "oracle", "O09", {"archived_log": [
        {"thread": 1, "sequence": 1, "first_ts": T, "blocks": 168 * 1024, "block_size": 1024}],
        "data_files": [{"file_name": "f1"}, {"file_name": "f2"}],
        "redo_logs": [{"group_no": 1, "bytes": 10}, {"group_no": 2, "bytes": 20}]})
    assert [(x.n_datafiles, x.min_redo_bytes, x.max_redo_bytes, x.redo_mb_per_hour) for x in r] == [(2, 10, 20, 1.0)]
    r = run(spark, "oracle", "O20", {"archived_log": [
        {"thread": 1, "sequence": s, "first_ts": T, "blocks": 1024 * 1024, "block_size": 512} for s in range(4)]})
    assert [(x.day, float(x.archive_gb)) for x in r] == [("2024-01-30", 2.0)]


def test_oracle_trends_and_shares(spark):
    views = _perf_views(spark, {"i": {"tm": {"DB time": 4000, "DB CPU": 1000},
                                      "ev": {"a": (2000, 1), "b": (500, 1), "c": (300, 1), "d": (100, 1),
                                             "e": (50, 1), "f": (10, 1)}}})
    ctx = base.Ctx(spark, views, F.lit(AS_OF).cast("timestamp"))
    share = {x.event_name: x.pct for x in base.REGISTRY["O76"].fn(ctx).collect()}
    # top five of the waits + DB CPU, each as a share of their own total (2000+1000+500+300+100 = 3900)
    assert set(share) == {"a", "DB CPU", "b", "c", "d"} and share["a"] == 51.28
    tr = {(x.snap_id, x.stat_name): x.rate for x in base.REGISTRY["O75"].fn(base.Ctx(spark, {
        "sysstat": _view(spark, "oracle", "sysstat", [
            {"instance_number": 1, "snap_id": s, "stat_name": "user commits", "value": Decimal(v)}
            for s, v in ((1, 0), (2, 3600), (3, 10800))]),
        "snapshots": _view(spark, "oracle", "snapshots", [
            {"instance_number": 1, "snap_id": s, "begin_ts": T + (s - 1) * dt.timedelta(hours=1),
             "end_ts": T + s * dt.timedelta(hours=1)} for s in (1, 2, 3)])}, F.lit(AS_OF).cast("timestamp"))).collect()}
    assert tr == {(1, "user commits"): 0.0, (2, "user commits"): 1.0, (3, "user commits"): 2.0}
    m = run(spark, "oracle", "O72", {"sysmetric": [
        {"instance_number": 1, "snap_id": 5, "metric_name": "Host CPU Utilization (%)", "average": 40.0},
        {"instance_number": 1, "snap_id": 5, "metric_name": "Database CPU Time Ratio", "average": 70.0}]})
    assert [(x.snap_id, x.host_cpu_pct, x.db_cpu_pct, x.background_cpu_pct) for x in m] == [(5, 40.0, 70.0, None)]


def test_mysql_values(spark):
    r = run(spark, "mysql", "M19", {"status": [st("Uptime", 100), st("Questions", 1000), st("Com_commit", 30),
                                               st("Com_rollback", 20), st("Threads_created", 5), st("Connections", 100)]})
    x = r[0]
    assert (x.qps, x.tps, x.thread_cache_hit_pct) == (10.0, 0.5, 95.0)
    r = run(spark, "mysql", "M31", {"variables": [st("replicate_do_db", ""), st("binlog_ignore_db", "mysql")]})
    assert sorted((x.name, x.display_value) for x in r) == [("binlog_ignore_db", "mysql"), ("replicate_do_db", "(none)")]
    r = run(spark, "mysql", "M33", {"processlist": [{"id": 9, "command": "Binlog Dump GTID", "host": "10.0.0.5:51234"},
                                                    {"id": 10, "command": "Query", "host": "x:1"}], "replica_hosts": []})
    assert [(x.id, x.replica_host, x.replica_port) for x in r] == [(9, "10.0.0.5", 51234)]
    r = run(spark, "mysql", "M28", {"schemata": [{"schema_name": "app"}, {"schema_name": "empty"}, {"schema_name": "mysql"}],
                                    "tables": [{"table_schema": "app", "table_name": "t", "table_type": "BASE TABLE"}],
                                    "views": [{"table_schema": "app", "table_name": "v"}],
                                    "routines": [{"routine_schema": "app", "routine_name": "p", "routine_type": "PROCEDURE"}],
                                    "triggers": [], "events": []})
    assert sorted((x.schema_name, x.n_tables, x.n_views, x.n_procedures, x.n_events) for x in r) == [
        ("app", 1, 1, 1, 0), ("empty", 0, 0, 0, 0)]


def test_postgres_values(spark):
    r = run(spark, "postgres", "P01", {"facts": [st("version", "16.2"), st("listen_addresses", "10.0.0.1"),
                                                 st("postmaster_start_time", "2024-01-28 21:30:00"),
                                                 st("total_size_bytes", 20 * 1024 * MB)]})
    x = r[0]
    assert (x.host, x.uptime_days, x.uptime_hours, x.uptime_minutes, x.total_size_pretty) == ("10.0.0.1", 2, 2, 30, "20 GB")
    r = run(spark, "postgres", "P08", {"activity": [
        {"pid": 1, "datname": "a", "state": "active", "backend_type": "client backend"},
        {"pid": 2, "datname": "a", "state": "idle", "backend_type": "client backend"},
        {"pid": 3, "datname": "a", "state": "idle", "backend_type": "client backend"},
        {"pid": 4, "datname": None, "state": None, "backend_type": "checkpointer"}]})
    assert sorted((x.state, x.datname, x.n_connections) for x in r) == [("active", "a", 1), ("idle", "a", 2),
                                                                       ("total", "all", 3)]
    r = run(spark, "postgres", "P04", {"objects": [{"schemaname": "app", "relname": "t", "relkind": "r"},
                                                   {"schemaname": "app", "relname": "i", "relkind": "i"},
                                                   {"schemaname": "pg_temp_3", "relname": "x", "relkind": "r"}],
                                       "functions": [{"schemaname": "app", "proname": "f"},
                                                     {"schemaname": "pg_catalog", "proname": "g"}]})
    assert [(x.schemaname, x.n_tables, x.n_indexes, x.n_functions) for x in r] == [("app", 1, 1, 1)]


def test_sqlserver_and_host_values(spark):
    r = run(spark, "sqlserver", "S23", {"db_users": [
        {"database_name": "d", "user_name": "u", "type_desc": "SQL_USER", "role_name": "db_owner"},
        {"database_name": "d", "user_name": "u", "type_desc": "SQL_USER", "role_name": "db_datareader"},
        {"database_name": "d", "user_name": "u", "type_desc": "SQL_USER", "role_name": "db_owner"}]})
    assert [(x.user_name, x.roles) for x in r] == [("u", "db_datareader, db_owner")]
    r = run(spark, "sqlserver", "S16", {"objects": [{"database_name": "d", "type_desc": "USER_TABLE"},
                                                    {"database_name": "d", "type_desc": "VIEW"},
                                                    {"database_name": "d", "type_desc": "SQL_SCALAR_FUNCTION"}],
                                        "databases": [{"database_name": "d"}, {"database_name": "e"}]})
    assert sorted((x.database_name, x.n_tables, x.n_views, x.n_functions) for x in r) == [("d", 1, 1, 1), ("e", 0, 0, 0)]
    r = run(spark, "host", "H13", {"files": [{"path": "/b", "name": "bin.000002", "size_bytes": 3 * MB},
                                             {"path": "/b", "name": "bin.000001", "size_bytes": 3 * MB},
                                             {"path": "/b", "name": "bin.000003", "size_bytes": MB}]})
    assert [(x.n_files, x.total_mb, x.largest_file) for x in r] == [(3, 7.0, "bin.000001")]
    dump = "\n".join(["sysctl", "vm.swappiness = 10", "kernel.shmmax = 4096", "other.key = 1", "",
                      "diskusage", "** n1:", "x", "** n2:", "y", ""])
    r = run(spark, "host", "H07", {"os_text": [{"path": "p", "text": dump}]})
    assert sorted((x.name, x.value) for x in r) == [("kernel.shmmax", "4096"), ("vm.swappiness", "10")]
    r = run(spark, "host", "H08", {"os_text": [{"path": "p", "text": dump}]})
    assert [(x.section, x.n_hosts) for x in r] == [("diskusage", 2)]


def test_more_listing_values(spark):
    GB = 1024 ** 3
    r = run(spark, "oracle", "O04", {"database": [{"name": "CDB1", "log_mode": "ARCHIVELOG"}],
                                     "pdbs": [{"con_id": 2, "name": "PDB$SEED"}, {"con_id": 4, "name": "SALES"},
                                              {"con_id": 3, "name": "HR"}]})
    assert [(x.name, x.pdbs) for x in r] == [("CDB1", "HR,SALES")]
    r = run(spark, "oracle", "O24", {"data_files": [{"bytes": 2 * GB}, {"bytes": GB}], "temp_files": [{"bytes": GB}],
                                     "tablespaces": [{"used_bytes": GB // 2}]})
    assert [(x.physical_gb, x.temp_gb, x.used_gb) for x in r] == [(3.0, 1.0, 0.5)]
    r = run(spark, "oracle", "O43", {"users": [{"username": "APP", "oracle_maintained": "N"},
                                               {"username": "NONE", "oracle_maintained": "N"},
                                               {"username": "SYS", "oracle_maintained": "Y"}],
                                     "objects": [{"owner": "APP", "object_name": "T", "object_type": "TABLE", "status": "VALID"},
                                                 {"owner": "APP", "object_name": "V", "object_type": "VIEW", "status": "INVALID"},
                                                 {"owner": "SYS", "object_name": "X", "object_type": "TABLE", "status": "VALID"}]})
    assert sorted((x.owner, x.n_tables, x.n_views, x.n_invalid) for x in r) == [("APP", 1, 1, 1), ("NONE", 0, 0, 0)]
    r = run(spark, "oracle", "O59", {"alert_log": [
        {"originating_ts": T, "message_text": "ORA-00600", "problem_key": "ORA 600"},
        {"originating_ts": T, "message_text": "ORA-00600", "problem_key": "ORA 600"},
        {"originating_ts": T, "message_text": "Thread 1 advanced", "problem_key": None},
        {"originating_ts": AS_OF - 91 * DAY, "message_text": "ORA-7445", "problem_key": "ORA 7445"}]})
    assert [(x.problem_key, x.message_text) for x in r] == [("ORA 600", "ORA-00600")]
    snaps = [{"instance_number": 1, "snap_id": s, "begin_ts": T, "end_ts": T, "startup_ts": T - DAY} for s in (1, 2)]
    r = run(spark, "oracle", "O71", {"snapshots": snaps,
                                     "sqlstat": [{"instance_number": 1, "snap_id": 2, "sql_id": q, "elapsed_delta": e,
                                                  "exec_delta": 1} for q, e in (("a", 10), ("b", 20))],
                                     "time_model": [],
                                     "sqltext": [{"sql_id": "a", "sql_text": "select * from t"},
                                                 {"sql_id": "b", "sql_text": "begin dbms_stats.gather; end;"}]})
    assert [(x.sql_id, x.rn) for x in r] == [("a", 2)]
    r = run(spark, "mysql", "M24", {"wait_summary": [
        {"event_name": f"wait/io/file/{i}", "count_star": 1, "sum_timer_wait": Decimal(i)} for i in range(12)]
        + [{"event_name": "idle", "count_star": 1, "sum_timer_wait": Decimal(999)}]})
    assert sorted(x.rn for x in r) == list(range(1, 11)) and {x.event_name for x in r if x.rn == 1} == {"wait/io/file/11"}
    r = run(spark, "host", "H12", {"log_lines": [{"source": "e", "line_no": i, "line": str(i)} for i in range(1, 61)]})
    assert sorted(x.line_no for x in r) == list(range(11, 61))
    dump = "\n".join(["mysql_config", "max_connections = 500", "innodb_buffer_pool_size=8G", ""])
    r = run(spark, "host", "H14", {"os_text": [{"path": "p", "text": dump}]})
    assert sorted((x.name, x.value) for x in r) == [("innodb_buffer_pool_size", "8G"), ("max_connections", "500")]
    html = ('<table id="dbinfo"><tr><th>k</th><th>v</th></tr><tr><td>version</td><td>19c</td></tr></table>')
    r = run(spark, "report", "R04", {"report_html": [{"path": "r.html", "html": html}]})
    assert sorted((x.table_id, x.row_no, x.col_no, x.cell) for x in r) == [
        ("dbinfo", 0, 1, "k"), ("dbinfo", 0, 2, "v"), ("dbinfo", 1, 1, "version"), ("dbinfo", 1, 2, "19c")]
    r = run(spark, "sqlserver", "S01", {"facts": [st("ProductVersion", "16.0.4105.2"), st("StartTime", "2024-01-21 08:00:00"),
                                                  st("CpuCount", 8)]})
    assert [(x.version, x.cpus, x.uptime_days) for x in r] == [("16.0.4105.2", "8", 10)]


def test_remaining_listing_values(spark):
    r = run(spark, "oracle", "O05", {"osstat": [{"inst_id": 1, "stat_name": "NUM_CPUS", "value": Decimal(16)},
                                                {"inst_id": 1, "stat_name": "PHYSICAL_MEMORY_BYTES", "value": Decimal(2 ** 36)}]})
    assert [(x.cpus, x.cores, x.memory_bytes) for x in r] == [(16.0, None, float(2 ** 36))]
    r = run(spark, "oracle", "O06", {"settings": [{"inst_id": 1, "name": "sga_target", "value": "8", "unit": "G"},
                                                  {"inst_id": 1, "name": "open_cursors", "value": "300"}]})
    assert [(x.name, x.display_value) for x in r] == [("sga_target", "8 G")]
    r = run(spark, "oracle", "O07", {"snapshots": [
        {"instance_number": 1, "snap_id": s, "startup_ts": T - (DAY if s < 3 else dt.timedelta(hours=1))}
        for s in (1, 2, 3)]})
    assert [(x.begin_snap, x.end_snap) for x in r] == [(1, 2)]   # 3 is alone after a restart
    r = run(spark, "oracle", "O08", {"role_privs": [{"grantee": "X", "granted_role": "GGS_GGSUSER_ROLE"}],
                                     "users": [{"username": "splex_admin"}, {"username": "APP"}]})
    assert sorted((x.product, x.n_markers) for x in r) == [("goldengate", 1), ("shareplex", 1)]
    r = run(spark, "oracle", "O11", {"database": [{"dbid": 7, "name": "PROD", "log_mode": "ARCHIVELOG"}],
                                     "instance": [{"inst_id": 1, "version": "19.0"}, {"inst_id": 2, "version": "19.0"}]})
    assert [(x.name, x.n_instances, x.version) for x in r] == [("PROD", 2, "19.0")]
    r = run(spark, "oracle", "O48", {"scheduler_jobs": [{"owner": "A", "job_name": "J1"}, {"owner": "A", "job_name": "J2"}],
                                     "scheduler_running": [{"owner": "A", "job_name": "J2", "session_id": 77}]})
    assert sorted((x.job_name, x.session_id) for x in r) == [("J1", None), ("J2", 77)]
    r = run(spark, "oracle", "O53", {"autotask_history": [{"client_name": "c", "window_start_ts": AS_OF - 6 * DAY},
                                                          {"client_name": "old", "window_start_ts": AS_OF - 8 * DAY}]})
    assert [x.client_name for x in r] == ["c"]
    r = run(spark, "oracle", "O61", {"asm_diskgroups": [{"group_number": 1, "name": "DATA"}],
                                     "asm_attributes": [{"group_number": 1, "name": "au_size", "value": "4M"},
                                                        {"group_number": 1, "name": "template.x", "value": "y"}]})
    assert [(x.diskgroup, x.name, x.value) for x in r] == [("DATA", "au_size", "4M")]
    r = run(spark, "oracle", "O73", {"resource_limit_hist": [
        {"instance_number": 1, "snap_id": 4, "resource_name": "processes", "current_utilization": 120},
        {"instance_number": 1, "snap_id": 4, "resource_name": "sessions", "current_utilization": 150}]})
    assert [(x.snap_id, x.processes, x.sessions) for x in r] == [(4, 120, 150)]
    r = run(spark, "oracle", "O74", {"sysmetric": [
        {"instance_number": 1, "snap_id": 4, "metric_name": "Logons Per Sec", "average": 2.0, "maxval": 9.0},
        {"instance_number": 1, "snap_id": 4, "metric_name": "Logons Per Sec", "average": 4.0, "maxval": 5.0}]})
    assert [(x.logons_max, x.logons_avg) for x in r] == [(9.0, 3.0)]
    r = run(spark, "mysql", "M01", {"variables": [st("version", "8.0.36"), st("innodb_buffer_pool_size", 2 * 1024 * MB)],
                                    "status": [st("Uptime", 172800)]})
    assert [(x.version, x.buffer_pool_mb, x.uptime_days) for x in r] == [("8.0.36", 2048.0, 2.0)]
    r = run(spark, "mysql", "M18", {"tables": [{"table_schema": "a", "table_name": "t", "storage_engine": "InnoDB",
                                                "data_length": MB, "index_length": MB},
                                               {"table_schema": "a", "table_name": "u", "storage_engine": "InnoDB",
                                                "data_length": MB, "index_length": 0},
                                               {"table_schema": "mysql", "table_name": "x", "storage_engine": "InnoDB"}]})
    assert [(x.storage_engine, x.n_tables, x.total_mb) for x in r] == [("InnoDB", 2, 3.0)]
    r = run(spark, "postgres", "P02", {"settings": [{"name": "shared_buffers", "setting": "16384", "unit": "8kB"},
                                                    {"name": "search_path", "setting": "public"}]})
    assert [(x.name, x.display_value) for x in r] == [("shared_buffers", "16384 8kB")]
    r = run(spark, "sqlserver", "S03", {"sessions": [{"database_name": "d", "login_name": "l", "status": "sleeping"},
                                                     {"database_name": "d", "login_name": "l", "status": "sleeping"},
                                                     {"database_name": "d", "login_name": "l", "status": "running"}]})
    assert sorted((x.status, x.n_sessions) for x in r) == [("running", 1), ("sleeping", 2)]
    reg = run(spark, "report", "R02", {})
    assert len(reg) == len(base.REGISTRY) and {x.priority for x in reg} == {"high", "medium", "low"}
    tiers = {x.tier: x.n_checks for x in run(spark, "report", "R03", {})}
    assert sum(tiers.values()) == len(base.REGISTRY) and set(tiers) == {"weekly", "monthly", "quarterly"}


def test_host_memory_fallback_and_meminfo(spark):
    dump = "\n".join(["memusage", "93.5", "", "swapusage", "0", "", "meminfo", "MemTotal:       16318412 kB",
                      "HugePages_Total:       0", "", "thp", "always madvise [never]", ""])
    r = run(spark, "host", "H04", {"os_text": [{"path": "p", "text": dump}]})
    assert [(x.mem_used_pct, x.swap_used_pct, x.is_abnormal) for x in r] == [(93.5, 0.0, True)]
    r = run(spark, "host", "H06", {"os_text": [{"path": "p", "text": dump}]})
    assert sorted((x.mi_name, x.mi_kb) for x in r if x.section == "meminfo") == [("HugePages_Total", 0),
                                                                               ("MemTotal", 16318412)]
    assert not any(x.is_abnormal for x in r)


PROJECTIONS = [
    ("O01", "oracle", {"database": [{"dbid": 1, "name": "P", "database_role": "PRIMARY", "open_mode": "READ WRITE"}]},
     "name", ["P"]),
    ("O12", "oracle", {"version_banner": [{"banner": "Oracle Database 19c"}]}, "banner", ["Oracle Database 19c"]),
    ("O14", "oracle", {"patches": [{"patch_id": 1, "action": "APPLY"}, {"patch_id": 2, "action": "ROLLBACK"}]},
     "patch_id", [1, 2]),
    ("O37", "oracle", {"settings": [{"inst_id": 1, "name": "db_recovery_file_dest_size", "value": "10", "unit": "G"},
                                    {"inst_id": 1, "name": "processes", "value": "300"}]}, "display_value", ["10 G"]),
    ("O38", "oracle", {"database": [{"log_mode": "ARCHIVELOG", "flashback_on": "NO"}]}, "flashback_on", ["NO"]),
    ("O46", "oracle", {"directories": [{"owner": "SYS", "directory_name": "DP", "directory_path": "/u01/dp"}]},
     "directory_path", ["/u01/dp"]),
    ("O50", "oracle", {"db_links": [{"owner": "APP", "db_link": "REMOTE", "host": "h"}]}, "db_link", ["REMOTE"]),
    ("O52", "oracle", {"autotask_windows": [{"window_name": "MON", "optimizer_stats": "ENABLED"},
                                            {"window_name": "TUE", "optimizer_stats": "DISABLED"}]},
     "window_name", ["MON"]),
    ("O60", "oracle", {"asm_clients": [{"group_number": 1, "instance_name": "+ASM1", "db_name": "P", "status": "CONNECTED"}]},
     "db_name", ["P"]),
    ("M45", "mysql", {"binlog_events": [{"event_name": "Write_rows", "count_star": 3, "sum_number_of_bytes": 2 * MB}],
                      "variables": [st("max_binlog_size", 1024)]}, "mb", [2.0]),
    ("P07", "postgres", {"tablespaces": [{"spcname": "pg_default", "size_bytes": 2048}]}, "size", ["2048 bytes"]),
    ("P18", "postgres", {"extensions": [{"extname": "pg_stat_statements", "extversion": "1.10"}]},
     "extname", ["pg_stat_statements"]),
    ("H01", "host", {"os_text": [{"path": "p", "text": "kernel\n5.14\n\nosversion\nRHEL 9\n"}]}, "line", ["5.14", "RHEL 9"]),
    ("H09", "host", {"os_text": [{"path": "p", "text": "patches\n35643107;DB RU 19.21\n\nkernel\n5.14\n"}]},
     "line", ["35643107;DB RU 19.21"]),
]


def test_projection_checks(spark):
    for cid, engine, views, col, want in PROJECTIONS:
        got = sorted(r[col] for r in run(spark, engine, cid, views))
        assert got == sorted(want), cid

"""The container beside the instance: filters, rows of each container, joins within it, roll-ups of the nested key."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_checks_literal import AS_OF, ctx, run, view

from fleetcheck.operators import shapes
from fleetcheck.plans.checks import base

E = "oracle"


def of(spark, name, *data):
    return view(spark, E, name, [{"instance_id": "a", **r} for r in data])


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def in_each(row, key="con_id", values=(1, 2, 3, 4, None)):
    return [{**row, key: v} for v in values]


def test_rows_of_each_container_and_none_of_the_root(spark):
    users = [{"username": "APP", "oracle_maintained": "N", "account_status": "OPEN", "default_tablespace": "USERS", "expiry_ts": dt.datetime(2024, 2, 2), "profile": "P"}]
    views = {
        "objects": of(spark, "objects", *in_each({"owner": "APP", "object_name": "V", "object_type": "VIEW", "status": "INVALID", "oracle_maintained": "N"})),
        "tablespaces": of(spark, "tablespaces", *in_each({"tablespace_name": "USERS", "contents": "PERMANENT", "total_bytes": 100, "used_bytes": 95})),
        "users": of(spark, "users", *in_each(users[0])),
        "sequences": of(spark, "sequences", *in_each({"sequence_owner": "APP", "sequence_name": "S", "last_number": Decimal(9), "max_value": Decimal(10), "cycle_flag": "N"})),
        "registry": of(spark, "registry", *in_each({"comp_id": "JAVA", "status": "INVALID"})),
        "db_links": of(spark, "db_links", *in_each({"owner": "APP", "db_link": "L"})),
        "directories": of(spark, "directories", *in_each({"owner": "SYS", "directory_name": "D"})),
        "jobs": of(spark, "jobs", *in_each({"job": 1, "broken": "Y"})),
        "autotask_clients": of(spark, "autotask_clients", *in_each({"client_name": "sql tuning advisor", "status": "ENABLED"})),
        "datapump_jobs": of(spark, "datapump_jobs", *in_each({"owner_name": "APP", "job_name": "J", "state": "EXECUTING"}), {"job_name": "BIN$x", "state": "EXECUTING", "con_id": 3}),
    }
    c = ctx(spark, E, views)
    for check in ("O21", "O22", "O26", "O13", "O50", "O46", "O47", "O51", "O58", "O40"):
        assert [r[0] for r in got(run(c, check), "con_id")] == [0, 3, 4], check


def test_members_are_found_in_their_own_container(spark):
    users = [{"username": "APP", "oracle_maintained": "N", "account_status": "OPEN", "con_id": 3, "profile": "P"},
             {"username": "APP", "oracle_maintained": "N", "account_status": "LOCKED", "con_id": 4, "profile": "P"},
             {"username": "DEV", "oracle_maintained": "Y", "account_status": "OPEN", "con_id": 4, "profile": "Q"}]
    views = {"users": of(spark, "users", *users),
             "segments": of(spark, "segments", *[{"owner": o, "segment_name": "T", "segment_type": "TABLE", "tablespace_name": "SYSTEM", "con_id": c} for o in ("APP", "DEV") for c in (3, 4, 5)]),
             "role_privs": of(spark, "role_privs", *[{"grantee": "APP", "granted_role": "DBA", "con_id": c} for c in (3, 4)]),
             "profiles": of(spark, "profiles", *[{"profile": p, "resource_name": "IDLE_TIME", "limit_value": "5", "con_id": c} for p in "PQ" for c in (3, 4)]),
             "objects": of(spark, "objects", *[{"owner": "APP", "object_name": f"T{c}", "object_type": "TABLE", "status": "VALID", "con_id": c} for c in (3, 3, 4, 1)])}
    c = ctx(spark, E, views)
    assert got(run(c, "O32"), "con_id", "owner") == [(3, "APP"), (4, "APP")]
    assert got(run(c, "O41"), "con_id", "grantee") == [(3, "APP")]
    assert got(run(c, "O45"), "con_id", "profile") == [(3, "P"), (4, "Q")]
    assert got(run(c, "O43"), "con_id", "owner", "n_tables") == [(3, "APP", 2), (4, "APP", 1)]


def test_findings_name_the_container(spark):
    views = {"tablespaces": of(spark, "tablespaces", *in_each({"tablespace_name": "USERS", "contents": "PERMANENT", "total_bytes": 100, "used_bytes": 95}))}
    f = base.run_findings(base.Ctx(spark, views, F.lit(AS_OF).cast("timestamp")), E, ids=["O22"])
    assert sorted(r["object_key"] for r in f.collect()) == ["3|USERS", "4|USERS", "USERS"]


def test_totals_of_containers_and_of_the_instance(spark):
    gb = 1 << 30
    views = {"data_files": of(spark, "data_files", *[{"tablespace_name": "U", "bytes": gb, "con_id": c} for c in (1, 3, 3, 4)]),
             "temp_files": of(spark, "temp_files", {"bytes": 2 * gb, "con_id": 4}), "tablespaces": of(spark, "tablespaces", {"used_bytes": gb, "con_id": 3})}
    assert got(run(ctx(spark, E, views), "O24"), "con_id", "physical_gb", "temp_gb", "used_gb") == sorted(
        [(None, 3.0, 2.0, 1.0), (3, 2.0, None, 1.0), (4, 1.0, 2.0, None)], key=repr)


def test_growth_is_of_each_container(spark):
    hist = [{"tablespace_id": 1, "snap_id": d, "block_size": 1, "rtime": f"01/{d}/2024 10:00:00", "tablespace_size": 100, "tablespace_usedsize": u, "con_id": c}
            for d, u in ((27, 10), (28, 30)) for c in (1, 3, 4)]
    views = {"tablespace_usage_hist": of(spark, "tablespace_usage_hist", *hist), "instance": of(spark, "instance", {"startup_ts": dt.datetime(2024, 1, 1)})}
    assert got(run(ctx(spark, E, views), "O25"), "con_id", "day", "total", "growth") == sorted(
        [(c, d, t, g) for c in (3, 4) for d, t, g in (("2024-01-27", 10, None), ("2024-01-28", 30, 20))], key=repr)


def test_job_errors_have_run_details(spark):
    at = lambda h: dt.datetime(2024, 1, 30, h)
    log = [{"owner": "APP", "job_name": "J", "log_id": i, "status": "FAILED", "log_ts": at(1 if i < 3 else i), "con_id": 3, "error": 0} for i in range(6)]
    log += [{"owner": "SYS", "job_name": "ORA$AT_OS_OPT_SY_12", "log_id": 50, "status": "FAILED", "log_ts": at(2), "con_id": 3}]
    views = {"job_log": of(spark, "job_log", *log),
             "job_run_details": of(spark, "job_run_details", {"log_id": 5, "run_duration_s": 7, "error": 942, "additional_info": "no table"})}
    assert got(run(ctx(spark, E, views), "O49"), "log_id", "error", "run_duration_s", "additional_info") == sorted(
        [(5, 942, 7, "no table"), (4, None, None, None), (3, None, None, None)], key=repr)
    tied = [r for r in log if r["log_id"] < 3]  # three at one instant: the later entries are the newer ones
    assert got(run(ctx(spark, E, {"job_log": of(spark, "job_log", *tied)}), "O49"), "log_id", "rnk") == [(0, 3), (1, 2), (2, 1)]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_nested_rollup_equals_brute_force(spark, levels):
    rows = [("a", 1, None, 5), ("a", 1, 2, 7), ("a", None, 2, 1), ("b", 3, 3, 2), (None, 3, 3, 4), ("a", 1, 2, 9)]
    keys = ["i", "c", "n"][:levels]
    out = shapes.nested_rollup(spark.createDataFrame(rows, "i string, c int, n int, v bigint"), keys, {"s": F.sum("v"), "k": F.count("*"), "m": F.max("v")}, {"m": "max"})
    want = {}
    for r in rows:
        for depth in range(1, levels + 1):
            key = r[:depth] + (None,) * (levels - depth) + (depth,)
            s, k, m = want.get(key, (0, 0, 0))
            want[key] = (s + r[3], k + 1, max(m, r[3]))
    assert {tuple(r)[:levels + 1]: tuple(r)[levels + 1:] for r in out.collect()} == want

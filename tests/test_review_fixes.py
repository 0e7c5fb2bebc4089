"""Rows that a review of the first round measured as wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetcheck.functions import fround
from fleetcheck.operators import ranking, verdict

from test_checks_literal import by, ctx, run, view

T = dt.datetime


@pytest.mark.parametrize("x,digits,want", [(1e17, 2, 1e17), (1e13, 6, 1e13), (-2.5, 0, -3.0), (2.5, 0, 3.0), (-0.125, 2, -0.13),
                                           (0.0, 2, 0.0), (None, 2, None)])
def test_fround(spark, x, digits, want):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(fround("x", digits)).first()[0] == want


def test_topn_keeps_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 1)], "k int, v int")
    for fn, want in (("rank", 3), ("dense_rank", 4), ("row_number", 2)):
        assert ranking.topn(df, [F.col("v").desc()], 2, fn=fn).count() == want


def test_config_audit_with_a_reference_that_is_no_number(spark):
    s = spark.createDataFrame([("i", "cap", "9"), ("i", "cpus", "many"), ("j", "cap", "9"), ("j", "cpus", "2")], "instance_id string, name string, value string")
    out = verdict.config_audit(s, [("cap", "gt", None, "cpus", 4.0, "x")], ["instance_id"])
    assert {r["instance_id"]: r["is_abnormal"] for r in out.collect()} == {"i": False, "j": True}


def test_sqlserver(spark):
    e = "sqlserver"
    late = "x" * 400 + " Severity: 20"
    c = ctx(spark, e, {
        "databases": view(spark, e, "databases", [{"instance_id": "s", "database_name": n, "database_id": i, "state": st}
                                                  for n, i, st in (("old", 5, "ONLINE"), ("new", 6, "ONLINE"), ("msdb", 4, "ONLINE"), ("off", 7, "OFFLINE"))]),
        "backups": view(spark, e, "backups", [
            {"instance_id": "s", "database_name": "old", "type": "D", "start_ts": T(2020, 1, 1), "finish_ts": T(2020, 1, 1)},
            {"instance_id": "s", "database_name": "new", "type": "D", "start_ts": T(2024, 1, 29), "finish_ts": T(2024, 1, 29)}]),
        "error_log": view(spark, e, "error_log", [{"instance_id": "s", "log_ts": T(2024, 1, 30), "text": late},
                                                  {"instance_id": "s", "log_ts": T(2024, 1, 29), "text": "fine"}])})
    assert {(r["database_name"], r["is_abnormal"]) for r in run(c, "S10").collect()} == {("old", True), ("new", False)}
    assert [(len(r["text300"]), r["is_abnormal"]) for r in sorted(run(c, "S22").collect(), key=lambda r: r["rn"])] == [(300, True), (4, False)]


def test_mysql(spark):
    e = "mysql"
    var = lambda d: view(spark, e, "variables", [{"instance_id": "m", "name": k, "value": v} for k, v in d.items()])
    users = view(spark, e, "users", [
        {"instance_id": "m", "user": "app", "host": "%", "password_last_changed": T(2024, 1, 30), "account_locked": "N"},
        {"instance_id": "m", "user": "locked", "host": "%", "password_last_changed": T(2020, 1, 1), "account_locked": "Y"},
        {"instance_id": "m", "user": "mysql.sys", "host": "localhost", "account_locked": "Y"}])
    c = ctx(spark, e, {"users": users, "variables": var({"default_password_lifetime": "0"})})
    assert by(run(c, "M37"), "user", "is_abnormal") == {("app",): False, ("locked",): True, ("(global)",): True}
    c = ctx(spark, e, {"variables": var({"innodb_redo_log_capacity": "0", "innodb_log_file_size": str(1 << 30), "innodb_log_files_in_group": "2"})})
    assert [(r["redo_mb"], r["is_abnormal"]) for r in run(c, "M35").collect()] == [(2048.0, False)]


def test_postgres(spark):
    e = "postgres"
    c = ctx(spark, e, {"bgwriter": view(spark, e, "bgwriter", [{"instance_id": "p", "checkpoints_timed": 0, "checkpoints_req": 3, "maxwritten_clean": 0}])})
    assert run(c, "P20").first()["is_abnormal"] is False
    c = ctx(spark, e, {"tables": view(spark, e, "tables", [{"instance_id": "p", "schemaname": "s", "relname": "t", "relkind": "r", "relpages": 100, "reltuples": 10.0}]),
                       "column_stats": view(spark, e, "column_stats", [])})
    assert [r["relname"] for r in run(c, "P13").collect()] == ["t"]


def test_oracle_segments(spark):
    e = "oracle"
    c = ctx(spark, e, {"segments": view(spark, e, "segments", [
        {"instance_id": "o", "owner": "SYS", "segment_name": "AUD$", "segment_type": "TABLE", "tablespace_name": "SYSTEM", "bytes": 1 << 40},
        {"instance_id": "o", "owner": "APP", "segment_name": "T", "segment_type": "TABLE", "tablespace_name": "USERS", "bytes": 1 << 40}])})
    assert [r["segment_name"] for r in run(c, "O28").collect()] == ["T"]


def test_oracle_owners_without_flag(spark):
    """Versions whose views have no oracle_maintained: system schemas go by name."""
    e = "oracle"
    objects = [{"instance_id": "o", "owner": o, "object_type": "VIEW", "object_name": f"V{i}", "status": "INVALID"}
               for o in ("APP", "SYS") for i in range(60)]
    users = [{"instance_id": "o", "username": u, "account_status": "OPEN"} for u in ("APP", "SYS", "OUTLN")]
    c = ctx(spark, e, {"objects": view(spark, e, "objects", objects), "users": view(spark, e, "users", users),
                       "database": view(spark, e, "database", [{"instance_id": "o"}])})
    assert [(r["owner"], r["n_invalid"], r["is_abnormal"]) for r in run(c, "O21").collect()] == [("APP", 60, True)]
    assert [r["username"] for r in run(c, "O42").collect()] == ["APP"]
    assert [(r["owner"], r["n_invalid"]) for r in run(c, "O43").collect()] == [("APP", 60)]


def test_summary_has_a_line_for_every_check_that_was_due(spark, tmp_path):
    from fleetcheck.plans import fleet
    from fleetcheck.plans.checks import base
    e = "oracle"
    views = {"tablespaces": view(spark, e, "tablespaces", [
                 {"instance_id": "a", "tablespace_name": "USERS", "contents": "PERMANENT", "total_bytes": 100, "used_bytes": 95}]),
             "objects": view(spark, e, "objects", [{"instance_id": "a", "owner": "APP", "object_type": "VIEW", "status": "VALID"}])}

    @base.check("Z98", e, "fails_when_built", ["tablespaces"])
    def z98(ctx):
        raise ValueError("boom")

    try:
        _, s = fleet.fleet_summary(spark, {e: views}, fleet.as_of_ts("2024-01-31 00:00:00"),
                                   unreadable={e: {"users": "denied"}})
        got = {r["check_id"]: (r["status"], r["n_abnormal"], r["error"]) for r in s.collect()}
        assert got["O22"] == ("abnormal", 1, None) and got["O21"] == ("normal", 0, None)
        assert got["Z98"] == ("error", 0, "boom") and got["O40"] == ("error", 0, "users: denied")
    finally:
        base.REGISTRY.pop("Z98", None)
    (tmp_path / "oracle" / "tablespaces" / "snapshot_date=2024-01-30").mkdir(parents=True)
    (tmp_path / "oracle" / "tablespaces" / "snapshot_date=2024-01-30" / "part-0.parquet").write_bytes(b"not a parquet file")
    errors = {}
    assert fleet.load_views(spark, str(tmp_path), e, errors=errors) == {} and list(errors) == ["tablespaces"]


def test_text_parsers_do_not_shuffle(spark):
    from fleetcheck.plans import fixtures
    for key in ("os_section_parse", "html_table_extract"):
        plan = fixtures.QUERIES[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan

"""PostgreSQL checks P01-P24 (thin operator calls over PostgreSQL snapshot views)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import format_bytes, pct, seconds_between
from ...operators import capacity as cap
from ...operators import perf, ranking, relations, shapes, time, verdict
from .base import K, check

E = "postgres"
MB = 1024.0 * 1024
GIB = MB * 1024

# Instance settings shown with their unit.
INSTANCE_SETTINGS = ["max_connections", "shared_buffers", "effective_cache_size", "work_mem",
                     "maintenance_work_mem", "wal_level", "max_wal_size", "min_wal_size", "checkpoint_timeout",
                     "archive_mode", "archive_command", "autovacuum", "log_min_duration_statement",
                     "shared_preload_libraries"]
# System schemas.
SYSTEM_SCHEMAS = ["pg_catalog", "information_schema", "pg_toast"]
SUPERUSER_OK = ["postgres"]


@check("P01", E, "scalars", ["facts"])
def p01(ctx):
    f = verdict.status_wide(ctx.cur("facts"), K, {
        "version": "version", "host": "host", "hostname": "hostname", "listen_address": "listen_addresses",
        "port": "port", "data_directory": "data_directory", "start_time": "postmaster_start_time",
        "timezone": "timezone", "server_encoding": "server_encoding", "max_connections": "max_connections",
        "current_connections": "current_connections", "db_count": "db_count", "total_size": "total_size_bytes"},
        cast="string")
    start = F.try_to_timestamp("start_time")
    up = seconds_between(start, ctx.as_of)
    return (f.withColumn("host", F.coalesce("host", "hostname", "listen_address"))
             .withColumn("uptime_days", F.floor(up / 86400)).withColumn("uptime_hours", F.floor(up % 86400 / 3600))
             .withColumn("uptime_minutes", F.floor(up % 3600 / 60))
             .withColumn("total_size_pretty", format_bytes("total_size")))


@check("P02", E, "instance_info", ["settings"])
def p02(ctx):
    return verdict.settings_select(ctx.cur("settings"), INSTANCE_SETTINGS, value_col="setting", unit_col="unit")


@check("P03", E, "database_detail", ["databases"], key=("datname",), metric="age_xid", threshold=1e9)
def p03(ctx):
    d = ctx.cur("databases").withColumn("size_pretty", format_bytes("size_bytes"))
    return verdict.threshold_flag(d, "age_xid", 1e9, ">")


@check("P04", E, "object_count", ["objects", "functions"])
def p04(ctx):
    o = ctx.cur("objects").filter(~F.col("schemaname").isin(SYSTEM_SCHEMAS) & ~F.col("schemaname").startswith("pg_temp_"))
    fn = ctx.cur("functions").filter(~F.col("schemaname").isin(SYSTEM_SCHEMAS))
    schemas = o.select(*K, "schemaname").unionByName(fn.select(*K, "schemaname")).distinct()
    k = F.col("relkind")
    return shapes.object_matrix(schemas, [*K, "schemaname"], {
        "n_tables": (o, k.isin("r", "p")), "n_indexes": (o, k == "i"), "n_sequences": (o, k == "S"),
        "n_views": (o, k.isin("v", "m")), "n_functions": (fn, None)})


@check("P05", E, "table_age", ["tables"], key=("schemaname", "relname"), metric="age_xid", threshold=5e8)
def p05(ctx):
    t = ctx.cur("tables").filter(F.col("relkind").isin("r", "m", "t"))
    top = ranking.topn(t, [F.col("age_xid").desc(), F.col("schemaname").asc(), F.col("relname").asc()], 30, K)
    return verdict.threshold_flag(top, "age_xid", 5e8, ">")


@check("P06", E, "top_tables_by_size", ["tables"], key=("schemaname", "relname"), metric="size_bytes",
       threshold=10 * GIB)
def p06(ctx):
    t = ctx.cur("tables").filter(~F.col("schemaname").isin(SYSTEM_SCHEMAS)).withColumn("size_pretty",
                                                                                      format_bytes("size_bytes"))
    top = ranking.topn(t, [F.col("size_bytes").desc(), F.col("schemaname").asc(), F.col("relname").asc()], 20, K)
    return verdict.threshold_flag(top, "size_bytes", 10 * GIB, ">")


@check("P07", E, "tablespace_usage", ["tablespaces"])
def p07(ctx):
    return ctx.cur("tablespaces").select(*K, "spcname", "location", "owner", format_bytes("size_bytes").alias("size"),
                                         "size_bytes")


@check("P08", E, "connection_count", ["activity"])
def p08(ctx):
    a = ctx.cur("activity").filter(F.col("backend_type") == "client backend")
    return shapes.group_total_sets(a, ["state", "datname"], [F.count("*").alias("n_connections")],
                                   labels={"state": "total", "datname": "all"}, outer=K)


@check("P09", E, "slow_query", ["activity"], key=("pid",), metric="elapsed_s", threshold=300)
def p09(ctx):
    a = ctx.cur("activity").filter(F.col("state") == "active")
    return time.long_running(a, "query_start", ctx.as_of, 60, 300)


@check("P10", E, "vacuum_status", ["tables"], key=("schemaname", "relname"), metric="n_dead_tup")
def p10(ctx):
    t = ctx.cur("tables").filter(F.col("n_dead_tup") > 0)
    t = t.withColumn("last_vac", F.greatest("last_vacuum_ts", "last_autovacuum_ts"))
    t = time.age_flag(t, "last_vac", ctx.as_of, 7)
    t = t.withColumn("is_abnormal", (F.col("n_dead_tup") > 10000) & F.col("is_abnormal"))
    return ranking.topn(t, [F.col("n_dead_tup").desc(), F.col("schemaname").asc(), F.col("relname").asc()], 50, K)


@check("P11", E, "replication", ["replication"], key=("client_addr", "application_name"), metric="lag_bytes",
       threshold=10 * MB)
def p11(ctx):
    r = perf.position_lag(ctx.cur("replication"), "sent_lsn", "replay_lsn")
    return verdict.threshold_flag(r.withColumn("lag_bytes", F.col("lag_bytes").cast("double")), "lag_bytes", 10 * MB, ">")


@check("P12", E, "wal_archive", ["archiver"], metric="failed_count")
def p12(ctx):
    a = ctx.cur("archiver")
    recent = F.col("last_failed_ts") >= ctx.as_of - F.expr("INTERVAL 24 HOURS")
    return a.withColumn("is_abnormal", F.coalesce((F.col("failed_count") > 0) | recent, F.lit(False)))


@check("P13", E, "bloat_tables", ["tables", "column_stats"], key=("schemaname", "relname"), metric="bloat_pct",
       threshold=40)
def p13(ctx):
    """Pages that tables should need. ``bloat_model="layout"`` counts the tuples' layout only, as the reference does, and so
    takes a table of wide rows for bloated; the default adds the mean widths of the columns' values."""
    if ctx.p("bloat_model", "width") == "layout":
        t = ctx.cur("tables").filter(F.col("relkind") == "r")
        stats = ctx.cur("column_stats").withColumnRenamed("tablename", "relname")
        out = cap.layout_bloat(t, stats, [*K, "schemaname", "relname"], "reltuples", "relpages")
        return ranking.topn(out, [F.col("bloat_bytes").desc(), F.col("schemaname").asc(), F.col("relname").asc()], 50, K)
    cs = ctx.cur("column_stats").groupBy(*K, F.col("schemaname"), F.col("tablename").alias("relname")).agg(
        F.sum(F.col("avg_width") * (F.lit(1.0) - F.col("null_frac"))).alias("row_width"))
    t = ctx.cur("tables").filter((F.col("relkind") == "r") & (F.col("relpages") > 8)).join(
        cs, [*K, "schemaname", "relname"], "left").withColumn("row_width", F.coalesce("row_width", F.lit(0.0)))
    return cap.bloat_estimate(t, [*K, "schemaname", "relname"], "reltuples", "relpages", "row_width")


@check("P14", E, "index_usage", ["index_usage"], key=("schemaname", "relname", "indexrelname"))
def p14(ctx):
    i = ctx.cur("index_usage").filter(~F.col("is_unique") & ~F.col("is_primary"))
    i = i.withColumn("is_abnormal", F.col("idx_scan") == 0)
    return ranking.topn(i, [F.col("idx_scan").asc(), F.col("size_bytes").desc(), F.col("indexrelname").asc()], 50, K)


@check("P15", E, "lock_conflicts", ["locks", "activity"], key=("waiter",), priority="high")
def p15(ctx):
    keys = ["locktype", "database", "relation", "page", "tuple", "virtualxid", "transactionid", "classid", "objid",
            "objsubid"]
    locks = ctx.cur("locks")
    b = relations.blocking_pairs(locks, [*K, *keys], "pid", F.col("granted"))
    act = ctx.cur("activity").select(*K, "pid", "usename", "query")
    w = act.select(*K, F.col("pid").alias("waiter"), F.col("usename").alias("waiter_user"),
                   F.col("query").alias("waiter_query"))
    h = act.select(*K, F.col("pid").alias("first_holder"), F.col("usename").alias("holder_user"),
                   F.col("query").alias("holder_query"))
    return b.join(w, [*K, "waiter"], "left").join(h, [*K, "first_holder"], "left").withColumn("is_abnormal", F.lit(True))


@check("P16", E, "backup_status", ["archiver"])
def p16(ctx):
    return ctx.cur("archiver").withColumn("is_abnormal", F.coalesce(F.col("failed_count") > 0, F.lit(False)))


@check("P17", E, "db_size", ["databases"], key=("datname",), metric="size_bytes", threshold=100 * GIB)
def p17(ctx):
    d = ctx.cur("databases").withColumn("size_pretty", format_bytes("size_bytes"))
    return verdict.threshold_flag(d, "size_bytes", 100 * GIB, ">")


@check("P18", E, "extension_list", ["extensions"])
def p18(ctx):
    return ctx.cur("extensions").select(*K, "extname", "extversion", "schema", "description")


@check("P19", E, "cache_hit_ratio", ["database_stats"], key=("datname",), metric="hit_pct", threshold=95)
def p19(ctx):
    # templates are no one's databases, nor are the statistics of shared objects; a database that read nothing misses nothing
    d = ctx.cur("database_stats").filter(~F.col("datname").like("template%"))
    d = d.withColumn("total", F.col("blks_read") + F.col("blks_hit"))
    hit = F.when(F.col("total") == 0, F.lit(100.0)).otherwise(perf.hit_ratio("blks_read", "total"))
    return perf.ratio_kpi(d, {"hit_pct": hit}, red_below=95)


@check("P20", E, "bgwriter_stats", ["bgwriter"])
def p20(ctx):
    b = ctx.cur("bgwriter").withColumn("timed", F.coalesce("num_timed", "checkpoints_timed")) \
        .withColumn("requested", F.coalesce("num_requested", "checkpoints_req"))
    bad = ((F.col("timed") > 0) & (F.col("requested") > F.col("timed"))) | (F.col("maxwritten_clean") > 0)
    return b.withColumn("is_abnormal", F.coalesce(bad, F.lit(False)))


@check("P21", E, "user_roles", ["roles"], key=("rolname",), priority="high")
def p21(ctx):
    r = ctx.cur("roles")
    r = verdict.role_matrix(r, {"rolsuper": "superuser", "rolcreatedb": "create_db", "rolcreaterole": "create_role",
                                "rolcanlogin": "can_login", "rolreplication": "replication"},
                            unexpected=F.col("rolsuper") & ~F.col("rolname").isin(SUPERUSER_OK))
    expired = F.col("rolvaliduntil") < ctx.as_of
    return r.withColumn("is_abnormal", F.col("is_abnormal") | F.coalesce(expired, F.lit(False)))


@check("P22", E, "pg_hba_rules", ["hba_rules"], key=("line_number",), priority="high")
def p22(ctx):
    h = ctx.cur("hba_rules").select(*K, "line_number", "type", F.array_join("database", ",").alias("database"),
                                    F.array_join("user_name", ",").alias("user_name"), "address", "auth_method")
    return h.withColumn("is_abnormal", F.coalesce(F.col("auth_method") == "trust", F.lit(False)))


@check("P23", E, "unused_indexes_detail", ["index_usage"], key=("schemaname", "relname", "indexrelname"),
       metric="size_bytes", threshold=MB)
def p23(ctx):
    i = ctx.cur("index_usage").filter((F.col("idx_scan") == 0) & ~F.col("is_primary") & ~F.col("is_unique"))
    i = i.withColumn("size_pretty", format_bytes("size_bytes"))
    top = ranking.topn(i, [F.col("size_bytes").desc(), F.col("indexrelname").asc()], 50, K)
    return verdict.threshold_flag(top, "size_bytes", MB, ">")


@check("P24", E, "database_stats", ["database_stats"], key=("datname",), metric="deadlocks", threshold=0)
def p24(ctx):
    d = ctx.cur("database_stats").withColumn("commit_pct", pct("xact_commit", F.col("xact_commit") + F.col("xact_rollback")))
    return verdict.threshold_flag(d, "deadlocks", 0, ">")

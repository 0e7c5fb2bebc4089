"""Oracle checks O01-O77 (thin operator calls over Oracle snapshot views)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import days_between, decode_date_bytes, fround, interval_minutes, pct, safe_div, seconds_between
from ...operators import capacity as cap
from ...operators import perf, ranking, relations, shapes, time, verdict
from .base import K, check

E = "oracle"
MB = 1024.0 * 1024
GB = MB * 1024

# Parameter audit rules (name, kind, expected, ref, factor, advice).
PARAMETER_RULES = [
    ("processes", "lt", "500", None, None, "Raise processes to 500 or more before connections are refused."),
    ("sessions", "lt", "500", None, None, "Allow at least 500 sessions."),
    ("db_files", "lt", "500", None, None, "Leave room for growth: allow 500 data files or more."),
    ("spfile", "is_null", None, None, None, "Create a server parameter file and restart with it, so changes persist."),
    ("optimizer_adaptive_features", "eq", "TRUE", None, None, "Switch adaptive optimisation off where steady execution plans matter."),
    ("optimizer_adaptive_plans", "eq", "TRUE", None, None, "Fix plans at parse time: set adaptive plans to FALSE."),
    ("optimizer_adaptive_statistics", "eq", "TRUE", None, None, "Set adaptive statistics to FALSE to keep estimates stable."),
    ("_optimizer_use_feedback", "eq", "TRUE", None, None, "Set cardinality feedback to FALSE if a second execution must not differ."),
    ("max_string_size", "eq", "STANDARD", None, None, "Use EXTENDED if columns over 4000 bytes are needed (one-way change)."),
    ("statistics_level", "ne", "TYPICAL", None, None, "Set TYPICAL: less loses advisors, more costs time."),
    ("control_file_record_keep_time", "lt", "10", None, None, "Keep records for 10 days or longer than the backup cycle."),
    ("_use_adaptive_log_file_sync", "ne", "FALSE", None, None, "Set FALSE, so that commits always wait by post and not by polling."),
    ("fast_start_parallel_rollback", "eq", "HIGH", None, None, "Choose LOW or FALSE, so that recovery leaves CPU to users."),
    ("_datafile_write_errors_crash_instance", "ne", "FALSE", None, None,
     "Set FALSE, so that one failed write takes the file offline and not the database."),
    ("max_dump_file_size", "eq", "unlimited", None, None, "Give trace files a size limit to protect the disk."),
    ("parallel_max_servers", "gt", None, "cpu_count", 4.0, "Lower the parallel servers to four for each CPU."),
    ("deferred_segment_creation", "eq", "TRUE", None, None, "Set FALSE, so that empty tables own a segment and old exports see them."),
]
# Resources whose limits are checked.
LIMITED = ["processes", "sessions", "transactions", "parallel_max_servers", "dml_locks", "max_rollback_segments",
           "max_shared_servers"]
# Tablespaces whose segments are not user data.
SYSTEM_TABLESPACES = ["SYSTEM", "SYSAUX"]
# Schemas that come with the DBMS, for versions whose views do not say so.
SYSTEM_OWNERS = [
    "ANONYMOUS", "APEX_030200", "APEX_040000", "APEX_040200", "APEX_PUBLIC_USER", "APPQOSSYS", "AUDSYS", "AURORA$JIS$UTILITY$",
    "AURORA$ORB$UNAUTHENTICATED", "BI", "CTXSYS", "DBSFWUSER", "DBSNMP", "DIP", "DMSYS", "DVF", "DVSYS", "EXFSYS", "FLOWS_030000",
    "FLOWS_FILES", "GGSYS", "GSMADMIN_INTERNAL", "GSMCATUSER", "GSMUSER", "HR", "IX", "LBACSYS", "MDDATA", "MDSYS", "MGMT_VIEW",
    "OE", "OJVMSYS", "OLAPSYS", "ORACLE_OCM", "ORDDATA", "ORDPLUGINS", "ORDSYS", "OSE$HTTP$ADMIN", "OUTLN", "OWBSYS", "OWBSYS_AUDIT",
    "PERFSTAT", "PM", "PUBLIC", "REMOTE_SCHEDULER_AGENT", "SCOTT", "SH", "SI_INFORMTN_SCHEMA", "SPATIAL_CSW_ADMIN_USR",
    "SPATIAL_WFS_ADMIN_USR", "SYS", "SYS$UMF", "SYSBACKUP", "SYSDG", "SYSKM", "SYSMAN", "SYSRAC", "SYSTEM", "TRACESVR", "TSMSYS",
    "WK_TEST", "WKPROXY", "WKSYS", "WMSYS", "XDB", "XS$NULL"]
# Known-malicious object name patterns.
RANSOM_PATTERNS = [("core", "DBMS_CORE_INTERNA%"), ("system", "DBMS_SYSTEM_INTERNA%"),
                   ("support", "DBMS_SUPPORT_INTERNA%")]
# Third-party replication / monitoring markers (role or user LIKE).
THIRD_PARTY = [("goldengate", "GGS_GGSUSER_ROLE"), ("goldengate", "GOLDENGATE"), ("shareplex", "SPLEX%"),
               ("maxgauge", "MAXGAUGE%")]
# Powerful roles reported for open users; DBA is red except for these grantees.
SYSTEM_ROLES = ["DBA", "SYSDBA", "IMP_FULL_DATABASE", "EXP_FULL_DATABASE", "DATAPUMP_IMP_FULL_DATABASE",
                "DATAPUMP_EXP_FULL_DATABASE"]
DBA_ALLOWED = ["SYS", "SYSTEM"]
# Profile limits that are never red, and resources exempt from the check.
PROFILE_OK_LIMITS = ["UNLIMITED", "DEFAULT", "NULL", "VERIFY_FUNCTION_11G", "ORA12C_STRONG_VERIFY_FUNCTION",
                     "ORA_STIG_PROFILE"]
PROFILE_EXEMPT = ["FAILED_LOGIN_ATTEMPTS", "PASSWORD_GRACE_TIME", "PASSWORD_LOCK_TIME"]
# Load-profile statistics (per second) and the two red ones.
LOAD_STATS = ["redo size", "session logical reads", "db block changes", "physical reads", "physical writes",
              "user calls", "parse count (total)", "parse count (hard)", "sorts (memory)", "sorts (disk)",
              "logons cumulative", "execute count", "user commits", "user rollbacks", "bytes sent via SQL*Net to client"]
# Lines of the load profile that are sums of two statistics.
LOAD_SUMS = {"sorts": ["sorts (memory)", "sorts (disk)"], "transactions": ["user commits", "user rollbacks"]}
LOAD_RED = {"parse count (hard)": 50.0, "logons cumulative": 50.0}


# The nested key of a container database's rows, and fixed values: the root and the seed, which are no one's containers.
C = [*K, "con_id"]
NO_CONTAINERS = [1, 2]


def _containers(ctx, view):
    """A view's rows in users' containers, ``con_id`` 0 where there are none (before 12c, or collected from one database)."""
    def build():
        df = ctx.cur(view)
        con = F.coalesce(F.col("con_id"), F.lit(0)) if "con_id" in df.columns else F.lit(0)
        return df.withColumn("con_id", con).filter(~F.col("con_id").isin(NO_CONTAINERS))
    return ctx.memo(f"containers:{view}", build)


def _since(ctx, days):
    return ctx.as_of - F.expr(f"INTERVAL {int(days)} DAYS")


@check("O01", E, "header_db", ["database"])
def o01(ctx):
    return ctx.cur("database").select(*K, "dbid", "name", "database_role", "open_mode")


@check("O02", E, "recyclebin_by_owner", ["recyclebin"])
def o02(ctx):
    rb = ctx.cur("recyclebin").withColumn("mb", F.col("space_blocks") * F.col("block_size") / MB)
    version = ctx.params.get("version")
    outer = K if version is not None and version <= 11 else [*K, "con_id"]  # 11g/10g: no container key
    return shapes.rollup_total(rb, outer, "owner",
                               [fround(F.sum("mb"), 2).alias("size_mb"), F.count("*").alias("n_objects")])


@check("O03", E, "environment", ["instance"])
def o03(ctx):
    inst = ctx.cur("instance")
    hosts = shapes.ordered_concat(inst, K, "host_name", distinct=True, out="hosts")
    names = shapes.ordered_concat(inst, K, "instance_name", distinct=True, out="instances")
    ver = inst.groupBy(*K).agg(F.max("version").alias("version"), F.min("startup_ts").alias("startup_ts"))
    return (ver.join(hosts, K).join(names, K)
               .withColumn("major_version", F.substring_index("version", ".", 1).try_cast("int")))


@check("O04", E, "database_scalars", ["database", "pdbs"])
def o04(ctx):
    pdbs = shapes.ordered_concat(ctx.cur("pdbs").filter(F.col("con_id") > 2), K, "name", out="pdbs")
    return ctx.cur("database").select(*K, "name", "log_mode").join(pdbs, K, "left")


@check("O05", E, "host_capacity", ["osstat"])
def o05(ctx):
    return verdict.status_wide(ctx.cur("osstat"), [*K, "inst_id"],
                               {"cpus": "NUM_CPUS", "cores": "NUM_CPU_CORES", "sockets": "NUM_CPU_SOCKETS",
                                "memory_bytes": "PHYSICAL_MEMORY_BYTES"}, name_col="stat_name", value_col="value")


@check("O06", E, "settings_scalars", ["settings"])
def o06(ctx):
    names = ["db_block_size", "cluster_database", "spfile", "db_create_file_dest", "memory_target", "sga_target",
             "sga_max_size", "pga_aggregate_target", "nls_characterset", "db_name"]
    return verdict.settings_select(ctx.cur("settings"), names, unit_col="unit").select(*K, "inst_id", "name",
                                                                                      "display_value")


@check("O07", E, "snapshot_pair", ["snapshots"])
def o07(ctx):
    return perf.snapshot_pair(ctx.cur("snapshots"), [*K, "instance_number"], "snap_id", "startup_ts")


@check("O08", E, "third_party", ["role_privs", "users"])
def o08(ctx):
    roles = ctx.cur("role_privs").select(*K, F.col("granted_role").alias("name"))
    users = ctx.cur("users").select(*K, F.col("username").alias("name"))
    u = relations.tagged_union({"role": roles, "user": users}, tag="kind")
    hits = relations.name_ioc(u.withColumn("name", F.upper("name")), "name", THIRD_PARTY, out="product")
    return hits.groupBy(*K, "product").agg(F.count("*").alias("n_markers")).withColumn("present", F.lit(True))


@check("O09", E, "files_redo_rate", ["archived_log", "data_files", "redo_logs"])
def o09(ctx):
    arch = (ctx.cur("archived_log").filter(F.col("first_ts") >= _since(ctx, 7))
            .groupBy(*K).agg(fround(F.sum(F.col("blocks") * F.col("block_size")) / MB / 168, 2).alias("redo_mb_per_hour")))
    files = ctx.cur("data_files").groupBy(*K).agg(F.count("*").alias("n_datafiles"))
    redo = ctx.cur("redo_logs").groupBy(*K).agg(F.min("bytes").alias("min_redo_bytes"),
                                                F.max("bytes").alias("max_redo_bytes"))
    return files.join(redo, K, "full").join(arch, K, "left")


@check("O10", E, "instance_info", ["instance"], key=("inst_id",), metric="uptime_days")
def o10(ctx):
    i = ctx.cur("instance").withColumn("uptime_days", days_between("startup_ts", ctx.as_of))
    return verdict.status_decode(i, "archiver", [("STARTED", "STARTED"), ("STOPPED", "STOPPED"),
                                                 ("FAILED", "FAILED")], bad=["FAILED"], label_col="archiver_label")


@check("O11", E, "base_info", ["database", "instance"])
def o11(ctx):
    i = ctx.cur("instance").groupBy(*K).agg(F.max("version").alias("version"), F.count("*").alias("n_instances"))
    return ctx.cur("database").select(*K, "dbid", "name", "log_mode", "platform_name", "created_ts").join(i, K, "left")


@check("O12", E, "version_banner", ["version_banner"])
def o12(ctx):
    return ctx.cur("version_banner").select(*K, "banner")


@check("O13", E, "components", ["registry"], key=("con_id", "comp_id"), priority="high")
def o13(ctx):
    return verdict.status_decode(_containers(ctx, "registry"), "status", [("VALID", "VALID")], good=["VALID"],
                                 default="NOT VALID")


@check("O14", E, "patch_history", ["patches"])
def o14(ctx):
    return _containers(ctx, "patches").select(*C, "action_ts", "action", "version", "patch_id", "comments")


# 10g-only rules — a cursor parameter x 0.8 below the largest
# per-session sum of its cursor statistics is red (value < 1.25 x that sum).
CURSOR_RULES_10G = [
    ("open_cursors", "lt", None, "_max_session_cursors", 1.25, "Open cursors may be too small."),
    ("session_cached_cursors", "lt", None, "_max_session_cached", 1.25, "Session cached cursors may be too small."),
]
CURSOR_STATS = {"_max_session_cursors": ["opened cursors current", "session cursor cache count"],
                "_max_session_cached": ["session cursor cache count"]}


def _cursor_aggregates(ctx):
    """Pseudo settings = max over sessions of the per-session sum (two groupBy
    levels: per session, then per instance)."""
    st = ctx.cur("sesstat")
    frames = []
    for name, stats in CURSOR_STATS.items():
        per_sid = (st.filter(F.col("stat_name").isin(stats)).groupBy(*K, "inst_id", "sid")
                     .agg(F.sum("value").alias("_s")))
        frames.append(per_sid.groupBy(*K, "inst_id").agg(F.max("_s").cast("string").alias("value"))
                             .withColumn("name", F.lit(name)))
    return frames[0].unionByName(frames[1])


@check("O15", E, "parameter_audit", ["settings"], key=("inst_id", "name"), priority="high")
def o15(ctx):
    s = ctx.cur("settings").select(*K, "inst_id", "name", "value")
    rules = list(PARAMETER_RULES)
    version = ctx.params.get("version")
    if "sesstat" in ctx.views and (version is None or version <= 10):
        s = s.unionByName(_cursor_aggregates(ctx))
        rules += CURSOR_RULES_10G
    return verdict.config_audit(s, rules, keys=[*K, "inst_id"]).filter(~F.col("name").startswith("_max_session"))


@check("O16", E, "resource_limit", ["resource_limit"], key=("inst_id", "resource_name"), metric="current_pct",
       priority="high")
def o16(ctx):
    r = ctx.cur("resource_limit").filter(F.col("resource_name").isin(LIMITED)).withColumn("limit_num", verdict.parse_limit("limit_value"))
    r = (r.withColumn("current_pct", pct("current_utilization", "limit_num"))
          .withColumn("max_pct", pct("max_utilization", "limit_num"))
          .withColumn("initial_num", F.trim("initial_allocation").try_cast("double")))
    bad = ((F.col("current_pct") > 80) | (F.col("max_pct") > 50)
           | (F.col("resource_name").isin("processes", "sessions") & (F.col("initial_num") < 500)))
    return r.withColumn("is_abnormal", F.coalesce(bad, F.lit(False)))


@check("O17", E, "control_files", ["controlfiles", "controlfile_records"], key=("name",), metric="size_mb")
def o17(ctx):
    big_sections = (ctx.cur("controlfile_records").filter(F.col("records_total") > 5000)
                    .groupBy(*K).agg(F.count("*").alias("big_sections")))
    cf = ctx.cur("controlfiles").withColumn("size_mb", F.col("block_size") * F.col("file_size_blks") / MB)
    cf = cf.join(big_sections, K, "left").withColumn("big_sections", F.coalesce("big_sections", F.lit(0)))
    return cf.withColumn("is_abnormal", (F.col("size_mb") > 512) | (F.col("big_sections") > 0))


@check("O18", E, "redo_logs", ["redo_logs"], key=("thread", "group_no", "member"), metric="size_mb")
def o18(ctx):
    r = ctx.cur("redo_logs").filter((F.col("type") == "ONLINE") & (F.col("status") != "UNUSED"))
    r = r.withColumn("size_mb", F.col("bytes") / MB)
    return verdict.threshold_flag(r, "size_mb", 100, "<=")


@check("O19", E, "redo_switch_matrix", ["log_history"], key=("thread", "day"), metric="total", threshold=1000)
def o19(ctx):
    return time.hour_matrix(ctx.cur("log_history"), "first_ts", [*K, "thread"], 100, 1000,
                            since=_since(ctx, 7), until=ctx.as_of)


@check("O20", E, "archive_per_day", ["archived_log"])
def o20(ctx):
    a = ctx.cur("archived_log").withColumn("gb", F.col("blocks") * F.col("block_size") / GB)
    return time.daily_volume(a, "first_ts", "gb", [*K, "thread"], since=_since(ctx, 10), until=ctx.as_of,
                             out="archive_gb")


def _user_owned(owner, flag="oracle_maintained"):
    """Rows of users' schemas: by the views' own flag, or by name where a version has no flag."""
    named = ~F.coalesce(F.col(owner).isin(SYSTEM_OWNERS), F.lit(False))
    return named if flag is None else F.coalesce(F.col(flag) == "N", named)


@check("O21", E, "invalid_objects", ["objects"], key=("con_id", "owner", "object_type"), metric="n_invalid", threshold=50)
def o21(ctx):
    o = _containers(ctx, "objects").filter((F.col("status") == "INVALID") & _user_owned("owner"))
    g = o.groupBy(*C, "owner", "object_type").agg(F.count("*").alias("n_invalid"))
    return verdict.threshold_flag(g, "n_invalid", 50, ">")


@check("O22", E, "tablespace_usage", ["tablespaces"], key=("con_id", "tablespace_name",), metric="used_pct", threshold=90,
       priority="high")
def o22(ctx):
    t = _containers(ctx, "tablespaces").withColumn("used_pct", pct("used_bytes", "total_bytes"))
    t = t.withColumn("total_gb", fround(F.col("total_bytes") / GB, 2)).withColumn(
        "used_gb", fround(F.col("used_bytes") / GB, 2)).withColumn(
        "free_gb", fround((F.col("total_bytes") - F.col("used_bytes")) / GB, 2))
    return verdict.threshold_flag(t, "used_pct", 90, ">=", when=F.col("contents") != "UNDO")


@check("O23", E, "tablespace_autoextend", ["data_files", "free_space"], key=("tablespace_name",),
       metric="used_of_max_pct", threshold=90, max_version=10)
def o23(ctx):
    f = ctx.cur("data_files").withColumn(
        "max_b", F.when(F.col("autoextensible") == "YES", F.greatest("bytes", "maxbytes")).otherwise(F.col("bytes")))
    return cap.capacity_autoextend(f, ctx.cur("free_space"), [*K, "tablespace_name"], "bytes", "max_b", "bytes")


@check("O24", E, "tablespace_total", ["data_files", "temp_files", "tablespaces"])
def o24(ctx):
    def by_level(view, size, name):
        """Of the instance (con_id NULL), and of each of its containers."""
        r = shapes.nested_rollup(_containers(ctx, view), [*K, "con_id"], {name: F.sum(size)})
        r = r.filter((F.col("level") == 1) | ((F.col("level") == 2) & (F.col("con_id") > 0)))
        return r.select(*K, F.coalesce("con_id", F.lit(0)).alias("con_id"), fround(F.col(name) / GB, 2).alias(name))
    d = by_level("data_files", "bytes", "physical_gb")
    return (d.join(by_level("temp_files", "bytes", "temp_gb"), C, "left").join(by_level("tablespaces", "used_bytes", "used_gb"), C, "left")
             .withColumn("con_id", F.when(F.col("con_id") > 0, F.col("con_id"))))


@check("O25", E, "tablespace_per_day", ["tablespace_usage_hist", "instance"], key=("con_id", "day",), metric="used_pct",
       threshold=90)
def o25(ctx):
    h = _containers(ctx, "tablespace_usage_hist").withColumn("ts", F.try_to_timestamp("rtime", F.lit("MM/dd/yyyy HH:mm:ss")))
    start = ctx.cur("instance").groupBy(*K).agg(F.max("startup_ts").alias("_start"))
    h = h.join(start, K).filter((F.col("ts") >= F.col("_start")) & (F.col("ts") >= _since(ctx, 30)))
    h = (h.withColumn("size_b", F.col("tablespace_size") * F.col("block_size"))
          .withColumn("used_b", F.col("tablespace_usedsize") * F.col("block_size")))
    used = time.daily_growth(h, ["tablespace_id"], "ts", "used_b", C, tie="snap_id", scale=0)
    size = time.daily_growth(h, ["tablespace_id"], "ts", "size_b", C, tie="snap_id", scale=0) \
        .select(*C, "day", F.col("total").alias("size_total"))
    out = used.join(size, [*C, "day"]).withColumn("used_pct", pct("total", "size_total"))
    return verdict.threshold_flag(out, "used_pct", 90, ">=")


@check("O26", E, "sequence_near_max", ["sequences"], key=("con_id", "sequence_owner", "sequence_name"), metric="pct",
       threshold=80)
def o26(ctx):
    s = _containers(ctx, "sequences").filter(F.col("cycle_flag") == "N")
    s = verdict.utilization_pct(s, "last_number", "max_value", red=80, op=">=")
    return s.filter(F.col("pct") >= 50)


@check("O27", E, "recyclebin", ["recyclebin"], metric="n_objects", threshold=1000)
def o27(ctx):
    g = ctx.cur("recyclebin").groupBy(*K).agg(
        F.count("*").alias("n_objects"),
        fround(F.sum(F.col("space_blocks") * F.col("block_size")) / GB, 2).alias("size_gb"))
    return verdict.threshold_flag(g, "n_objects", 1000, ">")


def _top_segments(ctx, kind):
    user_data = ~F.coalesce(F.col("tablespace_name").isin(SYSTEM_TABLESPACES), F.lit(False))
    s = _containers(ctx, "segments").filter(F.col("segment_type").startswith(kind) & user_data & _user_owned("owner", None)).withColumn("mb", F.col("bytes") / MB)
    parted = s.groupBy(*C, "owner", "segment_name").agg(
        F.max(F.when(F.col("partition_name").isNotNull(), "YES").otherwise("NO")).alias("partitioned"))
    top = cap.large_segments(s, ["con_id", "owner", "segment_name"], "mb", 10240, 10, 102400, part=K, out="size_mb")
    return top.join(parted, [*C, "owner", "segment_name"], "left")


@check("O28", E, "top_tables", ["segments"], key=("con_id", "owner", "segment_name"), metric="size_mb", threshold=102400)
def o28(ctx):
    return _top_segments(ctx, "TABLE")


@check("O29", E, "top_indexes", ["segments"], key=("con_id", "owner", "segment_name"), metric="size_mb", threshold=102400)
def o29(ctx):
    return _top_segments(ctx, "INDEX")


@check("O30", E, "partition_headroom", ["partitions"])
def o30(ctx):
    p = _containers(ctx, "partitions").filter(F.col("interval").isNull() | (F.col("interval") == "NO"))
    # base-table collections carry the bound as the 7-byte internal DATE
    p = p.withColumn("high_value", F.coalesce(
        F.date_format(decode_date_bytes("high_value_raw"), "yyyy-MM-dd HH:mm:ss"), F.col("high_value")))
    return cap.partition_headroom(p, [*C, "table_owner", "table_name"], "partition_position",
                                  ["partition_name", "high_value", "composite"])


@check("O31", E, "fk_without_index", ["fk_columns", "index_columns"], key=("owner", "table_name", "constraint_name"),
       max_version=10)
def o31(ctx):
    fk = ctx.cur("fk_columns")
    ix = ctx.cur("index_columns").select(*K, F.col("table_owner").alias("owner"), "table_name", "column_name",
                                         F.col("column_position").alias("position"))
    miss = relations.missing_related(fk, ix, [*K, "owner", "table_name", "column_name", "position"])
    return miss.select(*K, "owner", "table_name", "constraint_name", "column_name", "position") \
        .withColumn("is_abnormal", F.lit(True))


@check("O32", E, "user_objects_in_system", ["segments", "users"], key=("con_id", "owner", "segment_name"))
def o32(ctx):
    seg = _containers(ctx, "segments").filter(F.col("tablespace_name").isin("SYSTEM", "SYSAUX"))
    u = relations.tagged_union({"TABLE": seg.filter(F.col("segment_type").startswith("TABLE")),
                                "INDEX": seg.filter(F.col("segment_type").startswith("INDEX"))}, tag="kind")
    users = _containers(ctx, "users")
    version = ctx.params.get("version")
    if version is not None and version <= 11:
        # 11g/10g have no maintained flag: owners whose default tablespace is not SYSTEM/SYSAUX
        app = users.filter(~F.col("default_tablespace").isin("SYSTEM", "SYSAUX"))
    else:
        app = users.filter(F.col("oracle_maintained") == "N")
    app_users = app.select(*C, F.col("username").alias("owner"))
    return relations.member_of(u, app_users, [*C, "owner"]).withColumn("is_abnormal", F.lit(True))


@check("O33", E, "ransomware_objects", ["objects"], key=("con_id", "owner", "object_name"), priority="high")
def o33(ctx):
    o = _containers(ctx, "objects").select(*C, "owner", "object_name", "object_type", "created_ts")
    return relations.name_ioc(o, "object_name", RANSOM_PATTERNS).withColumn("is_abnormal", F.lit(True))


@check("O34", E, "sysaux_history_objects", ["segments"], key=("segment_name",), metric="size_mb", threshold=32767)
def o34(ctx):
    s = (ctx.cur("segments").filter((F.col("tablespace_name") == "SYSAUX") & F.col("segment_name").startswith("WRH$_"))
         .groupBy(*K, "segment_name", "segment_type").agg(fround(F.sum("bytes") / MB, 2).alias("size_mb")))
    top = ranking.topn(s, [F.col("size_mb").desc(), F.col("segment_name").asc()], 10, K)
    return verdict.threshold_flag(top, "size_mb", 32767, ">")


@check("O35", E, "sysaux_occupants", ["sysaux_occupants"], key=("occupant_name",), metric="size_mb",
       threshold=32767)
def o35(ctx):
    o = ctx.cur("sysaux_occupants").withColumn("size_mb", fround(F.col("space_usage_kbytes") / 1024, 2))
    return verdict.threshold_flag(o.filter(F.col("size_mb") > 100), "size_mb", 32767, ">")


@check("O36", E, "hwm_statistics", ["hwm_stats"], max_version=10)
def o36(ctx):
    h = ctx.cur("hwm_stats").filter(F.col("name").isin("DB Size (GB)", "Segment Size (GB)", "DB_SIZE", "SEGMENT_SIZE"))
    return h.select(*K, "name", fround(F.col("highwater") / GB, 2).alias("highwater_gb"),
                    fround(F.col("last_value") / GB, 2).alias("last_value_gb"))


@check("O37", E, "flashback_parameters", ["settings"])
def o37(ctx):
    return verdict.settings_select(ctx.cur("settings"), ["db_flashback_retention_target", "db_recovery_file_dest",
                                                         "db_recovery_file_dest_size"], unit_col="unit")


@check("O38", E, "flashback_status", ["database"])
def o38(ctx):
    return ctx.cur("database").select(*K, "log_mode", "flashback_on")


@check("O39", E, "default_passwords", ["users"], key=("username",), priority="high")
def o39(ctx):
    u = ctx.cur("users").filter(F.col("account_status") == "OPEN")
    version = ctx.params.get("version")
    if "default_pwd_hashes" in ctx.views and (version is not None and version <= 11 or
                                              "default_pwd_users" not in ctx.views):
        # 11g/10g: the password hash is in a reference table of known default hashes (supplied as data)
        known = ctx.cur("default_pwd_hashes").select(*K, "username", "password_hash")
        hit = relations.member_of(u.select(*K, "username", "account_status", "password_hash"), known,
                                  [*K, "username", "password_hash"]).drop("password_hash")
    else:
        hit = relations.member_of(u.select(*K, "username", "account_status"),
                                  ctx.cur("default_pwd_users").select(*K, "username"), [*K, "username"])
    return hit.withColumn("is_abnormal", F.lit(True))


@check("O40", E, "password_expiry", ["users"], key=("con_id", "username",), metric="days_left", threshold=7)
def o40(ctx):
    u = _containers(ctx, "users").filter(F.col("account_status") == "OPEN")
    return time.expiry_window(u, "expiry_ts", ctx.as_of, 30, 7, min_days=None)


@check("O41", E, "system_roles", ["role_privs", "users"], key=("con_id", "grantee", "granted_role"), priority="high")
def o41(ctx):
    open_users = _containers(ctx, "users").filter(F.col("account_status") == "OPEN").select(*C, F.col("username").alias("grantee"))
    r = relations.member_of(_containers(ctx, "role_privs").filter(F.col("granted_role").isin(SYSTEM_ROLES)), open_users,
                            [*C, "grantee"])
    return verdict.role_matrix(r, {}, unexpected=(F.col("granted_role") == "DBA") & ~F.col("grantee").isin(DBA_ALLOWED))


@check("O42", E, "schema_list", ["users", "database"], key=("con_id", "username",))
def o42(ctx):
    u = _containers(ctx, "users").filter((F.col("account_status") == "OPEN") & _user_owned("username"))
    created = ctx.cur("database").select(*K, F.col("created_ts").alias("_db_created"))
    u = u.join(created, K, "left")
    late = F.col("created_ts") > F.col("_db_created") + F.expr("INTERVAL 1 DAY")
    bad = late & F.col("default_tablespace").isin("SYSTEM", "SYSAUX")
    return u.withColumn("is_abnormal", F.coalesce(bad, F.lit(False))).drop("_db_created")


@check("O43", E, "schema_object_matrix", ["users", "objects"], min_version=11)
def o43(ctx):
    users = _containers(ctx, "users").filter(_user_owned("username")).select(*C, F.col("username").alias("owner"))
    o = _containers(ctx, "objects")
    t = F.col("object_type")
    return shapes.object_matrix(users, [*C, "owner"], {
        "n_tables": (o, t == "TABLE"), "n_indexes": (o, t == "INDEX"),
        "n_temp_tables": (o, (t == "TABLE") & F.col("object_name").startswith("SYS_TEMP")),
        "n_views": (o, t == "VIEW"), "n_procedures": (o, t.isin("PROCEDURE", "FUNCTION", "PACKAGE")),
        "n_triggers": (o, t == "TRIGGER"), "n_invalid": (o, F.col("status") == "INVALID")})


@check("O44", E, "stale_statistics", ["tab_statistics"], key=("con_id", "owner", "table_name"), metric="num_rows",
       min_version=12)
def o44(ctx):
    s = _containers(ctx, "tab_statistics").filter((F.col("stale_stats") == "YES") & (F.col("num_rows") > 10000))
    return ranking.topn(s, [F.col("num_rows").desc(), F.col("con_id").asc(), F.col("owner").asc(), F.col("table_name").asc()], 20, K) \
        .withColumn("is_abnormal", F.lit(True))


@check("O45", E, "profiles", ["profiles", "users"], key=("con_id", "profile", "resource_name"))
def o45(ctx):
    used = _containers(ctx, "users").filter(F.col("account_status") == "OPEN").select(*C, "profile").distinct()
    p = relations.member_of(_containers(ctx, "profiles"), used, [*C, "profile"])
    bad = ~F.col("resource_name").isin(PROFILE_EXEMPT) & ~F.col("limit_value").isin(PROFILE_OK_LIMITS)
    return p.withColumn("is_abnormal", F.coalesce(bad, F.lit(False)))


@check("O46", E, "directories", ["directories"])
def o46(ctx):
    return _containers(ctx, "directories").select(*C, "owner", "directory_name", "directory_path")


@check("O47", E, "jobs", ["jobs"], key=("con_id", "job",))
def o47(ctx):
    return verdict.status_decode(_containers(ctx, "jobs"), "broken", [("Y", "BROKEN"), ("N", "OK")], bad=["Y"])


@check("O48", E, "scheduler_jobs", ["scheduler_jobs", "scheduler_running"])
def o48(ctx):
    run = _containers(ctx, "scheduler_running").select(*C, "owner", "job_name", "session_id")
    return _containers(ctx, "scheduler_jobs").join(run, [*C, "owner", "job_name"], "left")


# Maintenance jobs whose failures are not listed (LIKE pattern).
JOB_NOT_LIKE = "ORA$AT_OS_OPT_SY%"


@check("O49", E, "job_errors", ["job_log"], key=("con_id", "owner", "job_name", "log_id"))
def o49(ctx):
    log = _containers(ctx, "job_log").filter(~F.coalesce(F.col("job_name").like(JOB_NOT_LIKE), F.lit(False)))
    r = ranking.recent_failures(log, [*C, "owner", "job_name"], [F.col("log_ts").desc(), F.col("log_id").desc()], 3,
                                failed=F.col("status") != "SUCCEEDED", since=_since(ctx, 7), ts="log_ts")
    if ctx.has("job_run_details"):
        details = ctx.cur("job_run_details").select(*K, "log_id", "actual_start_ts", "run_duration_s", "error", "additional_info")
        r = r.drop("error").join(details, [*K, "log_id"], "left")
    return r.withColumn("is_abnormal", F.lit(True))


@check("O50", E, "db_links", ["db_links"])
def o50(ctx):
    return _containers(ctx, "db_links").select(*C, "owner", "db_link", "username", "host", "created_ts")


@check("O51", E, "autotask_clients", ["autotask_clients"], key=("con_id", "client_name"))
def o51(ctx):
    version = ctx.params.get("version")
    if version is not None and version <= 10 and "scheduler_jobs" in ctx.views:
        # 10g: the same two maintenance tasks are scheduler jobs, judged by their enabled state
        rules = [("GATHER_STATS_JOB", "ne", "TRUE", None, None, "enable optimizer statistics"),
                 ("AUTO_SPACE_ADVISOR_JOB", "eq", "TRUE", None, None, "disable the space advisor")]
        jobs = _containers(ctx, "scheduler_jobs").select(*C, F.col("job_name").alias("client_name"),
                                                F.col("enabled").alias("status"))
        return verdict.config_audit(jobs, rules, keys=C, name_col="client_name", value_col="status")
    rules = [("auto optimizer stats collection", "ne", "ENABLED", None, None, "enable optimizer statistics"),
             ("auto space advisor", "eq", "ENABLED", None, None, "disable the space advisor"),
             ("sql tuning advisor", "eq", "ENABLED", None, None, "disable the SQL tuning advisor")]
    return verdict.config_audit(_containers(ctx, "autotask_clients"), rules, keys=C, name_col="client_name",
                                value_col="status")


@check("O52", E, "autotask_windows", ["autotask_windows"])
def o52(ctx):
    return _containers(ctx, "autotask_windows").filter(F.col("optimizer_stats") == "ENABLED")


@check("O53", E, "autotask_history", ["autotask_history"], min_version=11)
def o53(ctx):
    return _containers(ctx, "autotask_history").filter(F.col("window_start_ts") >= _since(ctx, 7))


@check("O54", E, "standby_parameters", ["settings"], key=("name",))
def o54(ctx):
    s = ctx.cur("settings")
    dest = (s.filter(F.col("name").rlike("^log_archive_dest_[0-9]+$") & (F.trim(F.coalesce("value", F.lit(""))) != ""))
            .withColumn("suffix", F.regexp_extract("name", "([0-9]+)$", 1)))
    state = (s.filter(F.col("name").rlike("^log_archive_dest_state_[0-9]+$"))
             .select(*K, "inst_id", F.regexp_extract("name", "([0-9]+)$", 1).alias("suffix"),
                     F.col("value").alias("dest_state")))
    pairs = dest.join(state, [*K, "inst_id", "suffix"], "left").select(*K, "inst_id", "name", "value", "dest_state")
    other = (verdict.settings_select(s, ["log_archive_config", "standby_file_management", "fal_server", "fal_client",
                                         "db_unique_name"])
             .select(*K, "inst_id", "name", "value", F.lit(None).cast("string").alias("dest_state")))
    u = pairs.unionByName(other)
    bad = (F.col("name") == "standby_file_management") & (F.upper("value") == "MANUAL")
    return u.withColumn("is_abnormal", F.coalesce(bad, F.lit(False)))


@check("O55", E, "standby_apply", ["archived_log", "redo_logs"], key=("thread",), metric="gap", threshold=5)
def o55(ctx):
    return perf.sequence_gap(ctx.cur("archived_log"), [*K, "thread"], "sequence", F.col("applied") == "YES", 5,
                             current=ctx.cur("redo_logs"))


@check("O56", E, "standby_destination", ["archive_dest_status"], key=("dest_id",))
def o56(ctx):
    d = ctx.cur("archive_dest_status").filter(F.col("status") != "INACTIVE")
    bad = (F.col("gap_status").isNotNull() & (F.col("gap_status") != "NO GAP")) | \
          (F.col("error").isNotNull() & (F.trim("error") != ""))
    return d.withColumn("is_abnormal", F.coalesce(bad, F.lit(False)))


@check("O57", E, "backup_jobs", ["backup_jobs"], key=("session_key",), priority="high")
def o57(ctx):
    b = ctx.cur("backup_jobs").filter(F.col("input_type").isin("DB FULL", "DB INCR") & (F.col("start_ts") >= _since(ctx, 14)))
    return verdict.status_decode(b, "status", [("COMPLETED", "COMPLETED"), ("RUNNING", "RUNNING")],
                                 good=["COMPLETED", "RUNNING"], default="FAILED")


@check("O58", E, "orphaned_export_jobs", ["datapump_jobs"], key=("con_id", "owner_name", "job_name"))
def o58(ctx):
    # a job whose table was dropped bears the table's name in the recycle bin
    jobs = _containers(ctx, "datapump_jobs").filter(~F.coalesce(F.col("job_name").startswith("BIN$"), F.lit(False)))
    return verdict.status_decode(jobs, "state", [("NOT RUNNING", "NOT RUNNING")],
                                 good=["NOT RUNNING"], default="ORPHANED")


@check("O59", E, "alert_log", ["alert_log"], min_version=11)
def o59(ctx):
    a = ctx.cur("alert_log").filter((F.col("originating_ts") >= _since(ctx, 90)) & F.col("problem_key").isNotNull())
    return a.select(*K, F.date_format("originating_ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "problem_key",
                    "message_text").distinct()


@check("O60", E, "asm_clients", ["asm_clients"], min_version=11)
def o60(ctx):
    return ctx.cur("asm_clients").select(*K, "group_number", "instance_name", "db_name", "status")


@check("O61", E, "asm_attributes", ["asm_attributes", "asm_diskgroups"], min_version=11)
def o61(ctx):
    g = ctx.cur("asm_diskgroups").select(*K, "group_number", F.col("name").alias("diskgroup"))
    a = ctx.cur("asm_attributes").filter(~F.col("name").startswith("template"))
    return a.join(g, [*K, "group_number"])


@check("O62", E, "asm_diskgroups", ["asm_diskgroups"], key=("name",), metric="pct", threshold=90)
def o62(ctx):
    g = ctx.cur("asm_diskgroups").withColumn("used_mb", F.col("total_mb") - F.col("free_mb"))
    g = verdict.utilization_pct(g, "used_mb", "total_mb")
    return g.withColumn("is_abnormal", F.coalesce((F.col("pct") >= 90) | (F.col("offline_disks") > 0), F.lit(False)))


@check("O63", E, "snapshot_inventory", ["snapshots"], metric="n_snaps", threshold=1000)
def o63(ctx):
    g = ctx.cur("snapshots").groupBy(*K).agg(F.min("snap_id").alias("min_snap"), F.max("snap_id").alias("max_snap"),
                                             F.countDistinct("snap_id").alias("n_snaps"))
    return verdict.threshold_flag(g, "n_snaps", 1000, ">")


@check("O64", E, "snapshot_settings", ["wr_control"])
def o64(ctx):
    w = ctx.cur("wr_control")
    # collections carry either plain numbers or the DAY TO SECOND intervals themselves
    w = (w.withColumn("snap_interval_min", F.coalesce("snap_interval_min", interval_minutes("snap_interval")))
          .withColumn("retention_days", F.coalesce("retention_days", interval_minutes("retention") / 1440)))
    return w.withColumn("is_abnormal", F.coalesce((F.col("snap_interval_min") < 15) | (F.col("retention_days") > 60),
                                                  F.lit(False)))


def _pair(ctx):
    return ctx.memo("pair", lambda: perf.snapshot_pair(ctx.cur("snapshots"), [*K, "instance_number"], "snap_id",
                                                       "startup_ts"))


def _delta(ctx, view, names, value="value", key="stat_name"):
    s = ctx.cur(view)
    if names is not None:
        s = s.filter(F.col(key).isin(list(names)))
    return perf.snapshot_delta(s, _pair(ctx), [*K, "instance_number"], "snap_id", [key], value)


def _pair_seconds(ctx):
    return ctx.memo("pair_seconds", lambda: _pair_seconds_build(ctx))


def _pair_seconds_build(ctx):
    sn = ctx.cur("snapshots").select(*K, "instance_number", "snap_id", "end_ts")
    p = _pair(ctx)
    b = sn.withColumnRenamed("snap_id", "begin_snap").withColumnRenamed("end_ts", "_b")
    e = sn.withColumnRenamed("snap_id", "end_snap").withColumnRenamed("end_ts", "_e")
    return (p.join(b, [*K, "instance_number", "begin_snap"]).join(e, [*K, "instance_number", "end_snap"])
             .select(*K, "instance_number", seconds_between("_b", "_e").alias("elapsed_s")))


@check("O65", E, "snapshot_info", ["snapshots", "time_model", "osstat"], metric="db_time_pct", threshold=80)
def o65(ctx):
    p = [*K, "instance_number"]
    d = _delta(ctx, "time_model", ["DB time"])
    cpus = verdict.status_wide(ctx.cur("osstat"), K, {"cpus": "NUM_CPUS"}, name_col="stat_name")
    out = d.join(_pair_seconds(ctx), p).join(cpus, K, "left")
    out = out.withColumn("db_time_s", F.col("delta") / 1e6).withColumn(
        "db_time_pct", fround(F.lit(100.0) * safe_div(F.col("db_time_s"), F.col("cpus") * F.col("elapsed_s")), 2))
    if ctx.has("sysstat"):
        # sessions, and cursors per session, as they stood at both ends: one pass over the two snapshots
        now = ctx.cur("sysstat").filter(F.col("stat_name").isin("logons current", "opened cursors current")).join(_pair(ctx), p)
        at = lambda snap, stat: F.max(F.when((F.col("snap_id") == F.col(snap)) & (F.col("stat_name") == stat), F.col("value"))).cast("double")
        ends = now.groupBy(*p).agg(*[at(f"{end}_snap", stat).alias(f"{end}_{name}") for end in ("begin", "end")
                                     for name, stat in (("sessions", "logons current"), ("cursors", "opened cursors current"))])
        ends = ends.select(*p, *[c for end in ("begin", "end") for c in (
            F.col(f"{end}_sessions"), fround(safe_div(f"{end}_cursors", f"{end}_sessions"), 1).alias(f"{end}_cursors_per_session"))])
        out = out.join(ends, p, "left")
    return verdict.threshold_flag(out, "db_time_pct", 80, ">")


@check("O66", E, "load_profile", ["snapshots", "sysstat"], key=("instance_number", "stat_name"), metric="per_sec")
def o66(ctx):
    p = [*K, "instance_number"]
    d = _delta(ctx, "sysstat", LOAD_STATS).select(*p, "stat_name", F.col("delta").cast("double").alias("delta"))
    both = d.withColumn("stat_name", F.coalesce(*[F.when(F.col("stat_name").isin(parts), F.lit(name)) for name, parts in LOAD_SUMS.items()])).filter(F.col("stat_name").isNotNull())
    both = both.groupBy(*p, "stat_name").agg(F.sum("delta").alias("delta"), F.count("delta").alias("_n")).filter(F.col("_n") == 2)  # a sum needs both
    d = d.unionByName(both.drop("_n"))
    if ctx.has("time_model"):  # microseconds
        seconds = _delta(ctx, "time_model", ["DB time", "DB CPU"])
        d = d.unionByName(seconds.select(*p, F.concat("stat_name", F.lit(" (s)")).alias("stat_name"), (F.col("delta") / 1e6).cast("double").alias("delta")))
    r = perf.rate_per_second(d.join(_pair_seconds(ctx), p), "delta", F.col("elapsed_s").cast("double"), 2)
    red = None
    for name, lim in LOAD_RED.items():
        c = (F.col("stat_name") == name) & (F.col("per_sec") > lim)
        red = c if red is None else red | c
    return r.withColumn("is_abnormal", F.coalesce(red, F.lit(False)))


def _counter_sums(ctx, view, key, counters):
    """Sums over a view's keys of what each counter grew by between the two snapshots: a key needs both ends, as a statistic does."""
    p = [*K, "instance_number"]
    long = ctx.cur(view).select(*p, "snap_id", F.col(key).alias("_key"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("_counter"), F.col(c).alias("value")) for c in counters])))
    d = perf.snapshot_delta(long, _pair(ctx), p, "snap_id", ["_key", "_counter"], "value")
    return d.groupBy(*p).agg(*[F.sum(F.when(F.col("_counter") == c, F.col("delta"))).cast("double").alias(c) for c in counters])


@check("O67", E, "instance_efficiency", ["snapshots", "sysstat"], key=("instance_number",), priority="high")
def o67(ctx):
    names = {"pr": "physical reads", "prd": "physical reads direct", "prdl": "physical reads direct (lob)",
             "lr": "session logical reads", "pc": "parse count (total)", "ph": "parse count (hard)",
             "ex": "execute count", "sm": "sorts (memory)", "sd": "sorts (disk)", "scp": "session cursor cache hits",
             "rsr": "redo synch writes", "rle": "redo log space requests", "re": "redo entries",
             "ptc": "parse time cpu", "pte": "parse time elapsed"}
    p = [*K, "instance_number"]
    d = _delta(ctx, "sysstat", list(names.values()))
    w = shapes.conditional_pivot(d, p, "stat_name", {k: v for k, v in names.items()}, "max",
                                 "delta", cast="double")
    for view, key, counters in (("waitstat", "class", ["wait_count"]), ("librarycache", "namespace", ["pins", "pinhits"]), ("latch", "latch_name", ["gets", "misses"])):
        if ctx.has(view):
            w = w.join(_counter_sums(ctx, view, key, counters), p, "left")
        else:
            w = w.withColumns({c: F.lit(None).cast("double") for c in counters})
    cpu = F.lit(None).cast("double")
    if ctx.has("time_model"):  # the statistic counts hundredths of a second, the model microseconds
        w = w.join(_delta(ctx, "time_model", ["DB CPU"]).select(*p, (F.col("delta") / 10000).cast("double").alias("_cpu")), p, "left")
        cpu = F.col("_cpu")
    return perf.ratio_kpi(w, {
        "buffer_nowait_pct": perf.hit_ratio("wait_count", "lr"),
        "redo_nowait_pct": perf.hit_ratio("rle", "re"),
        "buffer_hit_pct": perf.hit_ratio(F.col("pr") - F.coalesce("prd", F.lit(0.0)) - F.coalesce("prdl", F.lit(0.0)), "lr"),
        "in_memory_sort_pct": perf.hit_ratio("sd", F.col("sm") + F.col("sd")),
        "library_hit_pct": fround(F.lit(100.0) * safe_div("pinhits", "pins"), 2),
        "soft_parse_pct": perf.hit_ratio("ph", "pc"),
        "execute_to_parse_pct": perf.hit_ratio("pc", "ex"),
        "latch_hit_pct": perf.hit_ratio("misses", "gets"),
        "parse_cpu_pct": fround(F.lit(100.0) * safe_div("ptc", "pte"), 2),
        "non_parse_cpu_pct": perf.hit_ratio("ptc", cpu),
    }, red_below=90.0).drop("_cpu")


@check("O68", E, "top_wait_events", ["snapshots", "system_event", "time_model"], key=("event_name",),
       metric="avg_ms")
def o68(ctx):
    # 10g has no foreground counters: foreground = total - background (never below 0 background)
    zero = F.lit(0).cast("decimal(38,0)")
    ev = ctx.cur("system_event").filter(F.col("wait_class") != "Idle").withColumn(
        "fg_time", F.coalesce("time_waited_us_fg",
                              F.col("time_waited_us") - F.greatest(zero, F.coalesce("time_waited_us_bg", zero)))).withColumn(
        "fg_waits", F.coalesce("total_waits_fg",
                               F.col("total_waits") - F.greatest(zero, F.coalesce("total_waits_bg", zero))))
    p = [*K, "instance_number"]
    t = perf.snapshot_delta(ev, _pair(ctx), p, "snap_id", ["event_name", "wait_class"], "fg_time")
    n = perf.snapshot_delta(ev, _pair(ctx), p, "snap_id", ["event_name", "wait_class"], "fg_waits") \
        .select(*p, "event_name", F.col("delta").alias("waits"))
    waits = t.join(n, [*p, "event_name"]).select(*p, "event_name", "wait_class", F.col("delta").alias("time_us"), "waits")
    cpu = _delta(ctx, "time_model", ["DB CPU"]).select(*p, F.lit("DB CPU").alias("event_name"),
                                                      F.lit("CPU").alias("wait_class"),
                                                      F.col("delta").alias("time_us"), F.lit(None).cast("decimal(38,0)").alias("waits"))
    dbt = _delta(ctx, "time_model", ["DB time"]).select(*p, F.col("delta").alias("_dbt"))
    u = waits.unionByName(cpu).join(dbt, p, "left")
    u = (u.withColumn("time_s", fround(F.col("time_us") / 1e6, 2))
          .withColumn("avg_ms", fround(safe_div(F.col("time_us") / 1000, "waits"), 2))
          .withColumn("pct_db_time", fround(F.lit(100.0) * safe_div("time_us", "_dbt"), 2)))
    top = ranking.topn(u, [F.col("time_us").desc(), F.col("event_name").asc()], 10, p)
    return top.withColumn("is_abnormal", F.coalesce((F.col("avg_ms") > 10) & (F.col("time_s") > 1000), F.lit(False)))


@check("O69", E, "time_model", ["snapshots", "time_model"], key=("stat_name",), metric="pct")
def o69(ctx):
    d = _delta(ctx, "time_model", None)
    p = [*K, "instance_number"]
    dbt = d.filter(F.col("stat_name") == "DB time").select(*p, F.col("delta").alias("_dbt"))
    out = d.join(dbt, p).withColumn("pct", fround(F.lit(100.0) * safe_div("delta", "_dbt"), 2)) \
        .withColumn("time_s", fround(F.col("delta") / 1e6, 2))
    bad = (F.col("stat_name") == "parse time elapsed") & (F.col("pct") > 20) & (F.col("time_s") > 500)
    return out.withColumn("is_abnormal", F.coalesce(bad, F.lit(False)))


# Statements that are no application's (LIKE patterns of their texts, and of their modules).
SQL_NOT_LIKE = ["%td%", "call%", "begin%", "BEGIN%", "declare%", "DECLARE%"]
MODULE_NOT_LIKE = "DBMS_SCHEDULER%"


def _top_sql(ctx, tested=True):
    """The heaviest statements; ``tested``: of those with a text that is an application's, where texts were collected."""
    p = [*K, "instance_number"]
    dbt = _delta(ctx, "time_model", ["DB time"]).select(*p, F.col("delta").alias("_dbt"))
    texts = ctx.cur("sqltext") if tested and ctx.has("sqltext") else None
    stats = ctx.cur("sqlstat").join(_pair(ctx), p)
    if texts is not None:
        stats = stats.filter(F.col("module").isNull() | ~F.col("module").like(MODULE_NOT_LIKE))
    top = perf.statement_report(
        stats, p, "sql_id", "snap_id", F.col("begin_snap"), F.col("end_snap"),
        {"elapsed_us": "elapsed_delta", "cpu_us": "cpu_delta", "io_us": "iowait_delta"}, "elapsed_us", 10, execs="exec_delta",
        shares={"pct_cpu": ("cpu_us", "elapsed_us"), "pct_io": ("io_us", "elapsed_us")}, totals=dbt, total="_dbt",
        texts=texts, text="sql_text", not_like=SQL_NOT_LIKE, text_on=[*K, "sql_id"], most={"module": "module"}, per_exec="_us")
    if texts is not None:
        top = top.drop("sql_text")
    return top.drop("_us").withColumn("elapsed_s", fround(F.col("elapsed_us") / 1e6, 2)) \
        .withColumn("per_exec_s", fround(safe_div(F.col("elapsed_us") / 1e6, "execs"), 2))


@check("O70", E, "top_sql_elapsed", ["snapshots", "sqlstat", "time_model"], key=("sql_id",), metric="per_exec_s",
       threshold=60)
def o70(ctx):
    t = _top_sql(ctx)
    return t.withColumn("is_abnormal", F.coalesce((F.col("per_exec_s") > 60) | (F.col("pct_total") > 20), F.lit(False)))


@check("O71", E, "top_sql_text", ["snapshots", "sqlstat", "time_model", "sqltext"])
def o71(ctx):
    t = _top_sql(ctx, tested=False).select(*K, "sql_id", "rn")
    txt = ctx.cur("sqltext").select(*K, "sql_id", F.substring("sql_text", 1, 1000).alias("sql_text"))
    return t.join(txt, [*K, "sql_id"]).filter(~F.lower("sql_text").like("%dbms_%")).distinct()


def _trend(ctx, view, names, key, value, agg="max"):
    s = ctx.cur(view).filter(F.col(key).isin(list(names.values())))
    return shapes.conditional_pivot(s, [*K, "instance_number", "snap_id"], key, names, agg, value)


@check("O72", E, "trend_cpu", ["sysmetric"])
def o72(ctx):
    return _trend(ctx, "sysmetric", {"background_cpu_pct": "Background CPU Usage Per Sec",
                                      "host_cpu_pct": "Host CPU Utilization (%)",
                                      "db_cpu_pct": "Database CPU Time Ratio"}, "metric_name", "average", "avg")


@check("O73", E, "trend_connections", ["resource_limit_hist"])
def o73(ctx):
    return _trend(ctx, "resource_limit_hist", {"processes": "processes", "sessions": "sessions"},
                  "resource_name", "current_utilization")


@check("O74", E, "trend_logons", ["sysmetric"])
def o74(ctx):
    s = ctx.cur("sysmetric").filter(F.col("metric_name") == "Logons Per Sec")
    return s.groupBy(*K, "instance_number", "snap_id").agg(F.max("maxval").alias("logons_max"),
                                                           F.avg("average").alias("logons_avg"))


@check("O75", E, "trend_commits_redo", ["sysstat", "snapshots"])
def o75(ctx):
    s = ctx.cur("sysstat").filter(F.col("stat_name").isin("user commits", "redo size"))
    sn = ctx.cur("snapshots").select(*K, "instance_number", "snap_id",
                                     seconds_between("begin_ts", "end_ts").alias("interval_s"))
    s = s.join(sn, [*K, "instance_number", "snap_id"])
    return perf.counter_trend(s, [*K, "instance_number"], ["stat_name"], "snap_id", "value",
                              F.col("interval_s").cast("double"), 2)


@check("O76", E, "top5_wait_share", ["snapshots", "system_event", "time_model"])
def o76(ctx):
    w = o68(ctx).select(*K, "instance_number", "event_name", "time_us")
    p = [*K, "instance_number"]
    top = ranking.topn(w, [F.col("time_us").desc(), F.col("event_name").asc()], 5, p)
    return perf.time_share(top, p, "event_name", "time_us")


@check("O77", E, "run_errors", ["check_errors"], min_version=11)
def o77(ctx):
    return ctx.cur("check_errors").select(*K, "check_name", "error").withColumn("is_abnormal", F.lit(True))

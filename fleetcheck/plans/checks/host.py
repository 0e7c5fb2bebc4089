"""Host and log checks H01-H15 over OS dumps, log lines and file listings.

``os_text`` holds whole collector dumps (path, text); the instance is the
dump's host. ``log_lines`` holds error/alert log lines with their number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import fround
from ...operators import capacity as cap
from ...operators import ranking, text, verdict
from ...operators.sections import section_pairs, section_table
from ...sources import parse_log_lines
from .base import K, check

E = "host"

# Section names printed by the OS collectors (the last four
# only on clustered hosts).
OS_SECTIONS = ["rac", "osversion", "kernel", "cpu", "cpuasge", "memtotal", "memusage", "swap", "swapusage",
               "loadaverage", "upday", "time", "hosts", "sysctl", "limits", "diskusage", "inode", "meminfo",
               "freemem", "thp", "crontab", "ocrcheck", "votedisk", "ocrbackup", "oifcfg", "crsstat", "olsnode",
               "crsinit", "patches", "listener", "hba", "error_log_summary", "binlog_files", "mysql_config",
               "pg_config", "mssql_conf"]
CLUSTER_SECTIONS = ["ocrcheck", "votedisk", "ocrbackup", "oifcfg", "crsstat", "olsnode", "crsinit"]
# Kernel parameters reported per host.
SYSCTL_KEYS = ["kernel.shmall", "kernel.shmmax", "kernel.sem", "kernel.shmmni", "fs.aio-max-nr", "fs.file-max",
               "net.ipv4.ip_local_port_range", "net.core.rmem_default", "net.core.rmem_max",
               "net.core.wmem_default", "net.core.wmem_max", "vm.swappiness", "vm.nr_hugepages"]
# Error-log line classes.
LOG_CLASSES = [("error", r"\[ERROR\]|ORA-[0-9]+|ERROR:|FATAL:|PANIC:"), ("warning", r"\[Warning\]|WARNING:")]


def sections(ctx):
    return ctx.memo("os_sections", lambda: text.os_section_parse(ctx.cur("os_text"), "text", [*K, "path"],
                                                                sections=OS_SECTIONS))


def bodies(ctx):
    """The same sections, each as one row with the array of its lines."""
    return ctx.memo("os_bodies", lambda: text.os_sections(ctx.cur("os_text"), "text", [*K, "path"], sections=OS_SECTIONS))


def _value(ctx, name):
    s = sections(ctx).filter(F.col("section") == name)
    return s.groupBy(*K).agg(F.min_by(F.trim("line"), "line_no").alias(name))


@check("H01", E, "os_sections", ["os_text"])
def h01(ctx):
    return sections(ctx)


@check("H02", E, "cluster_sections", ["os_text"])
def h02(ctx):
    s = sections(ctx).filter(F.col("section").isin(CLUSTER_SECTIONS))
    bad = F.col("line").rlike(r"(?i)\b(OFFLINE|UNKNOWN|INTERMEDIATE|failed)\b") & (F.col("section") == "crsstat")
    return s.withColumn("is_abnormal", F.coalesce(bad, F.lit(False)))


@check("H03", E, "cpu_busy", ["os_text"], metric="cpu_busy_pct", threshold=80)
def h03(ctx):
    v = _value(ctx, "cpuasge").withColumn("cpu_busy_pct", F.col("cpuasge").try_cast("double"))
    return verdict.threshold_flag(v, "cpu_busy_pct", 80, ">")


@check("H04", E, "memory_swap", ["os_text"], metric="mem_used_pct", threshold=90)
def h04(ctx):
    rows = section_table(bodies(ctx), K, "freemem").withColumn("kind", F.regexp_replace("kind", ":$", ""))
    g = rows.groupBy(*K).agg(
        F.max(F.when(F.col("kind") == "Mem", F.col("total_kb"))).alias("mem_total_kb"),
        F.max(F.when(F.col("kind") == "Mem", F.col("used_kb"))).alias("mem_used_kb"),
        F.max(F.when(F.col("kind") == "Swap", F.col("total_kb"))).alias("swap_total_kb"),
        F.max(F.when(F.col("kind") == "Swap", F.col("used_kb"))).alias("swap_used_kb"))
    g = cap.os_usage(g, F.col("mem_used_kb"), F.col("mem_total_kb"), "mem_used_pct")
    g = cap.os_usage(g, F.col("swap_used_kb"), F.col("swap_total_kb"), "swap_used_pct")  # zero swap -> NULL
    # collectors that print the percentages themselves (memusage / swapusage sections)
    pre = (sections(ctx).filter(F.col("section").isin("memusage", "swapusage"))
           .groupBy(*K).agg(F.max(F.when(F.col("section") == "memusage", F.trim("line").try_cast("double"))).alias("_m"),
                            F.max(F.when(F.col("section") == "swapusage", F.trim("line").try_cast("double"))).alias("_s")))
    spine = sections(ctx).select(*K).distinct()
    g = (spine.join(g, K, "left").join(pre, K, "left")
              .withColumn("mem_used_pct", F.coalesce("mem_used_pct", fround("_m", 2)))
              .withColumn("swap_used_pct", F.coalesce("swap_used_pct", fround("_s", 2))).drop("_m", "_s"))
    return g.withColumn("mem_total_gb", fround(F.col("mem_total_kb") / 1024 / 1024, 2)) \
        .withColumn("is_abnormal", F.coalesce((F.col("mem_used_pct") > 90) | (F.col("swap_used_pct") > 50), F.lit(False)))


def _df_rows(ctx, section):
    rows = section_table(bodies(ctx), K, section).filter(F.col("mount").isNotNull())
    return rows.select(*K, "host", "filesystem", "fstype", "used_pct", "mount")


@check("H05", E, "disk_inode_usage", ["os_text"], key=("host", "kind", "mount"), metric="used_pct", threshold=90)
def h05(ctx):
    d = _df_rows(ctx, "diskusage").withColumn("kind", F.lit("space"))
    i = _df_rows(ctx, "inode").withColumn("kind", F.lit("inode"))
    return verdict.threshold_flag(d.unionByName(i), "used_pct", 90, ">=")


@check("H06", E, "memory_detail", ["os_text"])
def h06(ctx):
    s = sections(ctx).filter(F.col("section").isin("thp", "limits", "hosts", "crontab", "loadaverage", "upday"))
    thp_on = (F.col("section") == "thp") & F.col("line").contains("[always]")
    info = section_pairs(bodies(ctx), [*K, "path"], "meminfo").select(
        *K, "path", "host", F.lit("meminfo").alias("section"), "line_no", "line", F.col("name").alias("mi_name"), F.col("value").alias("mi_kb"))
    return s.unionByName(info, allowMissingColumns=True).withColumn("is_abnormal", thp_on)


@check("H07", E, "kernel_parameters", ["os_text"])
def h07(ctx):
    s = sections(ctx).filter(F.col("section") == "sysctl")
    kv = F.split(F.col("line"), r"\s*=\s*", 2)
    return verdict.settings_select(s.select(*K, F.trim(F.get(kv, 0)).alias("name"), F.trim(F.get(kv, 1)).alias("value")),
                                   SYSCTL_KEYS)


@check("H08", E, "multi_node_labels", ["os_text"])
def h08(ctx):
    return sections(ctx).filter(F.col("host").isNotNull()).groupBy(*K, "section").agg(
        F.countDistinct("host").alias("n_hosts"))


@check("H09", E, "patches_listener", ["os_text"])
def h09(ctx):
    return sections(ctx).filter(F.col("section").isin("patches", "listener"))


def _recent_log(ctx, days):
    """Lines of the last days; a line without a timestamp has that of its record."""
    lines = parse_log_lines(ctx.cur("log_lines")).withColumn("_piece", F.floor(F.col("line_no") / 65536))
    lines = text.record_lines(lines, [*K, "source"], "_piece", "line_no", F.col("ts").isNotNull(), F.col("ts"))
    lines = lines.withColumn("ts", F.col("record_ts")).drop("record_ts", "record_no", "_piece")
    since = ctx.as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    return lines.filter((F.col("ts") >= since) & (F.col("ts") <= ctx.as_of))


@check("H10", E, "alert_log_recent", ["log_lines"])
def h10(ctx):
    r = _recent_log(ctx, ctx.p("alert_days", 7))
    return text.log_severity(r, "line", LOG_CLASSES, [*K, "source", "line_no", "ts"], distinct=False, ts="ts") \
        .withColumn("is_abnormal", F.col("severity") == "error")


@check("H11", E, "error_log_summary", ["log_lines"], key=("message",), metric="n_lines")
def h11(ctx):
    r = _recent_log(ctx, 7)
    errs = r.filter(F.col("line").contains("[ERROR]"))
    top = text.log_fingerprint(errs, "line", 10, part=K, strip=text.LEADING_TIMESTAMP)
    tot = text.log_totals(r, "line", [("errors", r"\[ERROR\]"), ("warnings", r"\[Warning\]")], part=K) \
        .withColumnRenamed("n_lines", "total_lines")
    return top.join(tot, K, "left").withColumn("is_abnormal", F.lit(True))


@check("H12", E, "last_log_lines", ["log_lines"])
def h12(ctx):
    return ranking.topn(ctx.cur("log_lines"), [F.col("line_no").desc()], 50, [*K, "source"])


@check("H13", E, "binary_log_files", ["files"])
def h13(ctx):
    f = ctx.cur("files").withColumn("_id", F.col("name"))
    g = cap.file_summary(f, K, "_id", "size_bytes")
    return g.withColumn("total_mb", fround(F.col("total_size") / 1024 / 1024, 2)).withColumnRenamed("largest_id",
                                                                                                   "largest_file")


@check("H14", E, "settings_dumps", ["os_text"])
def h14(ctx):
    s = sections(ctx).filter(F.col("section").isin("mysql_config", "pg_config", "mssql_conf"))
    kv = F.split(F.col("line"), r"\s*=\s*", 2)
    return s.select(*K, "section", F.trim(F.get(kv, 0)).alias("name"), F.trim(F.get(kv, 1)).alias("value"))


@check("H15", E, "access_rules_file", ["os_text"])
def h15(ctx):
    s = sections(ctx).filter((F.col("section") == "hba") & ~F.trim("line").startswith("#"))
    return s.withColumn("is_abnormal", F.col("line").rlike(r"\btrust\s*$"))

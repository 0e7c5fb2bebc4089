"""Cross-report checks R01-R04: health summary, priority map, report tier,
and reading legacy HTML reports back into tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import findings as fnd
from ...operators import shapes, text
from .base import K, REGISTRY, check

E = "report"

# Priority per issue kind (the reference's 18 keyed levels),
# attached to the checks that report that issue; all other checks: medium.
ISSUE_PRIORITY = {
    "alert log errors": ("high", ["O59", "H10"]),
    "tablespace usage": ("high", ["O22", "O23"]),
    "lock waits": ("high", ["M27", "P15", "S17"]),
    "long transactions": ("high", ["M14"]),
    "standby apply": ("high", ["O55", "O56"]),
    "default passwords": ("high", ["O39"]),
    "invalid objects": ("medium", ["O21"]),
    "foreign keys without index": ("medium", ["O31", "M39"]),
    "stale statistics": ("medium", ["O44"]),
    "password expiry": ("medium", ["O40"]),
    "temporary space": ("medium", ["S15"]),
    "session count": ("medium", ["O16", "O73"]),
    "redo switches": ("low", ["O19"]),
    "unused indexes": ("low", ["P14", "P23"]),
    "ransomware objects": ("high", ["O33"]),
    "sequence near maximum": ("low", ["O26"]),
    "duplicate indexes": ("low", ["M08"]),
    "table fragmentation": ("low", ["M22"]),
}
PRIORITY_MAP = [(cid, prio, f"Resolve {issue}.") for issue, (prio, ids) in ISSUE_PRIORITY.items() for cid in ids]
# Report depth per tier (our assignment): weekly = core health (default),
# monthly adds performance history and trends, quarterly adds schema hygiene.
TIERS = ("weekly", "monthly", "quarterly")
TIER_OF = {
    **{c: "monthly" for c in ["O20", "O25", "O63", "O64", "O65", "O66", "O67", "O68", "O69", "O70", "O71", "O72",
                              "O73", "O74", "O75", "O76", "M19", "M23", "M24", "P13", "S08", "S09", "S18", "S19"]},
    **{c: "quarterly" for c in ["O28", "O29", "O30", "O31", "O32", "O34", "O35", "O36", "O43", "O44", "M08", "M15",
                                "M16", "M17", "M22", "M25", "M38", "M39", "P04", "P14", "P23", "S16", "S20", "S21"]},
}


def priorities(spark):
    return spark.createDataFrame(PRIORITY_MAP, "check_id string, priority string, advice string")


def health_summary_of(findings, spark, ran=None):
    """R01: per instance and check: normal/abnormal counts, priority (default
    medium), advice and the worst objects only when abnormal."""
    return fnd.health_summary(findings, priorities(spark), by=["instance_id", "check_id"], ran=ran,
                              worst=fnd.WORST if "object_key" in findings.columns else None)


def priority_rollup(summary):
    """R01 advice grouped by priority: per instance and level, the number of
    abnormal checks and their ids in order. The list is bounded by the size of
    the check registry, so the string aggregate is safe on a hot instance."""
    ab = summary.filter(F.col("status") == "abnormal")
    counts = ab.groupBy("instance_id", "priority").agg(F.count("*").alias("n_abnormal_checks"))
    ids = shapes.ordered_concat(ab, ["instance_id", "priority"], "check_id", distinct=True, out="check_ids")
    level = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return counts.join(ids, ["instance_id", "priority"]).withColumn("level", level)


@check("R02", E, "priority_map", [])
def r02(ctx):
    reg = ctx.spark.createDataFrame([(c.check_id, c.engine, c.name, c.tier) for c in REGISTRY.values()],
                                    "check_id string, engine string, name string, tier string")
    return reg.join(priorities(ctx.spark), "check_id", "left") \
        .withColumn("priority", F.coalesce("priority", F.lit(fnd.DEFAULT_PRIORITY))) \
        .withColumn("instance_id", F.lit(None).cast("string"))


@check("R03", E, "report_tier", [])
def r03(ctx):
    reg = ctx.spark.createDataFrame([(c.check_id, c.tier) for c in REGISTRY.values()], "check_id string, tier string")
    return reg.groupBy("tier").agg(F.count("*").alias("n_checks")).withColumn("instance_id", F.lit(None).cast("string"))


@check("R04", E, "report_extract", ["report_html"])
def r04(ctx):
    return text.html_table_extract(ctx.cur("report_html"), "html", [*K, "path"])


@check("R01", E, "health_summary", [])
def r01(ctx):
    f = ctx.params.get("findings")
    if f is None:
        from ...schemas import FINDINGS
        f = ctx.spark.createDataFrame([], FINDINGS)
    return health_summary_of(f, ctx.spark)

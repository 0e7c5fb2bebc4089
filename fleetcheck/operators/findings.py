"""Uniform findings table and the per-check health summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col

FINDINGS_COLUMNS = ["instance_id", "engine", "snapshot_ts", "check_id", "object_key", "metric",
                    "metric_text", "threshold", "is_abnormal", "priority", "advice"]

# Priority levels of the summary, default for unlisted checks.
PRIORITY_LEVELS = ("high", "medium", "low")
DEFAULT_PRIORITY = "medium"


def to_findings(df: DataFrame, check_id: str, object_key: Column, metric: Column | None = None,
                threshold: float | None = None, instance_id: Column | None = None,
                engine: str | Column | None = None, snapshot_ts: Column | None = None,
                metric_text: Column | None = None, advice: Column | None = None,
                abnormal: str = "is_abnormal") -> DataFrame:
    """Project any check output to the findings contract."""
    def c(v, t):
        if v is None:
            return F.lit(None).cast(t)
        return (F.lit(v) if not isinstance(v, Column) else v).cast(t)
    return df.select(
        c(instance_id, "string").alias("instance_id"),
        c(engine, "string").alias("engine"),
        c(snapshot_ts, "timestamp").alias("snapshot_ts"),
        F.lit(check_id).alias("check_id"),
        object_key.cast("string").alias("object_key"),
        c(metric, "double").alias("metric"),
        c(metric_text, "string").alias("metric_text"),
        c(threshold, "double").alias("threshold"),
        F.coalesce(col(abnormal), F.lit(False)).alias("is_abnormal"),
        F.lit(None).cast("string").alias("priority"),
        c(advice, "string").alias("advice"))


def union_findings(frames: Sequence[DataFrame]) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


#: Objects that the abnormal list of a check holds, at most; the counts are of all.
WORST = 10


def abnormal_list(findings: DataFrame, by: Sequence[str] = ("check_id",), k: int = WORST, out: str = "abnormal_items") -> DataFrame:
    """(by..., out): the ``k`` worst abnormal objects of each group as an array of (object_key, metric), worst first.

    Worst is what lies farthest from its threshold, on whichever side the check's red one is; objects without a metric
    come last, ties go by key. A rank with a group limit before its shuffle: every task sends ``k`` rows a group, those
    merge to ``k``, and no list that is collected is longer, however many objects of a check are red.
    """
    far = F.abs(F.col("metric") - F.coalesce("threshold", F.lit(0.0)))
    order = [far.desc_nulls_last(), F.col("object_key").asc_nulls_last(), F.col("metric").asc_nulls_last()]
    worst = findings.filter("is_abnormal").withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= k)
    listed = F.sort_array(F.collect_list(F.struct("_r", F.struct("object_key", "metric").alias("item"))))
    return worst.groupBy(*by).agg(F.transform(listed, lambda x: x["item"]).alias(out))


def health_summary(findings: DataFrame, priorities: DataFrame, by: Sequence[str] = ("check_id",),
                   ran: DataFrame | None = None, worst: int | None = None) -> DataFrame:
    """Normal / abnormal counts per check with its priority (default medium).

    ``priorities`` (check_id, priority, advice) is the fixed priority map — a
    literal list of a few dozen rows, broadcast. Counts come from one partial
    aggregation over the findings. ``ran`` (the columns ``by`` and ``error``): checks that were due; one
    without findings has a line as well, ``normal``, or ``error`` with its message. ``worst``: also the
    ``abnormal_list`` of so many objects; empty where nothing is red.
    """
    by = list(by)
    g = findings.groupBy(*by).agg(F.count_if(~F.col("is_abnormal")).alias("n_normal"),
                                  F.count_if(F.col("is_abnormal")).alias("n_abnormal"))
    if ran is not None:
        g = (ran.join(g, by, "full").withColumn("n_normal", F.coalesce("n_normal", F.lit(0)))
                .withColumn("n_abnormal", F.coalesce("n_abnormal", F.lit(0))))
    if worst is not None:
        empty = F.array().cast("array<struct<object_key:string,metric:double>>")
        g = g.join(abnormal_list(findings, by, worst), by, "left").withColumn("abnormal_items", F.coalesce("abnormal_items", empty))
    p = F.broadcast(priorities.select("check_id", F.col("priority").alias("_p"), F.col("advice").alias("_a")))
    return (g.join(p, "check_id", "left")
             .withColumn("priority", F.coalesce(F.col("_p"), F.lit(DEFAULT_PRIORITY)))
             .withColumn("advice", F.when(F.col("n_abnormal") > 0, F.col("_a")))
             .withColumn("status", F.when(F.lit(False) if ran is None else F.col("error").isNotNull(), F.lit("error"))
                         .when(F.col("n_abnormal") > 0, F.lit("abnormal")).otherwise(F.lit("normal")))
             .drop("_p", "_a"))

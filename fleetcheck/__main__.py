"""Fleet run from the command line.

    python -m fleetcheck --root /shared/snapshots --as-of "2024-01-31 00:00:00" \\
        --out /shared/health/2024-01-31 [--since 2024-01-01] [--engines oracle,mysql] [--tier monthly] \\
        [--materialize] [--one-job] [--shuffle-partitions 200000]

Reads ``root/{engine}/{view}/snapshot_date=...``, runs every applicable
check, writes ``out/findings`` (partitioned by engine, check_id),
``out/summary`` and ``out/priorities`` as parquet, and prints the counts.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from .plans import fleet
from .plans.checks.report import priority_rollup
from .session import build_session

ENGINES = ("oracle", "mysql", "postgres", "sqlserver", "host", "report")


def main(argv=None) -> dict:
    ap = argparse.ArgumentParser(prog="fleetcheck")
    ap.add_argument("--root", required=True)
    ap.add_argument("--as-of", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--since")
    ap.add_argument("--engines", default=",".join(ENGINES))
    ap.add_argument("--tier", choices=("weekly", "monthly", "quarterly"))
    ap.add_argument("--shuffle-partitions", type=int,
                    help="initial shuffle partitions (~ shuffle bytes / 128 MB on a cluster; AQE coalesces down)")
    ap.add_argument("--isolate", action="store_true", help="the default: one job per check; failing checks are "
                    "recorded in out/errors and the rest still run")
    ap.add_argument("--one-job", action="store_true", help="all findings in one job, which a failing check ends")
    ap.add_argument("--materialize", action="store_true",
                    help="checkpoint each latest collection before the checks (large fleets)")
    a = ap.parse_args(argv)
    spark = build_session("fleetcheck", shuffle_partitions=a.shuffle_partitions)
    as_of = fleet.as_of_ts(a.as_of)
    unreadable: dict = {e: {} for e in a.engines.split(",")}
    views = {e: fleet.load_views(spark, a.root, e, since=a.since, errors=unreadable[e], as_of=as_of) for e in unreadable}
    views = {e: v for e, v in views.items() if v}
    isolate = a.isolate or not a.one_job
    if isolate:
        built = fleet.build(spark, views, as_of, a.tier, a.materialize)
        errs = fleet.write_findings_isolated(spark, views, as_of, f"{a.out}/findings", a.tier, built)
        errs.write.mode("overwrite").parquet(f"{a.out}/errors")
        f = spark.read.parquet(f"{a.out}/findings")
        ran = fleet.checks_ran(spark, views, as_of, a.tier, unreadable, built)
        failed = errs.select(F.col("check_name").alias("check_id"), F.col("error").alias("_error"))
        ran = ran.join(failed, "check_id", "left").withColumn("error", F.coalesce("error", "_error")).drop("_error")
        from .plans.checks.report import health_summary_of
        summary = health_summary_of(f, spark, ran)
    else:
        f, summary = fleet.fleet_summary(spark, views, as_of, a.tier, out_path=f"{a.out}/findings",
                                         materialize=a.materialize, unreadable=unreadable)
    summary.write.mode("overwrite").parquet(f"{a.out}/summary")
    summary = spark.read.parquet(f"{a.out}/summary")
    priority_rollup(summary).write.mode("overwrite").parquet(f"{a.out}/priorities")
    counts = {r["status"]: r["n"] for r in summary.groupBy("status").count().withColumnRenamed("count", "n").collect()}
    result = {"engines": sorted(views), "findings": f.count(), "checks_normal": counts.get("normal", 0),
              "checks_abnormal": counts.get("abnormal", 0), "checks_failed": counts.get("error", 0)}
    if isolate:
        result["check_errors"] = spark.read.parquet(f"{a.out}/errors").count()
    print(json.dumps(result))
    return result


if __name__ == "__main__":
    main()

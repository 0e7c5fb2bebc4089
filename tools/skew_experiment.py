"""Skew experiment: one key holds a third of all rows.

Builds a skewed copy of the sf0.1 events (replicated REPL times with fresh
event ids; every third event moves to user 0 on one day, so one (day, user)
key holds a third of all rows) in a new scratch folder, then runs
operators on it and reports wall time and the longest task per query (from
Spark's event log). Compares redundant_index's single window (one task per
user-day, so the hot user-day sorts in one task) with the blocked prefix scan.

Usage: python tools/skew_experiment.py [REPL]   (default 60 -> ~6M events)
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from fleetcheck.functions import day_str  # noqa: E402
from fleetcheck.operators import ranking, relations  # noqa: E402
from fleetcheck.operators import time as tops  # noqa: E402
from fleetcheck.session import build_session  # noqa: E402


def max_task_by_group(log_dir):
    stage_group, longest = {}, {}
    for path in glob.glob(f"{log_dir}/**", recursive=True):
        if not os.path.isfile(path):
            continue
        for line in open(path):
            ev = json.loads(line)
            if ev.get("Event") == "SparkListenerJobStart":
                g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in ev.get("Stage IDs", []):
                    stage_group[sid] = g
            elif ev.get("Event") == "SparkListenerTaskEnd":
                info = ev.get("Task Info") or {}
                d = (info.get("Finish Time", 0) - info.get("Launch Time", 0)) / 1000.0
                sid = ev.get("Stage ID")
                longest[sid] = max(longest.get(sid, 0.0), d)
    out = {}
    for sid, d in longest.items():
        g = stage_group.get(sid)
        if g:
            out[g] = max(out.get(g, 0.0), d)
    return out


def main():
    repl = int(sys.argv[1]) if len(sys.argv) > 1 else 60
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    log_dir = f"{scratch}/eventlog"
    os.makedirs(log_dir)
    spark = build_session("skew", master="local[8]", shuffle_partitions=8,
                          extra={"spark.driver.memory": "16g", "spark.eventLog.enabled": "true",
                                 "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false",
                                 "spark.eventLog.rolling.enabled": "false"})
    sc = spark.sparkContext
    ev = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    n = ev.count()
    rep = spark.range(repl).withColumnRenamed("id", "r")
    skewed = ev.crossJoin(rep)  # test-data generation only: REPL copies of the events
    skewed = (skewed.withColumn("event_id", F.col("r") * n + F.col("event_id"))
                    .withColumn("_hot", F.col("event_id") % 3 == 0)
                    .withColumn("user_id", F.when(F.col("_hot"), F.lit(0)).otherwise(F.col("user_id")))
                    # the hot key is one (day, user): every third event moves to user 0 on 2024-01-15
                    .withColumn("ts", F.when(F.col("_hot"), F.to_timestamp_ntz(
                        F.concat(F.lit("2024-01-15 "), F.date_format("ts", "HH:mm:ss")))).otherwise(F.col("ts")))
                    .drop("_hot")
                    .drop("r"))
    path = f"{scratch}/events_skewed"
    skewed.repartition(16).write.parquet(path)
    data = spark.read.parquet(path)
    total = data.count()
    hot = data.filter(F.col("user_id") == 0).count()
    lists = data.select(day_str("ts").alias("day"), "user_id", "event_id", "event_type")
    runs = {
        "redundant_index_window": lambda: relations.redundant_index(lists, ["day"], "user_id", "event_id", "event_type"),
        "redundant_index_blocked": lambda: relations.redundant_index(lists, ["day"], "user_id", "event_id", "event_type",
                                                                     block=65536),
        "hour_matrix": lambda: tops.hour_matrix(data.withColumn("i", F.col("user_id") % 3), "ts", ["i"], 10, 120),
        "latest_per_key": lambda: ranking.latest_per_key(data, ["user_id"], ["ts", "event_id"], ["event_id", "value"]),
        # hot lock key: the hot (day, user) gives ~400k holders and thousands of waiters per event type —
        # a waiter x holder pair join would emit billions of rows; the per-key aggregation does not
        "blocking_pairs": lambda: relations.blocking_pairs(
            data.select("event_id", day_str("ts").alias("day"), "event_type",
                        F.expr("nullif(user_id % 10, 0)").alias("lock_key"), (F.col("value") >= 1).alias("granted")),
            ["day", "event_type", "lock_key"], "event_id", F.col("granted")),
    }
    result = {"rows": total, "hot_key_rows": hot, "queries": {}}
    for name, build in runs.items():
        sc.setJobGroup(name, name)
        t0 = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        result["queries"][name] = {"wall_s": round(time.perf_counter() - t0, 2)}
    spark.stop()
    for name, d in max_task_by_group(log_dir).items():
        if name in result["queries"]:
            result["queries"][name]["longest_task_s"] = round(d, 2)
    print(json.dumps(result))


if __name__ == "__main__":
    main()

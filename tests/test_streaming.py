"""Structured Streaming operators equal their batch twins on the fixture tables."""

import os
import tempfile

from pyspark.sql import functions as F

from fleetcheck.operators import time as tops
from fleetcheck.plans import fixtures
from fleetcheck.streaming import append_snapshots, checkpoint_path, counter_deltas, hour_counts, read_stream

SF = "/root/testdata/sf0.001"


def _run_to_memory(df, name, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
           .option("checkpointLocation", tempfile.mkdtemp(prefix="ckpt-"))
           .trigger(availableNow=True).start())
    q.awaitTermination(300)
    return q


def _events_dir(spark, tmp_path):
    """The streaming file source reads directories: stage the small table as
    four sequential appends of consecutive time ranges (arrival in time order)."""
    import time as _t
    ev = spark.read.parquet(f"{SF}/events.parquet")
    d = str(tmp_path / "events")
    bounds = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-02-01"]
    for lo, hi in zip(bounds, bounds[1:]):
        ev.filter((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.mode("append").parquet(d)
        _t.sleep(0.05)
    return ev, d


def test_hour_counts_stream_matches_batch(spark, tmp_path):
    ev, d = _events_dir(spark, tmp_path)
    src = read_stream(spark, d, ev.schema, max_files_per_trigger=1).withColumn("instance_id", F.col("user_id") % 3)
    _run_to_memory(hour_counts(src, "ts", ["instance_id"], delay="0 seconds"), "hour_counts_t")
    got = spark.sql("select instance_id, day, sum(n) as total from hour_counts_t group by 1, 2")
    batch = tops.hour_matrix(ev.withColumn("instance_id", F.col("user_id") % 3), "ts", ["instance_id"], 10, 120)
    # append mode emits windows closed by the watermark: every hour except the last open one per key
    g = {(r.instance_id, r.day): r.total for r in got.collect()}
    b = {(r.instance_id, r.day): r.total for r in batch.collect()}
    assert set(g) <= set(b)
    assert sum(b.values()) - sum(g.values()) <= 3 * 24
    assert sum(1 for k in g if g[k] == b[k]) >= len(g) - 3


def test_counter_deltas_stream_matches_batch(spark, tmp_path):
    c = fixtures.counters(spark, SF).select("instance_id", "stat", "snap_id", "startup", "value")
    path = str(tmp_path / "counters")
    c.write.mode("overwrite").parquet(path)
    src = read_stream(spark, path, c.schema)
    _run_to_memory(counter_deltas(src, ["instance_id", "stat"], "snap_id", "startup", "value"), "deltas_t")
    got = {(r.instance_id, r.stat, r.snap): r.delta for r in spark.table("deltas_t").collect()}
    from pyspark.sql import Window
    w = Window.partitionBy("instance_id", "stat").orderBy("snap_id")
    exp = c.withColumn("p", F.lag("value").over(w)).withColumn("ps", F.lag("startup").over(w)).withColumn(
        "d", F.when((F.col("ps") == F.col("startup")) & (F.col("value") >= F.col("p")), F.col("value") - F.col("p")))
    want = {(r.instance_id, r.stat, r.snap_id): r.d for r in exp.collect()}
    assert got == want


def test_append_snapshots_foreach_batch(spark, tmp_path):
    ev, d = _events_dir(spark, tmp_path)
    src = read_stream(spark, d, ev.schema, max_files_per_trigger=2).select(
        F.lit("i1").alias("instance_id"), F.col("ts").cast("timestamp").alias("snapshot_ts"), "event_id")
    root = str(tmp_path / "store")
    q = append_snapshots(src, root, "events_view", name=f"t-{os.getpid()}")
    q.awaitTermination(300)
    back = spark.read.parquet(f"{root}/events_view")
    assert back.count() == ev.count()
    assert "snapshot_date" in back.columns
    assert checkpoint_path(spark, "x").endswith("/streams/x")


def test_log_class_counts_stream(spark, tmp_path):
    from fleetcheck.streaming import log_class_counts, read_log_stream
    d = tmp_path / "logs"
    d.mkdir()
    (d / "a.log").write_text("2024-01-30T10:00:01 [ERROR] x\n2024-01-30T10:05:00 [Warning] y\n"
                             "2024-01-30T10:59:59 [ERROR] z\nno timestamp [ERROR]\n")
    (d / "b.log").write_text("2024-01-30T12:00:00 [ERROR] late hour closes the 10:00 window\n")
    classes = [("error", r"\[ERROR\]", "[ERROR]"), ("warning", r"\[Warning\]", "[Warning]")]
    src = read_log_stream(spark, str(d), max_files_per_trigger=1)
    _run_to_memory(log_class_counts(src, classes, delay="0 seconds", part=()), "log_counts_t")
    got = {(r.severity, str(r.hour_start)): r.n for r in spark.table("log_counts_t").collect()}
    assert got == {("error", "2024-01-30 10:00:00"): 2, ("warning", "2024-01-30 10:00:00"): 1}


def test_read_text_files_recursive(spark, tmp_path):
    from fleetcheck.sources import read_text_files
    (tmp_path / "bundle" / "host1").mkdir(parents=True)
    (tmp_path / "bundle" / "host1" / "report.html").write_text("<span id=\"v\">1</span>")
    (tmp_path / "bundle" / "host1" / "os.txt").write_text("kernel\n5.14\n")
    df = read_text_files(spark, str(tmp_path / "bundle"), glob="*.html")
    rows = df.collect()
    assert len(rows) == 1 and rows[0].path.endswith("host1/report.html") and "span" in rows[0].text


def test_hour_matrix_from_streamed_counts_equals_batch(spark, tmp_path):
    from fleetcheck.streaming import hour_matrix_from_counts
    ev, d = _events_dir(spark, tmp_path)
    src = read_stream(spark, d, ev.schema).withColumn("instance_id", F.col("user_id") % 3)
    # a delay covering the whole range keeps every window open; update mode emits running counts
    _run_to_memory(hour_counts(src, "ts", ["instance_id"], delay="400 days"), "hour_counts_u", mode="update")
    counts = spark.sql("select instance_id, day, hour, max(n) as n from hour_counts_u group by 1, 2, 3")
    got = hour_matrix_from_counts(counts, ["instance_id"], 10, 120)
    want = tops.hour_matrix(ev.withColumn("instance_id", F.col("user_id") % 3), "ts", ["instance_id"], 10, 120)
    cols = ["instance_id", "day", "total", "red_cells", "is_abnormal"] + [f"h{h:02d}" for h in range(24)]
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == \
        sorted(tuple(r[c] for c in cols) for r in want.collect())

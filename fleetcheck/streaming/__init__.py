"""Incremental ingest with Structured Streaming.

* ``hour_counts`` — the day x hour matrix as a watermarked event-time
  aggregation: an hour's count is emitted once the watermark passes it
  (append mode), so late rows within the allowed delay are still counted and
  state is dropped afterwards.
* ``counter_deltas`` — cumulative counters -> per-snapshot deltas as a custom
  stateful operator (``applyInPandasWithState``): the state per (instance,
  statistic) is the last (snap, startup, value); a restart (new startup) or a
  counter reset yields NULL instead of a negative delta, matching
  ``operators.perf.snapshot_delta``.
* ``log_class_counts`` — error/alert log lines as they arrive: leading
  timestamp parsed, lines classified by the guarded regex classes, counted
  per (source, class, hour) with a watermark (the incremental form of the
  log_severity / log_fingerprint totals).
* ``append_snapshots`` — a ``foreachBatch`` sink appending each micro-batch
  to the date-partitioned snapshot store (idempotent per batch id).

Checkpoints live under the session's ``spark.checkpoint.dir`` (a shared,
fault-tolerant folder on a cluster), so a restarted query resumes exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ensure_checkpoint_dir


def checkpoint_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def hour_counts(events: DataFrame, ts: str, part: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """Per (part, hour window) event counts with a watermark on ``ts``.
    The batch matrix (``operators.time.hour_matrix``) is a pivot of these rows."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need TIMESTAMP (session TZ = UTC)
    return (events.withWatermark(ts, delay)
                  .groupBy(*part, F.window(ts, "1 hour").alias("w"))
                  .agg(F.count("*").alias("n"))
                  .select(*part, F.date_format("w.start", "yyyy-MM-dd").alias("day"),
                          F.hour("w.start").alias("hour"), "n"))


def read_log_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """New log files under ``path`` as (source, line) rows."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"))


def log_class_counts(lines: DataFrame, classes, delay: str = "1 hour", line: str = "line",
                     part=("source",)) -> DataFrame:
    """Per (part, class, hour window) line counts of classified log lines."""
    from ..functions import first_match
    from ..sources import parse_log_lines
    df = (parse_log_lines(lines, line).withColumn("ts", F.col("ts").cast("timestamp"))
          .withColumn("severity", first_match(line, classes)).filter(F.col("severity").isNotNull()
                                                                   & F.col("ts").isNotNull()))
    return (df.withWatermark("ts", delay)
              .groupBy(*part, "severity", F.window("ts", "1 hour").alias("w"))
              .agg(F.count("*").alias("n"))
              .select(*part, "severity", F.col("w.start").alias("hour_start"), "n"))


def hour_matrix_from_counts(counts: DataFrame, part: Sequence[str], cell_red: float, total_red: float) -> DataFrame:
    """Batch view over the streamed (part, day, hour, n) rows: the same day x
    hour matrix and verdicts as ``operators.time.hour_matrix`` (one
    conditional aggregate per (part, day))."""
    cells = [F.sum(F.when(F.col("hour") == h, F.col("n")).otherwise(0)).cast("bigint").alias(f"h{h:02d}")
             for h in range(24)]
    out = counts.groupBy(*part, "day").agg(*cells, F.sum("n").cast("bigint").alias("total"))
    red_cells = sum((F.col(f"h{h:02d}") > cell_red).cast("int") for h in range(24))
    return out.withColumn("red_cells", red_cells).withColumn("is_abnormal", F.col("total") > total_red)


DELTA_SCHEMA = "snap long, startup long, value long, delta long"
STATE_SCHEMA = "snap long, startup long, value long"


def _delta_fn(keys: Sequence[str]):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        last = state.get if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values("snap")
        out = []
        for snap, startup, value in zip(rows["snap"], rows["startup"], rows["value"]):
            if last is not None and snap <= last[0]:
                continue  # replayed or late snapshot: already accounted for
            d = None
            if last is not None and startup == last[1] and value >= last[2]:
                d = int(value - last[2])
            out.append((*key, int(snap), int(startup), int(value), d))
            last = (int(snap), int(startup), int(value))
        if last is not None:
            state.update(last)
        cols = list(keys) + ["snap", "startup", "value", "delta"]
        yield pd.DataFrame(out, columns=cols).astype({"delta": "Int64"}) if out else pd.DataFrame(columns=cols)
    return fn


def counter_deltas(counters: DataFrame, keys: Sequence[str], snap: str, startup: str, value: str) -> DataFrame:
    """Stateful per-key deltas of cumulative counters across micro-batches.
    State is one small row per key; input is grouped by key, so the work is
    partitioned by (instance, statistic)."""
    keys = list(keys)
    key_ddl = ", ".join(f"{k} {t}" for k, t in counters.select(*keys).dtypes)
    src = counters.select(*keys, F.col(snap).cast("long").alias("snap"), F.col(startup).cast("long").alias("startup"),
                          F.col(value).cast("long").alias("value"))
    return src.groupBy(*keys).applyInPandasWithState(
        _delta_fn(keys), f"{key_ddl}, {DELTA_SCHEMA}", STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def append_snapshots(df: DataFrame, root: str, view: str, name: str | None = None, trigger: dict | None = None):
    """Start a streaming query appending micro-batches to ``root/view``
    partitioned by snapshot_date. Re-delivered batch ids overwrite their own
    folder (``batch_id`` partition) so a retried batch is not duplicated."""
    spark = df.sparkSession

    def write(batch: DataFrame, batch_id: int):
        (batch.withColumn("snapshot_date", F.to_date("snapshot_ts")).withColumn("batch_id", F.lit(batch_id))
              .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy("snapshot_date", "batch_id").parquet(f"{root}/{view}"))

    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path(spark, name or view))
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()

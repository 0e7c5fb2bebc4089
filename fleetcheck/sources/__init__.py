"""Readers: parquet snapshot tables, fixture tables, text (logs, OS dumps,
report HTML) and JDBC extracts. All return lazy DataFrames; filters and
column selections applied later reach the parquet scan (pushdown/pruning)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import align, write_snapshots

FIXTURE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                  "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver fixture table ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Lazy accessor: ``Tables(spark, dir).orders`` reads orders.parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURE_TABLES:
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def read_snapshots(spark: SparkSession, root: str, view: str, since: str | None = None,
                   until: str | None = None, engine: str | None = None,
                   schema=None) -> DataFrame:
    """A catalog view's snapshots, stored as parquet partitioned by
    ``snapshot_date`` (and carrying ``instance_id, engine, snapshot_ts``).
    Date bounds become partition filters. ``schema``: the declared columns, so
    that files of older collections give NULL for columns they lack."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.option("basePath", f"{root}/{view}").parquet(f"{root}/{view}")
    if since is not None:
        df = df.filter(F.col("snapshot_date") >= F.lit(since).cast("date"))
    if until is not None:
        df = df.filter(F.col("snapshot_date") <= F.lit(until).cast("date"))
    if engine is not None:
        df = df.filter(F.col("engine") == engine)
    return df


def read_text_files(spark: SparkSession, path: str, whole: bool = True, recursive: bool = True,
                    glob: str | None = None) -> DataFrame:
    """Text files -> (path, text) with whole files (OS dumps, report HTML), or
    (path, line) per line for big logs (splittable). Collector bundles are
    unpacked upstream; ``recursive`` walks the unpacked tree, ``glob`` keeps
    e.g. ``*.html`` only."""
    r = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    if whole:
        return (r.option("wholetext", "true").text(path)
                .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    return r.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def read_log_lines(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """Lines of log files with their places: (path, split, at, line). Files are split; ``split`` is where a piece begins
    in its file and ``at`` rises within it, so (split, at) is a file's order (``operators.text.record_lines``)."""
    r = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
                               F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


# Log timestamp shapes (ISO, and 'Mon dd hh:mm:ss yyyy' with
# an optional leading weekday) accepted by ``parse_log_lines``.
LOG_TS_ISO = r"^\s*\[?(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})"
LOG_TS_TEXT = r"^\s*(?:[A-Z][a-z]{2} )?([A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2} \d{4})"


def parse_log_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``ts`` parsed from either leading timestamp form (NULL otherwise)."""
    iso = F.regexp_extract(F.col(line), LOG_TS_ISO, 1)
    txt = F.regexp_replace(F.regexp_extract(F.col(line), LOG_TS_TEXT, 1), " +", " ")
    ts = F.coalesce(F.try_to_timestamp(F.regexp_replace(iso, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")),
                    F.try_to_timestamp(txt, F.lit("MMM d HH:mm:ss yyyy")))
    return lines.withColumn("ts", ts.cast("timestamp_ntz"))


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 8,
              fetchsize: int = 500, properties: dict | None = None) -> DataFrame:
    """Live pull of a catalog view over JDBC, split into ``num_partitions``
    range reads on ``partition_column`` so executors fetch in parallel."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetchsize)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
              .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()


def with_envelope(df: DataFrame, instance_id: Column | str, engine: str, snapshot_ts: Column | str) -> DataFrame:
    """Attach the ``(instance_id, engine, snapshot_ts)`` envelope."""
    i = F.lit(instance_id) if isinstance(instance_id, str) else instance_id
    t = F.lit(snapshot_ts).cast("timestamp") if isinstance(snapshot_ts, str) else snapshot_ts
    return df.select(i.alias("instance_id"), F.lit(engine).alias("engine"), t.alias("snapshot_ts"), "*")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def jdbc_frames(spark: SparkSession, url: str, queries: dict, properties: dict | None = None,
                partitioning: dict | None = None) -> dict:
    """One DataFrame per catalog view, pulled live over JDBC. ``queries``
    maps view -> SQL text run by the inspected database (supplied by the
    caller); ``partitioning`` maps view -> (column, lower, upper, n) for
    parallel range reads of the large views."""
    out = {}
    for view, sql in queries.items():
        part = (partitioning or {}).get(view)
        kw = dict(partition_column=part[0], lower=part[1], upper=part[2], num_partitions=part[3]) if part else {}
        out[view] = read_jdbc(spark, url, f"({sql}) q", properties=properties, **kw)
    return out


def collect_views(frames: dict, root: str, engine: str, instance_id: str, snapshot_ts: str) -> list:
    """Write one collection of an instance's views to the snapshot store
    (``root/{engine}/{view}``, partitioned by date and slice), adding the
    envelope and the declared types. Collecting again replaces it; a view
    without rows is known as empty. Returns the views written."""
    written = []
    for view, df in frames.items():
        spark = df.sparkSession
        taken = with_envelope(spark.range(1), instance_id, engine, snapshot_ts).drop("id")
        rows = align(with_envelope(df, instance_id, engine, snapshot_ts), engine, view)
        write_snapshots(rows, f"{root}/{engine}", view, taken)
        written.append(view)
    return written

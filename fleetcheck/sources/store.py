"""The snapshot store: catalog views written collection by collection, and the newest collection of each instance.

``root/{view}/snapshot_date=.../slice=...`` holds the rows of a view; a slice is one collection of one instance
(instance and instant). ``root/collections/view=.../snapshot_date=.../slice=...`` holds one line for each: when it
was taken and how many rows it has, none included. Both are written under dynamic partition overwrite, so that a
collection written again replaces itself and nothing else, whichever other instances share its date.

What is newest is read from the lines alone. They give the dates, which become static partition filters, and the
slices, which prune the view's partitions at run time; rows of older collections are never read. An instance whose
newest collection of a view is empty has no current rows, however many an older one had.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import ENVELOPE, VIEWS, schema

PARTITIONS = "snapshot_date date, slice string"
LINES = f"{ENVELOPE}, n_rows bigint, write_id string, view string, {PARTITIONS}"
MAX_BROADCAST = 500_000  # newest collections of one view that are sent to all tasks; more are joined by shuffle
MAX_DATES = 5_000  # distinct newest dates that become a list in the filter; more become a range


def _dated(df: DataFrame) -> DataFrame:
    slice_ = F.concat_ws("@", F.coalesce("instance_id", F.lit("")), F.unix_micros("snapshot_ts").cast("string"))
    return df.withColumn("snapshot_date", F.to_date("snapshot_ts")).withColumn("slice", slice_)


def _replace(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("snapshot_date", "slice").parquet(path))


def align(df: DataFrame, engine: str, view: str) -> DataFrame:
    """The declared columns in their declared types, missing ones as NULL; an undeclared view as it is."""
    if view not in VIEWS.get(engine, {}):
        return df
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema(engine, view).fields])


def write_snapshots(df: DataFrame, root: str, view: str, taken: DataFrame | None = None) -> None:
    """Write whole collections of a view (rows with the envelope), replacing those written before.

    ``taken``: (instance_id, engine, snapshot_ts) of all collections in the rows, so that those without rows are
    known as empty. Rows are dealt by slice and large slices are split, so files are few and a hot instance is no task.
    """
    spark, write_id = df.sparkSession, uuid.uuid4().hex
    # With ``taken`` the rows' source, a live database maybe, is read once.
    first, last = (df if taken is None else taken).agg(F.to_date(F.min("snapshot_ts")), F.to_date(F.max("snapshot_ts"))).first()
    _replace(_dated(df).withColumn("write_id", F.lit(write_id)).hint("rebalance", "snapshot_date", "slice"), f"{root}/{view}")
    written = spark.createDataFrame([], f"{ENVELOPE}, n_rows bigint")
    if first is not None:
        back = spark.read.schema(f"{ENVELOPE}, write_id string, {PARTITIONS}").parquet(f"{root}/{view}")
        back = back.filter(F.col("snapshot_date").between(first, last) & (F.col("write_id") == write_id))
        written = back.groupBy("instance_id", "engine", "snapshot_ts").agg(F.count("*").alias("n_rows"))
    if taken is not None:
        known = written.select(F.col("instance_id").alias("_i"), F.col("snapshot_ts").alias("_t"))
        empty = taken.select("instance_id", "engine", "snapshot_ts").distinct().join(
            known, F.col("instance_id").eqNullSafe(F.col("_i")) & (F.col("snapshot_ts") == F.col("_t")), "left_anti")
        written = written.unionByName(empty.withColumn("n_rows", F.lit(0).cast("bigint")))
    lines = _dated(written).withColumn("write_id", F.lit(write_id))
    _replace(lines.hint("rebalance", "snapshot_date"), f"{root}/collections/view={view}")


def collections(spark: SparkSession, root: str) -> DataFrame:
    """One line for each (view, instance, instant) in the store; none where nothing was registered."""
    sch = StructType.fromDDL(LINES)
    try:
        return spark.read.schema(sch).option("basePath", f"{root}/collections").parquet(f"{root}/collections")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], sch)


def newest_collections(lines: DataFrame, as_of: Column) -> DataFrame:
    """The newest line at or before ``as_of`` of each (view, instance); one partial aggregate, no row of a view read."""
    held = lines.filter((F.col("snapshot_date") <= F.to_date(as_of)) & (F.col("snapshot_ts") <= as_of))
    last = held.groupBy("view", "instance_id").agg(
        F.max_by(F.struct("snapshot_ts", "snapshot_date", "slice", "n_rows"), "snapshot_ts").alias("_last"))
    return last.select("view", "instance_id", "_last.*")


class Views(dict):
    """Views of one engine by name, with the newest collections of all of them and the dates these fall on."""

    def __init__(self, views: dict[str, DataFrame], newest: DataFrame | None = None):
        super().__init__(views)
        self.newest, self._at = newest, {}
        if newest is not None:
            # One line a view: how many collections are newest there, and their days.
            held = newest.filter(F.col("n_rows") > 0).groupBy("view").agg(
                F.count("*").alias("n"), F.collect_set("snapshot_date").alias("dates"))
            self._at = {r["view"]: (r["n"], sorted(r["dates"])) for r in held.collect()}

    def registered(self, name: str) -> bool:
        return self.newest is not None and "slice" in self[name].columns

    def current(self, name: str) -> DataFrame:
        """Rows of each instance's newest collection of a view: one scan, pruned to the newest dates and slices."""
        n, dates = self._at.get(name, (0, []))
        df = self[name]
        if not dates:
            return df.filter(F.lit(False))
        day = F.col("snapshot_date")
        df = df.filter(day.isin(dates) if len(dates) <= MAX_DATES else day.between(dates[0], dates[-1]))
        last = self.newest.filter((F.col("view") == name) & (F.col("n_rows") > 0)).select("snapshot_date", "slice")
        return df.join(F.broadcast(last) if n <= MAX_BROADCAST else last, ["snapshot_date", "slice"], "left_semi")

"""Helpers shared by the operators: shared scratch tables and shipping the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _SCRATCH.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="run-", dir="/tmp"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a reliable cut of the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def workers_ready(spark: SparkSession) -> None:
    """Make this package importable in Python workers, and bound the bytes of an Arrow batch.

    Rows of text are long, so a batch is bounded by rows and bytes; neither bound changes a result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "fleetcheck_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.write(os.path.join(top, "__init__.py"), "fleetcheck/__init__.py")
        here = os.path.join(top, "llm")
        for f in sorted(os.listdir(here)):
            if f.endswith(".py"):
                z.write(os.path.join(here, f), f"fleetcheck/llm/{f}")
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(df: DataFrame, column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def free_name(columns, name: str) -> str:
    """A column name that is none of columns."""
    while name in columns:
        name += "_"
    return name


def apart(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns of df under names c0, c1..., which no column of an operator has; ``together`` gives the names back."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])


def together(columns: list[str]):
    """The columns that ``apart`` renamed, under their own names."""
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

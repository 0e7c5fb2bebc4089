"""SparkSession construction and cluster-safe settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job wants. AQE re-plans joins from runtime sizes (a side
# only becomes a broadcast when its *measured* size is under the threshold),
# coalesces small shuffle partitions and splits skewed join partitions.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "fleetcheck", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if (spark.sparkContext.master or "").startswith("local") or spark.conf.get("spark.checkpoint.dir", None):
        ensure_checkpoint_dir(spark)  # on a cluster, enforced where a checkpoint is actually taken
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared, fault-tolerant folder and is
    used as is (and must be set: a cluster run without it fails fast). Only
    in local mode with the setting unset (local runs, tests) a scratch folder
    is created so that ``DataFrame.checkpoint()`` works.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster run needs a shared, fault-tolerant "
                               "folder for checkpoints (a machine-local folder would be lost with its executor)")
        d = tempfile.mkdtemp(prefix="fleetcheck-ckpt-")  # local mode / tests only
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def local_session(cores: int | None = None) -> SparkSession:
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return build_session(master=f"local[{cores}]", shuffle_partitions=cores,
                         extra={"spark.driver.memory": "16g"})

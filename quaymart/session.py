"""Session helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import SparkSession

# Settings this library relies on. They are hints for a new session only: a cluster's own
# values (executor memory, shuffle partitions) win because an existing session is reused.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g",
                  app: str = "quaymart") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """A folder, not yet made, in the shared space the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine may do without that setting and gets a temporary folder; on a
    cluster every executor would write to a disk of its own, so that is an error.
    """
    shared_space = spark.conf.get("spark.checkpoint.dir", None)
    if shared_space:
        return f"{shared_space.rstrip('/')}/quaymart-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.mkdtemp(prefix='run-', dir=os.environ.get('TMPDIR', '/tmp'))}/data"


def durable(df):
    """Cut the lineage of ``df`` by a reliable checkpoint that outlives a lost executor.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is
    unset, as in local tests, a temporary folder is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or scratch_folder(spark))
    return df.checkpoint(eager=True)


def written(df):
    """``df`` as a table in the shared folder, read back: computed once and safe from lost executors."""
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def delete_folder(spark, folder: str) -> None:
    """Delete a folder that ``scratch_folder`` named, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release_shuffles(df) -> None:
    """Have Spark delete the shuffle files of steps that are over.

    It does so once the driver's plans of them are collected, and a driver with free memory may not collect for hours.
    Shuffles that a living frame can still read are kept.
    """
    gc.collect()
    df.sparkSession._jvm.System.gc()


def shared(df):
    """Keep a compact intermediate that several branches of one plan read.

    Used only for folded tables (items, item-days, cubes), never for raw rows. Blocks spill to
    disk and are recomputed from their lineage when an executor is lost.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)

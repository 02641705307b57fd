"""What operators need from the session: a shared folder and lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    temporary one where it is unset on a single machine, as in tests. On a
    cluster an unset folder is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}_{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks(df: DataFrame, rows: int, each: int = 256) -> int:
    """How many tasks share so many rows, of which each takes milliseconds of
    Python. Spark joins small partitions by their bytes, which say nothing about
    such work; repartition with this number keeps them apart."""
    return max(df.sparkSession.sparkContext.defaultParallelism, min(rows // each, 10_000))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any
    more: its cleaner follows the driver's garbage collections, which are rare
    where the driver has little to do, as in loops over small frames."""
    gc.collect()
    spark._jvm.System.gc()


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of fresh_path that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

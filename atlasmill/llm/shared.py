"""Folders that the driver and all executors share, and tables stored in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and Spark runs in one process, a new temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base if "://" in base or base.startswith("file:") else f"file://{base}"


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor loses nothing."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() made and nothing reads any more, and lets Spark drop the shuffles of finished jobs."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t.stored_path
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    if tables:
        drop_shuffles(tables[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs: it cleans up after plans that nothing refers to."""
    spark._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, as a number of groups that keeps all its cores busy."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

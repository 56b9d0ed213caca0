"""Tables in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; on a cluster, where executors could
    not read what others wrote to their own disks, that is an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, where the session is still there."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; whoever owns the shared folder clears it
        pass


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    atexit.register(removed, spark, path)
    return path


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """df written once and read again: for results that several parts of a plan use; cuts lineage and survives the loss of executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes in fewer partitions than there are, as a small file does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def held(df: DataFrame) -> DataFrame:
    """df computed once and held by the driver as a local table, for results bounded by the batch of queries (a few rows for each): joins with it
    need no stage of their own."""
    return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)

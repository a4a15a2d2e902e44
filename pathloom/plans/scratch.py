"""Folders for tables that a query writes on its way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where spark.checkpoint.dir says, deleted when the driver ends; a local one only where Spark itself is local and none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="pathloom-")
        # local Spark alone: nobody else reads it, so it goes with the process
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    path = f"{shared}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the folder of spark.checkpoint.dir, partitions and their order kept; one of our own only as in scratch()."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or scratch(spark, "checkpoints"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written once and read again, for what is read several times; a checkpoint would be computed twice."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Tables in the folder that driver and executors share, for results that several steps read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; where that is unset and all runs in one
    process, under a folder of our own. It goes when the driver's JVM ends."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.barloom.store", None)
    if not at:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="barloom-store-")
        spark.conf.set("spark.barloom.store", at)
    home = f"{at.rstrip('/')}/store-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return home


def settled(df: DataFrame) -> DataFrame:
    """df written once and read back: later steps read files that survive a lost executor, and plans stay short."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

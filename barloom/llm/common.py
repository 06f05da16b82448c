"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and U+0009 to U+000D (fixed value).
SPACE = r"[\x20\x09-\x0D]"
NON_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where
    it is unset and all runs in one process. On a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.conf.get("spark.barloom.shared.dir", None)
        if not at:
            if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            at = "file://" + tempfile.mkdtemp(prefix="barloom-")
            spark.conf.set("spark.barloom.shared.dir", at)
    return at.rstrip("/") if "://" in at else "file://" + os.path.abspath(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder under the shared one. The folder goes when the
    driver's JVM ends."""
    home = f"{shared_dir(spark)}/barloom-{spark.sparkContext.applicationId}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        fs.mkdirs(target)
        fs.deleteOnExit(target)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back. Cuts lineage; files
    survive the loss of an executor, and their size is known to the planner."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.barloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote, when nothing reads it any more."""
    spark, path = df.sparkSession, df.barloom_path
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names near the given ones that df doesn't have (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        n = f"__{name}"
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def free_name(df: DataFrame, name: str, carry: tuple[str, ...] | None = None) -> str:
    """The name of a result column: the given one, or with underscores before it if df (of which
    only carry stays) has that."""
    taken = {c.lower() for c in (df.columns if carry is None else carry)}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, whatever path the driver has."""
    sc = spark.sparkContext
    if getattr(sc, "_barloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    d = tempfile.mkdtemp(prefix="barloom-code-")  # the driver serves the file until it ends
    atexit.register(shutil.rmtree, d, True)
    stage = os.path.join(d, "stage")
    shutil.copytree(os.path.join(root, "barloom"), os.path.join(stage, "barloom"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(d, f"barloom-{uuid.uuid4().hex}"), "zip", stage))
    sc._barloom_shipped = True


def open_fs(uri: str):
    """(pyarrow filesystem, path) of a URI in the shared folder, on driver or executor."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def text_of(col: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def scan_partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))

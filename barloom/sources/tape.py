"""Tapes: bars by (symbol, datetime), and the files they come from and go to."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.chunks import numbered

TAPE_SCHEMA = T.StructType([
    T.StructField("datetime", T.TimestampType()), T.StructField("symbol", T.StringType()),
    *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_from_ticks(ticks: DataFrame, symbol: str, ts: str, price: str, width: str) -> DataFrame:
    """OHLCV bars of a tick table. One shuffle: all aggregates have partial forms."""
    return (
        ticks.groupBy(F.col(symbol).alias("symbol"), F.window(ts, width).start.alias("datetime"))
        .agg(F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.sum(price).alias("volume"), F.count("*").alias("ticks"))
    )


def with_bar_index(tape: DataFrame) -> DataFrame:
    """bar: 0-based place of a row within its symbol."""
    return numbered(tape, "bar")


def event_bars(spark: SparkSession, sf_dir: str, width: str = "4 hours") -> DataFrame:
    return with_bar_index(bars_from_ticks(table(spark, sf_dir, "events"), "event_type", "ts", "value", width))


def read_csv(spark: SparkSession, path: str, schema: T.StructType = TAPE_SCHEMA, columns: list[str] | None = None) -> DataFrame:
    """A tape file with its schema given; columns prunes the scan."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.select(*columns) if columns else df


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Header only."""
    return spark.read.option("header", True).csv(path).columns


def same_place(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two paths lead to one place, or one to a place within the other: URIs are completed, local links followed."""

    def whole(path: str) -> str:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
        return "file:" + os.path.realpath(uri.removeprefix("file:")) if uri.startswith("file:") else uri.rstrip("/")

    x, y = whole(a), whole(b)
    return x == y or x.startswith(y + "/") or y.startswith(x + "/")


def write_csv(df: DataFrame, path: str, overwrite_source: str | None = None) -> None:
    if overwrite_source and same_place(df.sparkSession, path, overwrite_source):
        raise ValueError("an enriched tape never overwrites its source")
    df.write.mode("overwrite").csv(path, header=True)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder, partitioned by column split: a reader of one split prunes the rest."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def append_ledger(spark: SparkSession, record: dict, path: str) -> None:
    """One canonical JSON line for each run."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def dataset_manifest(tape: DataFrame) -> DataFrame:
    """rows, first and last time, and the symbols of a tape."""
    return tape.agg(F.count("*").alias("n_rows"), F.min("datetime").alias("first_ts"), F.max("datetime").alias("last_ts"), F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"))


def file_manifest(spark: SparkSession, path: str, tape: DataFrame) -> dict:
    """dataset_manifest() with the bytes and the SHA-256 of the files: of one file its own, of
    several that of their hashes in order of the names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", "length", F.sha2("content", 256).alias("sha"))
    one = files.agg(F.sum("length").alias("bytes"), F.count("*").alias("files"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha"))), lambda x: x.sha), "").alias("all"))
    row = one.first()
    sha = row["all"] if row["files"] == 1 else hashlib.sha256(row["all"].encode()).hexdigest()
    return dataset_manifest(tape).first().asDict() | {"path": path, "bytes": row["bytes"], "sha256": sha}

"""Sinks. Spark writes directories of part files, committed per job."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


MONTH = "month"


def write_table(df: DataFrame, path: str, overwrite: bool = True, partition_by: str | None = None) -> str:
    """zstd parquet; with ``overwrite=False`` an existing table is left as it is."""
    writer = df.write.mode("overwrite" if overwrite else "ignore").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return path


def bucketed_name(path: str) -> str:
    """The catalog's name for a bucketed table at a path."""
    return f"halocline_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}"


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> str:
    """Parquet in ``buckets`` files by a hash of ``keys``, sorted by them; see ``readers.bucketed``.

    The one shuffle of a table happens here. Joins and groups on the keys later find the rows in place.
    """
    spark, name = df.sparkSession, bucketed_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.repartition(buckets, *keys).write.mode("overwrite").option("compression", "zstd").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    return path


def write_months(df: DataFrame, path: str, day: str = "install_date") -> str:
    """Parquet partitioned by the month of ``day``; only the months that ``df`` holds are replaced, others stay as they are."""
    months = df.withColumn(MONTH, F.trunc(F.col(day), "MM")).hint("rebalance", F.col(MONTH))
    writer = months.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    writer.partitionBy(MONTH).parquet(path)
    return path


def write_summary_csv(df: DataFrame, path: str) -> str:
    """CSV with a header, one file, for summary tables. The table is made by many tasks and only written by one."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_split(df: DataFrame, path: str, split_column: str = "split") -> dict[str, DataFrame]:
    """Write the table once, partitioned by its split label, and return lazy views of it.

    Reading one split prunes to its directory, so train and test need no second
    write; they come back without the label.
    """
    write_table(df, path, partition_by=split_column)
    full = df.sparkSession.read.parquet(path)
    parts = {
        name: full.filter(F.col(split_column) == name).drop(split_column) for name in ("train", "test")
    }
    return {"full": full, **parts}


def ingest(spark: SparkSession, datasets: Mapping[str, Mapping[str, str]], overwrite: bool = True) -> list[str]:
    """Copy each dataset that names a ``remote`` parquet path to its ``local`` path, by month if it names a ``day`` column."""
    copied = []
    for name, entry in datasets.items():
        if entry.get("remote"):
            rows = spark.read.parquet(entry["remote"])
            if entry.get("day"):
                write_months(rows, entry["local"], entry["day"])
            else:
                write_table(rows, entry["local"], overwrite=overwrite)
            copied.append(name)
    return copied


def staged(path: str) -> Callable[[DataFrame], DataFrame]:
    """A step for plans that read an intermediate table twice: write it, go on from the files.

    ``path`` lies on shared storage, so the rows outlive any executor.
    """

    def step(df: DataFrame) -> DataFrame:
        return df.sparkSession.read.parquet(write_table(df, path))

    return step

"""Shared helpers: batch maps over (key, text) columns and tables in the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: words are runs of anything but these bytes, which is what
#: ``bytes.split()`` does to UTF-8.
SPACE = rb"[\x20\x09-\x0D]+"

Batches = Iterator[pa.RecordBatch]


def map_batches(df: DataFrame, fn: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``mapInArrow`` on named columns; ``fn`` sees record batches of one partition."""
    return df.mapInArrow(fn, schema)


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under names that nothing else uses."""
    return df.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t"))


def raw_texts(batch: pa.RecordBatch, name: str = "t") -> list[bytes]:
    """UTF-8 of a text column; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def str_texts(batch: pa.RecordBatch, name: str = "t") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def id_type(df: DataFrame, id_col: str) -> str:
    """DDL type of the id column, kept as it is in every result."""
    return df.schema[id_col].dataType.simpleString()


def batch_of(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; where that is unset, a local folder, which only a local master can use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = given.get() if given.isDefined() else None
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="halocline-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/halocline-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """The table after a round trip through the shared folder: lineage ends there, and any executor can read it."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return reread(df, path), path


def reread(df: DataFrame, path: str) -> DataFrame:
    """What is at ``path`` now, with the columns of ``df``; also where no file is left."""
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made and nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

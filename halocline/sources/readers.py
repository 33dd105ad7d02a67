"""Scans. Everything is lazy; projections and filters reach the parquet reader."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.sources.sinks import MONTH, bucketed_name

BASE_SOURCE = "installs"


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet at any Hadoop path (``s3a://``, ``hdfs://``, local), optionally projected."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_window(spark: SparkSession, path: str, date_from, date_to, day: str = "install_date") -> DataFrame:
    """Rows of a half-open date window; of a table by months (``sinks.write_months``) only the window's months are listed."""
    low, high = [dt.date.fromisoformat(str(x)) for x in (date_from, date_to)]
    df = spark.read.parquet(path)
    rows = df.filter((F.col(day) >= F.lit(low)) & (F.col(day) < F.lit(high)))
    if MONTH not in df.columns:
        return rows
    last = (high - dt.timedelta(days=1)).replace(day=1)
    return rows.filter(F.col(MONTH).between(F.lit(low.replace(day=1)), F.lit(last))).drop(MONTH)


def bucketed(spark: SparkSession, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """A table that ``sinks.write_bucketed`` made, also in a session whose catalog has not seen it."""
    name = bucketed_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def scan_nanos(spark: SparkSession, path: str, time_columns: Sequence[str]) -> DataFrame:
    """Parquet written with nanosecond timestamps, as some dataframe libraries do.

    Spark reads those only as longs, and only with the session switch
    ``spark.sql.legacy.parquet.nanosAsLong`` on, which the caller sets.
    """
    df = spark.read.parquet(path)
    return df.withColumns(
        {
            c: F.timestamp_micros(F.floor(F.col(c) / 1000).cast("bigint")).cast("timestamp_ntz")
            for c in time_columns
            if dict(df.dtypes)[c] == "bigint"
        }
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its own file system, local or remote."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm_path)


def ordered_feature_scans(
    spark: SparkSession, paths: Mapping[str, str], base: str = BASE_SOURCE,
    read: Callable[[SparkSession, str], DataFrame] = scan,
) -> dict[str, DataFrame]:
    """Feature tables by name with the join base first; a missing path or base raises."""
    if base not in paths:
        raise KeyError(f"no path is given for the join base '{base}'")
    for name, path in paths.items():
        if not path_exists(spark, path):
            raise FileNotFoundError(f"'{path}', the table of source '{name}', does not exist")
    order = [base, *[n for n in paths if n != base]]
    return {name: read(spark, paths[name]) for name in order}

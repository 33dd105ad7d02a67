"""Views of an order star schema as the seven marketing sources (see FIXTURES.md).

An order is an install, its line items are the user's events. Used by the
registered queries and by the benchmark.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from halocline.operators.costs import COST_KEYS

TRAIN_START, TEST_START, TEST_END = "1995-01-01", "2000-07-01", "2001-07-01"


_schemas: dict[tuple[str, int, int], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by path. Its footer is read once per version of the path: queries here open the same few tables many times."""
    path = f"{sf_dir}/{name}.parquet"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target)
    version = (status.getPath().toString(), status.getModificationTime(), status.getLen())
    if version not in _schemas:
        _schemas[version] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[version]).parquet(path)


def _orders(spark: SparkSession, sf_dir: str, grain: str) -> DataFrame:
    organic = F.col("c_mktsegment") == "BUILDING"
    none = F.lit(None).cast("string")
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("o_orderkey").alias("match_id"),
            F.date_trunc(grain, "o_orderdate").cast("date").alias("install_date"),
            F.when(F.col("o_orderpriority") < "3", "ios").otherwise("android").alias("platform"),
            F.when(organic, "organic").otherwise(F.lower("c_mktsegment")).alias("media_source"),
            F.col("r_name").alias("country_code"),
            F.when(~organic, F.col("o_orderstatus")).alias("campaign"),
            none.alias("af_adset"),
            none.alias("af_ad"),
            F.col("o_totalprice").alias("_price"),
        )
    )


def installs(spark: SparkSession, sf_dir: str, grain: str = "quarter") -> DataFrame:
    return _orders(spark, sf_dir, grain).drop("_price")


def events(spark: SparkSession, sf_dir: str, flag: str, grain: str = "quarter") -> DataFrame:
    """Long events: user key, time, amount, day offset."""
    offset = ((F.col("l_linenumber") * 3 + F.col("l_partkey")) % 12).cast("int")
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), F.date_trunc(grain, "o_orderdate").cast("date").alias("install_date")
    )
    start = F.date_add("install_date", offset).cast("timestamp_ntz")
    time = F.timestamp_add("MINUTE", (F.col("l_suppkey") % 1440).cast("int"), start)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("match_id"),
        "install_date",
        time.alias("time"),
        F.col("l_extendedprice").alias("amount"),
        offset.alias("day"),
    )


def costs(spark: SparkSession, sf_dir: str, grain: str = "quarter") -> DataFrame:
    """Cost rows; money is summed in whole cents, so that rounding does not depend on the order."""
    organic = F.col("media_source") == "organic"
    n = F.count(F.lit(1))
    return (
        _orders(spark, sf_dir, grain)
        .groupBy(*COST_KEYS)
        .agg(F.sum(F.round(F.col("_price") * 100).cast("bigint")).alias("_cents"), n.alias("installs"))
        .select(
            *COST_KEYS,
            F.when(organic, 0.0).otherwise(F.expr("(_cents + 500) div 1000") / 100.0).alias("spend"),
            "installs",
            (F.col("installs") * 20).alias("clicks"),
            F.when(F.col("campaign") == "P", 0).otherwise(F.col("installs") * 1000).alias("impressions"),
        )
    )


def sessions(spark: SparkSession, sf_dir: str, grain: str = "quarter") -> DataFrame:
    """One row per user with session events; a day without any is null."""
    ev = events(spark, sf_dir, "N", grain)
    days = [
        F.nullif(F.count(F.when(F.col("day") == d, 1)), F.lit(0)).cast("double").alias(f"sessions_{d}")
        for d in range(8)
    ]
    total = F.count(F.when(F.col("day").between(0, 7), 1)).cast("double").alias("n_sessions_total")
    return ev.groupBy("match_id", "install_date").agg(*days, total)


def user_list(spark: SparkSession, sf_dir: str, grain: str = "quarter") -> DataFrame:
    """Keys only, for the device and personal sources."""
    return installs(spark, sf_dir, grain).select("match_id", "install_date")


SOURCES = {
    "installs": installs,
    "iap": partial(events, flag="R"),
    "ads": partial(events, flag="A"),
    "sessions": sessions,
    "costs": costs,
    "devices": user_list,
    "personal": user_list,
}

"""Exploration of a cohort table: null map, describe, group profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.functions.policy import NUMERIC_TYPES
from halocline.operators.keys import lookup_join
from halocline.operators.quantiles import exact_quantiles, quantile_of_positions, value_positions


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def null_map(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Type, distinct values, nulls and null share per column.

    Distinct values are counted by grouping ``(column, value)`` pairs, which
    spreads over the cluster, rather than by one expanded distinct aggregate.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    pairs = text.unpivot([], columns, "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    names = F.col("column")
    kind = F.lit(None).cast("string")
    for c in columns:
        kind = F.when(names == c, types[c]).otherwise(kind)
    nulls = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    return pairs.groupBy("column").agg(
        F.first(kind).alias("dtype"),
        F.count("value").alias("n_unique"),
        nulls.alias("n_null"),
        F.round(nulls / F.sum("n") * 100, 2).alias("pct_null"),
    )


def group_profile(df: DataFrame, value: str, group: str) -> DataFrame:
    """Count, mean, sample deviation and exact median of a value per group."""
    moments = df.groupBy(group).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    medians = exact_quantiles(df, value, [0.5], [group]).withColumnRenamed("q50", "median")
    return moments.join(medians, group, "left")


def country_profile(df: DataFrame, share: str = "organic_share", size: str = "total_installs") -> DataFrame:
    return df.groupBy("country_code").agg(
        F.count(F.lit(1)).alias("n_cohorts"),
        F.sum(size).alias("total_installs"),
        F.avg(share).alias("share_mean"),
        F.stddev_samp(share).alias("share_std"),
    )


def top_countries(df: DataFrame, n: int = 20) -> DataFrame:
    return country_profile(df).orderBy(F.desc("total_installs"), "country_code").limit(n)


def daily_profile(df: DataFrame, share: str = "organic_share", size: str = "total_installs") -> DataFrame:
    return df.groupBy("install_date", "platform").agg(
        F.avg(share).alias("share"), F.count(F.lit(1)).alias("n"), F.sum(size).alias("installs")
    )


def box_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """Quartiles and whiskers (the furthest values within 1.5 interquartile ranges) per group."""
    pos = value_positions(df, value, [group])
    quart = pos.groupBy(group).agg(
        *[quantile_of_positions(p).alias(name) for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    v, reach = F.col("value"), (F.col("q3") - F.col("q1")) * 1.5
    return (
        lookup_join(pos, quart, [group], spread_by=["value"])
        .groupBy(group)
        .agg(
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_lo"),
            F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_hi"),
        )
    )

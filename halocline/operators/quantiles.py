"""Exact ranks and quantiles without a global sort or a single-task aggregate.

``percentile`` merges every distinct value in one task. Here equal values are
first reduced to counts, a bounded sketch cuts the value range into buckets of
similar size, and running counts are taken per bucket. Equal values share a
bucket row, so a value that makes up a third of the data costs nothing extra.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halocline.operators.keys import lookup_join

FAN_OUT = 64


def _count_below(cut: str, low: int, high: int) -> str:
    """SQL for the number of sorted cuts below ``value``: a binary search that compiles to nested ifs."""
    if low == high:
        return str(low)
    mid = (low + high) // 2
    return f"if(get(_cuts, {cut.format(mid)}) < value, {_count_below(cut, mid + 1, high)}, {_count_below(cut, low, mid)})"


def bucket_count(df: DataFrame) -> int:
    """A multiple of ``FAN_OUT``: at least one bucket for each shuffle partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return FAN_OUT * max(1, min(FAN_OUT, math.ceil(parts / FAN_OUT)))


def _with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """The number of cuts below the value, by every ``buckets / FAN_OUT``-th cut first and then by those between."""
    step = buckets // FAN_OUT
    outer = _count_below(f"({{}} + 1) * {step} - 1", 0, FAN_OUT - 1)
    found = df.withColumn("_outer", F.expr(outer))
    inner = _count_below(f"_outer * {step} + {{}}", 0, step - 1)
    return found.withColumn("_bucket", F.col("_outer") * step + F.expr(inner)).drop("_cuts", "_outer")


def value_positions(
    df: DataFrame,
    value: Column | str,
    groups: Sequence[str] = (),
    *,
    bounded_groups: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """One row per distinct non-null value: ``value, n, before, total`` within its group.

    ``before`` counts the smaller rows of the group and ``total`` all of them.
    Set ``bounded_groups`` when the groups are few by construction (names of
    columns): their cut points are then broadcast instead of joined by shuffle.
    """
    value = F.col(value) if isinstance(value, str) else value
    groups, buckets = list(groups), buckets or bucket_count(df)
    counts = (
        df.select(*groups, value.cast("double").alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy(*groups, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    probs = [i / buckets for i in range(1, buckets)]
    cuts = F.percentile_approx("value", probs, 8 * buckets)
    # keeping ``n`` alive here lets the cuts read the very exchange that the counts come from
    counted = counts.filter(F.col("n") > 0)
    if groups:
        edges = counted.groupBy(*groups).agg(cuts.alias("_cuts"))
        # a group may own most of the values, so its rows are spread over several tasks
        cut_rows = counts.join(F.broadcast(edges), groups) if bounded_groups else lookup_join(counts, edges, groups, spread_by=["value"])
    else:
        cut_rows = counts.withColumn("_cuts", counted.agg(cuts).scalar())
    cut_rows = _with_bucket(cut_rows, buckets)

    everything = groups or [F.lit(0)]
    sizes = cut_rows.groupBy(*groups, "_bucket").agg(F.sum("n").alias("_size"))
    below = Window.partitionBy(*everything).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *groups,
        "_bucket",
        F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_offset"),
        F.sum("_size").over(Window.partitionBy(*everything)).alias("total"),
    )
    if not groups or bounded_groups:
        offsets = F.broadcast(offsets)
    inside = (
        Window.partitionBy(*groups, "_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        cut_rows.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(offsets, [*groups, "_bucket"])
        .select(*groups, "value", "n", (F.col("_offset") + F.col("_inside")).alias("before"), "total")
    )


def quantile_of_positions(prob: float) -> Column:
    """Aggregate over ``value_positions`` rows: the linearly interpolated quantile."""
    place = F.lit(prob) * (F.col("total") - 1)
    low, high = F.floor(place), F.ceil(place)

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("value")))

    return at(low) + (at(high) - at(low)) * F.max(place - low)


def quantile_name(prob: float) -> str:
    return f"q{int(round(prob * 100)):02d}"


def exact_quantiles(
    df: DataFrame,
    value: Column | str,
    probs: Sequence[float],
    groups: Sequence[str] = (),
    *,
    bounded_groups: bool = False,
) -> DataFrame:
    """Columns ``qNN`` with the exact quantiles per group."""
    pos = value_positions(df, value, groups, bounded_groups=bounded_groups)
    return pos.groupBy(*groups).agg(*[quantile_of_positions(p).alias(quantile_name(p)) for p in probs])


def long_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns plus one ``(column, value)`` row per listed column."""
    numeric = df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return numeric.unpivot(list(keep), list(columns), "column", "value")


def describe(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact percentiles of each column."""
    rows = long_columns(df, columns)
    v = F.col("value")
    moments = rows.groupBy("column").agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    return moments.join(exact_quantiles(rows, "value", probs, ["column"], bounded_groups=True), "column", "left")


def histogram(df: DataFrame, value: Column | str, bins: int) -> DataFrame:
    """Equal-width histogram from minimum to maximum; the last bin is closed and empty bins are kept."""
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(value.cast("double").alias("value")).filter(F.col("value").isNotNull())
    flat = F.min("value") == F.max("value")
    span = rows.agg(
        F.struct(
            F.when(flat, F.min("value") - 0.5).otherwise(F.min("value")).alias("lo"),
            F.when(flat, F.max("value") + 0.5).otherwise(F.max("value")).alias("hi"),
        ).alias("span")
    )
    placed = rows.withColumn("_span", span.scalar())
    lo, hi = F.col("_span.lo"), F.col("_span.hi")
    place = F.floor((F.col("value") - lo) / (hi - lo) * bins)
    counts = placed.withColumn("bin", F.least(place, F.lit(bins - 1)).cast("bigint")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = df.sparkSession.range(bins).select(F.col("id").alias("bin")).withColumn("_span", span.scalar())
    width = (hi - lo) / bins
    return grid.join(counts, "bin", "left").select(
        "bin",
        (lo + width * F.col("bin")).alias("bin_lo"),
        (lo + width * (F.col("bin") + 1)).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def finite_or_null(x: float | None) -> float | None:
    return None if x is None or math.isnan(x) or math.isinf(x) else x

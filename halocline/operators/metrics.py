"""Weighted regression metrics, percentage-error tables and calibration."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.functions import scalar as S
from halocline.operators.quantiles import (
    exact_quantiles,
    histogram,
    quantile_name,
    quantile_of_positions,
    value_positions,
)

# Inner edges of the percentage-error bins.
ERROR_EDGES = (-1.00, -0.50, -0.25, -0.10, 0.0, 0.10, 0.25, 0.50, 1.00)


def regression_report(
    df: DataFrame, y: str, pred: str, weight: str, groups: Sequence[str] = ()
) -> DataFrame:
    """rmse_w, mae_w, r2_w, wmape, rmse_u, mae_u; one row, or one per group.

    The spread around the mean is taken on values shifted by the global weighted
    mean, so that the one-pass formula does not cancel and no group mean has to
    be joined back. Undefined metrics are null.
    """
    rows = df.select(
        *groups,
        F.col(y).cast("double").alias("y"),
        F.col(pred).cast("double").alias("p"),
        F.col(weight).cast("double").alias("w"),
    )
    w, truth = F.col("w"), F.col("y")
    centre = rows.agg(F.try_divide(F.sum(w * truth), F.sum(w)))
    rows = rows.withColumn("_shifted", truth - centre.scalar())
    err, d = truth - F.col("p"), F.col("_shifted")
    spread = F.when(
        F.min(truth) < F.max(truth), F.sum(w * d * d) - F.try_divide(F.pow(F.sum(w * d), 2), F.sum(w))
    )
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.try_divide(F.sum(w * err * err), F.sum(w))).alias("rmse_w"),
        F.try_divide(F.sum(w * F.abs(err)), F.sum(w)).alias("mae_w"),
        (1 - F.try_divide(F.sum(w * err * err), spread)).alias("r2_w"),
        F.try_divide(F.sum(w * F.abs(err)), F.sum(w * F.abs(truth))).alias("wmape"),
        F.sqrt(F.avg(err * err)).alias("rmse_u"),
        F.avg(F.abs(err)).alias("mae_u"),
    )


def with_errors(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Absolute and percentage error of each row."""
    return df.withColumns(
        {
            "abs_err": F.abs(F.col(y) - F.col(pred)),
            "pe": S.percentage_error(F.col(y).cast("double"), F.col(pred)),
        }
    )


def error_bins(
    df: DataFrame, pe: str, weight: str, groups: Sequence[str] = (), edges: Sequence[float] = ERROR_EDGES
) -> DataFrame:
    """Weight, share of weight and row count per percentage-error bin, empty bins included.

    Bins are right-closed and open at both ends. Each bin is a conditional sum of
    one aggregate, unrolled to rows afterwards, so no bin table is joined.
    """
    bounds = [-math.inf, *edges, math.inf]
    e, w = F.col(pe), F.col(weight).cast("double")
    aggs = [F.sum(F.when(e.isNotNull(), w)).alias("_total")]
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        inside = (e > lo) if math.isinf(hi) else (e > lo) & (e <= hi)
        if math.isinf(lo):
            inside = e <= hi
        aggs.append(F.sum(F.when(inside, w)).alias(f"_w{i}"))
        aggs.append(F.count_if(inside).alias(f"_n{i}"))
    rows = []
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        weight_i = S.zero_if_null(F.col(f"_w{i}"))
        share = F.coalesce(F.try_divide(weight_i, F.col("_total")), F.lit(0.0))
        rows.append(
            F.struct(
                F.lit(i).cast("bigint").alias("bin"),
                F.lit(lo).alias("lo"),
                F.lit(hi).alias("hi"),
                weight_i.alias("weight"),
                share.alias("pct"),
                F.col(f"_n{i}").alias("count"),
            )
        )
    return df.groupBy(*groups).agg(*aggs).select(*groups, F.inline(F.array(*rows)))


def error_summary(
    df: DataFrame, pe: str, groups: Sequence[str] = (), bounded_groups: bool = False
) -> DataFrame:
    """n, mean, median, outer quantiles and shares within 10, 20 and 50 % of a percentage error."""
    pos = value_positions(df, pe, groups, bounded_groups=bounded_groups)
    n, v = F.col("n"), F.col("value")

    def within(limit: float) -> Column:
        return F.try_divide(F.sum(F.when(F.abs(v) <= limit, n).otherwise(0)), F.sum(n))

    return pos.groupBy(*groups).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"),
        F.try_divide(F.sum(n * v), F.sum(n)).alias("mean"),
        quantile_of_positions(0.5).alias("median"),
        *[quantile_of_positions(p).alias(quantile_name(p)) for p in (0.05, 0.25, 0.75, 0.95)],
        within(0.10).alias("within_10pct"),
        within(0.20).alias("within_20pct"),
        within(0.50).alias("within_50pct"),
    )


def calibration_table(df: DataFrame, y: str, pred: str, weight: str, bins: int = 20) -> DataFrame:
    """Weighted mean prediction and truth per quantile bin of the prediction.

    Bins are right-closed with the lowest value included; equal edges collapse.
    """
    probs = [i / bins for i in range(bins + 1)]
    pos = value_positions(df, pred)
    edges = pos.agg(F.array_distinct(F.array(*[quantile_of_positions(p) for p in probs])).alias("edges"))
    p, w = F.col(pred), F.col(weight).cast("double")
    rows = df.filter(p.isNotNull()).withColumn("_edges", edges.scalar())
    below = F.lit(0)
    for i in range(bins + 1):
        below = below + F.when(F.get("_edges", F.lit(i)) < p, 1).otherwise(0)
    binned = rows.withColumn("bin", F.greatest(below, F.lit(1)).cast("bigint"))
    return binned.groupBy("bin").agg(
        F.try_divide(F.sum(p * w), F.sum(w)).alias("pred_mean"),
        F.try_divide(F.sum(F.col(y) * w), F.sum(w)).alias("true_mean"),
        F.sum(w).alias("total_w"),
        F.count(F.lit(1)).alias("n"),
    )


def error_histogram(df: DataFrame, pe: str, limit: float = 2.0, bins: int = 80) -> DataFrame:
    """Histogram of the percentage error clipped to ``+-limit``, in percent."""
    return histogram(df, S.clip(F.col(pe), -limit, limit) * 100, bins)


def error_centre(df: DataFrame, pe: str) -> DataFrame:
    """Median and mean of the unclipped error, the two marks of that histogram."""
    return exact_quantiles(df, pe, [0.5]).select(F.col("q50").alias("median")).withColumn(
        "mean", df.agg(F.avg(pe)).scalar()
    )


def errors_by_group(df: DataFrame, y: str, pred: str, weight: str, groups: Sequence[str], worst: int = 10) -> DataFrame:
    """Groups with the largest weighted relative error, ``worst`` of them."""
    table = regression_report(df, y, pred, weight, groups)
    return table.orderBy(F.desc_nulls_last("wmape"), *groups).limit(worst)

"""What cleaning did to a target table, as one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from halocline.operators.quantiles import exact_quantiles


def _facts(target: str, size: str) -> list[Column]:
    """Of the rows that are left."""
    return [
        F.count(F.lit(1)).alias("rows_after"),
        F.avg(target).alias("target_mean"),
        F.stddev_samp(target).alias("target_std"),
        F.min(size).alias("size_min"),
        F.max(size).alias("size_max"),
    ]


def _report(stats: DataFrame, after: DataFrame, target: str, size: str) -> DataFrame:
    """The report from a row of counts and moments; exact medians come from the rows that are left."""

    def median(c: str) -> Column:
        return exact_quantiles(after, c, [0.5]).scalar()

    full = stats.withColumns({"target_median": median(target), "size_median": median(size)})
    dropped = F.col("rows_before") - F.col("rows_after")
    return full.select(
        "rows_before",
        "rows_after",
        dropped.alias("rows_dropped"),
        F.coalesce(F.try_divide(dropped * 100.0, F.col("rows_before")), F.lit(0.0)).alias("pct_dropped"),
        "target_mean",
        "target_std",
        "target_median",
        "size_min",
        "size_median",
        "size_max",
    )


def cleaning_report(
    before: DataFrame, after: DataFrame, target: str = "organic_share", size: str = "total_installs"
) -> DataFrame:
    """Row counts before and after, share dropped, and the target and size left over."""
    n_before = before.agg(F.count(F.lit(1))).scalar()
    return _report(after.agg(*_facts(target, size)).withColumn("rows_before", n_before), after, target, size)


def reported_write(
    before: DataFrame, clean: Callable[[DataFrame], DataFrame], stage: Callable[[DataFrame], DataFrame],
    target: str = "organic_share", size: str = "total_installs",
) -> DataFrame:
    """Clean a table, store it by ``stage``, and report as ``cleaning_report`` does.

    Counts and moments are observed while the rows pass on their way to the file; the source is read once and the stored table only for its medians.
    """
    seen, left = Observation(), Observation()
    cleaned = clean(before.observe(seen, F.count(F.lit(1)).alias("rows_before")))
    facts = _facts(target, size)
    kept = stage(cleaned.observe(left, *facts))
    kinds = cleaned.agg(*facts, F.count(F.lit(1)).alias("rows_before")).schema
    row = left.get | seen.get
    stats = before.sparkSession.createDataFrame([tuple(row[f.name] for f in kinds)], kinds)
    return _report(stats, kept, target, size)

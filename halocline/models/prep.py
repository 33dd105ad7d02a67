"""Feature preparation: medians, scaling and category lists, fitted on the cluster.

What is fitted is small by construction (a row per feature, a list of countries)
and is kept on the driver as plain Python, so that applying it is a projection.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from halocline.operators.quantiles import exact_quantiles, long_columns

#: Deviations below this share of the mean are rounding of a constant.
ROUNDING = 1e-9
#: A fitted table of up to this many names is joined by broadcast, a larger one by shuffle.
BROADCAST_NAMES = 200_000


@dataclass(frozen=True)
class Lookup:
    """A fitted value per name: a stored table and its measured size. Nothing of it is on the driver."""

    rows: DataFrame
    size: int

    def attach(self, df: DataFrame, column: str, value: str, other: Column) -> DataFrame:
        """Add ``value`` by the name in ``column``; an unknown or null name gets ``other``."""
        rows = self.rows.select(F.col("name").alias("_name"), F.col("value").alias("_value"))
        if self.size <= BROADCAST_NAMES:
            rows = F.broadcast(rows)
        joined = df.join(rows, F.col(column).cast("string") == F.col("_name"), "left")
        return joined.withColumn(value, F.coalesce("_value", other)).drop("_name", "_value")


def lookup(df: DataFrame, name: str, value: str, stage: Callable[[DataFrame], DataFrame] | None = None) -> Lookup:
    """Store a fitted table, by ``stage`` (see ``sources.sinks.staged``) or on the executors' disks, and count it."""
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(value).alias("value"))
    rows = stage(rows) if stage else rows.persist(StorageLevel.MEMORY_AND_DISK)
    return Lookup(rows, rows.count())


@dataclass(frozen=True)
class Prep:
    features: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    countries: tuple[str, ...] = ()
    platforms: tuple[str, ...] = ()


def prep_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Median per feature, and mean and population deviation after filling nulls with it.

    The moments of the filled column follow from those of the present values, so
    the table is read once for medians and once for moments and never filled. A
    deviation of 0 or no more than rounding leaves becomes 1; a feature without any value counts as constant 0.
    """
    rows = long_columns(df, features)
    v = F.col("value")
    moments = rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("_all"),
        F.count(v).alias("_present"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("_avg"),
        F.coalesce(F.var_pop(v), F.lit(0.0)).alias("_var"),
    )
    medians = exact_quantiles(rows, "value", [0.5], ["column"], bounded_groups=True)
    joined = moments.join(medians, "column", "left").withColumn("median", F.coalesce("q50", F.lit(0.0)))
    there, absent = F.col("_present"), F.col("_all") - F.col("_present")
    mean = (F.col("_avg") * there + F.col("median") * absent) / F.col("_all")
    with_mean = joined.withColumn("mean", mean)
    ss = there * (F.col("_var") + F.pow(F.col("_avg") - F.col("mean"), 2)) + absent * F.pow(
        F.col("median") - F.col("mean"), 2
    )
    std = F.sqrt(ss / F.col("_all"))
    return with_mean.select(
        F.col("column").alias("feature"), "median", "mean", F.when(std <= ROUNDING * F.abs("mean"), 1.0).otherwise(std).alias("std")
    )


def categories(df: DataFrame, column: str) -> tuple[str, ...]:
    """Sorted distinct values; one short name each on the driver."""
    rows = df.select(F.col(column).cast("string")).distinct().collect()
    return tuple(sorted(str(r[0]) for r in rows))


def fit_prep(
    df: DataFrame, features: Sequence[str], country: str | None = "country_code", platform: str | None = "platform"
) -> Prep:
    by_name = {r["feature"]: r for r in prep_stats(df, features).collect()}
    no_rows = {"median": 0.0, "mean": 0.0, "std": 1.0}
    rows = [by_name.get(f, no_rows) for f in features]
    return Prep(
        features=tuple(features),
        medians=tuple(r["median"] for r in rows),
        means=tuple(r["mean"] for r in rows),
        stds=tuple(r["std"] for r in rows),
        countries=categories(df, country) if country else (),
        platforms=categories(df, platform) if platform else (),
    )


def scaled(prep: Prep) -> dict[str, Column]:
    """Filled and standardised features, as columns."""
    out = {}
    for f, median, mean, std in zip(prep.features, prep.medians, prep.means, prep.stds):
        out[f] = (F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(median)) - F.lit(mean)) / F.lit(std)
    return out


def with_category(
    df: DataFrame, column: str, values: Sequence[str], name: str, content: Sequence, strict: bool = False
) -> DataFrame:
    """Add ``name``: the entry of ``content`` that stands at the value's place in ``values``.

    An unknown value gets the first entry, or raises when ``strict``. The fitted names are a small table that is joined,
    so neither the plan nor a row's work grows with their number.
    """
    kind = "bigint" if all(isinstance(c, int) for c in content) else "double"
    table = df.sparkSession.createDataFrame(list(zip(values, content)), f"_name string, _content {kind}")
    key = F.coalesce(F.col(column).cast("string"), F.lit("None"))
    other = F.lit(content[0] if content else 0).cast(kind)
    if strict:
        other = F.raise_error(F.concat(F.lit(f"unknown {column}: "), key)).cast(kind)
    joined = df.join(table, key == F.col("_name"), "left")
    found = F.when(F.col("_name").isNull(), other).otherwise(F.col("_content"))
    return joined.withColumn(name, found).drop("_name", "_content")


def apply_prep(df: DataFrame, prep: Prep, keep: Sequence[str], strict: bool = False) -> DataFrame:
    """``keep`` columns, the scaled features as one array, and the two category indexes."""
    for column, values, name in (
        ("country_code", prep.countries, "_country_idx"), ("platform", prep.platforms, "_platform_idx"),
    ):
        df = with_category(df, column, values, name, list(range(len(values))), strict)
    return df.select(
        *keep,
        F.array(*scaled(prep).values()).alias("x"),
        F.col("_country_idx").alias("country_idx"),
        F.col("_platform_idx").alias("platform_idx"),
    )


def target_encoding(df: DataFrame, target: str, weight: str, column: str = "country_code") -> DataFrame:
    """Weighted mean of the target per category; null categories are left out."""
    w = F.col(weight)
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.try_divide(F.sum(F.col(target) * w), F.sum(w)).alias(f"{column.split('_')[0]}_te"))
    )

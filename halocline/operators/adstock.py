"""Carry-over of spend: geometric adstock along each geo's time line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def geometric_weights(decay: float, l_max: int, normalize: bool = False) -> list[float]:
    weights = [decay**k for k in range(l_max)]
    total = sum(weights) if normalize else 1.0
    return [w / total for w in weights]


def adstock(value: Column, window, decay: float, l_max: int, normalize: bool = False) -> Column:
    """Weighted sum of the current and the ``l_max - 1`` previous rows of ``window``."""
    out = F.lit(0.0)
    for k, weight in enumerate(geometric_weights(decay, l_max, normalize)):
        lagged = value if k == 0 else F.lag(value, k).over(window)
        out = out + F.coalesce(lagged, F.lit(0.0)) * weight
    return out


def adstock_columns(
    panel: DataFrame, columns: Sequence[str], decay: float, l_max: int, *, geo: str = "geo",
    day: str = "install_date", normalize: bool = False,
) -> DataFrame:
    """Replace each spend column by its adstock. A geo has one row per bucket, so the calendar bounds its window."""
    window = Window.partitionBy(geo).orderBy(day)
    return panel.withColumns({c: adstock(F.col(c), window, decay, l_max, normalize) for c in columns})


def lag_columns(
    panel: DataFrame, columns: Sequence[str], l_max: int, *, geo: str = "geo", day: str = "install_date"
) -> DataFrame:
    """Add ``<column>__lag`` arrays of the last ``l_max`` values, so that any decay can be tried without a new window."""
    window = Window.partitionBy(geo).orderBy(day)
    lags = {}
    for c in columns:
        steps = [F.col(c), *[F.lag(c, k).over(window) for k in range(1, l_max)]]
        lags[f"{c}__lag"] = F.array(*[F.coalesce(s, F.lit(0.0)) for s in steps])
    return panel.withColumns(lags)


def complete_buckets(
    panel: DataFrame, columns: Sequence[str], cadence_days: int, *, geo: str = "geo", day: str = "install_date"
) -> DataFrame:
    """Add the buckets a geo lacks, with zero spend and ``observed`` false.

    Lags count rows, so carry-over needs every bucket between the first and last
    date of the panel. Each geo unfolds its own sequence; nothing is crossed.
    """
    span = panel.agg(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi"))).scalar()
    steps = F.sequence(F.col("_span.lo"), F.col("_span.hi"), F.make_dt_interval(F.lit(max(cadence_days, 1))))
    calendar = (
        panel.select(geo).distinct().withColumn("_span", span).select(geo, F.explode(steps).alias(day))
    )
    filled = calendar.join(panel.withColumn("observed", F.lit(True)), [geo, day], "left")
    return filled.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns}
        | {"observed": F.coalesce("observed", F.lit(False))}
    )


def with_warmup(train: DataFrame, test: DataFrame) -> DataFrame:
    """Training rows ahead of the test rows, flagged, so that carry-over reaches into the test period."""
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))

"""From model contributions to organic installs attributed to channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halocline.operators.keys import lookup_join
from halocline.operators.panel import spend_long

MIN_PREDICTED = 1e-9


def predictions_from_contributions(contributions: DataFrame) -> DataFrame:
    """Sum every part of the model (channels, intercept, controls) per geo and date."""
    return contributions.groupBy("geo", "install_date").agg(F.sum("contribution").alias("pred_scaled"))


def geo_scale(panel: DataFrame, predictions: DataFrame, target: str = "organic_installs") -> DataFrame:
    """Observed over predicted total per geo, the prediction clamped away from zero."""
    joined = panel.select("geo", "install_date", target).join(predictions, ["geo", "install_date"])
    return joined.groupBy("geo").agg(
        (F.sum(target) / F.greatest(F.sum("pred_scaled"), F.lit(MIN_PREDICTED))).alias("scale")
    )


def scale_overview(scale: DataFrame) -> DataFrame:
    return scale.agg(
        F.count(F.lit(1)).alias("n_geos"),
        F.avg("scale").alias("mean"),
        F.stddev_samp("scale").alias("std"),
        F.min("scale").alias("min"),
        F.max("scale").alias("max"),
    )


def attribute(channel_contributions: DataFrame, scale: DataFrame, panel: DataFrame) -> DataFrame:
    """``(install_date, geo, channel, halo_organic, spend)``; a geo without scale gets a null halo."""
    scaled = channel_contributions.join(scale, "geo", "left").select(
        "install_date", "geo", "channel", (F.col("contribution") * F.col("scale")).alias("halo_organic")
    )
    return scaled.join(spend_long(panel), ["install_date", "geo", "channel"], "left")


def channel_summary(attribution: DataFrame, panel: DataFrame, target: str = "organic_installs") -> DataFrame:
    """Halo and spend per channel, share of all organic installs, halo per 1000 spent; largest first."""
    total = panel.agg(F.sum(target)).scalar()
    halo, spend = F.col("halo_total"), F.col("spend_total")
    sums = attribution.groupBy("channel").agg(
        F.coalesce(F.sum("halo_organic"), F.lit(0.0)).alias("halo_total"),
        F.coalesce(F.sum("spend"), F.lit(0.0)).alias("spend_total"),
    )
    return sums.withColumns(
        {
            "share_of_total_organic": F.try_divide(halo, total),
            "halo_per_1k_spend": F.try_divide(halo, spend / 1000.0),
        }
    ).orderBy(F.desc("halo_total"), "channel")


def halo_totals(attribution: DataFrame, panel: DataFrame, target: str = "organic_installs") -> DataFrame:
    """Observed, attributed and remaining organic installs, and the attributed share."""
    observed = panel.agg(F.sum(target).cast("double")).scalar()
    halo = F.col("halo")
    return (
        attribution.agg(F.coalesce(F.sum("halo_organic"), F.lit(0.0)).alias("halo"))
        .withColumn("observed", observed)
        .select(
            "observed",
            "halo",
            (F.col("observed") - halo).alias("baseline"),
            F.try_divide(halo, F.col("observed")).alias("halo_share"),
        )
    )


def halo_over_time(attribution: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Halo per date, one column per channel in the given order, zero filled."""
    return attribution.groupBy("install_date").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("halo_organic"))), F.lit(0.0)).alias(c)
            for c in channels
        ]
    )


def channels_by_halo(attribution: DataFrame) -> list[str]:
    """Channel names by falling total, for the column order above; a collect of one row per channel column."""
    sums = attribution.groupBy("channel").agg(F.sum("halo_organic").alias("_halo"))
    return [r[0] for r in sums.orderBy(F.desc("_halo"), "channel").select("channel").collect()]


def calibrated(predictions: DataFrame, scale: DataFrame, missing: float = 1.0) -> DataFrame:
    """Predictions on the original scale; a geo that was not calibrated keeps factor ``missing``."""
    factor = F.coalesce("scale", F.lit(missing))
    return predictions.join(scale, "geo", "left").withColumn("pred", F.col("pred_scaled") * factor).drop("scale")


def match_test(test: DataFrame, predictions: DataFrame) -> DataFrame:
    """Test rows with their prediction; predictions of other dates are cut by a semi join first."""
    dates = test.select("install_date").distinct()
    kept = predictions.join(dates, "install_date", "left_semi")
    return test.join(kept, ["geo", "install_date"])


def true_organic(shares: DataFrame, attribution: DataFrame) -> DataFrame:
    """Organic installs left after the halo: share times installs minus all channels, per geo and date.

    ``shares`` holds ``geo, install_date, organic_share, total_installs``, where the
    share may be observed or predicted. Where no halo was estimated (a geo or date outside of the
    attribution) what is left is unknown: null, with ``halo_known`` false.
    """
    halo = attribution.groupBy("geo", "install_date").agg(F.sum("halo_organic").alias("halo_organic"))
    organic = F.col("organic_share") * F.col("total_installs")
    paid_part = F.col("halo_organic")
    return shares.join(halo, ["geo", "install_date"], "left").select(
        "geo",
        "install_date",
        organic.alias("organic"),
        paid_part.alias("paid_induced"),
        (organic - paid_part).alias("true_organic"),
        paid_part.isNotNull().alias("halo_known"),
    )


def attribution_checks(summary: DataFrame, max_halo_per_1k: float, decays: DataFrame, curve: DataFrame) -> DataFrame:
    """One row per sanity check with the number of violations.

    ``decays`` has a ``decay`` column; ``curve`` has ``channel, x, y`` points of the
    fitted saturation, a handful per channel.
    """
    step = F.col("y") - F.lag("y").over(Window.partitionBy("channel").orderBy("x"))
    bounded = summary.agg(F.count_if(F.col("halo_per_1k_spend") > max_halo_per_1k).alias("violations"))
    decay = decays.agg(F.count_if(~F.col("decay").between(0.0, 1.0)).alias("violations"))
    rising = curve.withColumn("_step", step).agg(F.count_if(F.col("_step") < 0).alias("violations"))
    named = [("halo_bounded", bounded), ("decay_in_unit_range", decay), ("saturation_monotone", rising)]
    out = None
    for name, df in named:
        row = df.select(F.lit(name).alias("check_name"), "violations", (F.col("violations") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def pool_rare(df: DataFrame, column: str, min_rows: int, label: str = "other", by: DataFrame | None = None) -> DataFrame:
    """Replace values with fewer than ``min_rows`` rows by ``<column>_other``'s label.

    Rows are counted in ``by``, if given (the table that a model is fitted on), else in ``df``. The frequent values number at most
    rows / min_rows; only that list is joined.
    """
    keep = (df if by is None else by).groupBy(column).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows)
    kept = keep.select(F.col(column), F.lit(True).alias("_keep"))
    spread = [c for c in df.columns if c != column][:1] or [column]
    joined = lookup_join(df, kept, [column], spread_by=spread)
    return joined.withColumn(column, F.when(F.col("_keep"), F.col(column)).otherwise(label)).select(*df.columns)

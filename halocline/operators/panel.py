"""The marketing-mix panel: installs and spend per geo and time bucket."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.config import ORGANIC, OTHER_PAID, MixSettings
from halocline.functions import scalar as S
from halocline.operators.cohorts import install_counts

GEO_DAY = ["platform", "country_code", "install_date"]
GEO = ["platform", "country_code"]


def in_window(day: Column, date_from, date_to) -> Column:
    """Half-open date window."""
    low, high = [F.lit(dt.date.fromisoformat(str(x))) for x in (date_from, date_to)]
    return (day >= low) & (day < high)


def paid(costs: DataFrame) -> DataFrame:
    """Rows of paid sources; a null source is not paid."""
    return costs.filter(F.col("media_source") != ORGANIC)


def channel_totals(costs: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Spend per paid channel in the window, channels without spend left out."""
    rows = paid(costs)
    if date_from is not None and date_to is not None:
        rows = rows.filter(in_window(F.col("install_date"), date_from, date_to))
    return (
        rows.groupBy("media_source").agg(F.sum("spend").alias("total_spend")).filter(F.col("total_spend") > 0)
    )


def top_channels(costs: DataFrame, n: int, date_from=None, date_to=None) -> DataFrame:
    """The ``n`` channels with most spend; ties in name order."""
    return channel_totals(costs, date_from, date_to).orderBy(F.desc("total_spend"), "media_source").limit(n)


def channel_names(costs: DataFrame, n: int, date_from=None, date_to=None) -> list[str]:
    """Names of the top channels. A collect of at most ``n`` rows: names become columns."""
    rows = top_channels(costs, n, date_from, date_to).select("media_source").collect()
    return [r[0] for r in rows]


def channel_bucket(channels: Sequence[str]) -> Column:
    """The source itself when listed, else ``other_paid``."""
    source = F.col("media_source")
    return F.when(source.isin(list(channels)), source).otherwise(OTHER_PAID) if channels else F.lit(OTHER_PAID)


def spend_by_channel(costs: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Long spend per geo, day and channel; channels outside the list become ``other_paid``."""
    return (
        paid(costs)
        .withColumn("channel", channel_bucket(channels))
        .groupBy(*GEO_DAY, "channel")
        .agg(F.coalesce(F.sum("spend"), F.lit(0.0)).alias("spend"))
    )


def channel_columns(channels: Sequence[str]) -> dict[str, str]:
    """Channel -> panel column, the bucket for the rest last."""
    return {c: f"spend_{c}" for c in dict.fromkeys([*channels, OTHER_PAID])}


def spend_wide(costs: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One ``spend_<channel>`` column per listed channel plus ``spend_other_paid``, zero filled.

    Conditional sums give the pivot in one aggregate with a fixed set of columns.
    """
    rows = paid(costs).withColumn("channel", channel_bucket(channels))
    sums = [
        S.zero_if_null(F.sum(F.when(F.col("channel") == c, F.col("spend")))).alias(name)
        for c, name in channel_columns(channels).items()
    ]
    return rows.groupBy(*GEO_DAY).agg(*sums)


def join_spend(installs: DataFrame, spend: DataFrame, how: str = "left") -> DataFrame:
    """Install counts with spend, absent spend as 0.

    ``left`` loses spend on days without installs; ``full_outer`` keeps it.
    """
    columns = [c for c in spend.columns if c.startswith("spend_")]
    counts = ["total_installs", "organic_installs"]
    joined = installs.join(spend, GEO_DAY, how)
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in counts}
        | {c: S.zero_if_null(F.col(c)) for c in columns}
    )


def keep_countries(panel: DataFrame, min_installs: int | Column) -> DataFrame:
    """Rows of countries with at least ``min_installs`` installs, a number or a scalar subquery."""
    if isinstance(min_installs, int) and min_installs <= 0:
        return panel
    keep = panel.groupBy("country_code").agg(F.sum("total_installs").alias("_n")).filter(F.col("_n") >= min_installs)
    return panel.join(keep.select("country_code"), "country_code", "left_semi")


def top_geos(panel: DataFrame, n: int) -> DataFrame:
    """The ``n`` platform and country pairs with most installs; ties in name order."""
    totals = panel.groupBy(*GEO).agg(F.sum("total_installs").alias("geo_total"))
    return totals.orderBy(F.desc("geo_total"), *GEO).limit(n)


def keep_top_geos(panel: DataFrame, n: int) -> DataFrame:
    """Rows of the top geos; the keep-list has at most ``n`` rows and is broadcast."""
    if n <= 0:
        return panel
    return panel.join(F.broadcast(top_geos(panel, n).select(*GEO)), GEO, "left_semi")


def bucket_days(panel: DataFrame, days: int) -> DataFrame:
    """Sum the daily panel into buckets of ``days``, counted from its first date; dates without rows stay out."""
    if days <= 1:
        return panel
    anchor = panel.agg(F.min("install_date")).scalar()
    sums = ["organic_installs", "total_installs", *[c for c in panel.columns if c.startswith("spend_")]]
    return (
        panel.withColumn("_anchor", anchor)
        .withColumn("_bucket", S.date_bucket(F.to_date("install_date"), F.to_date("_anchor"), days))
        .groupBy(*GEO, F.col("_bucket").alias("install_date"))
        .agg(*[F.sum(c).alias(c) for c in sums])
    )


def add_weekdays(panel: DataFrame) -> DataFrame:
    return panel.withColumns(S.weekday_columns(F.col("install_date")))


def geo_name() -> Column:
    return F.concat("platform", F.lit("_"), "country_code")


def build_panel(
    installs: DataFrame,
    costs: DataFrame,
    *,
    date_from,
    date_to,
    mix: MixSettings = MixSettings(),
    channels: Sequence[str] | None = None,
    spend_join: str = "left",
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Geo by time panel of organic installs, total installs and spend per channel.

    The date window is applied before aggregating: the date is a grouping key, so
    the result is the same and the filter reaches the scan. Both sides are reduced
    to geo-days before they meet. Only the channel list is collected, and only if
    it is not given. The keep-lists and the first date each read the geo-days again: ``stage``
    stores them (see ``sources.sinks.staged``), else installs and costs are scanned for each.
    """
    if channels is None:
        channels = channel_names(costs, mix.top_n_channels, date_from, date_to)
    window = in_window(F.col("install_date"), date_from, date_to)
    counts = install_counts(installs.filter(window), GEO_DAY)
    panel = join_spend(counts, spend_wide(costs.filter(window), channels), spend_join)
    panel = stage(panel) if stage else panel
    panel = keep_countries(panel, mix.min_country_installs)
    panel = keep_top_geos(panel, mix.top_n_geos)
    panel = bucket_days(panel, mix.cadence_days)
    if mix.cadence_days <= 1:
        panel = add_weekdays(panel)
    return panel.withColumn("geo", geo_name())


def ordered(panel: DataFrame) -> DataFrame:
    """The panel in the order of its keys, for a sink: ranges of geos over tasks, sorted inside."""
    order = ["geo", "platform", "country_code", "install_date"]
    return panel.repartitionByRange(*order).sortWithinPartitions(*order)


def panel_facts(panel: DataFrame) -> DataFrame:
    """Rows, geos and date range of a panel."""
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("platform", "country_code").alias("n_geos"),
        F.min("install_date").alias("first_date"),
        F.max("install_date").alias("last_date"),
    )


def spend_totals(panel: DataFrame) -> DataFrame:
    """Total of every spend column, one row each."""
    columns = [c for c in panel.columns if c.startswith("spend_")]
    sums = panel.agg(*[F.sum(c).alias(c) for c in columns])
    return sums.unpivot([], columns, "channel", "total_spend")


def spend_long(panel: DataFrame) -> DataFrame:
    """``(install_date, geo, channel, spend)`` from the wide panel."""
    columns = [c for c in panel.columns if c.startswith("spend_")]
    return panel.unpivot(["install_date", "geo"], columns, "channel", "spend")

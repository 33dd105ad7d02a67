"""Acquisition-cost features: ratios per cost row, attached to every install."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.config import USER_KEYS
from halocline.functions import scalar as S
from halocline.operators.keys import first_per_key, lookup_join

# The attribution key shared by installs and cost rows.
COST_KEYS = ("install_date", "platform", "media_source", "country_code", "campaign", "af_adset", "af_ad")


def cost_ratios(costs: DataFrame) -> DataFrame:
    """``installs`` becomes ``installs_spend``; cpi, ctr, cvr and cpm are null on a zero denominator."""
    df = costs.withColumnRenamed("installs", "installs_spend") if "installs" in costs.columns else costs
    spend, n = F.col("spend"), F.col("installs_spend")
    return df.withColumns(
        {
            "cpi": S.safe_ratio(spend, n),
            "ctr": S.safe_ratio(F.col("clicks"), F.col("impressions")),
            "cvr": S.safe_ratio(n, F.col("clicks")),
            "cpm": S.safe_ratio(spend * 1000, F.col("impressions")),
        }
    )


def build_costs(costs: DataFrame, installs: DataFrame) -> DataFrame:
    """Cost features per user, from raw costs and the install features.

    Costs are reduced to one row per key first, so the join cannot fan out and,
    since installs hold one row per user, its result needs no dedupe. The ratios
    are computed on the cost rows, before they are repeated for every user.
    """
    rows = installs.select(*USER_KEYS, *[k for k in COST_KEYS if k not in USER_KEYS])
    date_type = rows.schema["install_date"].dataType
    lookup = first_per_key(costs.withColumn("install_date", F.col("install_date").cast(date_type)), COST_KEYS)
    joined = lookup_join(rows, cost_ratios(lookup), COST_KEYS, spread_by=["match_id"])
    return joined.drop(*[k for k in COST_KEYS if k not in USER_KEYS])

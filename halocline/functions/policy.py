"""Which aggregate a column gets when users are rolled up to cohorts."""

from __future__ import annotations

from pyspark.sql import types as T

# Name fragments and day-column prefixes that are summed.
SUM_FRAGMENTS = (
    "spend",
    "impressions",
    "clicks",
    "installs_spend",
    "_cum_",
    "_count",
    "purchase_count",
    "rev_d",
    "iap_rev",
    "ads_rev",
)
DAY_PREFIXES = ("sessions_", "iap_", "ads_", "iap_count_", "iap_check_size_")

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def is_day_column(name: str) -> bool:
    """True for ``sessions_3``, ``iap_count_5`` and the like."""
    head, sep, tail = name.rpartition("_")
    return bool(sep) and tail.isdigit() and name.startswith(DAY_PREFIXES)


def cohort_aggregate(name: str, data_type: T.DataType) -> str | None:
    """``"sum"``, ``"mean"``, or None for columns that the roll-up leaves out."""
    if not isinstance(data_type, NUMERIC_TYPES):
        return None
    if is_day_column(name) or any(part in name for part in SUM_FRAGMENTS):
        return "sum"
    return "mean"

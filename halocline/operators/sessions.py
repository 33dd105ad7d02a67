"""User features from per-day session counts. Row-local, then one dedupe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.config import USER_KEYS, Settings
from halocline.functions import scalar as S
from halocline.operators.keys import first_per_key

WEEK = 7


def existing_days(columns, last_day: int) -> list[str]:
    return [f"sessions_{d}" for d in range(last_day + 1) if f"sessions_{d}" in columns]


def slope_by_position(names: Sequence[str]) -> Column:
    """Least-squares slope over column positions 0..n-1; 0 for a single column."""
    mean = (len(names) - 1) / 2.0
    spread = sum((i - mean) ** 2 for i in range(len(names)))
    if spread == 0:
        return F.lit(0.0)
    terms = " + ".join(f"coalesce(`{n}`, 0.0D) * ({i - mean}D)" for i, n in enumerate(names))
    return F.expr(f"({terms}) / {spread}D")


def last_positive_position(names: Sequence[str]) -> Column:
    """1-based position of the last positive column, 0 when none is."""
    cases = " ".join(f"when `{n}` > 0 then {i}" for i, n in reversed(list(enumerate(names, start=1))))
    return F.expr(f"bigint(case {cases} else 0 end)") if names else F.lit(0).cast("bigint")


def build_sessions(raw: DataFrame, settings: Settings = Settings()) -> DataFrame:
    df = first_per_key(raw, USER_KEYS)
    names = existing_days(df.columns, WEEK)
    if "active_days_7d" in df.columns:
        idle = F.lit(WEEK) - F.col("active_days_7d")
    else:
        idle = F.lit(WEEK) - S.row_count_positive(names[:WEEK])
    derived = {
        "sessions_d1": S.row_sum(existing_days(df.columns, 1)),
        "session_velocity_slope": slope_by_position(names) if names else F.lit(0.0),
        "last_active_day": last_positive_position(names),
        "zero_session_days": F.when(idle < 0, 0).otherwise(idle),
    }
    filled = {}
    for d in range(settings.horizon):
        name = f"sessions_{d}"
        filled[name] = S.zero_if_null(F.col(name).cast("double")) if name in df.columns else F.lit(0.0)
    return df.withColumns(derived).withColumns(filled)

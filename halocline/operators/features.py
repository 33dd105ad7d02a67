"""The feature registry: source name -> function from raw table to user-grain table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from halocline.config import USER_KEYS, Settings
from halocline.functions.scalar import coerce_timestamps
from halocline.operators.costs import build_costs
from halocline.operators.keys import first_per_key
from halocline.operators.purchases import build_ads, build_iap
from halocline.operators.sessions import build_sessions


def build_users(raw: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Install, device and personal tables: one row per user."""
    return first_per_key(raw, USER_KEYS)


BUILDERS: dict[str, Callable[..., DataFrame]] = {
    "installs": build_users,
    "ads": build_ads,
    "iap": build_iap,
    "sessions": build_sessions,
    "personal": build_users,
    "costs": build_costs,
    "devices": build_users,
}


def build_source(
    name: str, raw: DataFrame, settings: Settings = Settings(), installs: DataFrame | None = None
) -> DataFrame:
    """Features of one source; costs also need the install features."""
    raw = coerce_timestamps(raw, ["install_time", "install_date"])
    if name == "costs":
        if installs is None:
            raise ValueError("costs need the install features")
        return build_costs(raw, installs)
    return BUILDERS[name](raw, settings)


def build_all(raw: Mapping[str, DataFrame], settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Features of every known source, installs first; sources without a builder are skipped."""
    if "installs" not in raw:
        raise KeyError("Base dataset 'installs' is missing")
    installs = build_source("installs", raw["installs"], settings)
    out = {"installs": installs}
    for name, df in raw.items():
        if name != "installs" and name in BUILDERS:
            out[name] = build_source(name, df, settings, installs)
    return out

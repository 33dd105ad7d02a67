"""Settings with the defaults that decide results.

One frozen dataclass replaces layered configuration files; ``load_settings``
applies a JSON file of overrides, named directly or by ``HALOCLINE_OVERRIDES``.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import os
from dataclasses import dataclass, field

USER_KEYS = ("match_id", "install_date")
ORGANIC = "organic"
OTHER_PAID = "other_paid"

# The modelling whitelist, in report order.
MODEL_FEATURES = (
    "log1p_ads_cum_learn",
    "installs_spend",
    "cpi",
    "ctr",
    "cvr",
    "cpm",
    "ads_avg_check_learn",
    "ads_days_with_purchase_learn",
    "ads_purchase_count_learn",
    "log1p_iap_cum_learn",
    "iap_days_with_purchase_learn",
    "iap_purchase_count_learn",
    "iap_avg_check_learn",
    "rev_d1_iap",
    "rev_d3_iap",
    "d1_share_iap",
    "has_second_iap",
    "time_to_first_iap_minutes",
    "time_first_and_second_iap_minutes",
    "n_sessions_total",
    "weekend_sessions",
    "session_velocity_slope",
    "last_active_day",
    "lag_first_session",
    "lag_last_session",
    "session_span_days",
    "density_1d",
    "density_3d",
    "density_7d",
    "avg_gap_day7",
    "med_gap_day7",
    "max_gap_day7",
    "ret_1",
    "ret_2",
    "ret_3",
    "ret_4",
    "ret_5",
    "ret_6",
    "ret_7",
)


@dataclass(frozen=True)
class MixSettings:
    """Panel and marketing-mix model."""

    target: str = "organic_installs"
    top_n_channels: int = 10
    min_country_installs: int = 0
    top_n_geos: int = 100
    cadence_days: int = 7
    adstock_l_max: int = 4
    saturation: str = "logistic"
    geo_dim: bool = True
    yearly_seasonality: int = 0
    decay_grid: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7)
    shape_grid: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0)
    shrinkage: float = 0.5
    holdout_share: float = 0.2
    learn_pooling: bool = True
    refine_steps: int = 4


@dataclass(frozen=True)
class BinomialSettings:
    """Hierarchical binomial model."""

    alpha_prior_sigma: float = 1.5
    beta_prior_sigma: float = 1.0
    spread_prior_sigma: float = 1.0
    chains: int = 2
    draws: int = 500
    random_seed: int = 42
    max_iter: int = 100
    tol: float = 3e-4
    spread_tol: float = 1e-3
    spread_rounds: int = 1000
    #: Countries with fewer training cohorts are pooled into one; 0 keeps all.
    pool_min_rows: int = 0
    quadrature_nodes: int = 15
    quadrature_rounds: int = 10


@dataclass(frozen=True)
class Settings:
    predict_target: str = ORGANIC
    horizon: int = 7
    learn_days: int = 7
    max_event_day: int = 360
    cohort_keys: tuple[str, ...] = ("platform", "media_source", "country_code", "install_date")
    min_total_installs: int = 30
    target: str = "organic_share"
    weight: str = "total_installs"
    keep_keys: tuple[str, ...] = ("platform", "country_code", "install_date")
    features: tuple[str, ...] = MODEL_FEATURES
    ridge_alpha: float = 1.0
    #: Buckets of the user tables on the user keys; 0 writes plain files.
    user_buckets: int = 0
    train_start: dt.date = dt.date(2024, 11, 1)
    test_start: dt.date = dt.date(2025, 5, 1)
    test_end: dt.date = dt.date(2025, 6, 1)
    mix: MixSettings = field(default_factory=MixSettings)
    binomial: BinomialSettings = field(default_factory=BinomialSettings)

    @property
    def target_keys(self) -> tuple[str, ...]:
        return tuple(k for k in self.cohort_keys if k != "media_source")


def _apply(settings, overrides: dict):
    known = {f.name: f for f in dataclasses.fields(settings)}
    changes = {}
    for name, value in overrides.items():
        if name not in known:
            raise KeyError(f"unknown setting '{name}'")
        current = getattr(settings, name)
        if dataclasses.is_dataclass(current):
            value = _apply(current, value)
        elif isinstance(current, dt.date):
            value = dt.date.fromisoformat(str(value))
        elif isinstance(current, tuple):
            value = tuple(value)
        changes[name] = value
    return dataclasses.replace(settings, **changes)


def load_settings(path: str | None = None, overrides: dict | None = None) -> Settings:
    """Defaults, then the JSON file at ``path`` (or the environment's), then ``overrides``."""
    settings = Settings()
    path = path or os.environ.get("HALOCLINE_OVERRIDES")
    if path:
        with open(path, encoding="utf-8") as fh:
            settings = _apply(settings, json.load(fh))
    return _apply(settings, overrides or {})

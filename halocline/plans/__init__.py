"""Jobs and registered queries."""

from __future__ import annotations


def all_queries():
    from halocline.plans import cohort_queries, model_queries, panel_queries  # noqa: F401
    from halocline.plans.registry import REGISTRY

    return dict(REGISTRY)

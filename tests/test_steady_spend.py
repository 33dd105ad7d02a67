"""Queries on the mix model where every week has about the same spend, as with many orders per week."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SEGMENTS = ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"]
WEEKS = 339
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def steady(tmp_path_factory):
    """Orders of ten geos: a paid order per week and channel, whose price varies by 2 %, and one to four organic ones."""
    rng, at = np.random.default_rng(3), tmp_path_factory.mktemp("steady")
    regions = pd.DataFrame({"r_regionkey": np.arange(5, dtype="int32"), "r_name": [f"R{i}" for i in range(5)]})
    nations = pd.DataFrame({"n_nationkey": np.arange(5, dtype="int32"), "n_name": [f"N{i}" for i in range(5)], "n_regionkey": np.arange(5, dtype="int32")})
    keys = np.arange(25)
    customers = pd.DataFrame({"c_custkey": keys, "c_nationkey": (keys // 5).astype("int32"), "c_mktsegment": [SEGMENTS[k % 5] for k in keys]})
    week, customer, platform = (a.ravel() for a in np.meshgrid(np.arange(WEEKS), keys, np.arange(2), indexing="ij"))
    copies = np.where(customer % 5 == 0, rng.integers(1, 5, len(week)), 1)
    week, customer, platform = (np.repeat(a, copies) for a in (week, customer, platform))
    orders = pd.DataFrame(
        {
            "o_orderkey": np.arange(len(week)),
            "o_custkey": customer,
            "o_orderstatus": "O",
            "o_totalprice": np.round(100_000 * (1 + 0.02 * rng.standard_normal(len(week))), 2),
            "o_orderdate": (pd.Timestamp("1995-01-01") + pd.to_timedelta(7 * week, unit="D")).astype("datetime64[us]"),
            "o_orderpriority": np.where(platform == 0, "1-URGENT", "5-LOW"),
        }
    )
    for name, table in (("region", regions), ("nation", nations), ("customer", customers), ("orders", orders)):
        table.to_parquet(at / f"{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["mmm_coefficients", "mmm_contributions", "mmm_evaluation", "mmm_grid_scores"])
def test_fit_on_steady_spend_equals_sql(spark, steady, name):
    assert difference(QUERIES[name](spark, steady), connect(steady).sql(ORACLES[name])) is None


@pytest.mark.parametrize(
    "name, n_rows, columns",
    [
        ("mmm_channel_effects", 5, ["hdi_lo", "mean", "hdi_hi"]),
        ("mmm_diagnostics", 50, ["hdi_lo", "mean", "hdi_hi"]),
        ("mmm_roas", 5, ["roas_hdi_lo", "roas_mean", "roas_hdi_hi"]),
    ],
)
def test_draws_on_steady_spend(spark, steady, name, n_rows, columns):
    """Draws are not followed in SQL: a row per channel (and geo), and non-negative intervals around the mean."""
    found = QUERIES[name](spark, steady).toPandas()
    assert len(found) == n_rows
    if name == "mmm_roas":
        found = found[found["total_spend"] > 0]
    low, mean, high = (found[c].to_numpy(float) for c in columns)
    assert len(found) and np.isfinite([low, mean, high]).all()
    assert (low >= 0).all() and (low <= mean).all() and (mean <= high).all()

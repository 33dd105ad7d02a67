"""Statistics against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from halocline.operators import correlation as C
from halocline.operators import draws as D
from halocline.operators import metrics as X
from halocline.operators import profile as P
from halocline.operators import quantiles as N
from tests.conftest import rows

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def sample(spark):
    n = 3000
    pdf = pd.DataFrame(
        {
            "g": RNG.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]),
            "x": np.where(RNG.random(n) < 0.35, 0.0, RNG.normal(size=n)),
            "y": np.round(RNG.exponential(size=n), 1),
            "w": RNG.integers(1, 90, n).astype(float),
        }
    )
    pdf.loc[RNG.random(n) < 0.1, "x"] = None
    pdf["p"] = pdf["y"] * 0.8 + RNG.normal(scale=0.2, size=n)
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return df, pdf


def test_exact_quantiles(sample):
    df, pdf = sample
    probs = [0.0, 0.05, 0.5, 0.77, 1.0]
    (r,) = rows(N.exact_quantiles(df, "x", probs))
    want = np.quantile(pdf["x"].dropna(), probs)
    assert np.allclose([r[N.quantile_name(p)] for p in probs], want)
    for r in rows(N.exact_quantiles(df, "y", probs, ["g"])):
        assert np.allclose([r[N.quantile_name(p)] for p in probs], np.quantile(pdf.y[pdf.g == r["g"]], probs))


def test_positions_add_up_with_a_hot_value(sample):
    df, pdf = sample
    got = pd.DataFrame(rows(N.value_positions(df, "x"), "value"))
    counts = pdf["x"].value_counts().sort_index()
    assert np.allclose(got["value"], counts.index) and (got["n"].to_numpy() == counts.to_numpy()).all()
    assert (got["before"].to_numpy() == np.r_[0, counts.cumsum().to_numpy()[:-1]]).all()
    assert (got["total"] == len(pdf["x"].dropna())).all()


def test_histogram_equals_numpy(sample):
    df, pdf = sample
    got = pd.DataFrame(rows(N.histogram(df, "p", 40), "bin"))
    want, edges = np.histogram(pdf["p"], bins=40)
    assert (got["n"].to_numpy() == want).all() and np.allclose(got["bin_lo"], edges[:-1])


def test_flat_histogram(spark):
    got = rows(N.histogram(spark.range(5).select(F.lit(2.0).alias("v")), "v", 4), "bin")
    assert [r["n"] for r in got] == [0, 0, 5, 0] and got[0]["bin_lo"] == 1.5


def test_describe(sample):
    df, pdf = sample
    for r in rows(N.describe(df, ["x", "w"], [0.25, 0.9])):
        s = pdf[r["column"]].describe(percentiles=[0.25, 0.9])
        assert r["count"] == s["count"]
        assert np.allclose([r["mean"], r["std"], r["q25"], r["q90"]], [s["mean"], s["std"], s["25%"], s["90%"]])


def test_report_and_null_metrics(sample, spark):
    df, pdf = sample
    (r,) = rows(X.regression_report(df, "y", "p", "w"))
    y, p, w = pdf.y.to_numpy(), pdf.p.to_numpy(), pdf.w.to_numpy()
    e, m = y - p, np.average(y, weights=w)
    assert r["rmse_w"] == pytest.approx(np.sqrt(np.average(e**2, weights=w)))
    assert r["r2_w"] == pytest.approx(1 - np.sum(w * e**2) / np.sum(w * (y - m) ** 2))
    assert r["wmape"] == pytest.approx(np.sum(w * abs(e)) / np.sum(w * abs(y)))
    assert r["mae_u"] == pytest.approx(abs(e).mean())
    for g in rows(X.regression_report(df, "y", "p", "w", ["g"])):
        k = (pdf.g == g["g"]).to_numpy()
        mg = np.average(y[k], weights=w[k])
        assert g["r2_w"] == pytest.approx(1 - np.sum(w[k] * e[k] ** 2) / np.sum(w[k] * (y[k] - mg) ** 2))
    flat = spark.createDataFrame([(0.0, 0.1, 1.0), (0.0, 0.2, 2.0)], "y double, p double, w double")
    (r,) = rows(X.regression_report(flat, "y", "p", "w"))
    assert r["r2_w"] is None and r["wmape"] is None and r["mae_w"] > 0


def test_error_bins_are_right_closed(spark):
    pe = [-1.0, -0.5, 0.0, 1.0, None, -2.0, 3.0]
    df = spark.createDataFrame([(e, 2.0) for e in pe], "pe double, w double")
    got = rows(X.error_bins(df, "pe", "w"), "bin")
    assert [r["count"] for r in got] == [2, 1, 0, 0, 1, 0, 0, 0, 1, 1]
    assert sum(r["pct"] for r in got) == pytest.approx(1.0) and got[0]["weight"] == 4.0
    empty = rows(X.error_bins(df.filter("pe is null"), "pe", "w"))
    assert len(empty) == 10 and all(r["pct"] == 0.0 for r in empty)


def test_zero_target_has_no_percentage_error(spark):
    df = X.with_errors(spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y double, p double"), "y", "p")
    assert [r["pe"] for r in rows(df, "y")] == [None, -0.5]
    (s,) = rows(X.error_summary(df, "pe"))
    assert s["n"] == 1 and s["median"] == -0.5 and s["within_50pct"] == 1.0 and s["within_20pct"] == 0.0
    (none,) = rows(X.error_summary(df.filter("pe is null"), "pe"))
    assert none["n"] == 0 and none["mean"] is None


@pytest.mark.parametrize("pred", ["p", "x"])
def test_calibration_equals_qcut(sample, pred):
    df, pdf = sample
    pdf = pdf.dropna(subset=[pred]).copy()
    pdf["bin"] = pd.qcut(pdf[pred], 20, duplicates="drop")
    grouped = [b for _, b in pdf.groupby("bin", observed=True)]
    got = rows(X.calibration_table(df, "y", pred, "w"), "bin")
    assert len(got) == len(grouped)
    for r, b in zip(got, grouped):
        assert r["total_w"] == b.w.sum() and r["true_mean"] == pytest.approx(np.average(b.y, weights=b.w))


def test_correlations_skip_nulls_pairwise(sample, spark):
    _, pdf = sample
    wide = pdf.assign(
        id=np.arange(len(pdf)), flat=3.7, z=pdf.y.where(RNG.random(len(pdf)) > 0.2), z2=pdf.w, gone=np.nan,
        far=(pdf.w + 1e9).where(pdf.index % 50 == 0), once=pdf.y.where(pdf.index == 7),
    )
    wide.loc[wide.z.isna(), "z2"] = np.nan  # the same rows are missing as in z
    names = ["x", "y", "z", "w", "p", "z2", "flat", "gone", "far", "once"]
    df = spark.createDataFrame(wide.drop(columns="g"))
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})
    got = {(r["feat_a"], r["feat_b"]): r for r in rows(C.correlation_table(df, names, ["id"]))}
    assert list(got) == [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    for (a, b), r in got.items():
        both = wide[[a, b]].dropna()
        assert r["n"] == len(both)
        for name, pair in (("pearson", both), ("spearman", both.rank())):
            varies = len(pair) > 1 and (pair.nunique() > 1).all()
            assert r[name] == (pytest.approx(np.corrcoef(pair[a], pair[b])[0, 1], abs=1e-9) if varies else None)
    (top,) = rows(C.feature_pairs(df, ["x", "y", "w", "p"], ["id"], top=1))
    assert (top["feat_a"], top["feat_b"]) == ("y", "p")
    best = C.top_pairs(df, ["x", "y", "w", "far"], "p", ["id"], n=2, top=None)
    assert [(r["feat_a"], r["feat_b"]) for r in best.collect()] == [("y", "far")] or best.count() == 1
    assert {r["n"] for r in C.correlation_table(df.limit(0), names, ["id"]).collect()} == {0}


def test_ranks_are_shared_by_columns_that_miss_the_same_rows():
    counts = np.array([[9, 7, 7], [7, 7, 7], [7, 7, 7]])
    slots, of_pair = C.rank_slots(counts)
    assert slots == [(0, -1), (1, -1), (2, -1), (0, 1)]
    assert of_pair[0, 1] == of_pair[0, 2] == 3 and of_pair[1, 0] == 1 and of_pair[2, 1] == 2


def test_null_map(sample):
    df, pdf = sample
    got = {r["column"]: r for r in rows(P.null_map(df))}
    assert got["x"]["n_null"] == pdf.x.isna().sum() and got["x"]["n_unique"] == pdf.x.nunique()
    assert got["g"]["dtype"] == "string" and got["x"]["pct_null"] == round(pdf.x.isna().mean() * 100, 2)


def test_box_stats(sample):
    df, pdf = sample
    for r in rows(P.box_stats(df, "y", "g")):
        v = pdf.y[pdf.g == r["g"]]
        q1, q3 = v.quantile(0.25), v.quantile(0.75)
        assert (r["q1"], r["q3"]) == pytest.approx((q1, q3))
        assert r["whisker_hi"] == v[v <= q3 + 1.5 * (q3 - q1)].max()


@pytest.fixture(scope="module")
def chains(spark):
    pdf = pd.DataFrame(
        [
            {"chain": c, "draw": d, "param": p, "value": v}
            for p, shift in (("mu", 0.0), ("bad[1]", 3.0))
            for c in range(4)
            for d, v in enumerate(RNG.normal(loc=shift * c, size=250))
        ]
    )
    return spark.createDataFrame(pdf), pdf


def test_hdi_is_the_narrowest_window(chains):
    df, pdf = chains
    for r in rows(D.summary(df)):
        v = np.sort(pdf.value[pdf.param == r["param"]].to_numpy())
        k = int(np.floor(0.94 * len(v)))
        i = np.argmin(v[k:] - v[: len(v) - k])
        assert (r["hdi_lo"], r["hdi_hi"]) == pytest.approx((v[i], v[i + k]))
        assert r["mean"] == pytest.approx(v.mean()) and r["sd"] == pytest.approx(v.std())


def test_diagnostics_tell_good_from_bad(chains):
    df, _ = chains
    got = {r["param"]: r for r in rows(D.diagnostics(df))}
    assert got["mu"]["r_hat"] < 1.02 and got["bad[1]"]["r_hat"] > 1.5
    assert 600 < got["mu"]["ess_bulk"] < 1600 and got["bad[1]"]["ess_bulk"] < 50
    assert got["mu"]["mcse_mean"] == pytest.approx(1 / np.sqrt(1000), rel=0.3)
    (o,) = rows(D.convergence_overview(D.diagnostics(df)))
    assert o["n_params"] == 2 and o["n_bad_rhat"] == 1 and o["share_bad_ess"] == 0.5
    assert [r["param"] for r in rows(D.scalar_parameters(D.diagnostics(df)))] == ["mu"]
    plain = {r["param"]: r["rhat"] for r in rows(D.split_rhat(df))}
    assert plain["mu"] < 1.02 and plain["bad[1]"] > 1.5


def test_slow_chain_has_fewer_effective_draws(spark):
    noise, walk = RNG.normal(size=(2, 1000)), []
    for c in noise:
        x, out = 0.0, []
        for e in c:
            x = 0.9 * x + e
            out.append(x)
        walk.append(out)
    pdf = pd.DataFrame(
        [{"chain": c, "draw": d, "param": "ar", "value": float(v)} for c in range(2) for d, v in enumerate(walk[c])]
    )
    (r,) = rows(D.diagnostics(spark.createDataFrame(pdf)))
    assert 40 < r["ess_bulk"] < 300  # about 2000 * (1 - .9) / (1 + .9)


def test_the_correlated_table_has_no_more_parts_than_tasks(spark, tmp_path):
    """Every pass over the cohorts costs a task per part, so the parts of the last shuffle are merged."""
    from halocline.plans.model_queries import CORRELATED, correlated_table

    n = 800
    key = np.arange(n)
    tables = {
        "region": {"r_regionkey": [0, 1], "r_name": ["EU", "US"]},
        "nation": {"n_nationkey": [0, 1], "n_regionkey": [0, 1]},
        "customer": {"c_custkey": [0, 1, 2], "c_nationkey": [0, 1, 1], "c_mktsegment": ["BUILDING", "FURNITURE", "MACHINERY"]},
        "orders": {
            "o_orderkey": key, "o_custkey": key * 7 % 3, "o_orderstatus": "F", "o_totalprice": key * 10.0,
            "o_orderdate": pd.Timestamp("1999-01-01") + pd.to_timedelta(key % 170, unit="D"), "o_orderpriority": np.where(key % 5 < 3, "1-URGENT", "5-LOW"),
        },
        "lineitem": {
            "l_orderkey": key, "l_partkey": key * 5, "l_suppkey": key % 9, "l_linenumber": key % 4, "l_extendedprice": key * 3.0,
            "l_returnflag": np.array(["R", "A", "N"])[key % 3],
        },
    }
    for name, columns in tables.items():
        pd.DataFrame(columns).astype({"o_orderdate": "datetime64[us]"} if name == "orders" else {}).to_parquet(tmp_path / f"{name}.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        table = correlated_table(spark, str(tmp_path))
        assert table.count() == 8
        assert set(CORRELATED) <= set(table.columns)
        assert table.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

"""Models against closed forms and simulated truth."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from halocline.config import BinomialSettings, MixSettings
from halocline.models import binomial as B
from halocline.models import mix as M
from halocline.models import prep as R
from halocline.models import ridge as G
from halocline.operators import attribution as T
from halocline.operators import draws as D
from halocline.operators import metrics as X
from tests.conftest import rows

RNG = np.random.default_rng(11)
N = 600
FEATURES = ["a", "b", "flat"]


def cohorts():
    pdf = pd.DataFrame(
        {
            "platform": RNG.choice(["ios", "android"], N),
            "country_code": RNG.choice([f"C{i}" for i in range(6)], N, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.1]),
            "a": RNG.normal(5, 3, N),
            "b": RNG.exponential(2, N),
            "flat": np.ones(N),
            "total_installs": RNG.integers(30, 500, N),
        }
    )
    effect = {f"C{i}": e for i, e in enumerate(RNG.normal(0, 0.5, 6))}
    eta = -1 + 0.2 * (pdf.a - 5) - 0.3 * pdf.b + pdf.country_code.map(effect) + 0.3 * (pdf.platform == "ios")
    pdf["organic_installs"] = RNG.binomial(pdf.total_installs, 1 / (1 + np.exp(-eta)))
    pdf["organic_share"] = pdf.organic_installs / pdf.total_installs
    pdf.loc[RNG.random(N) < 0.15, "b"] = None
    return pdf


PDF = cohorts()


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(PDF)
    return df.withColumn("b", F.when(~F.isnan("b"), F.col("b"))).persist()


def numpy_prep(columns):
    x = PDF.assign(country_te=0.0) if "country_te" not in PDF else PDF
    filled = x[columns].fillna(x[columns].median())
    std = filled.std(ddof=0).replace(0, 1.0)
    return ((filled - filled.mean()) / std).to_numpy()


def test_prep_equals_pandas(table):
    prep = R.fit_prep(table, FEATURES)
    got = np.vstack([r["x"] for r in R.apply_prep(table, prep, []).collect()])
    assert np.allclose(np.sort(got, axis=0), np.sort(numpy_prep(FEATURES), axis=0))
    assert prep.stds[2] == 1.0 and prep.countries == tuple(f"C{i}" for i in range(6))


def test_unseen_categories(table, spark):
    prep = R.fit_prep(table, FEATURES)
    new = table.limit(1).withColumn("country_code", F.lit("XX"))
    assert R.apply_prep(new, prep, []).first()["country_idx"] == 0
    with pytest.raises(Exception, match="unknown country_code"):
        R.apply_prep(new, prep, [], strict=True).collect()
    model = G.fit_ridge(table, target="organic_share", weight="total_installs", features=FEATURES)
    assert G._encode(new, model.country_te, model.global_mean).first()["country_te"] == pytest.approx(model.global_mean)


def test_ridge_equals_closed_form(table):
    model = G.fit_ridge(table, target="organic_share", weight="total_installs", features=FEATURES, alpha=2.0)
    w = PDF.total_installs.to_numpy(float)
    te = PDF.groupby("country_code").apply(
        lambda g: np.average(g.organic_share, weights=g.total_installs), include_groups=False
    )
    full = PDF.assign(country_te=PDF.country_code.map(te))
    x = full[[*FEATURES, "country_te"]]
    x = x.fillna(x.median())
    x = ((x - x.mean()) / x.std(ddof=0).replace(0, 1.0)).to_numpy()
    x = np.column_stack([x, full.platform == "android", full.platform == "ios"]).astype(float)
    p = full.organic_share.clip(1e-3, 1 - 1e-3)
    y = np.log(p / (1 - p)).to_numpy()
    xm, ym = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    xc, yc = x - xm, y - ym
    coef = np.linalg.solve(xc.T @ (xc * w[:, None]) + 2.0 * np.eye(x.shape[1]), xc.T @ (yc * w))
    assert np.allclose(model.coefficients, coef, atol=1e-7)
    assert model.intercept == pytest.approx(ym - xm @ coef)
    want = np.sort(1 / (1 + np.exp(-(x @ coef + model.intercept))))
    got = sorted(r["pred"] for r in rows(G.predict_ridge(model, table)))
    assert np.allclose(got, want, atol=1e-8)
    assert rows(G.coefficient_table(model, table, 2))[0]["abs_coef"] == pytest.approx(max(abs(coef)))


def test_ridge_on_no_row_and_on_one(table):
    fit = {"target": "organic_share", "weight": "total_installs", "features": FEATURES}
    model = G.fit_ridge(table.limit(0), **fit)
    assert model.intercept is None and model.coefficients == () and G.coefficient_table(model, table).count() == 0
    assert G.predict_ridge(model, table).filter("pred is not null").count() == 0
    one = table.orderBy("total_installs", "a").limit(1).persist()
    model = G.fit_ridge(one, **fit)
    assert model.coefficients == (0.0,) * 5
    (r,) = rows(G.predict_ridge(model, one))
    assert r["pred"] == pytest.approx(min(max(r["organic_share"], 1e-3), 1 - 1e-3))


def test_a_lookup_is_joined_either_way(table, monkeypatch):
    fit = {"target": "organic_share", "weight": "total_installs", "features": FEATURES}
    want = sorted(r["pred"] for r in rows(G.predict_ridge(G.fit_ridge(table, **fit), table)))
    monkeypatch.setattr(R, "BROADCAST_NAMES", 0)
    assert np.allclose(sorted(r["pred"] for r in rows(G.predict_ridge(G.fit_ridge(table, **fit), table))), want)


def test_binomial_equals_newton(table):
    settings = BinomialSettings()
    model = B.fit_binomial(table, features=FEATURES, learn_spread=False, spreads=(0.7, 0.9))
    x = np.column_stack([np.ones(N), numpy_prep(FEATURES)])
    c = pd.get_dummies(PDF.country_code).to_numpy(float)
    p = pd.get_dummies(PDF.platform).to_numpy(float)
    z = np.column_stack([x, c, p])
    lam = np.r_[settings.alpha_prior_sigma**-2, np.ones(3), np.full(6, 0.7**-2), np.full(2, 0.9**-2)]
    k, n = PDF.organic_installs.to_numpy(float), PDF.total_installs.to_numpy(float)
    theta = np.zeros(z.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-z @ theta))
        h = z.T @ (z * (n * q * (1 - q))[:, None]) + np.diag(lam)
        theta = theta + np.linalg.solve(h, z.T @ (k - n * q) - lam * theta)
    got = np.r_[model.alpha, model.beta, model.u_country, model.u_platform]
    assert np.allclose(got, theta, atol=1e-5)
    cov = np.linalg.inv(h)
    at = [0, 1, 2, 3, 10, 11]
    assert np.allclose(model.curvature.core, cov[np.ix_(at, at)], rtol=1e-3, atol=1e-6)
    assert np.allclose(model.curvature.country_variance(), np.diag(cov)[4:10], rtol=1e-3, atol=1e-6)
    assert model.converged and model.iterations < 15


def test_binomial_learns_spread_and_predicts(table, spark):
    model = B.fit_binomial(table, features=FEATURES)
    assert 0.15 < model.sigma_country < 1.2 and model.converged
    scored = B.predict_binomial(model, table)
    (r,) = rows(X.regression_report(scored, "organic_share", "pred", "total_installs"))
    assert r["r2_w"] > 0.8
    draws = B.posterior_draws(model, spark, BinomialSettings(draws=400))
    got = {s["param"]: s for s in rows(D.summary(draws))}
    sd = model.curvature.core_sd()[1]
    table_sd = {r["param"]: r["sd"] for r in rows(B.effects_table(model, spark))}
    assert got["u_country[C3]"]["sd"] == pytest.approx(table_sd["u_country[C3]"], rel=0.15)
    assert got["beta[a]"]["mean"] == pytest.approx(model.beta[0], abs=4 * sd / np.sqrt(800))
    assert got["beta[a]"]["sd"] == pytest.approx(sd, rel=0.15)
    again = B.posterior_draws(model, spark, BinomialSettings(draws=400)).filter("param = 'alpha' and draw = 7")
    assert rows(again, "chain") == rows(draws.filter("param = 'alpha' and draw = 7"), "chain")


def test_binomial_with_extreme_rows_and_an_early_stop(table):
    """Far-out features neither overflow nor are clipped, and a fit that is cut short says so."""
    wild = table.withColumn("a", F.when(F.rand(1) < 0.01, F.lit(1e4)).otherwise(F.col("a")))
    assert all(np.isfinite(B.fit_binomial(wild, features=FEATURES, learn_spread=False).beta))
    short = B.fit_binomial(table, features=FEATURES, settings=BinomialSettings(max_iter=1))
    assert not short.converged and short.iterations == 1


def test_fits_with_twenty_thousand_countries(spark):
    many = spark.range(20_000).select(
        F.concat(F.lit("C"), "id").alias("country_code"), F.lit("ios").alias("platform"), (F.col("id") % 7).cast("double").alias("a"),
        (5 + F.col("id") % 5).alias("organic_installs"), F.lit(20).alias("total_installs"),
    ).withColumn("organic_share", F.col("organic_installs") / 20)
    model = B.fit_binomial(many, features=["a"], learn_spread=False)
    assert model.converged and len(model.u_country) == 20_000 and model.curvature.core.shape == (3, 3)
    assert B.predict_binomial(model, many.limit(50)).filter("pred between 0.2 and 0.5").count() == 50
    ridge = G.fit_ridge(many, target="organic_share", weight="total_installs", features=["a"])
    assert G.predict_ridge(ridge, many.limit(50)).filter("pred is not null").count() == 50


def test_counts_from_share_round_half_even(spark):
    df = spark.createDataFrame([(0.5, 5), (0.5, 7), (0.25, 4)], "s double, n bigint")
    assert sorted(r["organic_installs"] for r in rows(B.counts_from_share(df, "s", "n"))) == [1, 2, 4]


@pytest.fixture(scope="module")
def simulated(spark):
    """Eight geos, 60 weeks, three channels with a known order of strength and decay .5."""
    start, out = dt.date(2024, 1, 1), []
    for g in range(8):
        size = 20 * (g + 1)
        spend = RNG.gamma(1.0, 100.0, (60, 3)) * (RNG.random((60, 3)) < 0.6)
        carried = sum(np.vstack([np.zeros((k, 3)), spend[: 60 - k]]) * 0.5**k for k in range(4)) / 1.875
        x = carried / spend.max(axis=0)
        sat = (1 - np.exp(-2 * x)) / (1 + np.exp(-2 * x))
        y = size * (0.5 + sat @ np.array([0.9, 0.4, 0.0])) + RNG.normal(scale=0.01 * size, size=60)
        for t in range(60):
            out.append(
                (f"g{g}", f"p{g % 2}", f"c{g}", start + dt.timedelta(days=7 * t), float(max(y[t], 0)), 3 * size,
                 *map(float, spend[t]))
            )
    cols = "geo string, platform string, country_code string, install_date date, organic_installs double, total_installs bigint"
    return spark.createDataFrame(out, cols + ", spend_big double, spend_mid double, spend_none double").persist()


@pytest.fixture(scope="module")
def fitted(simulated):
    cut = F.col("install_date") < F.lit(dt.date(2024, 12, 1))
    train, test = simulated.filter(cut), simulated.filter(~cut)
    return train, test, M.fit_mix(train, MixSettings(decay_grid=(0.1, 0.5, 0.8), shape_grid=(1.0, 2.0, 4.0)))


def test_mix_recovers_the_truth(fitted):
    train, test, model = fitted
    assert (model.decay, model.shape) == (0.5, 2.0)
    mean = {r["part"]: r["v"] for r in rows(M.coefficient_rows(model).groupBy("part").agg(F.avg("value").alias("v")))}
    assert mean["spend_big"] > mean["spend_mid"] > 0.05 > mean["spend_none"] >= 0.0


def test_contributions_add_up_to_the_prediction(fitted):
    train, _, model = fitted
    parts = M.contributions(model, train)
    pred = T.predictions_from_contributions(parts)
    scale = {r["geo"]: r["scale"] for r in rows(T.geo_scale(train, pred))}
    assert all(s == pytest.approx(1.0, abs=0.02) for s in scale.values())
    calibrated = T.calibrated(pred, T.geo_scale(train, pred))
    total = calibrated.agg(F.sum("pred")).first()[0]
    assert total == pytest.approx(train.agg(F.sum("organic_installs")).first()[0])
    att = T.attribute(M.channel_contributions(model, parts), T.geo_scale(train, pred), train)
    names = [r["channel"] for r in rows(T.channel_summary(att, train).select("channel", "halo_total"))]
    assert set(names) == {"spend_big", "spend_mid", "spend_none"}
    assert T.channels_by_halo(att)[:2] == ["spend_big", "spend_mid"]
    (tot,) = rows(T.halo_totals(att, train))
    assert tot["baseline"] + tot["halo"] == pytest.approx(tot["observed"]) and 0 < tot["halo_share"] < 1


def test_mix_predicts_out_of_sample(fitted):
    train, test, model = fitted
    scale = T.geo_scale(train, M.predict_mix(model, train))
    matched = T.match_test(test, T.calibrated(M.predict_test(model, train, test), scale))
    assert matched.count() == test.count()
    (r,) = rows(X.regression_report(matched, "organic_installs", "pred", "total_installs"))
    assert r["r2_w"] > 0.9


def test_intervals_hold_the_estimate(fitted):
    """Draws and attribution speak of the same installs, with and without a scale."""
    train, _, model = fitted
    parts = M.contributions(model, train)
    channels = M.channel_contributions(model, parts)
    twice = train.select("geo").distinct().withColumn("scale", F.lit(2.0))
    for scale, factor in ((None, 1.0), (twice, 2.0)):
        total = {r["channel"]: factor * r["v"] for r in rows(channels.groupBy("channel").agg(F.sum("contribution").alias("v")))}
        for r in rows(D.summary(M.halo_draws(model, train, 300, scale=scale), ("channel",))):
            if r["channel"] != "spend_none":
                assert r["hdi_lo"] < total[r["channel"]] < r["hdi_hi"]
                assert abs(r["mean"] - total[r["channel"]]) < 3 * r["sd"]


def test_truncated_draws_have_the_moments_of_a_half_normal():
    rng = np.random.default_rng(0)
    got = M.truncated_draws(np.array([0.0, 3.0, -6.0]), np.eye(3), np.array([0.0, 3.0, 0.0]), 0, 6000, rng)
    assert (got >= 0).all()
    assert got[:, 0].mean() == pytest.approx(np.sqrt(2 / np.pi), abs=0.03)
    assert got[:, 1].mean() == pytest.approx(3.0, abs=0.06)
    assert got[:, 2].mean() == pytest.approx(0.158, abs=0.02)  # inverse Mills ratio at 6, less 6


def test_diagnostics_refuse_ragged_chains_and_count_undefined_ones(spark):
    even = spark.range(400).selectExpr("cast(id % 2 as int) chain", "cast(id / 2 as int) draw", "'a' param", "sin(id * id) value")
    (r,) = rows(D.diagnostics(even))
    assert all(np.isfinite(r[c]) for c in ("r_hat", "ess_bulk", "ess_tail", "mcse_mean", "mcse_sd"))
    with pytest.raises(Exception, match="differ in their draws"):
        D.diagnostics(even.filter("not (chain = 1 and draw > 150)")).collect()
    diag = spark.createDataFrame([("a", 1.0, 900.0), ("b", None, None), ("c", float("nan"), 900.0)], "param string, r_hat double, ess_bulk double")
    (o,) = rows(D.convergence_overview(diag))
    assert (o["n_bad_rhat"], o["n_bad_ess"], o["n_undefined"], o["max_rhat"]) == (2, 1, 2, 1.0)


def test_single_series_and_yearly_terms(fitted):
    train, _, _ = fitted
    mix = MixSettings(geo_dim=False, yearly_seasonality=1, decay_grid=(0.5,), shape_grid=(2.0,))
    model = M.fit_mix(train, mix)
    assert model.controls == ("year_sin_1", "year_cos_1")
    assert {r["geo"] for r in rows(M.coefficient_rows(model).select("geo").distinct())} == {"all"}
    assert M.predict_mix(model, train).count() == train.select("install_date").distinct().count()
    test = fitted[1]
    assert M.predict_test(model, train, test).count() == test.select("install_date").distinct().count()


def test_mix_without_hold_out_says_so(fitted):
    train, _, _ = fitted
    with pytest.raises(ValueError, match="hold-out"):
        M.fit_mix(train, MixSettings(holdout_share=0.0, decay_grid=(0.5,), shape_grid=(2.0,)))


@pytest.mark.parametrize("steadiness", [0.3, 0.01, 1e-4])
def test_non_negative_ridge_with_steady_channels(steadiness):
    """Spend that hardly varies is collinear with the intercept; the minimum is that of the best choice of zero coefficients."""
    rng, n, free = np.random.default_rng(5), 6, 1
    x = np.column_stack([np.ones(2800), 0.9 + steadiness * rng.standard_normal((2800, n - 2)), np.zeros(2800)])
    y = 0.2 + x[:, 1:5] @ [0.4, 0.0, 0.3, -0.2] + 0.02 * rng.standard_normal(2800)
    xy = np.column_stack([x, y])
    equations = xy.T @ xy
    found = M.solve(equations, np.zeros(n), M.POOLED_RIDGE, free)
    a, b = equations[:n, :n] + M.POOLED_RIDGE * np.eye(n), equations[:n, n]
    best = None
    for zero in range(2 ** (n - free)):
        on = [j for j in range(n) if j < free or not zero >> (j - free) & 1]
        coef = np.zeros(n)
        coef[on] = np.linalg.solve(a[np.ix_(on, on)], b[on])
        if coef[free:].min() >= 0 and (best is None or coef @ a @ coef / 2 - b @ coef < best[0]):
            best = (coef @ a @ coef / 2 - b @ coef, coef)
    assert found == pytest.approx(best[1], abs=1e-7)
    assert found[free:].min() >= 0


def test_spread_maximises_the_marginal_likelihood(table):
    """Quadrature against a fine sum over each country's effect, given the other coefficients."""
    settings = BinomialSettings()
    model = B.fit_binomial(table, features=FEATURES, settings=settings)
    assert model.converged
    prep = model.prep
    x = np.column_stack([np.ones(N), numpy_prep(FEATURES)])
    fixed = x @ np.r_[model.alpha, model.beta] + np.array(model.u_platform)[[prep.platforms.index(p) for p in PDF.platform]]
    k, n = PDF.organic_installs.to_numpy(float), PDF.total_installs.to_numpy(float)
    u = np.linspace(-4, 4, 8001)

    def likelihood(sigma):
        total = -(sigma**2) / (2 * settings.spread_prior_sigma**2)
        for c in prep.countries:
            at = (PDF.country_code == c).to_numpy()
            eta = fixed[at][:, None] + u
            ll = (k[at][:, None] * eta - n[at][:, None] * np.logaddexp(0, eta)).sum(axis=0) - u**2 / (2 * sigma**2) - np.log(sigma)
            total += ll.max() + np.log(np.exp(ll - ll.max()).sum())
        return total

    grid = np.exp(np.linspace(np.log(0.1), np.log(2), 400))
    best = grid[np.argmax([likelihood(s) for s in grid])]
    assert model.sigma_country == pytest.approx(best, rel=0.02)
    laplace = B.fit_binomial(table, features=FEATURES, settings=BinomialSettings(quadrature_rounds=0))
    assert laplace.sigma_country == pytest.approx(model.sigma_country, rel=0.3)


def test_importance_weights_equal_a_plain_computation(table, spark):
    settings = BinomialSettings(draws=150)
    model = B.fit_binomial(table, features=FEATURES, learn_spread=False, spreads=(0.7, 0.9))
    ratios = np.array([r["log_ratio"] for r in rows(B.log_ratios(model, table, settings), "number")])
    wide = B.posterior_draws(model, spark, settings).toPandas()
    wide["number"] = wide.chain * 150 + wide.draw
    names = B.parameter_names(model)
    draws = wide.pivot(index="number", columns="param", values="value")[names].to_numpy()
    z = np.column_stack([np.ones(N), numpy_prep(FEATURES), pd.get_dummies(PDF.country_code), pd.get_dummies(PDF.platform)]).astype(float)
    k, n = PDF.organic_installs.to_numpy(float), PDF.total_installs.to_numpy(float)
    lam = np.r_[settings.alpha_prior_sigma**-2, np.ones(3), np.full(6, 0.7**-2), np.full(2, 0.9**-2)]
    eta = z @ draws.T
    posterior = (k[:, None] * eta - n[:, None] * np.logaddexp(0, eta)).sum(axis=0) - 0.5 * (draws**2 @ lam)
    mode = np.array([r["value"] for r in rows(B.effects_table(model, spark))])
    eta = z @ mode
    q = 1 / (1 + np.exp(-eta))
    info = z.T @ (z * (n * q * (1 - q))[:, None]) + np.diag(lam)
    off = draws - mode
    want = posterior + 0.5 * np.einsum("ij,jk,ik->i", off, info, off)
    assert np.allclose(ratios - ratios.mean(), want - want.mean(), atol=0.02)
    weights = B.importance_weights(model, table, settings)
    (r,) = rows(B.importance_summary(weights))
    assert r["n_draws"] == 300 and 200 < r["n_effective"] <= 300 and r["shape"] < 0.5
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    got = {s["param"]: s for s in rows(B.weighted_summary(B.posterior_draws(model, spark, settings), weights))}
    w = np.array([x["weight"] for x in rows(weights, "chain", "draw")])
    assert got["beta[a]"]["mean"] == pytest.approx(w @ draws[:, 1]) and got["alpha"]["sd"] == pytest.approx(np.sqrt(w @ draws[:, 0] ** 2 - (w @ draws[:, 0]) ** 2))


def test_smoothing_finds_the_shape_of_a_tail():
    rng = np.random.default_rng(4)
    for shape in (0.2, 0.7):
        excess = np.expm1(-shape * np.log(rng.random(4000))) / shape
        k, scale = B.pareto_tail(excess)
        assert k == pytest.approx(shape, abs=0.06) and scale == pytest.approx(1.0, abs=0.08)
    weights, shape = B.smoothed_weights(np.zeros(100))
    assert np.allclose(weights, 0.01) and shape == 0.0
    heavy = np.log(rng.pareto(0.9, 2000) + 1)  # no mean: the largest raw weight would take over
    weights, shape = B.smoothed_weights(heavy)
    raw = np.exp(heavy - heavy.max())
    assert shape > 0.7 and weights.sum() == pytest.approx(1.0) and weights.max() < (raw / raw.sum()).max()


@pytest.fixture(scope="module")
def pooled_panel(spark):
    """Sixty geos whose effects scatter around a common value, each channel with its own spread."""
    rng, start, out = np.random.default_rng(9), dt.date(2024, 1, 1), []
    for g in range(60):
        spend = rng.gamma(1.0, 100.0, (80, 2))
        spend[40] = 900.0  # one scale for all
        carried = sum(np.vstack([np.zeros((k, 2)), spend[: 80 - k]]) * 0.45**k for k in range(4)) / sum(0.45**k for k in range(4))
        sat = np.tanh(1.4 * carried / spend.max(axis=0) / 2)
        y = 1.0 + sat @ np.array([0.8 + 0.05 * rng.standard_normal(), 0.9 + 0.35 * rng.standard_normal()]) + rng.normal(scale=0.02, size=80)
        for t in range(80):
            out.append((f"g{g}", "p", f"c{g}", start + dt.timedelta(days=7 * t), float(max(y[t], 0.0)), 100, *map(float, spend[t])))
    cols = "geo string, platform string, country_code string, install_date date, organic_installs double, total_installs bigint"
    return spark.createDataFrame(out, cols + ", spend_even double, spend_mixed double").persist()


def test_pooling_is_learned_per_channel(pooled_panel):
    plain = MixSettings(decay_grid=(0.45,), shape_grid=(1.4,), learn_pooling=False, refine_steps=0)
    panel, n = M.model_panel(pooled_panel, plain), 3
    channels = M.channel_list(panel)
    scales = M.scale_table(panel, channels, "organic_installs").withColumn("target_max", F.lit(1.0))
    for c in channels:
        scales = scales.withColumn(f"{c}__max", F.lit(900.0))
    lagged = M.lagged_panel(panel, scales, channels, plain).filter("observed").withColumn("_held", F.lit(False))
    rows_ = M._Rows(lagged, plain, tuple(channels), ())
    stats = M._statistics(rows_.design([F.lit(0).alias("grid"), "geo"], 0.45, 1.4)).persist()
    centre, pull, spread, noise = M.learn_pooling(stats, np.zeros(n), np.full(n, 0.5), 1)
    assert centre[1] == pytest.approx(0.8, abs=0.05) and centre[2] == pytest.approx(0.9, abs=0.12)
    assert spread[1] == pytest.approx(0.05, abs=0.03) and spread[2] == pytest.approx(0.35, rel=0.25)
    assert noise == pytest.approx(0.0004, rel=0.1) and pull[1] > 10 * pull[2]


def test_refinement_leaves_the_grid(pooled_panel):
    grid = {"decay_grid": (0.2, 0.3), "shape_grid": (3.0, 6.0)}
    coarse = M.fit_mix(pooled_panel, MixSettings(**grid, learn_pooling=False, refine_steps=0))
    assert (coarse.decay, coarse.shape) == (0.3, 3.0) and M.grid_edges(coarse).filter("not passed").count() == 2
    fine = M.fit_mix(pooled_panel, MixSettings(**grid, learn_pooling=False, refine_steps=2))
    assert fine.decay == pytest.approx(0.45, abs=0.05)
    assert M.grid_edges(fine).filter("not passed").count() == 0
    error = {}
    for name, model in (("coarse", coarse), ("fine", fine)):
        (r,) = rows(X.regression_report(T.match_test(pooled_panel, M.predict_mix(model, pooled_panel).withColumnRenamed("pred_scaled", "pred")),
                                        "organic_installs", "pred", "total_installs"))
        error[name] = r["rmse_w"]
    assert error["fine"] <= error["coarse"] + 1e-9


@pytest.mark.parametrize("kind", ["logistic", "michaelis_menten", "hill"])
def test_slopes_of_the_media_columns(spark, kind):
    mix = MixSettings(saturation=kind, adstock_l_max=3)
    df = spark.createDataFrame([([3.0, 0.0, 5.0], 7.0), ([0.0, 0.0, 0.0], 7.0), ([1.0, 8.0, 2.0], 9.0)], "c__lag array<double>, c__max double")
    step = 1e-6
    by_decay, by_shape = M.media_slopes("c", mix, 0.4, 1.7)
    near = [(M.media("c", mix, a, s) - M.media("c", mix, b, t)) / (2 * step)
            for a, b, s, t in ((0.4 + step, 0.4 - step, 1.7, 1.7), (0.4, 0.4, 1.7 + step, 1.7 - step))]
    for r in df.select(by_decay.alias("a"), by_shape.alias("b"), near[0].alias("x"), near[1].alias("y")).collect():
        assert r["a"] == pytest.approx(r["x"], abs=1e-7) and r["b"] == pytest.approx(r["y"], abs=1e-7)


def test_sweep_has_every_metric_per_point_and_fold(fitted):
    train, _, _ = fitted
    mix = MixSettings(decay_grid=(0.1, 0.5), shape_grid=(1.0, 2.0), holdout_share=0.3)
    table = M.sweep(train, mix, folds=3)
    got = table.collect()
    assert {(r["grid"], r["fold"]) for r in got} == {(g, f) for g in range(4) for f in range(3)}
    assert all(r["n"] > 0 and r["rmse_w"] > 0 and r["wmape"] > 0 for r in got)
    mean = {g: np.mean([r["rmse_w"] for r in got if r["grid"] == g]) for g in range(4)}
    assert min(mean, key=mean.get) == 3  # decay .5 and shape 2, which made the panel

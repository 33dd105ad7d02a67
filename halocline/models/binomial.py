"""Hierarchical binomial model of organic installs, fitted by penalised reweighted least squares.

``organic ~ Binomial(total, p)``, ``logit p = alpha + x.beta + u_country + u_platform``
with normal priors. Every iteration is one distributed pass: tasks reduce their rows
to the blocks of the weighted normal equations, Spark adds the blocks up, and the
driver solves for the coefficients. The country block of the system is diagonal, so it is
eliminated first (Schur complement): what is solved densely has the size of features and platforms,
and everything that grows with the countries is linear in them. The two spreads follow from an
expectation step on the same system; the countries' spread then maximises the marginal likelihood, in which each country's effect is
integrated out by adaptive Gauss-Hermite quadrature on the executors.

Draws come from the normal approximation at the mode. How far they are from the posterior is measured: all draws get their log posterior
in one distributed pass, and Pareto-smoothed importance weights with the shape of their tail.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from halocline.config import BinomialSettings
from halocline.models.prep import Prep, apply_prep, fit_prep


@dataclass(frozen=True)
class Curvature:
    """Inverse of the penalised information, in blocks.

    ``core`` is the covariance of the dense part (intercept, features, platforms), ``diagonal`` the
    information of each country given the rest, ``cross`` the information between countries and dense part.
    """

    core: np.ndarray
    diagonal: np.ndarray
    cross: np.ndarray

    def core_sd(self) -> np.ndarray:
        return np.sqrt(np.diag(self.core))

    def country_variance(self) -> np.ndarray:
        lean = self.cross / self.diagonal[:, None]
        return 1.0 / self.diagonal + np.einsum("ij,jk,ik->i", lean, self.core, lean)


@dataclass(frozen=True)
class BinomialModel:
    prep: Prep
    alpha: float
    beta: tuple[float, ...]
    u_country: tuple[float, ...]
    u_platform: tuple[float, ...]
    sigma_country: float
    sigma_platform: float
    curvature: Curvature
    iterations: int
    converged: bool


def _blocks(theta: np.ndarray, n_fixed: int, n_country: int):
    """Task-side reduction of rows to normal-equation blocks.

    The design of a row is dense in ``1 + features`` and has a single one among the
    countries and platforms, so per task only the blocks of present categories are
    emitted: ``kind, i`` names the block row and ``v`` holds the weighted sums
    against the dense part, the platforms and the right-hand side.
    """
    beta = theta[:n_fixed]
    u_c = theta[n_fixed : n_fixed + n_country]
    u_p = theta[n_fixed + n_country :]
    n_p = len(u_p)

    def reduce_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = np.zeros((n_fixed, n_fixed + n_p + 1))
        country: dict[int, np.ndarray] = {}
        platform: dict[int, np.ndarray] = {}
        loglik = 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.column_stack([np.ones(len(pdf)), np.vstack(pdf["x"].to_numpy())])
            c = pdf["country_idx"].to_numpy()
            p = pdf["platform_idx"].to_numpy()
            k = pdf["k"].to_numpy(dtype=float)
            n = pdf["n"].to_numpy(dtype=float)
            eta = x @ beta + u_c[c] + u_p[p]
            small = np.exp(-np.abs(eta))  # never overflows, whatever the row
            prob = np.where(eta >= 0, 1.0, small) / (1.0 + small)
            w = n * small / (1.0 + small) ** 2
            score = k - n * prob
            loglik += float(np.sum(k * eta - n * np.logaddexp(0.0, eta)))
            hot = np.zeros((len(pdf), n_p))
            hot[np.arange(len(pdf)), p] = 1.0
            row = np.column_stack([x * w[:, None], hot * w[:, None], score])
            dense[:, :-1] += x.T @ row[:, :-1]
            dense[:, -1] += x.T @ score
            for table, idx in ((country, c), (platform, p)):
                present, where = np.unique(idx, return_inverse=True)
                sums = np.zeros((len(present), row.shape[1]))
                np.add.at(sums, where, row)
                for j, s in zip(present, sums):
                    table[int(j)] = table.get(int(j), 0.0) + s
        out = [("x", i, v) for i, v in enumerate(dense)]
        out += [("c", i, v) for i, v in country.items()]
        out += [("p", i, v) for i, v in platform.items()]
        out.append(("l", 0, np.array([loglik])))
        yield pd.DataFrame(
            {"kind": [o[0] for o in out], "i": [o[1] for o in out], "v": [o[2].tolist() for o in out]}
        )

    return reduce_task


@dataclass
class Equations:
    """Information and score at some coefficients: dense part first, then one entry or row per country."""

    info: np.ndarray
    score: np.ndarray
    diagonal: np.ndarray
    cross: np.ndarray
    country_score: np.ndarray
    loglik: float


def _normal_equations(matrix: DataFrame, theta: np.ndarray, n_fixed: int, n_c: int, n_p: int) -> Equations:
    """Sums of one pass; what is collected is linear in the countries."""
    parts = matrix.mapInPandas(_blocks(theta, n_fixed, n_c), "kind string, i int, v array<double>")
    sums = (
        parts.select("kind", "i", F.posexplode("v").alias("j", "v")).groupBy("kind", "i", "j").agg(F.sum("v")).collect()
    )
    size = n_fixed + n_p
    out = Equations(np.zeros((size, size)), np.zeros(size), np.zeros(n_c), np.zeros((n_c, size)), np.zeros(n_c), 0.0)
    for kind, i, j, v in sums:
        if kind == "l":
            out.loglik = v
        elif kind == "c":
            if j == size:
                out.country_score[i] = v
            else:
                out.cross[i, j] = v
        else:
            row = i if kind == "x" else n_fixed + i
            if j == size:
                out.score[row] = v
            else:
                out.info[row, j] = out.info[j, row] = v
    out.diagonal[:] = out.cross[:, 0]  # the intercept's column sums a country's weights
    return out


def _solve(eq: Equations, core_precision: np.ndarray, country_precision: float, core: np.ndarray, country: np.ndarray):
    """Newton step of the penalised likelihood for the dense part and the countries, and the curvature."""
    diagonal = eq.diagonal + country_precision
    g_core = eq.score - core_precision * core
    g_country = eq.country_score - country_precision * country
    lean = eq.cross / diagonal[:, None]
    inverse = np.linalg.inv(eq.info + np.diag(core_precision) - eq.cross.T @ lean)
    step = inverse @ (g_core - lean.T @ g_country)
    return step, (g_country - eq.cross @ step) / diagonal, Curvature(inverse, diagonal, eq.cross)


def _spread(u: np.ndarray, variances: np.ndarray, prior: float) -> float:
    """Expectation step for a group spread under a half-normal prior."""
    n, s = len(u), float(u @ u + variances.sum())
    if not n:
        return prior
    var = prior**2 * (-n + math.sqrt(n * n + 4.0 * s / prior**2)) / 2.0
    return math.sqrt(max(var, 1e-8))


@dataclass
class _Mode:
    """Where the Newton steps ended."""

    core: np.ndarray
    country: np.ndarray
    sigma_c: float
    sigma_p: float
    curvature: Curvature
    steps: int
    converged: bool


def _prepared(df: DataFrame, prep: Prep, organic: str, total: str) -> DataFrame:
    counts = {"k": F.col(organic).cast("double"), "n": F.col(total).cast("double")}
    return apply_prep(df.withColumns(counts), prep, ["k", "n"])


def _precision(settings: BinomialSettings, n_features: int, n_p: int, sigma_p: float) -> np.ndarray:
    """Prior precisions of the dense part: intercept, features, platforms."""
    fixed = [[settings.alpha_prior_sigma**-2], np.full(n_features, settings.beta_prior_sigma**-2)]
    return np.concatenate([*fixed, np.full(n_p, sigma_p**-2)])


def _find_mode(
    matrix: DataFrame, start: _Mode, n_fixed: int, settings: BinomialSettings, learn_country: bool, learn_platform: bool
) -> _Mode:
    """Newton steps on the penalised likelihood, with an expectation step for the spreads that are to be learned."""
    core, country, sigma_c, sigma_p = start.core, start.country, start.sigma_c, start.sigma_p
    n_c, n_p = len(country), len(core) - n_fixed
    learn = learn_country or learn_platform
    step, country_step = np.zeros_like(core), np.zeros_like(country)
    best, largest, converged, steps = -math.inf, math.inf, False, 0

    def equations() -> Equations:
        return _normal_equations(matrix, np.concatenate([core[:n_fixed], country, core[n_fixed:]]), n_fixed, n_c, n_p)

    def penalty(core: np.ndarray, country: np.ndarray, core_precision: np.ndarray) -> float:
        return 0.5 * float(core_precision @ core**2 + country @ country / sigma_c**2)

    def precision() -> np.ndarray:
        return _precision(settings, n_fixed - 1, n_p, sigma_p)

    for steps in range(1, settings.max_iter + 1):
        core_precision = precision()
        eq = equations()
        while eq.loglik - penalty(core, country, core_precision) < best - 1e-9 * abs(best) and largest > settings.tol:
            step, country_step, largest = step / 2, country_step / 2, largest / 2
            core, country = core - step, country - country_step
            eq = equations()
        old, at, at_country = (sigma_c, sigma_p), core, country
        # near the mode the spreads settle on the equations of this pass, without reading the rows again
        rounds = settings.spread_rounds if largest < 0.1 else 1
        for _ in range(rounds if learn else 1):
            step, country_step, curvature = _solve(eq, precision(), sigma_c**-2, at, at_country)
            core, country = at + step, at_country + country_step
            if not learn:
                break
            last = (sigma_c, sigma_p)
            if learn_country:
                sigma_c = _spread(country, curvature.country_variance(), settings.spread_prior_sigma)
            if learn_platform:
                sigma_p = _spread(core[n_fixed:], np.diag(curvature.core)[n_fixed:], settings.spread_prior_sigma)
            if max(abs(sigma_c / last[0] - 1.0), abs(sigma_p / last[1] - 1.0)) < settings.spread_tol:
                break
        moved = max(abs(sigma_c / old[0] - 1.0), abs(sigma_p / old[1] - 1.0))
        # the value to beat, under the spreads that the next pass will use
        best = eq.loglik - penalty(at, at_country, precision())
        largest = max(np.abs(step).max(initial=0.0), np.abs(country_step).max(initial=0.0))
        if largest < settings.tol and moved < settings.spread_tol:
            converged = True
            break
    return _Mode(core, country, sigma_c, sigma_p, curvature, start.steps + steps, converged)


def node_likelihoods(matrix: DataFrame, mode: _Mode, n_fixed: int, nodes: int) -> DataFrame:
    """Per country its log likelihood at the nodes ``u + sqrt(2) * s * t`` around its mode ``u`` with conditional deviation ``s``.

    Tasks send one row per country that they hold; the sums have ``nodes`` columns ``l0, l1, ...`` and a row per country.
    """
    places, _ = np.polynomial.hermite.hermgauss(nodes)
    beta, u_p, u_c = mode.core[:n_fixed], mode.core[n_fixed:], mode.country
    reach = math.sqrt(2.0) / np.sqrt(mode.curvature.diagonal)

    def reduce_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.column_stack([np.ones(len(pdf)), np.vstack(pdf["x"].to_numpy())])
            c, p = pdf["country_idx"].to_numpy(), pdf["platform_idx"].to_numpy()
            k, n = pdf["k"].to_numpy(dtype=float), pdf["n"].to_numpy(dtype=float)
            eta = (x @ beta + u_p[p] + u_c[c])[:, None] + reach[c][:, None] * places
            ll = k[:, None] * eta - n[:, None] * np.logaddexp(0.0, eta)
            present, where = np.unique(c, return_inverse=True)
            block = np.zeros((len(present), nodes))
            np.add.at(block, where, ll)
            for i, v in zip(present.tolist(), block):
                sums[i] = sums.get(i, 0.0) + v
        if sums:
            yield pd.DataFrame({"i": list(sums), "v": [v.tolist() for v in sums.values()]})

    parts = matrix.mapInPandas(reduce_task, "i int, v array<double>")
    return parts.groupBy("i").agg(*[F.sum(F.get("v", F.lit(q))).alias(f"l{q}") for q in range(nodes)])


def marginal_likelihood(at_nodes: DataFrame, mode: _Mode, nodes: int, sigmas: np.ndarray) -> np.ndarray:
    """Log marginal likelihood of all countries at each spread: their effects are integrated out where their data is."""
    places, weights = np.polynomial.hermite.hermgauss(nodes)
    u_c, reach = mode.country, math.sqrt(2.0) / np.sqrt(mode.curvature.diagonal)

    def reduce_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(sigmas))
        for pdf in batches:
            c = pdf["i"].to_numpy()
            ll = pdf[[f"l{q}" for q in range(nodes)]].to_numpy()
            z = u_c[c][:, None] + reach[c][:, None] * places
            terms = (ll + places**2 + np.log(weights) + np.log(reach[c])[:, None])[:, :, None] - z[:, :, None] ** 2 / (2.0 * sigmas**2)
            top = terms.max(axis=1, keepdims=True)
            inside = top[:, 0, :] + np.log(np.exp(terms - top).sum(axis=1))
            total += (inside - np.log(sigmas * math.sqrt(2.0 * math.pi))).sum(axis=0)
        yield pd.DataFrame({"j": np.arange(len(sigmas)), "v": total})

    sums = at_nodes.mapInPandas(reduce_task, "j int, v double").groupBy("j").agg(F.sum("v")).collect()
    out = np.zeros(len(sigmas))
    for j, v in sums:
        out[j] = v
    return out


def quadrature_spread(matrix: DataFrame, mode: _Mode, n_fixed: int, settings: BinomialSettings) -> float:
    """The countries' spread with the greatest marginal likelihood times its half-normal prior, given everything else."""
    nodes = settings.quadrature_nodes
    at_nodes = node_likelihoods(matrix, mode, n_fixed, nodes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        low, high = math.log(mode.sigma_c / 8.0), math.log(mode.sigma_c * 8.0)
        for _ in range(3):  # each round of 33 points narrows the range by 16
            grid = np.linspace(low, high, 33)
            sigmas = np.exp(grid)
            value = marginal_likelihood(at_nodes, mode, nodes, sigmas) - sigmas**2 / (2.0 * settings.spread_prior_sigma**2)
            best = int(value.argmax())
            low, high = grid[max(best - 1, 0)], grid[min(best + 1, 32)]
    finally:
        at_nodes.unpersist()
    return max(float(sigmas[best]), 1e-4)


def fit_binomial(
    train: DataFrame,
    *,
    features: Sequence[str],
    organic: str = "organic_installs",
    total: str = "total_installs",
    settings: BinomialSettings = BinomialSettings(),
    prep: Prep | None = None,
    learn_spread: bool = True,
    spreads: tuple[float, float] = (0.5, 0.5),
) -> BinomialModel:
    """Posterior mode and curvature. The prepared matrix is kept across the passes.

    A step that lowers the penalised likelihood is halved and tried again. ``converged`` says whether the
    last step stayed below ``tol`` and the spreads moved less than ``spread_tol`` (relative) in the last pass. Without
    ``quadrature_rounds`` the spreads are those of the expectation step.
    """
    prep = prep or fit_prep(train, features)
    matrix = _prepared(train, prep, organic, total).persist(StorageLevel.MEMORY_AND_DISK)
    n_fixed, n_c, n_p = 1 + len(features), len(prep.countries), len(prep.platforms)
    start = _Mode(np.zeros(n_fixed + n_p), np.zeros(n_c), *spreads, None, 0, False)
    try:
        mode = _find_mode(matrix, start, n_fixed, settings, learn_spread, learn_spread)
        for _ in range(settings.quadrature_rounds if learn_spread and n_c and mode.converged else 0):
            before, mode.sigma_c = mode.sigma_c, quadrature_spread(matrix, mode, n_fixed, settings)
            settled = abs(mode.sigma_c / before - 1.0) < 10 * settings.spread_tol
            mode = _find_mode(matrix, mode, n_fixed, settings, False, learn_spread)
            if settled:
                break
    finally:
        matrix.unpersist()
    return BinomialModel(
        prep=prep,
        alpha=float(mode.core[0]),
        beta=tuple(mode.core[1:n_fixed]),
        u_country=tuple(mode.country),
        u_platform=tuple(mode.core[n_fixed:]),
        sigma_country=mode.sigma_c,
        sigma_platform=mode.sigma_p,
        curvature=mode.curvature,
        iterations=mode.steps,
        converged=mode.converged,
    )


def predict_binomial(model: BinomialModel, df: DataFrame) -> DataFrame:
    """Add ``pred``, the share at the fitted coefficients. Effects are joined by name as a small table; unknown names get the first one's."""
    from halocline.functions.scalar import inv_logit
    from halocline.models.prep import with_category, scaled

    z = F.lit(model.alpha)
    for b, column in zip(model.beta, scaled(model.prep).values()):
        z = z + column * F.lit(float(b))
    out = df
    for column, values, effects in (
        ("country_code", model.prep.countries, model.u_country),
        ("platform", model.prep.platforms, model.u_platform),
    ):
        out = with_category(out, column, values, f"_u_{column}", [float(u) for u in effects])
        z = z + F.col(f"_u_{column}")
    return out.withColumn("pred", inv_logit(z)).drop("_u_country_code", "_u_platform")


def counts_from_share(df: DataFrame, share: str, total: str) -> DataFrame:
    """Organic installs rebuilt as a rounded product, halves to even."""
    return df.withColumn("organic_installs", F.rint(F.col(share) * F.col(total)).cast("bigint"))


def parameter_names(model: BinomialModel) -> list[str]:
    return [
        "alpha",
        *[f"beta[{f}]" for f in model.prep.features],
        *[f"u_country[{c}]" for c in model.prep.countries],
        *[f"u_platform[{p}]" for p in model.prep.platforms],
    ]


def effects_table(model: BinomialModel, spark: SparkSession) -> DataFrame:
    """Every coefficient with its posterior deviation."""
    values = [model.alpha, *model.beta, *model.u_country, *model.u_platform]
    core, n = model.curvature.core_sd(), 1 + len(model.beta)
    sds = [*core[:n], *np.sqrt(model.curvature.country_variance()), *core[n:]]
    rows = [(n, float(v), float(s)) for n, v, s in zip(parameter_names(model), values, sds)]
    return spark.createDataFrame(rows, "param string, value double, sd double")


def fit_table(model: BinomialModel, spark: SparkSession) -> DataFrame:
    """One row about the fit itself."""
    row = (model.iterations, model.converged, model.sigma_country, model.sigma_platform)
    return spark.createDataFrame([row], "iterations int, converged boolean, sigma_country double, sigma_platform double")


@dataclass(frozen=True)
class _Sampler:
    """The normal approximation as a function from a draw's number to the draw; small, and the same on every executor."""

    core: np.ndarray
    country: np.ndarray
    root: np.ndarray
    lean: np.ndarray
    spread: np.ndarray
    seed: int

    def draw(self, number: int) -> tuple[np.ndarray, np.ndarray, float]:
        """(dense part, countries, half the squared length in standard units)."""
        rng = np.random.default_rng([self.seed, number])
        a, b = rng.standard_normal(len(self.core)), rng.standard_normal(len(self.country))
        off = self.root @ a
        return self.core + off, self.country - self.lean @ off + self.spread * b, 0.5 * float(a @ a + b @ b)


def _sampler(model: BinomialModel, seed: int) -> _Sampler:
    core, bend = np.array([model.alpha, *model.beta, *model.u_platform]), model.curvature
    root = np.linalg.cholesky(bend.core + 1e-12 * np.eye(len(core)))
    return _Sampler(core, np.array(model.u_country), root, bend.cross / bend.diagonal[:, None], 1.0 / np.sqrt(bend.diagonal), seed)


def posterior_draws(
    model: BinomialModel, spark: SparkSession, settings: BinomialSettings = BinomialSettings()
) -> DataFrame:
    """Draws of the normal approximation as a long table ``(chain, draw, param, value)``, made on the executors.

    The dense part is drawn from its covariance, the countries given it. Each draw is seeded by its own number, so
    a lost task gives the same rows again.
    """
    names, n = parameter_names(model), 1 + len(model.beta)
    sampler, per_chain = _sampler(model, settings.random_seed), settings.draws

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number in pdf["id"].tolist():
                core, country, _ = sampler.draw(number)
                values = np.concatenate([core[:n], country, core[n:]])
                yield pd.DataFrame(
                    {"chain": number // per_chain, "draw": number % per_chain, "param": names, "value": values}
                )

    ids = spark.range(settings.chains * per_chain)
    return ids.mapInPandas(draw, "chain int, draw int, param string, value double")


#: Rows times draws that a task multiplies at a time.
CELLS = 2_000_000


def log_ratios(
    model: BinomialModel, train: DataFrame, settings: BinomialSettings = BinomialSettings(),
    organic: str = "organic_installs", total: str = "total_installs",
) -> DataFrame:
    """``(number, log_ratio)``: log posterior less log density of the approximation for every draw, up to a constant.

    One pass over the rows: a task adds up its rows' log likelihood for all draws and sends one number per draw.
    """
    n_fixed, n_p = 1 + len(model.beta), len(model.u_platform)
    draws = settings.chains * settings.draws
    sampler = _sampler(model, settings.random_seed)
    core_precision, country_precision = _precision(settings, n_fixed - 1, n_p, model.sigma_platform), model.sigma_country**-2
    matrix = _prepared(train, model.prep, organic, total)

    def reduce_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = [sampler.draw(number) for number in range(draws)]
        core, country = np.array([m[0] for m in made]), np.array([m[1] for m in made])
        total = np.zeros(draws)
        size = max(1, CELLS // draws)
        for pdf in batches:
            for lo in range(0, len(pdf), size):
                part = pdf.iloc[lo : lo + size]
                x = np.column_stack([np.ones(len(part)), np.vstack(part["x"].to_numpy())])
                c, p = part["country_idx"].to_numpy(), part["platform_idx"].to_numpy()
                k, n = part["k"].to_numpy(dtype=float), part["n"].to_numpy(dtype=float)
                eta = x @ core[:, :n_fixed].T + country[:, c].T + core[:, n_fixed + p].T
                total += k @ eta - n @ np.logaddexp(0.0, eta)
        yield pd.DataFrame({"number": np.arange(draws), "v": total})

    def with_density(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for number, v in zip(pdf["number"].tolist(), pdf["v"].tolist()):
                core, country, length = sampler.draw(number)
                out.append(v - 0.5 * float(core_precision @ core**2 + country_precision * country @ country) + length)
            yield pd.DataFrame({"number": pdf["number"], "log_ratio": out})

    sums = matrix.mapInPandas(reduce_task, "number int, v double").groupBy("number").agg(F.sum("v").alias("v"))
    return sums.mapInPandas(with_density, "number int, log_ratio double")


def importance_weights(
    model: BinomialModel, train: DataFrame, settings: BinomialSettings = BinomialSettings(), **columns: str
) -> DataFrame:
    """``(chain, draw, weight, shape)``: smoothed weights that turn the draws into draws of the posterior; they sum to 1.

    The smoothing sees one number per draw. A ``shape`` above 0.7 says that the approximation is too far off for the weights to help.
    """
    per_chain = settings.draws

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        weights, shape = smoothed_weights(pdf["log_ratio"].to_numpy())
        number = pdf["number"].to_numpy()
        return pd.DataFrame({"chain": number // per_chain, "draw": number % per_chain, "weight": weights, "shape": shape})

    ratios = log_ratios(model, train, settings, **columns)
    return ratios.groupBy().applyInPandas(smooth, "chain int, draw int, weight double, shape double")


def importance_summary(weights: DataFrame) -> DataFrame:
    """One row: draws, their effective number, the greatest weight, and the shape of the tail of the raw weights."""
    w = F.col("weight")
    return weights.agg(
        F.count(F.lit(1)).alias("n_draws"), (1.0 / F.sum(w * w)).alias("n_effective"), F.max(w).alias("max_weight"), F.max("shape").alias("shape")
    )


def weighted_summary(draws: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean and deviation per parameter under the weights, which have one row per draw."""
    joined = draws.join(F.broadcast(weights.select("chain", "draw", "weight")), ["chain", "draw"])
    w, v = F.col("weight"), F.col("value")
    sums = joined.groupBy("param").agg(F.sum(w * v).alias("mean"), F.sum(w * v * v).alias("_square"))
    return sums.select("param", "mean", F.sqrt(F.greatest(F.col("_square") - F.pow("mean", F.lit(2)), F.lit(0.0))).alias("sd"))


def pareto_tail(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto distribution (Zhang and Stephens), with a weak prior on the shape."""
    x = np.sort(excess)
    n = len(x)
    trials = 30 + int(math.sqrt(n))
    ladder = (1.0 - np.sqrt(trials / (np.arange(1, trials + 1) - 0.5))) / (3.0 * x[int(n / 4 + 0.5) - 1]) + 1.0 / x[-1]
    shapes = np.log1p(-ladder[:, None] * x).mean(axis=1)
    fits = n * (np.log(-ladder / shapes) - shapes - 1.0)
    belief = np.exp(fits - fits.max())
    theta = float(ladder @ belief / belief.sum())
    shape = float(np.log1p(-theta * x).mean())
    return (n * shape + 10 * 0.5) / (n + 10), -shape / theta


def smoothed_weights(log_ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Pareto-smoothed importance weights: the largest raw weights are replaced by the quantiles of the fitted tail."""
    raw = log_ratio - log_ratio.max()
    size = len(raw)
    tail = math.ceil(min(0.2 * size, 3.0 * math.sqrt(size)))
    order = np.argsort(raw, kind="stable")
    out, shape = raw.copy(), math.inf
    if tail >= 5 and tail < size:
        cut = float(np.exp(raw[order[-tail - 1]]))
        top = order[-tail:]
        excess = np.exp(raw[top]) - cut
        if excess[-1] - excess[0] > 1e-12 and excess[int(tail / 4 + 0.5) - 1] > 0:
            shape, scale = pareto_tail(excess)
            place = (np.arange(tail) + 0.5) / tail
            heights = scale * np.expm1(-shape * np.log1p(-place)) / shape if abs(shape) > 1e-12 else -scale * np.log1p(-place)
            out[top] = np.minimum(np.log(cut + heights), 0.0)
        else:
            shape = 0.0  # no tail: all large weights are equal
    weights = np.exp(out)
    return weights / weights.sum(), shape

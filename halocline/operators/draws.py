"""Summaries of a long table of posterior draws ``(chain, draw, param, value)``.

Every parameter has chains x draws rows, a number set by the sampler and not by
the data, so per-parameter windows and groups are bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HDI_PROB = 0.94
RHAT_LIMIT = 1.01
ESS_LIMIT = 200


def posterior_mean(draws: DataFrame, by: Sequence[str] = ("param",)) -> DataFrame:
    return draws.groupBy(*by).agg(F.avg("value").alias("mean"))


def hdi(draws: DataFrame, by: Sequence[str] = ("param",), prob: float = HDI_PROB) -> DataFrame:
    """Narrowest interval that spans ``floor(prob * n)`` ordered steps, leftmost on ties."""
    by = list(by)
    ordered = Window.partitionBy(*by).orderBy("value")
    ranked = draws.select(
        *by,
        "value",
        F.row_number().over(ordered).cast("bigint").alias("_rank"),
        F.floor(F.lit(prob) * F.count(F.lit(1)).over(Window.partitionBy(*by))).alias("_steps"),
    )
    low = ranked.select(*by, F.col("value").alias("lo"), (F.col("_rank") + F.col("_steps")).alias("_rank"))
    high = ranked.select(*by, F.col("value").alias("hi"), "_rank")
    spans = low.join(high, [*by, "_rank"])
    best = F.min(F.struct((F.col("hi") - F.col("lo")).alias("width"), "_rank", "lo", "hi"))
    return spans.groupBy(*by).agg(best.alias("_best")).select(
        *by, F.col("_best.lo").alias("hdi_lo"), F.col("_best.hi").alias("hdi_hi")
    )


def summary(
    draws: DataFrame, by: Sequence[str] = ("param",), prob: float = HDI_PROB, sample_sd: bool = False
) -> DataFrame:
    """Mean, standard deviation and highest-density interval per parameter."""
    sd = F.stddev_samp("value") if sample_sd else F.stddev_pop("value")
    stats = draws.groupBy(*by).agg(F.avg("value").alias("mean"), sd.alias("sd"))
    return stats.join(hdi(draws, by, prob), list(by))


def top_coefficients(draws: DataFrame, top: int = 20) -> DataFrame:
    """Parameters with the largest absolute posterior mean."""
    return (
        summary(draws)
        .withColumn("abs_mean", F.abs("mean"))
        .orderBy(F.desc("abs_mean"), "param")
        .limit(top)
    )


def channel_effects(draws: DataFrame) -> DataFrame:
    """Mean and interval per channel, averaged over geos, from draws with ``geo`` and ``channel``."""
    per_geo = summary(draws, ("geo", "channel"))
    return per_geo.groupBy("channel").agg(
        F.avg("mean").alias("mean"), F.avg("hdi_lo").alias("hdi_lo"), F.avg("hdi_hi").alias("hdi_hi")
    )


def split_rhat(draws: DataFrame) -> DataFrame:
    """Split R-hat per parameter: every chain is halved, then between- and within-half variances compared."""
    longest = F.max("draw").over(Window.partitionBy("param", "chain")) + 1
    halves = draws.withColumn("_half", F.when(F.col("draw") < F.floor(longest / 2), 0).otherwise(1))
    parts = halves.groupBy("param", "chain", "_half").agg(
        F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count(F.lit(1)).alias("n")
    )
    within, between = F.avg("v"), F.var_samp("m")
    n = F.min("n")
    return parts.groupBy("param").agg(
        F.sqrt(F.try_divide((n - 1) / n * within + between, within)).alias("rhat")
    )


def _ess(chains: np.ndarray) -> float:
    """Effective sample size of split chains (rows), Geyer's initial positive monotone sequence."""
    m, n = chains.shape
    if n < 4 or np.allclose(chains, chains[0, 0]):
        return float(m * n)
    centred = chains - chains.mean(axis=1, keepdims=True)
    size = 1 << (2 * n - 1).bit_length()
    spectrum = np.fft.rfft(centred, size, axis=1)
    cov = np.fft.irfft(spectrum * np.conj(spectrum), size, axis=1)[:, :n] / n
    within = cov[:, 0].mean() * n / (n - 1)
    total = within * (n - 1) / n + (chains.mean(axis=1).var(ddof=1) if m > 1 else 0.0)
    rho = 1.0 - (within - cov.mean(axis=0) * n / (n - 1)) / total
    rho[0] = 1.0
    pair = rho[: n - n % 2].reshape(-1, 2).sum(axis=1)
    stop = np.argmax(pair < 0) if (pair < 0).any() else len(pair)
    tau = -1.0 + 2.0 * np.minimum.accumulate(pair[:stop]).sum()
    tau = max(tau, 1.0 / np.log10(m * n))
    return float(m * n / tau)


def _halves(values: np.ndarray) -> np.ndarray:
    n = values.shape[1] // 2
    return np.concatenate([values[:, :n], values[:, -n:]], axis=0)


def _normal_scores(values: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    rank = pd.Series(values.ravel()).rank(method="average").to_numpy()
    quantile = (rank - 0.375) / (values.size + 0.25)
    inv = NormalDist().inv_cdf
    return np.array([inv(q) for q in quantile]).reshape(values.shape)


def _rhat(chains: np.ndarray) -> float:
    n = chains.shape[1]
    within = chains.var(axis=1, ddof=1).mean()
    if within == 0:
        return 1.0
    return float(np.sqrt(((n - 1) / n * within + chains.mean(axis=1).var(ddof=1)) / within))


def _even_chains(rows: pd.DataFrame) -> np.ndarray:
    """Chains as rows. Every chain has to hold the same draws, without gaps, repeats or undefined values."""
    wide = rows.pivot(index="chain", columns="draw", values="value").to_numpy(dtype=float)
    if not np.isfinite(wide).all():
        raise ValueError(f"chains of '{rows['param'].iloc[0]}' differ in their draws or hold undefined values")
    return wide


def _diagnose(rows: pd.DataFrame) -> pd.DataFrame:
    wide = _even_chains(rows)
    halves = _halves(wide)
    scores = _normal_scores(halves)
    folded = _normal_scores(np.abs(halves - np.median(halves)))
    tails = [_ess((halves <= np.quantile(halves, q)).astype(float)) for q in (0.05, 0.95)]
    sd, ess_mean = wide.std(ddof=1), _ess(halves)
    # the error of a standard deviation follows from that of the mean square
    square = (halves - halves.mean()) ** 2
    error_square = square.std(ddof=1) / np.sqrt(_ess(square))
    return pd.DataFrame(
        {
            "param": [rows["param"].iloc[0]],
            "r_hat": [max(_rhat(scores), _rhat(folded))],
            "ess_bulk": [_ess(scores)],
            "ess_tail": [min(tails)],
            "mcse_mean": [sd / np.sqrt(ess_mean)],
            "mcse_sd": [error_square / (2.0 * sd) if sd > 0 else 0.0],
        }
    )


def diagnostics(draws: DataFrame) -> DataFrame:
    """Mean, sd, interval, rank-normalised R-hat, bulk and tail sample size, and errors of mean and sd.

    Raises where a parameter's chains do not hold the same draws.
    """
    series = draws.groupBy("param").applyInPandas(
        _diagnose, "param string, r_hat double, ess_bulk double, ess_tail double, mcse_mean double, mcse_sd double"
    )
    return summary(draws, sample_sd=True).join(series, "param")


def convergence_overview(diag: DataFrame) -> DataFrame:
    """How many parameters miss the R-hat and sample-size limits, and the extremes; an undefined statistic misses its limit."""
    n = F.count(F.lit(1))

    def bad(column: str, over) -> Column:
        undefined = F.col(column).isNull() | F.isnan(column)
        return F.count_if(undefined | over)

    def defined(column: str) -> Column:
        return F.nanvl(F.col(column), F.lit(None).cast("double"))

    bad_rhat = bad("r_hat", F.col("r_hat") > RHAT_LIMIT)
    bad_ess = bad("ess_bulk", F.col("ess_bulk") < ESS_LIMIT)
    either = defined("r_hat").isNull() | defined("ess_bulk").isNull()
    return diag.agg(
        n.alias("n_params"),
        bad_rhat.alias("n_bad_rhat"),
        (bad_rhat / n).alias("share_bad_rhat"),
        bad_ess.alias("n_bad_ess"),
        (bad_ess / n).alias("share_bad_ess"),
        F.max(defined("r_hat")).alias("max_rhat"),
        F.min(defined("ess_bulk")).alias("min_ess_bulk"),
        F.count_if(either).alias("n_undefined"),
    )


def scalar_parameters(diag: DataFrame) -> DataFrame:
    """Parameters without an index in their name."""
    return diag.filter(F.col("param").rlike("^[A-Za-z_]+$"))

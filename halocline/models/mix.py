"""Marketing-mix model: organic installs per geo explained by carried-over, saturated spend.

A grid of carry-over and saturation settings is unfolded as rows of one plan. Per
grid point and geo the panel is reduced to normal equations (a geo has one row per
time bucket, so the calendar bounds the group). Pooled coefficients come from the
summed equations; each geo then solves its own small non-negative ridge pulled
towards them, on the executors. The grid point with the smallest weighted error on
the last part of the calendar wins. From there Gauss-Newton steps leave the grid, and an
empirical Bayes fit learns how strongly each coefficient is pooled. Spend and target are scaled per geo and scaled
back explicitly, so predictions are in installs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from halocline.config import MixSettings
from halocline.functions import scalar as S
from halocline.operators.adstock import complete_buckets, geometric_weights, lag_columns, with_warmup

POOLED_RIDGE = 1e-3


@dataclass(frozen=True)
class MixModel:
    """``pull`` is what ties each coefficient of a geo to the pooled one, in units of its normal equations."""

    mix: MixSettings
    channels: tuple[str, ...]
    controls: tuple[str, ...]
    decay: float
    shape: float
    pooled: tuple[float, ...]
    pull: tuple[float, ...]
    coefficients: DataFrame
    scales: DataFrame
    grid_scores: DataFrame

    @property
    def parts(self) -> list[str]:
        return ["intercept", *self.controls, *self.channels]


def channel_list(panel: DataFrame) -> list[str]:
    return [c for c in panel.columns if c.startswith("spend_")]


def control_list(panel: DataFrame) -> list[str]:
    return [c for c in panel.columns if c.startswith(("dow_", "year_"))]


def model_panel(panel: DataFrame, mix: MixSettings) -> DataFrame:
    """Panel at model grain: one series when the geo dimension is off, yearly terms when asked for."""
    if not mix.geo_dim:
        sums = ["organic_installs", "total_installs", *channel_list(panel)]
        controls = [F.first(c).alias(c) for c in control_list(panel)]
        panel = panel.groupBy("install_date").agg(*[F.sum(c).alias(c) for c in sums], *controls)
        panel = panel.withColumn("geo", F.lit("all"))
    return panel.withColumns(S.yearly_terms(F.col("install_date"), mix.yearly_seasonality))


def scale_table(train: DataFrame, channels: Sequence[str], target: str) -> DataFrame:
    """Largest target and spend per geo, 1 where that is zero."""

    def largest(c: str, name: str) -> Column:
        top = F.max(F.col(c).cast("double"))
        return F.when(top > 0, top).otherwise(1.0).alias(name)

    return train.groupBy("geo").agg(
        largest(target, "target_max"), *[largest(c, f"{c}__max") for c in channels]
    )


def lagged_panel(panel: DataFrame, scales: DataFrame, channels: Sequence[str], mix: MixSettings) -> DataFrame:
    """Complete time lines with spend lags and the scales, known geos only."""
    known = panel.join(scales.select("geo"), "geo", "left_semi")
    full = complete_buckets(known, channels, mix.cadence_days)
    return lag_columns(full, channels, mix.adstock_l_max).join(scales, "geo")


def media(channel: str, mix: MixSettings, decay: Column | float, shape: Column | float) -> Column:
    """Saturated adstock of one channel from its lag array, on the geo's spend scale; weights sum to 1."""
    lag = F.col(f"{channel}__lag")
    if isinstance(decay, float):
        weights: list[Column] = [F.lit(w) for w in geometric_weights(decay, mix.adstock_l_max, normalize=True)]
    else:
        raw = [F.pow(decay, F.lit(k)) for k in range(mix.adstock_l_max)]
        total = sum(raw[1:], raw[0])
        weights = [r / total for r in raw]
    carried = F.lit(0.0)
    for k, w in enumerate(weights):
        carried = carried + F.get(lag, F.lit(k)) * w
    return S.saturate(mix.saturation, carried / F.col(f"{channel}__max"), shape)


def _equations(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Normal equations of the fit part, of all rows, and weighted ones of the hold-out."""
    x = np.vstack(pdf["x"].to_numpy())
    y, w, held = pdf["y"].to_numpy(), pdf["w"].to_numpy(), pdf["held"].to_numpy(dtype=bool)
    xy = np.column_stack([x, y])
    fit = xy[~held].T @ xy[~held]
    every = xy.T @ xy
    out = (xy[held] * w[held, None]).T @ xy[held]
    stats = np.concatenate([fit.ravel(), every.ravel(), out.ravel(), [w[held].sum()]])
    return pd.DataFrame({"grid": [key[0]], "geo": [key[1]], "n": [len(pdf)], "stats": [stats]})


def _unpack(stats: np.ndarray, n: int):
    size = (n + 1) ** 2
    parts = [np.asarray(stats[i * size : (i + 1) * size]).reshape(n + 1, n + 1) for i in range(3)]
    return parts, float(stats[3 * size])


def pulls(pull: float | np.ndarray, n: int) -> np.ndarray:
    return np.broadcast_to(np.asarray(pull, float), (n,))


def solve(equations: np.ndarray, centre: np.ndarray, pull: float | np.ndarray, free: int) -> np.ndarray:
    """Ridge towards ``centre``; coefficients after the first ``free`` are kept non-negative.

    An active-set method on the normal equations, a convex problem of a few unknowns: linear systems over the coefficients off
    their bound. Near-collinear columns, as of channels with steady spend, take no more steps than others. No set comes twice, so it ends.
    """
    n = len(centre)
    pull = pulls(pull, n)
    a = equations[:n, :n] + np.diag(pull)
    b = equations[:n, n] + pull * centre
    diagonal = np.diag(a)
    unit = np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
    a, b = a / np.outer(unit, unit), b / unit
    bounded = np.arange(n) >= free
    start = centre * unit
    off, coef = _least(a, b, np.full(n, True), np.where(bounded, np.maximum(start, 0.0), start), bounded)
    seen, refused = {off.tobytes()}, np.full(n, False)
    while True:
        slope = b - a @ coef
        rounding = 8 * n * np.finfo(float).eps * (np.abs(b) + np.abs(a) @ np.abs(coef))
        rising = ~off & ~refused & (slope > rounding)
        if not rising.any():
            return coef / unit
        j = int(np.argmax(np.where(rising, slope, -np.inf)))
        trial_off, trial = _least(a, b, off | (np.arange(n) == j), coef, bounded)
        if trial_off.tobytes() in seen:  # by rounding only
            refused[j] = True
        else:
            off, coef = trial_off, trial
            seen.add(off.tobytes())
            refused[:] = False


def _least(a: np.ndarray, b: np.ndarray, off: np.ndarray, coef: np.ndarray, bounded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients ``off`` their bound, and the least point over them; those that meet zero on the way from ``coef`` leave."""
    while True:
        least = np.zeros(len(b))
        least[off] = np.linalg.lstsq(a[np.ix_(off, off)], b[off], rcond=None)[0]
        below = off & bounded & (least < 0.0)
        if not below.any():
            return off, least
        share = np.full(len(b), np.inf)
        share[below] = coef[below] / (coef[below] - least[below])
        first = share == share.min()
        coef = np.where(first, 0.0, coef + share.min() * (least - coef))
        off = off & ~first


def _solver(pooled: dict[int, np.ndarray], n: int, pull: float | np.ndarray, free: int, final: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for grid, geo, count, stats in zip(pdf["grid"], pdf["geo"], pdf["n"], pdf["stats"]):
                (fit, every, held), weight = _unpack(stats, n)
                coef = solve(every if final else fit, pooled[int(grid)], pull, free)
                gap = np.append(coef, -1.0)
                root, centre = np.zeros(0), np.zeros(0)
                if final:
                    ridge = every[:n, :n] + np.diag(pulls(pull, n))
                    centre = np.linalg.solve(ridge, every[:n, n] + pull * pooled[int(grid)])
                    noise = float(gap @ every @ gap) / max(int(count) - 1, 1)
                    curve = np.linalg.inv(ridge)
                    root = np.linalg.cholesky(curve * max(noise, 0.0) + 1e-12 * np.eye(n))
                rows.append((grid, geo, coef.tolist(), centre.tolist(), root.ravel().tolist(), float(gap @ held @ gap), weight))
            yield pd.DataFrame(rows, columns=["grid", "geo", "coef", "centre", "root", "sse", "weight"])

    return run


@dataclass(frozen=True)
class _Rows:
    """Observed panel rows with lags and scales, and what a design of them is made of."""

    table: DataFrame
    mix: MixSettings
    channels: tuple[str, ...]
    controls: tuple[str, ...]

    @property
    def unknowns(self) -> int:
        return 1 + len(self.controls) + len(self.channels)

    @property
    def free(self) -> int:
        return 1 + len(self.controls)

    def design(self, keys: Sequence[str], decay: Column | float, shape: Column | float) -> DataFrame:
        x = [F.lit(1.0), *[F.col(c).cast("double") for c in self.controls]]
        x += [media(c, self.mix, decay, shape) for c in self.channels]
        return self.table.select(
            *keys,
            F.array(*x).alias("x"),
            (F.col(self.mix.target) / F.col("target_max")).alias("y"),
            (F.col("total_installs") * F.pow(F.col("target_max"), 2)).alias("w"),
            F.col("_held").alias("held"),
        )


def _grid_points(grid: Sequence[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("grid"), F.lit(d).alias("decay"), F.lit(s).alias("shape")) for i, (d, s) in enumerate(grid)])


def _statistics(design: DataFrame) -> DataFrame:
    return design.groupBy("grid", "geo").applyInPandas(_equations, "grid int, geo string, n bigint, stats array<double>")


def _pooled(stats: DataFrame, grids: int, n: int, free: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Coefficients of the summed equations per grid point, of the fit part and of all rows."""
    sums = stats.select("grid", F.posexplode("stats").alias("j", "v")).groupBy("grid", "j").agg(F.sum("v").alias("v")).collect()
    totals = {i: np.zeros(3 * (n + 1) ** 2 + 1) for i in range(grids)}
    for g, j, v in sums:
        totals[g][j] = v
    pooled_fit, pooled_all = {}, {}
    for g, flat in totals.items():
        (fit, every, _), _ = _unpack(flat, n)
        pooled_fit[g] = solve(fit, np.zeros(n), POOLED_RIDGE, free)
        pooled_all[g] = solve(every, np.zeros(n), POOLED_RIDGE, free)
    return pooled_fit, pooled_all


SOLVED = "grid int, geo string, coef array<double>, centre array<double>, root array<double>, sse double, weight double"


def fit_mix(train: DataFrame, mix: MixSettings = MixSettings(), stage: Callable[[DataFrame], DataFrame] | None = None) -> MixModel:
    """Fit on a training panel with ``geo, install_date``, spend columns, target and total installs.

    ``stage`` stores the coefficients (see ``sources.sinks.staged``), so that the fit is not made again when an executor is lost.
    """
    panel = model_panel(train, mix)
    channels, controls = channel_list(panel), control_list(panel)
    spark = train.sparkSession
    scales = scale_table(panel, channels, mix.target)
    grid = [(d, s) for d in mix.decay_grid for s in mix.shape_grid]

    span = panel.agg(F.struct(F.min("install_date").alias("lo"), F.max("install_date").alias("hi"))).scalar()
    lagged = lagged_panel(panel, scales, channels, mix).filter("observed").withColumn("_span", span)
    days = F.datediff(F.col("_span.hi"), F.col("_span.lo"))
    cut = F.date_add(F.col("_span.lo"), F.floor(days * (1.0 - mix.holdout_share)).cast("int"))
    lagged = lagged.withColumn("_held", F.col("install_date") > cut)
    if mix.refine_steps:
        lagged = lagged.persist(StorageLevel.MEMORY_AND_DISK)  # every step reads it
    rows = _Rows(lagged, mix, tuple(channels), tuple(controls))
    n, free = rows.unknowns, rows.free
    unfolded = replace(rows, table=lagged.select("*", F.inline(_grid_points(grid))))
    stats = _statistics(unfolded.design(["grid", "geo"], F.col("decay"), F.col("shape"))).persist(StorageLevel.MEMORY_AND_DISK)
    pooled_fit, pooled_all = _pooled(stats, len(grid), n, free)

    scored = stats.mapInPandas(_solver(pooled_fit, n, mix.shrinkage, free, final=False), SOLVED)
    found = scored.groupBy("grid").agg(F.sqrt(F.try_divide(F.sum("sse"), F.sum("weight"))).alias("rmse")).collect()
    score = {r["grid"]: r["rmse"] for r in found if r["rmse"] is not None}
    if not score:
        raise ValueError("no hold-out row carries weight; enlarge 'holdout_share' or the calendar")
    best = min(range(len(grid)), key=lambda g: (score.get(g, float("inf")), g))
    (decay, shape), winner, centre = grid[best], stats.filter(F.col("grid") == best), pooled_all[best]
    if mix.refine_steps:
        decay, shape = refine(rows, decay, shape)
        if (decay, shape) != grid[best]:
            winner = _statistics(rows.design([F.lit(0).alias("grid"), "geo"], decay, shape)).persist(StorageLevel.MEMORY_AND_DISK)
            best, centre = 0, _pooled(winner, 1, n, free)[1][0]
    pull = np.full(n, mix.shrinkage)
    if mix.learn_pooling:
        centre, pull = learn_pooling(winner, centre, pull, free)[:2]
    coefficients = winner.mapInPandas(_solver({best: centre}, n, pull, free, final=True), SOLVED).select("geo", "coef", "centre", "root")
    if stage:
        coefficients = stage(coefficients)
        for table in (stats, winner, lagged):
            table.unpersist()
    else:
        coefficients, scales = coefficients.persist(StorageLevel.MEMORY_AND_DISK), scales.persist(StorageLevel.MEMORY_AND_DISK)
    scores = [(i, d, s, float(score.get(i, float("nan")))) for i, (d, s) in enumerate(grid)]
    return MixModel(
        mix=mix,
        channels=tuple(channels),
        controls=tuple(controls),
        decay=decay,
        shape=shape,
        pooled=tuple(centre.tolist()),
        pull=tuple(pull.tolist()),
        coefficients=coefficients,
        scales=scales,
        grid_scores=spark.createDataFrame(scores, "grid int, decay double, shape double, holdout_rmse_w double"),
    )


def learn_pooling(
    stats: DataFrame, centre: np.ndarray, pull: np.ndarray, free: int, rounds: int = 60, tol: float = 1e-2
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Empirical Bayes for geos' coefficients ``N(centre, spread^2)``: (centre, pull, spread, noise variance).

    Expectation-maximisation on the geos' normal equations; a round is one pass over them, and what comes back are sums of the size of the
    unknowns. ``pull`` is noise over squared spread, coefficient by coefficient, where a constant strength would tie all alike. Centres after the
    first ``free`` are kept non-negative, as the coefficients are.
    """
    n = len(centre)
    noise = 0.01
    variance = noise / np.maximum(pull, 1e-6)

    def expect(centre: np.ndarray, variance: np.ndarray, noise: float):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(3 * n + 3)
            for pdf in batches:
                for count, flat in zip(pdf["n"], pdf["stats"]):
                    (_, every, _), _ = _unpack(flat, n)
                    gram, right = every[:n, :n], every[:n, n]
                    bend = np.linalg.inv(gram / noise + np.diag(1.0 / variance))
                    mean = bend @ (right / noise + centre / variance)
                    gap = np.append(mean, -1.0)
                    total[:n] += mean
                    total[n : 2 * n] += mean**2
                    total[2 * n : 3 * n] += np.diag(bend)
                    total[3 * n :] += [float(gap @ every @ gap) + float(np.sum(gram * bend)), int(count), 1]
            yield pd.DataFrame({"j": np.arange(len(total)), "v": total})

        return run

    for _ in range(rounds):
        sums = stats.mapInPandas(expect(centre, variance, noise), "j int, v double").groupBy("j").agg(F.sum("v")).collect()
        total = np.zeros(3 * n + 3)
        for j, v in sums:
            total[j] = v
        geos = max(total[-1], 1.0)
        found = total[:n] / geos
        mean = np.where(np.arange(n) < free, found, np.maximum(found, 0.0))
        after = np.maximum(total[n : 2 * n] / geos - 2 * mean * found + mean**2 + total[2 * n : 3 * n] / geos, 1e-8)
        moved = max(np.abs(np.log(after / variance)).max(), abs(np.log(max(total[-3] / max(total[-2], 1.0), 1e-10) / noise)))
        centre, variance, noise = mean, after, max(total[-3] / max(total[-2], 1.0), 1e-10)
        if moved < tol:
            break
    return centre, noise / variance, np.sqrt(variance), noise


def media_slopes(channel: str, mix: MixSettings, decay: float, shape: float) -> tuple[Column, Column]:
    """Derivatives of ``media`` by decay and by shape."""
    lag, top = F.col(f"{channel}__lag"), F.col(f"{channel}__max")
    weights = geometric_weights(decay, mix.adstock_l_max, normalize=True)
    total = sum(decay**k for k in range(mix.adstock_l_max))
    growth = sum(k * decay ** (k - 1) for k in range(1, mix.adstock_l_max))
    slopes = [((k * decay ** (k - 1) if k else 0.0) - w * growth) / total for k, w in enumerate(weights)]

    def mixed(by: Sequence[float]) -> Column:
        out = F.lit(0.0)
        for k, w in enumerate(by):
            out = out + F.get(lag, F.lit(k)) * w
        return out / top

    by_input, by_shape = S.saturation_slopes(mix.saturation, mixed(weights), shape)
    return by_input * mixed(slopes), by_shape


def _joint_equations(n: int):
    """Products of inputs, their derivatives and target over the fit part of a geo, and weighted ones of the hold-out."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(pdf["x"].to_numpy())
        y, w, held = pdf["y"].to_numpy(), pdf["w"].to_numpy(), pdf["held"].to_numpy(dtype=bool)
        all_columns = np.column_stack([x, y])
        fit = all_columns[~held].T @ all_columns[~held]
        xy = np.column_stack([x[:, :n], y])
        out = (xy[held] * w[held, None]).T @ xy[held]
        stats = np.concatenate([fit.ravel(), out.ravel(), [w[held].sum()]])
        return pd.DataFrame({"geo": [key[0]], "stats": [stats]})

    return run


def _joint_sums(rows: _Rows, decay: float, shape: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """At one setting: penalised error of the fit, weighted error of the hold-out, and the Gauss-Newton system for
    (logit decay, log shape) with every geo's coefficients eliminated."""
    n, free, channels, mix = rows.unknowns, rows.free, rows.channels, rows.mix
    size, c = n + 2 * len(channels) + 1, len(channels)
    slopes = [media_slopes(channel, mix, decay, shape) for channel in channels]
    extra = F.array(*[a for a, _ in slopes], *[b for _, b in slopes])
    design = replace(rows, table=rows.table.withColumn("_slopes", extra)).design(["geo", "_slopes"], decay, shape)
    design = design.withColumn("x", F.concat("x", "_slopes")).drop("_slopes")
    stats = design.groupBy("geo").applyInPandas(_joint_equations(n), "geo string, stats array<double>").persist(StorageLevel.MEMORY_AND_DISK)

    def blocks(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        fit = np.asarray(flat[: size * size]).reshape(size, size)
        return fit, np.asarray(flat[size * size : -1]).reshape(n + 1, n + 1), float(flat[-1])

    at = np.append(np.arange(n), size - 1)
    try:
        sums = stats.select(F.posexplode("stats").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(size * size + (n + 1) ** 2 + 1)
        for j, v in sums:
            total[j] = v
        pooled = solve(blocks(total)[0][np.ix_(at, at)], np.zeros(n), POOLED_RIDGE, free)
        chain = (decay * (1.0 - decay), shape)

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(9)  # error, hold-out error, its weight, the system's four entries and its right side
            for pdf in batches:
                for flat in pdf["stats"]:
                    fit, held, weight = blocks(flat)
                    own = fit[np.ix_(at, at)]
                    coef = solve(own, pooled, mix.shrinkage, free)
                    gap = np.append(coef, -1.0)
                    effect = coef[free:]
                    lift = np.zeros((size, 2))  # from the columns to the two derivatives of the prediction
                    lift[n : n + c, 0], lift[n + c : n + 2 * c, 1] = effect * chain[0], effect * chain[1]
                    miss = np.zeros(size)
                    miss[:n], miss[-1] = -coef, 1.0
                    active = np.concatenate([np.arange(free), free + np.flatnonzero(effect > 0)])
                    ridge = own[np.ix_(active, active)] + mix.shrinkage * np.eye(len(active))
                    side = fit[active] @ lift
                    lean = np.linalg.solve(ridge, side)
                    away = fit[active] @ miss - mix.shrinkage * (coef - pooled)[active]
                    out[0] += float(gap @ own @ gap) + mix.shrinkage * float(np.sum((coef - pooled) ** 2))
                    out[1] += float(gap @ held @ gap)
                    out[2] += weight
                    out[3:7] += (lift.T @ fit @ lift - side.T @ lean).ravel()
                    out[7:] += lift.T @ (fit @ miss) - lean.T @ away
            yield pd.DataFrame({"j": np.arange(9), "v": out})

        sums = stats.mapInPandas(step, "j int, v double").groupBy("j").agg(F.sum("v")).collect()
    finally:
        stats.unpersist()
    out = np.zeros(9)
    for j, v in sums:
        out[j] = v
    held = float(np.sqrt(out[1] / out[2])) if out[2] > 0 else float("inf")
    return float(out[0]), held, out[3:7].reshape(2, 2), out[7:]


def refine(rows: _Rows, decay: float, shape: float) -> tuple[float, float]:
    """Gauss-Newton steps on decay and shape from a grid point; of all settings seen, the one with the least hold-out error.

    Steps are taken on logit and logarithm, so that no setting leaves its range, and halved until the fit improves.
    """
    decay = min(max(decay, 0.01), 0.99)
    error, held, system, right = _joint_sums(rows, decay, shape)
    seen = [(held, 0, decay, shape)]
    for _ in range(rows.mix.refine_steps):
        step = np.linalg.solve(system + 1e-9 * np.trace(system) * np.eye(2) + 1e-12 * np.eye(2), right)
        step = np.clip(step, -1.5, 1.5)
        for _ in range(5):
            odds = decay / (1.0 - decay) * math.exp(step[0])
            trial = (min(max(odds / (1.0 + odds), 1e-3), 0.999), min(max(shape * math.exp(step[1]), 1e-3), 1e3))
            after = _joint_sums(rows, *trial)
            if after[0] <= error:
                break
            step = step / 2
        else:
            break
        (error, held, system, right), (decay, shape) = after, trial
        seen.append((held, len(seen), decay, shape))
        if np.abs(step).max() < 1e-3:
            break
    return min(seen)[2:]


def sweep(panel: DataFrame, mix: MixSettings = MixSettings(), folds: int = 3) -> DataFrame:
    """All metrics per grid point and fold: ``grid, decay, shape, fold, n, rmse_w, ...``.

    The last ``holdout_share`` of the calendar is cut into ``folds`` windows; fold ``f`` is fitted on all rows before window ``f`` and tested on
    it (rolling origin). Grid points and folds are rows of one plan. Scales are those of the rows before the first window; geos that have none are left out.
    """
    from halocline.operators.metrics import regression_report, with_errors

    ready = model_panel(panel, mix)
    channels, controls = channel_list(ready), control_list(ready)
    n, free = 1 + len(controls) + len(channels), 1 + len(controls)
    grid = [(d, s) for d in mix.decay_grid for s in mix.shape_grid]
    span = ready.agg(F.struct(F.min("install_date").alias("lo"), F.max("install_date").alias("hi"))).scalar()
    days = F.datediff(F.col("_span.hi"), F.col("_span.lo"))

    def cut(fold: int) -> Column:
        share = 1.0 - mix.holdout_share * (folds - fold) / folds
        return F.date_add(F.col("_span.lo"), F.floor(days * share).cast("int"))

    day = F.col("install_date")
    early = ready.withColumn("_span", span).filter(day <= cut(0)).drop("_span")
    scales = scale_table(early, channels, mix.target)
    lagged = lagged_panel(ready, scales, channels, mix).filter("observed").withColumn("_span", span)
    windows = [F.struct(F.lit(f).alias("fold"), (day > cut(f)).alias("held"), (day <= cut(f + 1)).alias("inside")) for f in range(folds)]
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in controls], *[media(c, mix, F.col("decay"), F.col("shape")) for c in channels]]
    design = (
        lagged.select("*", F.inline(_grid_points(grid)))
        .withColumns({"x": F.array(*x), "y": F.col(mix.target) / F.col("target_max")})
        .select("grid", "geo", "x", "y", mix.target, "total_installs", "target_max", F.inline(F.array(*windows)))
        .filter("inside")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )

    def equations(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        xy = np.column_stack([np.vstack(pdf["x"].to_numpy()), pdf["y"].to_numpy()])
        return pd.DataFrame({"point": [key[0]], "geo": [key[1]], "gram": [(xy.T @ xy).ravel()]})

    point = (F.col("grid") * folds + F.col("fold")).alias("point")
    try:
        grams = (
            design.filter("not held").select(point, "geo", "x", "y").groupBy("point", "geo")
            .applyInPandas(equations, "point int, geo string, gram array<double>").persist(StorageLevel.MEMORY_AND_DISK)
        )
        sums = grams.select("point", F.posexplode("gram").alias("j", "v")).groupBy("point", "j").agg(F.sum("v").alias("v")).collect()
        totals: dict[int, np.ndarray] = {}
        for p, j, v in sums:
            totals.setdefault(p, np.zeros((n + 1) ** 2))[j] = v
        pooled = {p: solve(flat.reshape(n + 1, n + 1), np.zeros(n), POOLED_RIDGE, free) for p, flat in totals.items()}

        def by_geo(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                coefs = [
                    solve(np.asarray(g).reshape(n + 1, n + 1), pooled[int(p)], mix.shrinkage, free).tolist()
                    for p, g in zip(pdf["point"], pdf["gram"])
                ]
                yield pd.DataFrame({"point": pdf["point"], "geo": pdf["geo"], "coef": coefs})

        fitted = grams.mapInPandas(by_geo, "point int, geo string, coef array<double>")
        tested = design.filter("held").withColumn("point", point).join(fitted, ["point", "geo"])
        share = F.aggregate(F.zip_with("coef", "x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        scored = with_errors(tested.withColumn("pred", share * F.col("target_max")), mix.target, "pred")
        report = regression_report(scored, mix.target, "pred", "total_installs", ["grid", "fold"])
        names = panel.sparkSession.createDataFrame([(i, d, s) for i, (d, s) in enumerate(grid)], "grid int, decay double, shape double")
        metrics = names.join(report, "grid").collect()  # a row per grid point and fold
        return panel.sparkSession.createDataFrame(metrics, names.join(report, "grid").schema)
    finally:
        design.unpersist()


def coefficient_rows(model: MixModel) -> DataFrame:
    """Long coefficients ``(geo, part, value)`` on the scaled axes."""
    parts = F.array(*[F.lit(p) for p in model.parts])
    zipped = F.arrays_zip(parts.alias("part"), F.col("coef").alias("value"))
    return model.coefficients.select("geo", F.inline(zipped))


def contributions(model: MixModel, panel: DataFrame) -> DataFrame:
    """``(geo, install_date, part, contribution)`` in installs for every observed panel row."""
    mix = model.mix
    ready = model_panel(panel, mix)
    rows = lagged_panel(ready, model.scales, model.channels, mix).filter("observed").join(model.coefficients.select("geo", "coef"), "geo")
    inputs = [F.lit(1.0), *[F.col(c).cast("double") for c in model.controls]]
    inputs += [media(c, mix, model.decay, model.shape) for c in model.channels]
    parts = [
        F.struct(
            F.lit(name).alias("part"),
            (F.get("coef", F.lit(j)) * x * F.col("target_max")).alias("contribution"),
        )
        for j, (name, x) in enumerate(zip(model.parts, inputs))
    ]
    return rows.select("geo", "install_date", F.inline(F.array(*parts)))


def channel_contributions(model: MixModel, parts: DataFrame) -> DataFrame:
    """The channel rows of ``contributions``."""
    return parts.filter(F.col("part").isin(list(model.channels))).withColumnRenamed("part", "channel")


def predict_mix(model: MixModel, panel: DataFrame) -> DataFrame:
    """``(geo, install_date, pred_scaled)``: all parts summed, before calibration."""
    return contributions(model, panel).groupBy("geo", "install_date").agg(F.sum("contribution").alias("pred_scaled"))


def predict_test(model: MixModel, train: DataFrame, test: DataFrame) -> DataFrame:
    """Test predictions with carry-over from the end of the training rows, at the grain of the model."""
    parts = test_contributions(model, train, test)
    return parts.groupBy("geo", "install_date").agg(F.sum("contribution").alias("pred_scaled"))


def test_contributions(model: MixModel, train: DataFrame, test: DataFrame) -> DataFrame:
    """``contributions`` of the test rows; of the training rows only those that carry over are read."""
    dates = model_panel(test, model.mix).select("geo", "install_date")
    tail = train.filter(F.col("install_date") >= _warmup_start(train, model.mix))
    both = with_warmup(tail, test).drop("is_test")
    return contributions(model, both).join(dates, ["geo", "install_date"], "left_semi")


def _warmup_start(train: DataFrame, mix: MixSettings) -> Column:
    """First date that the adstock of a test row can reach back to; earlier training rows are not needed."""
    reach = (mix.adstock_l_max - 1) * max(mix.cadence_days, 1)
    return F.date_sub(train.agg(F.max("install_date")).scalar(), reach)


def grid_edges(model: MixModel) -> DataFrame:
    """Checks in the form of ``attribution_checks``: a best point at the edge of its grid asks for a wider grid."""
    found = (("decay_inside_grid", model.decay, model.mix.decay_grid), ("shape_inside_grid", model.shape, model.mix.shape_grid))
    rows = [(name, hit := int(len(grid) > 1 and value in (min(grid), max(grid))), not hit) for name, value, grid in found]
    return model.coefficients.sparkSession.createDataFrame(rows, "check_name string, violations bigint, passed boolean")


def response_curve(model: MixModel, points: int = 21) -> DataFrame:
    """Fitted saturation at a few spend levels (0..1 of the largest) per channel."""
    spark = model.coefficients.sparkSession
    x = F.col("id") / F.lit(float(points - 1))
    names = F.explode(F.array(*[F.lit(c) for c in model.channels]))
    return spark.range(points).select(
        names.alias("channel"), x.alias("x"), S.saturate(model.mix.saturation, x, model.shape).alias("y")
    )


def coefficient_draws(model: MixModel, draws: int = 500, seed: int = 42, chains: int = 2) -> DataFrame:
    """Draws ``(chain, draw, geo, channel, value)`` of the channel coefficients, ``draws`` in each chain.

    Normal around each geo's unconstrained solution with its curvature, cut to non-negative channels, as in
    the fit: every coefficient in turn is drawn from its truncated conditional (Gibbs steps). A geo and
    chain seed their own generator, so a rerun task repeats its rows.
    """
    n, first = len(model.parts), 1 + len(model.controls)
    channels = list(model.channels)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for pdf in batches:
            for geo, coef, centre, root in zip(pdf["geo"], pdf["coef"], pdf["centre"], pdf["root"]):
                for chain in range(chains):
                    rng = np.random.default_rng([seed, zlib.crc32(str(geo).encode()), chain])
                    values = truncated_draws(
                        np.asarray(centre), np.asarray(root).reshape(n, n), np.asarray(coef), first, draws, rng
                    )[:, first:]
                    yield pd.DataFrame(
                        {
                            "chain": chain,
                            "draw": np.repeat(np.arange(draws), len(channels)),
                            "geo": geo,
                            "channel": np.tile(channels, draws),
                            "value": values.ravel(),
                        }
                    )

    return model.coefficients.select("geo", "coef", "centre", "root").mapInPandas(
        draw, "chain int, draw int, geo string, channel string, value double"
    )


def truncated_draws(
    centre: np.ndarray, root: np.ndarray, start: np.ndarray, free: int, draws: int, rng, burn_in: int = 50
) -> np.ndarray:
    """Gibbs draws of a normal (mean, Cholesky root of the covariance) with coefficients from ``free`` on kept >= 0."""
    precision = np.linalg.inv(root @ root.T)
    spread = 1.0 / np.sqrt(np.diag(precision))
    state, out = start.copy(), np.empty((draws, len(centre)))
    for i in range(-burn_in, draws):
        for j in range(len(centre)):
            off = precision[j] @ (state - centre) - precision[j, j] * (state[j] - centre[j])
            mean = centre[j] - off / precision[j, j]
            state[j] = _draw_above(mean, spread[j], rng) if j >= free else mean + spread[j] * rng.standard_normal()
        if i >= 0:
            out[i] = state
    return out


def _draw_above(mean: float, sd: float, rng) -> float:
    """A normal value of at least 0; by an exponential proposal where 0 lies in the upper tail."""
    low = -mean / sd
    if low < 0.5:
        while (z := rng.standard_normal()) < low:
            pass
        return mean + sd * z
    rate = (low + np.sqrt(low * low + 4.0)) / 2.0
    while True:
        z = low + rng.exponential(1.0 / rate)
        if rng.random() <= np.exp(-((z - rate) ** 2) / 2.0):
            return mean + sd * z


def halo_draws(
    model: MixModel, panel: DataFrame, draws: int = 500, seed: int = 42, scale: DataFrame | None = None
) -> DataFrame:
    """Draws ``(chain, draw, channel, value)`` of each channel's total contribution in installs.

    A total is linear in the coefficient, so the panel is reduced to one exposure
    per geo and channel before it meets the draws. ``scale`` (``geo, scale``) is the
    factor that attribution applies, so that both speak of the same installs.
    """
    mix = model.mix
    rows = lagged_panel(model_panel(panel, mix), model.scales, model.channels, mix).filter("observed")
    sums = [F.sum(media(c, mix, model.decay, model.shape) * F.col("target_max")).alias(c) for c in model.channels]
    exposure = rows.groupBy("geo").agg(*sums).unpivot(["geo"], list(model.channels), "channel", "exposure")
    if scale is not None:
        exposure = exposure.join(scale, "geo").withColumn("exposure", F.col("exposure") * F.col("scale")).drop("scale")
    joined = coefficient_draws(model, draws, seed).join(exposure, ["geo", "channel"])
    return joined.groupBy("chain", "draw", "channel").agg(F.sum(F.col("value") * F.col("exposure")).alias("value"))


def roas_table(draws: DataFrame, spend: DataFrame) -> DataFrame:
    """Installs per 1000 spent with its interval; ``spend`` has ``channel, total_spend``."""
    from halocline.operators.draws import summary

    per_1k = F.col("total_spend") / 1000.0
    stats = summary(draws, ("channel",))
    return stats.join(spend, "channel", "left").select(
        "channel",
        "total_spend",
        *[F.try_divide(F.col(c), per_1k).alias(f"roas_{c}") for c in ("mean", "hdi_lo", "hdi_hi")],
    )

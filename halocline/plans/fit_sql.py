"""Model fits in SQL: linear systems, Newton steps and non-negative ridges over nested lists."""

from __future__ import annotations

from collections.abc import Sequence

from halocline.config import BinomialSettings, MixSettings
from halocline.operators.adstock import geometric_weights


def solve(matrix: str, size: str) -> str:
    """Gauss-Jordan elimination of a list of rows; what follows the first ``size`` columns becomes the solution.

    The systems here are positive definite, so the diagonal serves as pivots.
    """
    row = "list_transform(r, lambda v, j: v - r[p] * m[p][j] / m[p][p])"
    step = f"list_transform(m, lambda r, i: CASE WHEN i = p THEN list_transform(r, lambda v: v / r[p]) ELSE {row} END)"
    pivots = f"list_transform(range(1, {size} + 1), lambda q: [[CAST(q AS DOUBLE)]])"
    return f"list_reduce(list_prepend({matrix}, {pivots}), lambda m, b: {step.replace('[p]', '[CAST(b[1][1] AS BIGINT)]').replace('= p ', '= b[1][1] ')})"


def binomial_fit(features: Sequence[str], spreads: tuple[float, float], settings: BinomialSettings, steps: int = 15) -> str:
    """``mode`` (theta), ``params`` (param, value, sd) and ``design`` (keys, x) from ``clean``, ``train_rows`` and ``stats``.

    Newton's method on the penalised likelihood with given spreads. Needs WITH RECURSIVE.
    """
    columns = ", ".join(f"CAST({c} AS DOUBLE)" for c in features)
    named = ", ".join(f"'{f}'" for f in features)

    def fitted(column: str) -> str:
        return f"(SELECT list({column} ORDER BY list_position([{named}], feature)) FROM stats WHERE feature IN ({named}))"

    def hot(names: str, column: str) -> str:
        known = f"CASE WHEN list_contains({names}, {column}) THEN {column} ELSE {names}[1] END"
        return f"list_transform({names}, lambda c: CASE WHEN c = ({known}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"

    fixed = [settings.alpha_prior_sigma**-2] + [settings.beta_prior_sigma**-2] * len(features)
    score = "k - n / (1 + exp(-eta))"
    weight = "n * exp(-abs(eta)) / (1 + exp(-abs(eta))) ** 2"
    return f"""groups AS MATERIALIZED (
  SELECT coalesce((SELECT list(DISTINCT country_code ORDER BY country_code) FROM train_rows), []::VARCHAR[]) AS countries,
         coalesce((SELECT list(DISTINCT platform ORDER BY platform) FROM train_rows), []::VARCHAR[]) AS platforms,
         {fitted('median')} AS medians, {fitted('mean')} AS means, {fitted('std')} AS stds),
priors AS MATERIALIZED (
  SELECT list_concat({fixed}::DOUBLE[], list_transform(countries, lambda c: {spreads[0] ** -2}::DOUBLE),
                     list_transform(platforms, lambda c: {spreads[1] ** -2}::DOUBLE)) AS prec,
         list_concat(['alpha'], list_transform([{named}], lambda f: 'beta[' || f || ']'),
                     list_transform(countries, lambda c: 'u_country[' || c || ']'),
                     list_transform(platforms, lambda c: 'u_platform[' || c || ']')) AS names,
         {1 + len(features)} + len(countries) + len(platforms) AS p FROM groups),
design AS MATERIALIZED (
  SELECT clean.*, CAST(organic_installs AS DOUBLE) AS k, CAST(total_installs AS DOUBLE) AS n,
         list_concat([1.0::DOUBLE], list_transform([{columns}], lambda v, i: (coalesce(v, medians[i]) - means[i]) / stds[i]),
                     {hot('countries', 'country_code')}, {hot('platforms', 'platform')}) AS x FROM clean, groups),
fit_rows AS MATERIALIZED (SELECT x, k, n FROM design WHERE split = 'train'),
places AS MATERIALIZED (SELECT i, j, prec, p FROM priors, unnest(range(1, p + 1)) a(i), unnest(range(1, p + 2)) b(j)),
newton AS (
  SELECT 0 AS it, list_transform(prec, lambda v: 0.0::DOUBLE) AS theta FROM priors
  UNION ALL
  SELECT it + 1, list_transform(theta, lambda t, i: t + z[i][len(theta) + 1]) FROM (
    SELECT it, theta, {solve('a', 'len(theta)')} AS z FROM (
      SELECT any_value(it) AS it, any_value(theta) AS theta, list(cells ORDER BY i) AS a FROM (
        SELECT i, any_value(it) AS it, any_value(theta) AS theta, list(v ORDER BY j) AS cells FROM (
          SELECT i, j, any_value(it) AS it, any_value(theta) AS theta,
                 coalesce(sum(CASE WHEN j > p THEN ({score}) * x[i] ELSE {weight} * x[i] * x[j] END), 0)
                 + any_value(CASE WHEN i = j THEN prec[i] WHEN j > p THEN -prec[i] * theta[i] ELSE 0 END) AS v
          FROM (SELECT it, theta, x, k, n, list_dot_product(x, theta) AS eta FROM newton LEFT JOIN fit_rows ON true WHERE it < {steps}), places
          GROUP BY i, j) GROUP BY i)) WHERE it IS NOT NULL)),
mode AS MATERIALIZED (SELECT theta FROM newton WHERE it = {steps}),
information AS MATERIALIZED (
  SELECT list(cells ORDER BY i) AS a FROM (
    SELECT i, list_concat(list(v ORDER BY j), list_transform(range(1, any_value(p) + 1), lambda c: CASE WHEN c = any_value(i) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS cells
    FROM (
      SELECT i, j, any_value(p) AS p,
             coalesce(sum({weight} * x[i] * x[j]), 0) + any_value(CASE WHEN i = j THEN prec[i] ELSE 0 END) AS v
      FROM (SELECT x, k, n, list_dot_product(x, theta) AS eta FROM mode LEFT JOIN fit_rows ON true), places WHERE j <= p
      GROUP BY i, j) GROUP BY i)),
params AS (
  SELECT names[i] AS param, theta[i] AS value, sqrt(z[i][p + i]) AS sd
  FROM priors, mode, (SELECT {solve('a', 'len(a)')} AS z FROM information), unnest(range(1, p + 1)) t(i))"""


def quadratic(gram: str, coef: str) -> str:
    """Residual sum of squares of coefficients, from products whose last row and column are the target's."""
    q = f"list_append({coef}, -1.0::DOUBLE)"
    return f"list_dot_product({q}, list_transform({gram}, lambda r: list_dot_product(r, {q})))"


def ridge(name: str, source: str, keys: str, gram: str, centre: str, pull: float, unknowns: int, free: int, signed: bool = True) -> str:
    """Relation ``name`` (keys, coef): ridge towards ``centre``, coefficients after the first ``free`` not negative.

    Of all choices of coefficients that are zero, the feasible one with the least penalised error is the solution.
    """
    n, bound = unknowns, unknowns - free if signed else 0
    chosen = f"i <= {n - bound} OR (s >> (i - {n - bound + 1})) & 1 = 1"
    kept = f"list_transform(r, lambda v, j: CASE WHEN j = i THEN v + {pull} WHEN j = {n + 1} THEN v + {pull} * ({centre})[i] ELSE v END)"
    none = "list_transform(r, lambda v, j: CASE WHEN j = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    system = f"list_transform(({gram})[1:{n}], lambda r, i: CASE WHEN {chosen} THEN {kept} ELSE {none} END)"
    away = f"list_sum(list_transform(coef, lambda c, i: (c - ({centre})[i]) ** 2))"
    feasible = f"list_min(coef[{n - bound + 1}:{n}]) >= -1e-12" if bound else "true"
    return f"""{name} AS MATERIALIZED (
  SELECT {keys}, arg_min(coef, {quadratic(gram, 'coef')} + {pull} * {away}) AS coef FROM (
    SELECT *, list_transform({solve('a', str(n))}, lambda r: r[{n + 1}]) AS coef FROM (
      SELECT *, {system} AS a FROM {source}, (SELECT unnest(range({1 << bound})) AS s)))
  WHERE {feasible} GROUP BY {keys})"""


def nested(name: str, source: str, keys: str, columns: Sequence[str]) -> str:
    """Relation ``name`` (keys, one list of rows per column) from cells (keys, i, j, columns)."""
    rows = ", ".join(f"list(coalesce({c}, 0.0) ORDER BY j) AS {c}" for c in columns)
    lists = ", ".join(f"list({c} ORDER BY i) AS {c}" for c in columns)
    return f"{name} AS MATERIALIZED (SELECT {keys}, {lists} FROM (SELECT {keys}, i, {rows} FROM {source} GROUP BY {keys}, i) GROUP BY {keys})"


def media(channel: str) -> str:
    """Saturated (logistic) adstock of a channel on the geo's scale, from its lags and a grid point."""
    power = f"exp(-shape * list_dot_product({channel}_lag, weights) / {channel}_max)"
    return f"(1 - {power}) / (1 + {power})"


def cut_date(share: float) -> str:
    """The day after which that share of the calendar from ``lo`` to ``hi`` is over."""
    return f"lo + CAST(floor(date_diff('day', lo, hi) * CAST({share!r} AS DOUBLE)) AS INTEGER)"


def mix_design(channels: Sequence[str], mix: MixSettings, train_end: str, scale_until: str = "DATE '9999-12-31'") -> str:
    """``design`` (grid, geo, install_date, is_train, x, y, w, ...) of all observed rows of ``filled`` at every grid point.

    Scales are those of the training rows up to ``scale_until``.
    """
    lags = ", ".join(
        "[" + ", ".join(f"coalesce(lag({c}, {k}) OVER line, 0)::DOUBLE" if k else f"{c}::DOUBLE" for k in range(mix.adstock_l_max)) + f"] AS {c}_lag"
        for c in channels
    )
    largest = ", ".join(f"CASE WHEN max({c}) > 0 THEN max({c}) ELSE 1.0 END AS {c}_max" for c in channels)
    grid = [(d, s) for d in mix.decay_grid for s in mix.shape_grid]
    points = ", ".join(
        f"({i}, {d}, {s}::DOUBLE, {geometric_weights(d, mix.adstock_l_max, normalize=True)}::DOUBLE[])" for i, (d, s) in enumerate(grid)
    )
    x = ", ".join(media(c) for c in channels)
    return f"""lagged AS (SELECT geo, install_date, observed, organic_installs, total_installs, {lags} FROM filled
  WINDOW line AS (PARTITION BY geo ORDER BY install_date)),
train_panel AS (SELECT * FROM panel WHERE install_date < DATE '{train_end}'),
test_panel AS (SELECT * FROM panel WHERE install_date >= DATE '{train_end}'),
train_span AS (SELECT min(install_date) AS lo, max(install_date) AS hi FROM train_panel),
scales AS (
  SELECT geo, CASE WHEN max(organic_installs) > 0 THEN max(organic_installs)::DOUBLE ELSE 1.0 END AS target_max, {largest}
  FROM train_panel, train_span WHERE install_date <= {scale_until} GROUP BY geo),
points AS (SELECT * FROM (VALUES {points}) t(grid, decay, shape, weights)),
design AS MATERIALIZED (
  SELECT grid, geo, install_date, install_date < DATE '{train_end}' AS is_train, organic_installs, total_installs, target_max,
         install_date > {cut_date(1.0 - mix.holdout_share)} AS held,
         [1.0::DOUBLE, {x}] AS x, organic_installs / target_max AS y, total_installs * target_max ** 2 AS w
  FROM lagged JOIN scales USING (geo), points, train_span WHERE observed)"""


def mix_fit(channels: Sequence[str], mix: MixSettings, pooled_ridge: float, train_end: str) -> str:
    """``scores`` (grid, decay, shape, holdout_rmse_w), ``best`` (grid), ``fitted`` (geo, coef) and ``parts`` (geo, install_date, is_train, part, contribution)."""
    n, free = 1 + len(channels), 1
    names = ["intercept", *channels]
    zero = "list_transform(range(1, {n} + 1), lambda q: 0.0::DOUBLE)".format(n=n)
    return f"""{mix_design(channels, mix, train_end)},
cells AS MATERIALIZED (
  SELECT grid, geo, i, j, sum(v) FILTER (WHERE NOT held) AS fit, sum(v) AS every, sum(w * v) FILTER (WHERE held) AS held
  FROM (SELECT grid, geo, held, w, i, j, xy[i] * xy[j] AS v
        FROM (SELECT *, list_append(x, y) AS xy FROM design WHERE is_train), unnest(range(1, {n + 2})) a(i), unnest(range(1, {n + 2})) b(j))
  GROUP BY grid, geo, i, j),
{nested('grams', 'cells', 'grid, geo', ['fit', 'every', 'held'])},
pooled_cells AS (SELECT grid, i, j, sum(fit) AS fit, sum(every) AS every FROM cells GROUP BY grid, i, j),
{nested('pooled_grams', 'pooled_cells', 'grid', ['fit', 'every'])},
{ridge('pooled_fit', 'pooled_grams', 'grid', 'fit', zero, pooled_ridge, n, free)},
{ridge('pooled_all', 'pooled_grams', 'grid', 'every', zero, pooled_ridge, n, free)},
tried AS (SELECT grams.*, coef AS centre FROM grams JOIN pooled_fit USING (grid)),
{ridge('geo_fit', 'tried', 'grid, geo', 'fit', 'centre', mix.shrinkage, n, free)},
held_weight AS (SELECT grid, geo, sum(w) FILTER (WHERE held) AS weight FROM design WHERE is_train GROUP BY grid, geo),
scores AS MATERIALIZED (
  SELECT grid, any_value(decay) AS decay, any_value(shape) AS shape,
         sqrt(sum({quadratic('held', 'coef')}) / nullif(sum(weight), 0)) AS holdout_rmse_w
  FROM geo_fit JOIN grams USING (grid, geo) JOIN held_weight USING (grid, geo) JOIN points USING (grid) GROUP BY grid),
best AS (SELECT grid FROM scores ORDER BY holdout_rmse_w NULLS LAST, grid LIMIT 1),
chosen AS (SELECT grams.*, coef AS centre FROM grams JOIN best USING (grid) JOIN pooled_all USING (grid)),
{ridge('fitted', 'chosen', 'geo', 'every', 'centre', mix.shrinkage, n, free)},
parts AS MATERIALIZED (
  SELECT geo, install_date, is_train, {names}[j] AS part, coef[j] * x[j] * target_max AS contribution
  FROM design JOIN best USING (grid) JOIN fitted USING (geo), unnest(range(1, {n + 1})) t(j)),
train_predicted AS (SELECT geo, install_date, sum(contribution) AS pred_scaled FROM parts WHERE is_train GROUP BY geo, install_date),
train_scale AS (
  SELECT p.geo, sum(p.organic_installs) / greatest(sum(q.pred_scaled), 1e-9) AS scale
  FROM train_panel p JOIN train_predicted q ON p.geo = q.geo AND p.install_date = q.install_date GROUP BY p.geo)"""


def mix_sweep(channels: Sequence[str], mix: MixSettings, pooled_ridge: float, train_end: str, folds: int) -> str:
    """``predicted`` (grid, decay, shape, fold, organic_share, total_installs, abs_err): rolling-origin folds of the training rows."""
    n, free = 1 + len(channels), 1
    zero = f"list_transform(range(1, {n} + 1), lambda q: 0.0::DOUBLE)"
    cuts = [cut_date(1.0 - mix.holdout_share * (folds - f) / folds) for f in range(folds + 1)]
    windows = ", ".join(f"{{'fold': {f}, 'held': install_date > {cuts[f]}, 'inside': install_date <= {cuts[f + 1]}}}" for f in range(folds))
    return f"""{mix_design(channels, mix, train_end, cuts[0])},
windows AS MATERIALIZED (
  SELECT grid, geo, x, y, organic_installs, total_installs, target_max, f.fold, f.held
  FROM (SELECT design.*, unnest([{windows}]) AS f FROM design, train_span WHERE is_train) WHERE f.inside),
cells AS MATERIALIZED (
  SELECT grid, fold, geo, i, j, sum(xy[i] * xy[j]) AS fit
  FROM (SELECT *, list_append(x, y) AS xy FROM windows WHERE NOT held), unnest(range(1, {n + 2})) a(i), unnest(range(1, {n + 2})) b(j)
  GROUP BY grid, fold, geo, i, j),
{nested('grams', 'cells', 'grid, fold, geo', ['fit'])},
pooled_cells AS (SELECT grid, fold, i, j, sum(fit) AS fit FROM cells GROUP BY grid, fold, i, j),
{nested('pooled_grams', 'pooled_cells', 'grid, fold', ['fit'])},
{ridge('pooled', 'pooled_grams', 'grid, fold', 'fit', zero, pooled_ridge, n, free)},
tried AS (SELECT grams.*, coef AS centre FROM grams JOIN pooled USING (grid, fold)),
{ridge('geo_fit', 'tried', 'grid, fold, geo', 'fit', 'centre', mix.shrinkage, n, free)},
predicted AS (
  SELECT grid, decay, shape, fold, organic_installs AS organic_share, total_installs,
         abs(organic_installs - list_dot_product(coef, x) * target_max) AS abs_err
  FROM windows JOIN geo_fit USING (grid, fold, geo) JOIN points USING (grid) WHERE held)"""

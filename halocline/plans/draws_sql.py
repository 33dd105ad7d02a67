"""Diagnostics of draws in SQL: normal scores, autocovariances over pairs of lags, the initial monotone sequence."""

from __future__ import annotations

# Wichura's rational approximation AS 241 of the normal quantile, highest power first (centre, then outer part).
CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080),
    (5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867,
     5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0),
)
OUTER = (
    (7.74545014278341407640e-4, 0.0227238449892691845833, 0.241780725177450611770, 1.27045825245236838258,
     3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 0.0151986665636164571966, 0.148103976427480074590,
     0.689767334985100004550, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def normal_quantile(p: str) -> str:
    """Exact to double precision for probabilities that are not below 1e-11."""
    r, s = f"(0.180625 - ({p} - 0.5) ** 2)", f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)"
    inner = f"({p} - 0.5) * {_horner(CENTRE[0], r)} / {_horner(CENTRE[1], r)}"
    return f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN {inner} ELSE sign({p} - 0.5) * {_horner(OUTER[0], s)} / {_horner(OUTER[1], s)} END"


def _scores(value: str) -> str:
    rank = f"rank() OVER (PARTITION BY param ORDER BY {value}) + (count(*) OVER (PARTITION BY param, {value}) - 1) / 2.0"
    return f"({rank} - 0.375) / (count(*) OVER (PARTITION BY param) + 0.25)"


def diagnostics_sql() -> str:
    """``diagnosed``, one row per parameter, from ``chains`` (param, chain, draw, value) with an even number of draws each."""
    return f"""sized AS (SELECT *, (max(draw) OVER () + 1) // 2 AS n FROM chains),
split AS (SELECT param, 2 * chain + CAST(draw >= n AS INTEGER) AS c, draw % n AS t, value, n FROM sized),
marks AS (
  SELECT param, quantile_cont(value, 0.5) AS middle, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi, avg(value) AS mean
  FROM split GROUP BY param),
marked AS (SELECT split.*, lo, hi, mean, abs(value - middle) AS away FROM split JOIN marks USING (param)),
placed AS (SELECT *, {_scores('value')} AS p, {_scores('away')} AS p_away FROM marked),
series AS MATERIALIZED (
  SELECT param, c, t, n, unnest(['mean', 'square', 'tail_lo', 'tail_hi', 'bulk', 'folded']) AS kind,
         unnest([value, (value - mean) ** 2, CAST(value <= lo AS DOUBLE), CAST(value <= hi AS DOUBLE),
                 {normal_quantile('p')}, {normal_quantile('p_away')}]) AS v FROM placed),
centred AS MATERIALIZED (SELECT *, v - avg(v) OVER (PARTITION BY param, kind, c) AS off FROM series),
by_chain AS (SELECT param, kind, c, any_value(n) AS n, avg(v) AS m, var_samp(v) AS var FROM series GROUP BY param, kind, c),
spread AS (
  SELECT param, kind, any_value(n) AS n, count(*) AS chains, avg(var) AS within, var_samp(m) AS between FROM by_chain GROUP BY param, kind),
lags AS (
  SELECT a.param, a.kind, b.t - a.t AS lag, sum(a.off * b.off) / any_value(a.n) / count(DISTINCT a.c) AS cov
  FROM centred a JOIN centred b ON a.param = b.param AND a.kind = b.kind AND a.c = b.c AND b.t >= a.t GROUP BY a.param, a.kind, b.t - a.t),
rho AS (
  SELECT param, kind, lag, n, chains, CASE WHEN lag = 0 THEN 1 ELSE
    1 - (within - cov * n / (n - 1)) / (within * (n - 1) / n + between) END AS r
  FROM lags JOIN spread USING (param, kind) WHERE within + between > 0),
pairs AS (
  SELECT param, kind, lag // 2 AS k, sum(r) AS pair, any_value(n) AS n, any_value(chains) AS chains
  FROM rho WHERE lag < n - n % 2 GROUP BY param, kind, lag // 2),
initial AS (
  SELECT *, min(pair) OVER line AS falling, min(CASE WHEN pair < 0 THEN k END) OVER (PARTITION BY param, kind) AS stop
  FROM pairs WINDOW line AS (PARTITION BY param, kind ORDER BY k)),
sizes AS (
  SELECT param, kind, any_value(chains * n) / greatest(-1 + 2 * sum(falling) FILTER (WHERE stop IS NULL OR k < stop), 1 / log10(any_value(chains * n))) AS ess
  FROM initial GROUP BY param, kind),
facts AS (
  SELECT param, kind, coalesce(ess, chains * n) AS ess,
         CASE WHEN within > 0 THEN sqrt(((n - 1) / n * within + between) / within) ELSE 1 END AS rhat FROM spread LEFT JOIN sizes USING (param, kind)),
wide AS (
  SELECT param, max(rhat) FILTER (WHERE kind IN ('bulk', 'folded')) AS r_hat, max(ess) FILTER (WHERE kind = 'bulk') AS ess_bulk,
         min(ess) FILTER (WHERE kind IN ('tail_lo', 'tail_hi')) AS ess_tail, max(ess) FILTER (WHERE kind = 'mean') AS ess_mean,
         max(ess) FILTER (WHERE kind = 'square') AS ess_square FROM facts GROUP BY param),
ordered AS (
  SELECT param, value, row_number() OVER (PARTITION BY param ORDER BY value) AS r,
         CAST(floor(0.94 * count(*) OVER (PARTITION BY param)) AS BIGINT) AS steps FROM chains),
intervals AS (
  SELECT a.param, a.value AS hdi_lo, b.value AS hdi_hi, row_number() OVER (PARTITION BY a.param ORDER BY b.value - a.value, a.r) AS pick
  FROM ordered a JOIN ordered b ON a.param = b.param AND b.r = a.r + a.steps),
plain AS (
  SELECT param, avg(value) AS mean, stddev_samp(value) AS sd FROM chains GROUP BY param),
squares AS (SELECT param, stddev_samp(v) AS spread FROM series WHERE kind = 'square' GROUP BY param),
diagnosed AS (
  SELECT param, plain.mean, sd, hdi_lo, hdi_hi, r_hat, ess_bulk, ess_tail, sd / sqrt(ess_mean) AS mcse_mean,
         CASE WHEN sd > 0 THEN spread / sqrt(ess_square) / (2 * sd) ELSE 0 END AS mcse_sd
  FROM plain JOIN wide USING (param) JOIN squares USING (param) JOIN intervals USING (param) WHERE pick = 1)"""

"""Queries over metrics, profiles and models."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halocline.config import BinomialSettings, MixSettings
from halocline.functions import scalar as S
from halocline.models import binomial as B
from halocline.models import mix as M
from halocline.models import prep as R
from halocline.models import ridge as G
from halocline.operators import attribution as T
from halocline.operators import correlation as C
from halocline.operators import draws as D
from halocline.operators import metrics as X
from halocline.operators import profile as P
from halocline.operators import quantiles as N
from halocline.operators.panel import spend_totals
from halocline.plans import fit_sql
from halocline.plans import star_sql as Q
from halocline.plans.cohort_queries import CLEAN_FEATURES, TARGET_KEYS, clean_features, clean_sql, target_table
from halocline.plans.draws_sql import diagnostics_sql
from halocline.plans.panel_queries import CHANNELS, _split, completed_sql, weekly_panel
from halocline.plans.registry import query
from halocline.sources import star

FEATURES = list(CLEAN_FEATURES)
# Features with distinct behaviour, enough to show correlations and preparation.
PROFILED = ["log1p_ads_cum_learn", "installs_spend", "cpm", "iap_purchase_count_learn", "rev_d1_iap",
            "n_sessions_total", "session_velocity_slope"]

_ENCODED = f"""{Q.installs()}, {Q.target()}, train AS (SELECT * FROM target WHERE split = 'train'),
te AS (
  SELECT country_code, sum(organic_share * total_installs) / sum(total_installs) AS country_te
  FROM train GROUP BY country_code)"""

_SCORED = f"""{_ENCODED}, overall AS (SELECT sum(organic_share * total_installs) / sum(total_installs) AS m FROM train),
predicted AS (
  SELECT t.*, coalesce(te.country_te, m) * (0.8 + 0.1 * quarter(install_date)) AS pred
  FROM target t LEFT JOIN te ON t.country_code = te.country_code, overall),
scored AS (
  SELECT *, abs(organic_share - pred) AS abs_err,
         CASE WHEN abs(organic_share) > 1e-6 THEN (pred - organic_share) / organic_share END AS pe
  FROM predicted)"""


def scored_table(spark: SparkSession, d: str) -> DataFrame:
    """Cohorts with a plain prediction: the country's encoded share, bent by the quarter."""
    target = target_table(spark, d)
    train = target.filter(F.col("split") == "train")
    te = R.target_encoding(train, "organic_share", "total_installs")
    mean = train.agg(F.sum(F.col("organic_share") * F.col("total_installs")) / F.sum("total_installs")).scalar()
    encoded = target.join(te, "country_code", "left").withColumn("country_te", F.coalesce("country_te", mean))
    pred = F.col("country_te") * (F.lit(0.8) + F.lit(0.1) * F.quarter("install_date"))
    return X.with_errors(encoded.withColumn("pred", pred), "organic_share", "pred")


@query("country_code country_te:8", f"WITH {_ENCODED}, final AS (SELECT * FROM te)")
def target_encoding(spark, d):
    train = target_table(spark, d).filter(F.col("split") == "train")
    return R.target_encoding(train, "organic_share", "total_installs")


@query(
    "platform country_code install_date organic_share:6 pred:8 abs_err:8 pe:8",
    f"WITH {_SCORED}, final AS (SELECT * FROM scored)",
)
def error_rows(spark, d):
    return scored_table(spark, d)


def _metric_sql(groups: str = "", source: str = "scored") -> str:
    by = f"GROUP BY {groups}" if groups else ""
    keys = f"{groups}, " if groups else ""
    over = f"PARTITION BY {groups}" if groups else ""
    return f"""centred AS (
  SELECT *, sum(total_installs * organic_share) OVER ({over}) / sum(total_installs) OVER ({over}) AS m FROM {source}),
final AS (
  SELECT {keys}count(*) AS n, sqrt(sum(total_installs * abs_err * abs_err) / sum(total_installs)) AS rmse_w,
         sum(total_installs * abs_err) / sum(total_installs) AS mae_w,
         1 - sum(total_installs * abs_err * abs_err) / nullif(sum(total_installs * (organic_share - m) ** 2), 0) AS r2_w,
         sum(total_installs * abs_err) / nullif(sum(total_installs * abs(organic_share)), 0) AS wmape,
         sqrt(avg(abs_err * abs_err)) AS rmse_u, avg(abs_err) AS mae_u
  FROM centred {by})"""


METRICS = "n:int rmse_w:8 mae_w:8 r2_w:6 wmape:8 rmse_u:8 mae_u:8"


@query(METRICS, f"WITH {_SCORED}, {_metric_sql()}")
def weighted_metrics(spark, d):
    return X.regression_report(scored_table(spark, d), "organic_share", "pred", "total_installs")


@query(f"split platform {METRICS}", f"WITH {_SCORED}, {_metric_sql('split, platform')}")
def metrics_by_group(spark, d):
    return X.regression_report(scored_table(spark, d), "organic_share", "pred", "total_installs", ["split", "platform"])


@query(
    "platform country_code n:int wmape:8",
    f"WITH {_SCORED}, {_metric_sql('platform, country_code').replace('final AS', 'by_geo AS')}, final AS ("
    "SELECT * FROM by_geo ORDER BY wmape DESC NULLS LAST, platform, country_code LIMIT 5)",
)
def worst_geos(spark, d):
    return X.errors_by_group(
        scored_table(spark, d), "organic_share", "pred", "total_installs", ["platform", "country_code"], 5
    )


def _bins_sql(groups: str = "") -> str:
    edges = [*X.ERROR_EDGES]
    keys = f"{groups}, " if groups else ""
    case = " ".join(f"WHEN pe <= {e} THEN {i}" for i, e in enumerate(edges))
    join = " AND ".join(f"c.{g.strip()} = k.{g.strip()}" for g in groups.split(",")) if groups else "true"
    distinct = f"SELECT DISTINCT {groups} FROM scored" if groups else "SELECT 1 AS one"
    kept = ", ".join(f"k.{g.strip()}" for g in groups.split(",")) + ", " if groups else ""
    return f"""binned AS (SELECT {keys}total_installs, CASE {case} ELSE {len(edges)} END AS bin FROM scored WHERE pe IS NOT NULL),
counted AS (SELECT {keys}bin, sum(total_installs) AS weight, count(*) AS n FROM binned GROUP BY {keys}bin),
totals AS (SELECT {keys}sum(weight) AS total FROM counted {"GROUP BY " + groups if groups else ""}),
grid AS (SELECT k.*, b.bin FROM ({distinct}) k, (SELECT unnest(range({len(edges) + 1})) AS bin) b),
final AS (
  SELECT {kept}k.bin, coalesce(c.weight, 0) AS weight, coalesce(c.weight, 0) / t.total AS pct, coalesce(c.n, 0) AS count
  FROM grid k LEFT JOIN counted c ON {join} AND c.bin = k.bin
  LEFT JOIN totals t ON {join.replace('c.', 't.')})"""


@query("bin:int weight:2 pct:8 count:int", f"WITH {_SCORED}, {_bins_sql()}")
def pe_buckets(spark, d):
    return X.error_bins(scored_table(spark, d), "pe", "total_installs")


@query(
    "platform country_code bin:int weight:2 pct:8 count:int",
    f"WITH {_SCORED}, {_bins_sql('platform, country_code')}",
)
def pe_buckets_by_geo(spark, d):
    return X.error_bins(scored_table(spark, d), "pe", "total_installs", ["platform", "country_code"])


@query(
    "n:int mean:8 median:8 q05:8 q25:8 q75:8 q95:8 within_10pct:8 within_20pct:8 within_50pct:8",
    f"""WITH {_SCORED}, final AS (
  SELECT count(pe) AS n, avg(pe) AS mean, quantile_cont(pe, 0.5) AS median, quantile_cont(pe, 0.05) AS q05,
         quantile_cont(pe, 0.25) AS q25, quantile_cont(pe, 0.75) AS q75, quantile_cont(pe, 0.95) AS q95,
         avg(CASE WHEN abs(pe) <= 0.1 THEN 1.0 ELSE 0.0 END) AS within_10pct,
         avg(CASE WHEN abs(pe) <= 0.2 THEN 1.0 ELSE 0.0 END) AS within_20pct,
         avg(CASE WHEN abs(pe) <= 0.5 THEN 1.0 ELSE 0.0 END) AS within_50pct
  FROM scored WHERE pe IS NOT NULL)""",
)
def pe_summary(spark, d):
    return X.error_summary(scored_table(spark, d).persist(), "pe")


FINE = 1 << 30


def _calibration_sql(binned: str, other: str) -> str:
    """Twenty quantile bins of ``binned``; on a binary grid both engines see the same ties and their sums are exact."""
    return f"""WITH {_SCORED}, rounded AS (
  SELECT total_installs, floor({binned} * {FINE} + 0.5) / {FINE} AS b, floor({other} * {FINE} + 0.5) / {FINE} AS o
  FROM scored), edges AS (
  SELECT DISTINCT unnest(quantile_cont(b, [{", ".join(str(i / 20) for i in range(21))}])) AS e FROM rounded),
binned AS (SELECT *, greatest((SELECT count(*) FROM edges WHERE e < b), 1) AS bin FROM rounded),
final AS (
  SELECT bin, sum(b * total_installs) / sum(total_installs) AS pred_mean,
         sum(o * total_installs) / sum(total_installs) AS true_mean, sum(total_installs) AS total_w, count(*) AS n
  FROM binned GROUP BY bin)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.floor(F.col(c) * FINE + 0.5) / FINE for c in ("organic_share", "pred")}).persist()


CALIBRATION = "bin:int pred_mean:8 true_mean:8 total_w:2 n:int"


@query(CALIBRATION, _calibration_sql("pred", "organic_share"))
def calibration(spark, d):
    """Binned on the prediction."""
    return X.calibration_table(_rounded(scored_table(spark, d)), "organic_share", "pred", "total_installs")


@query(CALIBRATION, _calibration_sql("organic_share", "pred"))
def calibration_ties(spark, d):
    """Binned on the observed share, whose many ties make quantile edges collapse."""
    return X.calibration_table(_rounded(scored_table(spark, d)), "pred", "organic_share", "total_installs")


def _hist_sql(expr: str, source: str, bins: int) -> str:
    return f"""vals AS (SELECT {expr} AS v FROM {source} WHERE {expr} IS NOT NULL),
span AS (SELECT min(v) AS lo, max(v) AS hi FROM vals),
placed AS (SELECT CAST(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) AS BIGINT) AS bin FROM vals, span),
counted AS (SELECT bin, count(*) AS n FROM placed GROUP BY bin),
final AS (
  SELECT b.bin, lo + (hi - lo) / {bins} * b.bin AS bin_lo, lo + (hi - lo) / {bins} * (b.bin + 1) AS bin_hi,
         coalesce(n, 0) AS n
  FROM (SELECT unnest(range({bins})) AS bin) b LEFT JOIN counted c ON b.bin = c.bin, span)"""


HIST = "bin:int bin_lo:6 bin_hi:6 n:int"
_TARGET = f"{Q.installs()}, {Q.target()}"


@query(HIST, f"WITH {_SCORED}, {_hist_sql('CASE WHEN pe < -2 THEN -200.0 WHEN pe > 2 THEN 200.0 ELSE pe * 100 END', 'scored', 80)}")
def pe_histogram(spark, d):
    return X.error_histogram(scored_table(spark, d).persist(), "pe")


@query(
    "median:8 mean:8",
    f"WITH {_SCORED}, final AS (SELECT quantile_cont(pe, 0.5) AS median, avg(pe) AS mean FROM scored)",
)
def pe_centre(spark, d):
    return X.error_centre(scored_table(spark, d).persist(), "pe")


@query(HIST, f"WITH {_TARGET}, {_hist_sql('organic_share', 'target', 50)}")
def share_histogram(spark, d):
    return N.histogram(target_table(spark, d), "organic_share", 50)


_LOGIT = "ln(least(greatest(organic_share, 0.001), 0.999) / (1 - least(greatest(organic_share, 0.001), 0.999)))"


@query("platform country_code install_date z:6 back:6", f"""WITH {_TARGET}, final AS (
  SELECT platform, country_code, install_date, {_LOGIT} AS z, least(greatest(organic_share, 0.001), 0.999) AS back
  FROM target)""")
def logit_share(spark, d):
    df = target_table(spark, d).withColumn("z", S.logit(F.col("organic_share")))
    return df.withColumn("back", S.inv_logit(F.col("z")))


@query(HIST, f"WITH {_TARGET}, {_hist_sql(_LOGIT, 'target', 60)}")
def logit_histogram(spark, d):
    return N.histogram(target_table(spark, d), S.logit(F.col("organic_share")), 60)


@query(HIST, f"WITH {_TARGET}, {_hist_sql('total_installs', 'target', 80)}")
def size_histogram(spark, d):
    return N.histogram(target_table(spark, d), "total_installs", 80)


@query(HIST, f"WITH {_TARGET}, {_hist_sql('log10(total_installs)', 'target', 60)}")
def log_size_histogram(spark, d):
    return N.histogram(target_table(spark, d), F.log10("total_installs"), 60)


def _per_column(columns, body: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {body.format(c=c)} FROM clean" for c in columns)


@query(
    "column dtype n_unique:int n_null:int pct_null:2",
    f"""WITH {_TARGET}, final AS (
  SELECT 'platform' AS "column", 'string' AS dtype, count(DISTINCT platform) AS n_unique,
         count(*) FILTER (WHERE platform IS NULL) AS n_null, 0.0 AS pct_null FROM target
  UNION ALL SELECT 'install_date', 'date', count(DISTINCT install_date), 0, 0.0 FROM target
  UNION ALL SELECT 'organic_installs', 'bigint', count(DISTINCT nullif(organic_installs, 0)),
         count(*) FILTER (WHERE organic_installs = 0),
         round(count(*) FILTER (WHERE organic_installs = 0) * 100.0 / count(*), 2) FROM target)""",
)
def null_map(spark, d):
    """Zero organic installs are nulled so that the map has nulls to show."""
    df = target_table(spark, d).select(
        "platform", "install_date", F.nullif("organic_installs", F.lit(0)).alias("organic_installs")
    )
    return P.null_map(df)


@query(
    "column count:int mean:6 std:6 min:6 max:6 q10:6 q25:6 q50:6 q75:6 q90:6 q95:6 q99:6",
    f"""WITH {_TARGET}, final AS ({" UNION ALL ".join(
      f"SELECT '{c}' AS \"column\", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
      f"min({c}) AS min, max({c}) AS max, "
      + ", ".join(f"quantile_cont({c}, {p / 100}) AS q{p}" for p in (10, 25, 50, 75, 90, 95, 99))
      + " FROM target" for c in ("total_installs", "organic_installs", "organic_share"))})""",
)
def describe(spark, d):
    columns = ["total_installs", "organic_installs", "organic_share"]
    return N.describe(target_table(spark, d), columns, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])


@query(
    "platform count:int mean:8 std:8 median:8",
    f"""WITH {_TARGET}, final AS (
  SELECT platform, count(organic_share) AS count, avg(organic_share) AS mean, stddev_samp(organic_share) AS std,
         quantile_cont(organic_share, 0.5) AS median FROM target GROUP BY platform)""",
)
def platform_profile(spark, d):
    return P.group_profile(target_table(spark, d), "organic_share", "platform")


@query(
    "platform q1:8 median:8 q3:8 whisker_lo:8 whisker_hi:8",
    f"""WITH {_TARGET}, q AS (
  SELECT platform, quantile_cont(organic_share, 0.25) AS q1, quantile_cont(organic_share, 0.5) AS median,
         quantile_cont(organic_share, 0.75) AS q3 FROM target GROUP BY platform),
final AS (
  SELECT q.platform, q1, median, q3, min(organic_share) FILTER (WHERE organic_share >= q1 - 1.5 * (q3 - q1)) AS whisker_lo,
         max(organic_share) FILTER (WHERE organic_share <= q3 + 1.5 * (q3 - q1)) AS whisker_hi
  FROM target t JOIN q ON t.platform = q.platform GROUP BY q.platform, q1, median, q3)""",
)
def box_stats(spark, d):
    return P.box_stats(target_table(spark, d), "organic_share", "platform")


_COUNTRIES = f"""WITH {_TARGET}, final AS (
  SELECT country_code, count(*) AS n_cohorts, sum(total_installs) AS total_installs, avg(organic_share) AS share_mean,
         stddev_samp(organic_share) AS share_std FROM target GROUP BY country_code
  ORDER BY total_installs DESC, country_code LIMIT 3)"""


@query("country_code n_cohorts:int total_installs:int share_mean:8 share_std:8", _COUNTRIES)
def top_countries(spark, d):
    return P.top_countries(target_table(spark, d), 3)


@query(
    "install_date platform share:8 n:int installs:int",
    f"""WITH {_TARGET}, final AS (
  SELECT install_date, platform, avg(organic_share) AS share, count(*) AS n, sum(total_installs) AS installs
  FROM target GROUP BY install_date, platform)""",
)
def daily_profile(spark, d):
    return P.daily_profile(target_table(spark, d))


# Sums of floats differ in their last digits with the order of summation. Ranks must not see that, so both engines put the
# values on a grid that no mean or sum of cents falls half-way between.
GRID = 1 << 20
CORRELATED = [*FEATURES, "organic_share"]


def on_grid(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.floor(F.col(c).cast("double") * GRID + 0.5) / GRID for c in columns})


def correlated_table(spark: SparkSession, d: str) -> DataFrame:
    """The cohorts, few rows, in no more parts than tasks run at once: every pass over them costs a task per part."""
    return on_grid(clean_features(spark, d), CORRELATED).coalesce(spark.sparkContext.defaultParallelism).persist()


_GRID = ", ".join(f"floor(CAST({c} AS DOUBLE) * {GRID} + 0.5) / {GRID} AS {c}" for c in CORRELATED)
# Pearson and Spearman of all pairs over complete rows, average ranks on ties.
_PAIRS = f"""{clean_sql()},
grid AS (SELECT concat(platform, '|', country_code, '|', install_date) AS rid, {_GRID} FROM clean),
cells AS MATERIALIZED (SELECT rid, feature, v FROM grid UNPIVOT (v FOR feature IN ({", ".join(CORRELATED)}))),
names AS (SELECT unnest({CORRELATED}) AS feature, unnest(range({len(CORRELATED)})) AS i),
placed AS MATERIALIZED (SELECT rid, feature, i, v FROM cells JOIN names USING (feature)),
met AS (
  SELECT a.feature AS feat_a, b.feature AS feat_b, a.v AS x, b.v AS y FROM placed a JOIN placed b ON a.rid = b.rid AND a.i < b.i),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY feat_a, feat_b ORDER BY x)
           + (count(*) OVER (PARTITION BY feat_a, feat_b, x) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY feat_a, feat_b ORDER BY y)
           + (count(*) OVER (PARTITION BY feat_a, feat_b, y) - 1) / 2.0 AS ry
  FROM met),
coefficients AS (
  SELECT feat_a, feat_b, count(*) AS n,
         CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS pearson,
         CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS spearman FROM ranked GROUP BY feat_a, feat_b),
every_pair AS (
  SELECT a.feature AS feat_a, b.feature AS feat_b, coalesce(n, 0) AS n, pearson, spearman, abs(spearman) AS abs_spearman
  FROM names a JOIN names b ON a.i < b.i LEFT JOIN coefficients c ON c.feat_a = a.feature AND c.feat_b = b.feature)"""


@query(
    "feature pearson:6 spearman:6 abs_spearman:6",
    f"WITH {_PAIRS}, final AS (SELECT feat_a AS feature, * FROM every_pair WHERE feat_b = 'organic_share')",
)
def correlations(spark, d):
    """Every feature of the clean table against the target."""
    return C.target_correlations(correlated_table(spark, d), FEATURES, "organic_share", TARGET_KEYS)


@query(
    "feat_a feat_b n:int pearson:6 spearman:6",
    f"WITH {_PAIRS}, final AS (SELECT * FROM every_pair)",
)
def correlation_matrix(spark, d):
    return C.correlation_table(correlated_table(spark, d), CORRELATED, TARGET_KEYS)


@query(
    "feat_a feat_b abs_spearman:6",
    f"WITH {_PAIRS}, final AS (SELECT * FROM every_pair WHERE feat_b <> 'organic_share')",
)
def feature_pairs(spark, d):
    return C.feature_pairs(correlated_table(spark, d), FEATURES, TARGET_KEYS, top=None)


@query(
    "feat_a feat_b abs_spearman:6",
    f"""WITH {_PAIRS}, best AS (
  SELECT feat_a AS feature FROM every_pair WHERE feat_b = 'organic_share'
  ORDER BY round(abs_spearman, 9) DESC NULLS LAST, feat_a LIMIT 20),
final AS (
  SELECT * FROM every_pair WHERE feat_a IN (SELECT feature FROM best) AND feat_b IN (SELECT feature FROM best)
  ORDER BY round(abs_spearman, 9) DESC NULLS LAST, feat_a, feat_b LIMIT 30)""",
)
def top_feature_pairs(spark, d):
    """The 30 strongest pairs among the 20 features that correlate most with the target."""
    return C.top_pairs(correlated_table(spark, d), FEATURES, "organic_share", TARGET_KEYS)


def _prep_sql(columns, source: str = "train_rows") -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, (SELECT quantile_cont({c}, 0.5) FROM {source}) AS median, CAST({c} AS DOUBLE) AS v "
        f"FROM {source}"
        for c in columns
    )
    return f"""long_rows AS ({parts}), filled AS (SELECT feature, median, coalesce(v, median) AS v FROM long_rows),
stats AS (
  SELECT feature, max(median) AS median, avg(v) AS mean,
         CASE WHEN stddev_pop(v) <= 1e-9 * abs(avg(v)) THEN 1.0 ELSE stddev_pop(v) END AS std FROM filled GROUP BY feature)"""


_TRAIN = f"{clean_sql()}, train_rows AS (SELECT * FROM clean WHERE split = 'train')"


@query("feature median:4 mean:4 std:4", f"WITH {_TRAIN}, {_prep_sql(PROFILED)}, final AS (SELECT * FROM stats)")
def prep_stats(spark, d):
    return R.prep_stats(clean_features(spark, d).filter(F.col("split") == "train").persist(), PROFILED)


@query(
    "platform country_code install_date country_idx:int platform_idx:int "
    + " ".join(f"x_{c}:4" for c in PROFILED),
    f"""WITH {_TRAIN}, {_prep_sql(PROFILED)}, countries AS (
  SELECT country_code, row_number() OVER (ORDER BY country_code) - 1 AS idx
  FROM (SELECT DISTINCT country_code FROM train_rows)),
platforms AS (
  SELECT platform, row_number() OVER (ORDER BY platform) - 1 AS idx FROM (SELECT DISTINCT platform FROM train_rows)),
final AS (
  SELECT c.platform, c.country_code, c.install_date, coalesce(k.idx, 0) AS country_idx,
         coalesce(p.idx, 0) AS platform_idx,
  {", ".join(f"(coalesce(c.{f}, (SELECT median FROM stats WHERE feature = '{f}')) - "
             f"(SELECT mean FROM stats WHERE feature = '{f}')) / (SELECT std FROM stats WHERE feature = '{f}') AS x_{f}"
             for f in PROFILED)}
  FROM clean c LEFT JOIN countries k ON c.country_code = k.country_code
  LEFT JOIN platforms p ON c.platform = p.platform)""",
)
def prep_apply(spark, d):
    table = clean_features(spark, d).persist()
    fitted = R.fit_prep(table.filter(F.col("split") == "train"), PROFILED)
    ready = R.apply_prep(table, fitted, ["platform", "country_code", "install_date"])
    return ready.select("*", *[F.get("x", F.lit(i)).alias(f"x_{c}") for i, c in enumerate(PROFILED)])


def _fitted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Clean table and its training rows, kept in memory while a model makes its passes."""
    table = clean_features(spark, d).persist()
    return table, table.filter(F.col("split") == "train")


def _ridge(spark: SparkSession, d: str) -> tuple[DataFrame, G.RidgeModel]:
    table, train = _fitted(spark, d)
    return table, G.fit_ridge(train, target="organic_share", weight="total_installs", features=FEATURES)


# Ridge in SQL: normal equations of the long design, solved by elimination. The penalty leaves out the intercept.
_RIDGE = f"""RECURSIVE {_TRAIN},
te AS (
  SELECT country_code, sum(organic_share * total_installs) / sum(total_installs) AS country_te
  FROM train_rows WHERE country_code IS NOT NULL GROUP BY country_code),
encoded AS MATERIALIZED (
  SELECT c.*, concat(c.platform, '|', c.country_code, '|', c.install_date) AS rid,
         coalesce(te.country_te, (SELECT sum(organic_share * total_installs) / sum(total_installs) FROM train_rows)) AS country_te
  FROM clean c LEFT JOIN te ON c.country_code = te.country_code),
train_encoded AS (SELECT * FROM encoded WHERE split = 'train'),
{_prep_sql([*FEATURES, "country_te"], "train_encoded")},
kinds AS (SELECT DISTINCT platform FROM train_rows WHERE platform IS NOT NULL),
design AS MATERIALIZED (
  SELECT rid, 'intercept' AS feature, 1.0::DOUBLE AS v FROM encoded
  UNION ALL {" UNION ALL ".join(
      f"SELECT rid, '{c}', (coalesce(CAST({c} AS DOUBLE), median) - mean) / std FROM encoded, stats WHERE feature = '{c}'"
      for c in [*FEATURES, "country_te"])}
  UNION ALL SELECT rid, 'platform_' || k.platform, CASE WHEN e.platform = k.platform THEN 1.0 ELSE 0.0 END FROM encoded e, kinds k),
places AS MATERIALIZED (
  SELECT feature, row_number() OVER (ORDER BY feature <> 'intercept', feature) - 1 AS i FROM (SELECT DISTINCT feature FROM design)),
weighted AS MATERIALIZED (
  SELECT rid, i, v, total_installs AS w, {_LOGIT} AS y
  FROM design JOIN places USING (feature) JOIN train_encoded USING (rid)),
equations AS MATERIALIZED (
  SELECT a.i, b.i AS j, sum(a.w * a.v * b.v) + CASE WHEN a.i = b.i AND a.i > 0 THEN 1.0 ELSE 0.0 END AS v
  FROM weighted a JOIN weighted b USING (rid) GROUP BY a.i, b.i
  UNION ALL SELECT i, (SELECT count(*) FROM places), sum(w * v * y) FROM weighted GROUP BY i),
reduced AS (
  SELECT 0 AS k, i, j, v FROM equations
  UNION ALL
  SELECT a.k + 1, a.i, a.j, CASE WHEN a.i = a.k THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END
  FROM reduced a JOIN reduced r ON r.i = a.k AND r.j = a.j JOIN reduced c ON c.i = a.i AND c.j = a.k
  JOIN reduced p ON p.i = a.k AND p.j = a.k WHERE a.k < (SELECT count(*) FROM places)),
solved AS (
  SELECT feature, v AS coef FROM reduced JOIN places USING (i)
  WHERE k = (SELECT count(*) FROM places) AND j = (SELECT count(*) FROM places)),
fitted AS (
  SELECT rid, 1 / (1 + exp(-sum(coef * v))) AS pred FROM design JOIN solved USING (feature) GROUP BY rid),
predicted AS (
  SELECT e.*, pred, abs(organic_share - pred) AS abs_err,
         CASE WHEN abs(organic_share) > 1e-6 THEN (pred - organic_share) / organic_share END AS pe
  FROM encoded e JOIN fitted USING (rid))"""


@query(
    "platform country_code install_date split organic_share:6 total_installs:int pred:6 abs_err:6 pe:6",
    f"WITH {_RIDGE}, final AS (SELECT * FROM predicted)",
)
def ridge_predictions(spark, d):
    table, model = _ridge(spark, d)
    return X.with_errors(G.predict_ridge(model, table), "organic_share", "pred")


@query(
    "feature coef:6 abs_coef:6",
    f"""WITH {_RIDGE}, final AS (
  SELECT feature, coef, abs(coef) AS abs_coef FROM solved WHERE feature <> 'intercept'
  ORDER BY abs(coef) DESC, feature LIMIT 20)""",
)
def ridge_coefficients(spark, d):
    table, model = _ridge(spark, d)
    return G.coefficient_table(model, table)


@query(f"split {METRICS}", f"WITH {_RIDGE}, {_metric_sql('split', 'predicted')}")
def ridge_metrics(spark, d):
    table, model = _ridge(spark, d)
    return X.regression_report(G.predict_ridge(model, table), "organic_share", "pred", "total_installs", ["split"])


# Given spreads and a fine tolerance, so that SQL can follow the fit.
GIVEN_SPREADS = (0.5, 0.5)
EXACT = replace(BinomialSettings(), tol=1e-10)


def _binomial(spark: SparkSession, d: str) -> tuple[DataFrame, B.BinomialModel]:
    table, train = _fitted(spark, d)
    return table, B.fit_binomial(train, features=FEATURES, settings=EXACT, learn_spread=False, spreads=GIVEN_SPREADS)


_BINOMIAL = f"RECURSIVE {_TRAIN}, {_prep_sql(FEATURES)}, {fit_sql.binomial_fit(FEATURES, GIVEN_SPREADS, EXACT)}"


@query("param value:6 sd:6", f"WITH {_BINOMIAL}, final AS (SELECT * FROM params)")
def binomial_effects(spark, d):
    return B.effects_table(_binomial(spark, d)[1], spark)


@query(
    "platform country_code install_date split organic_share:6 total_installs:int pred:6 abs_err:6",
    f"""WITH {_BINOMIAL}, scored AS (
  SELECT design.*, 1 / (1 + exp(-list_dot_product(x, theta))) AS pred FROM design, mode),
final AS (SELECT *, abs(organic_share - pred) AS abs_err FROM scored)""",
)
def binomial_predictions(spark, d):
    table, model = _binomial(spark, d)
    return X.with_errors(B.predict_binomial(model, table), "organic_share", "pred")


@query(
    "platform country_code install_date organic_installs:int rebuilt:int",
    f"""WITH {Q.installs()}, {Q.target()}, final AS (
  SELECT platform, country_code, install_date, organic_installs, round_even(floor(organic_share * 64 + 0.5) / 64 * total_installs, 0) AS rebuilt FROM target)""",
)
def rounded_counts(spark, d):
    """Counts from shares in steps of a sixty-fourth, where halves are exact: they go to the even number."""
    shares = target_table(spark, d).withColumn("step", F.floor(F.col("organic_share") * 64 + 0.5) / 64)
    rebuilt = B.counts_from_share(shares.withColumnRenamed("organic_installs", "given"), "step", "total_installs")
    return rebuilt.withColumnsRenamed({"organic_installs": "rebuilt", "given": "organic_installs"})


@query("param mean:6 sd:6 hdi_lo:6 hdi_hi:6 abs_mean:6")
def binomial_summary(spark, d):
    _, model = _binomial(spark, d)
    return D.top_coefficients(B.posterior_draws(model, spark, replace(BinomialSettings(), draws=200)))


# Two even chains per flag from the quantities of order lines, summed over four steps so that neighbours are related.
CHAIN_DRAWS = 60
_CHAINS = f"""cells AS (
  SELECT l_returnflag AS param, CAST(l_orderkey % 2 AS INTEGER) AS chain, CAST((l_orderkey // 2) % {CHAIN_DRAWS} AS INTEGER) AS draw,
         CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3),
slots AS (SELECT param, chain, draw FROM (SELECT DISTINCT l_returnflag AS param FROM lineitem),
          (SELECT unnest(range(2)) AS chain), (SELECT unnest(range({CHAIN_DRAWS})) AS draw)),
chains AS (
  SELECT param, chain, draw, sum(coalesce(v, 0)) OVER (PARTITION BY param, chain ORDER BY draw ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS value
  FROM slots LEFT JOIN cells USING (param, chain, draw))"""


def data_chains(spark: SparkSession, d: str) -> DataFrame:
    lines = star.table(spark, d, "lineitem")
    param, chain = F.col("l_returnflag").alias("param"), (F.col("l_orderkey") % 2).cast("int").alias("chain")
    draw = (F.expr("l_orderkey div 2") % CHAIN_DRAWS).cast("int").alias("draw")
    cells = lines.groupBy(param, chain, draw).agg(F.sum("l_quantity").cast("double").alias("v"))
    pairs = lines.select(param).distinct().select("param", F.explode(F.expr("sequence(0, 1)")).alias("chain"))
    slots = pairs.select("*", F.explode(F.expr(f"sequence(0, {CHAIN_DRAWS - 1})")).alias("draw"))
    line = Window.partitionBy("param", "chain").orderBy("draw").rowsBetween(-3, 0)
    full = slots.join(cells, ["param", "chain", "draw"], "left")
    return full.withColumn("value", F.sum(F.coalesce("v", F.lit(0.0))).over(line)).drop("v")


DIAGNOSED = "param mean:6 sd:6 hdi_lo:6 hdi_hi:6 r_hat:6 ess_bulk:4 ess_tail:4 mcse_mean:6 mcse_sd:6"


@query(DIAGNOSED, f"WITH {_CHAINS}, {diagnostics_sql()}, final AS (SELECT * FROM diagnosed)")
def sampler_diagnostics(spark, d):
    """Rank-normalised diagnostics of even chains."""
    return D.diagnostics(data_chains(spark, d))


@query(
    "n_params:int n_bad_rhat:int share_bad_rhat:4 n_bad_ess:int share_bad_ess:4 max_rhat:6 min_ess_bulk:4 n_undefined:int",
    f"""WITH {_CHAINS}, {diagnostics_sql()}, final AS (
  SELECT count(*) AS n_params, count(*) FILTER (WHERE r_hat > 1.01) AS n_bad_rhat, avg(CASE WHEN r_hat > 1.01 THEN 1.0 ELSE 0.0 END) AS share_bad_rhat,
         count(*) FILTER (WHERE ess_bulk < 200) AS n_bad_ess, avg(CASE WHEN ess_bulk < 200 THEN 1.0 ELSE 0.0 END) AS share_bad_ess,
         max(r_hat) AS max_rhat, min(ess_bulk) AS min_ess_bulk, 0 AS n_undefined FROM diagnosed)""",
)
def convergence_overview(spark, d):
    return D.convergence_overview(D.diagnostics(data_chains(spark, d)))


@query("param mean:4 sd:4 hdi_lo:4 hdi_hi:4 r_hat:4 ess_bulk:2 ess_tail:2 mcse_mean:6 mcse_sd:6")
def mmm_diagnostics(spark, d):
    """The same for the channel coefficients of the mix model, per geo."""
    draws = M.coefficient_draws(_mix(spark, d)[2], 200)
    return D.diagnostics(draws.withColumn("param", F.concat_ws("|", "geo", "channel")))


# Constant pooling and settings on the grid, so that SQL can follow the fit.
PLAIN_MIX = MixSettings(learn_pooling=False, refine_steps=0)


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, M.MixModel]:
    panel = weekly_panel(spark, d).persist()
    train, test = _split(panel, False), _split(panel, True)
    return train, test, M.fit_mix(train, PLAIN_MIX)


SPENDS = [f"spend_{c}" for c in [*CHANNELS, "other_paid"]]
_MIX = f"{completed_sql()}, {fit_sql.mix_fit(SPENDS, PLAIN_MIX, M.POOLED_RIDGE, star.TEST_START)}"


@query("grid:int decay:2 shape:2 holdout_rmse_w:6", f"WITH {_MIX}, final AS (SELECT * FROM scores)")
def mmm_grid_scores(spark, d):
    return _mix(spark, d)[2].grid_scores


@query(
    "geo part value:6",
    f"""WITH {_MIX}, final AS (
  SELECT geo, unnest({["intercept", *SPENDS]}) AS part, unnest(coef) AS value FROM fitted)""",
)
def mmm_coefficients(spark, d):
    return M.coefficient_rows(_mix(spark, d)[2])


@query("geo install_date part contribution:6", f"WITH {_MIX}, final AS (SELECT * FROM parts WHERE is_train)")
def mmm_contributions(spark, d):
    train, _, model = _mix(spark, d)
    return M.contributions(model, train)


@query(
    "channel halo_total:4 spend_total:2 share_of_total_organic:6 halo_per_1k_spend:6",
    f"""WITH {_MIX}, spent AS ({" UNION ALL ".join(f"SELECT '{c}' AS channel, sum({c}) AS spend_total FROM train_panel" for c in SPENDS)}),
halo AS (SELECT part AS channel, sum(contribution * scale) AS halo_total FROM parts JOIN train_scale USING (geo) WHERE is_train GROUP BY part),
final AS (
  SELECT channel, halo_total, spend_total, halo_total / (SELECT sum(organic_installs) FROM train_panel) AS share_of_total_organic,
         halo_total / nullif(spend_total / 1000.0, 0) AS halo_per_1k_spend FROM halo JOIN spent USING (channel))""",
)
def mmm_attribution(spark, d):
    train, _, model = _mix(spark, d)
    parts = M.contributions(model, train)
    scale = T.geo_scale(train, T.predictions_from_contributions(parts))
    return T.channel_summary(T.attribute(M.channel_contributions(model, parts), scale, train), train)


@query(
    METRICS,
    f"""WITH {_MIX}, test_predicted AS (
  SELECT geo, install_date, sum(contribution) AS pred_scaled FROM parts WHERE NOT is_train GROUP BY geo, install_date),
predicted AS (
  SELECT p.geo, p.organic_installs, p.organic_installs AS organic_share, p.total_installs, abs(p.organic_installs - q.pred_scaled * coalesce(s.scale, 1.0)) AS abs_err
  FROM test_panel p JOIN test_predicted q ON p.geo = q.geo AND p.install_date = q.install_date LEFT JOIN train_scale s ON p.geo = s.geo),
{_metric_sql('', 'predicted')}""",
)
def mmm_evaluation(spark, d):
    train, test, model = _mix(spark, d)
    scale = T.geo_scale(train, M.predict_mix(model, train))
    matched = T.match_test(test, T.calibrated(M.predict_test(model, train, test), scale))
    return X.regression_report(matched, "organic_installs", "pred", "total_installs")


SWEEP_FOLDS = 3


@query(
    f"grid:int decay:2 shape:2 fold:int {METRICS}",
    f"""WITH {completed_sql()}, {fit_sql.mix_sweep(SPENDS, PLAIN_MIX, M.POOLED_RIDGE, star.TEST_START, SWEEP_FOLDS)},
{_metric_sql('grid, decay, shape, fold', 'predicted')}""",
)
def mmm_sweep(spark, d):
    """All metrics of every grid point on rolling-origin folds of the training weeks."""
    return M.sweep(_split(weekly_panel(spark, d).persist(), False), PLAIN_MIX, SWEEP_FOLDS)


@query("channel total_spend:2 roas_mean:4 roas_hdi_lo:4 roas_hdi_hi:4")
def mmm_roas(spark, d):
    train, _, model = _mix(spark, d)
    scale = T.geo_scale(train, M.predict_mix(model, train))
    return M.roas_table(M.halo_draws(model, train, 200, scale=scale), spend_totals(train))


@query("channel mean:6 hdi_lo:6 hdi_hi:6")
def mmm_channel_effects(spark, d):
    return D.channel_effects(M.coefficient_draws(_mix(spark, d)[2], 200))

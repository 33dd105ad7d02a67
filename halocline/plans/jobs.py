"""The batch jobs, each a function of a session, a data root and settings.

Jobs talk through tables under one root on shared storage: what a later job or a
second pass reads again is written once. Nothing but fitted coefficients and
channel names passes the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.config import USER_KEYS, Settings
from halocline.functions.scalar import date_bucket, logit
from halocline.models import binomial as B
from halocline.models import mix as M
from halocline.models import ridge as G
from halocline.operators import attribution as T
from halocline.operators import cohorts as C
from halocline.operators import correlation as K
from halocline.operators import draws as D
from halocline.operators import features as E
from halocline.operators import metrics as X
from halocline.operators import panel as P
from halocline.operators import profile as O
from halocline.operators import quantiles as N
from halocline.operators.cleaning_report import reported_write
from halocline.operators.purchases import build_iap
from halocline.sources import readers, sinks


OTHER_COUNTRY = "country_other"


@dataclass(frozen=True)
class Paths:
    root: str

    def raw(self, name: str) -> str:
        return f"{self.root}/raw/{name}"

    def feature(self, name: str) -> str:
        return f"{self.root}/features/{name}"

    def table(self, name: str) -> str:
        return f"{self.root}/tables/{name}"

    def result(self, name: str) -> str:
        return f"{self.root}/predictions/{name}"


def ingest(spark: SparkSession, paths: Paths, remote: Mapping[str, str], overwrite: bool = True) -> list[str]:
    """Copy remote datasets to the raw area."""
    entries = {n: {"remote": src, "local": paths.raw(n)} for n, src in remote.items() if src}
    return sinks.ingest(spark, entries, overwrite)


def build_features(spark: SparkSession, paths: Paths, settings: Settings = Settings()) -> list[str]:
    """User features of every raw source that exists, installs first since costs need them."""
    names = ["installs", *[n for n in E.BUILDERS if n != "installs"]]
    done = []
    for name in names:
        if not readers.path_exists(spark, paths.raw(name)):
            continue
        raw = E.coerce_timestamps(readers.scan(spark, paths.raw(name)), ["install_time", "install_date"])
        if name == "iap":
            table = build_iap(raw, settings, stage=sinks.staged(paths.table("iap_users")))
        else:
            installs = readers.scan(spark, paths.feature("installs")) if name == "costs" else None
            table = E.build_source(name, raw, settings, installs)
        if settings.user_buckets:
            sinks.write_bucketed(table, paths.feature(name), USER_KEYS, settings.user_buckets)
        else:
            sinks.write_table(table, paths.feature(name))
        done.append(name)
    return done


def _users(spark: SparkSession, paths: Paths, settings: Settings) -> dict[str, DataFrame]:
    names = [n for n in E.BUILDERS if readers.path_exists(spark, paths.feature(n))]
    read = partial(readers.bucketed, keys=USER_KEYS, buckets=settings.user_buckets) if settings.user_buckets else readers.scan
    return readers.ordered_feature_scans(spark, {n: paths.feature(n) for n in names}, read=read)


def build_cohorts(spark: SparkSession, paths: Paths, settings: Settings = Settings()) -> str:
    """Cohort table on all cohort keys."""
    rolled = C.roll_up_sources(_users(spark, paths, settings), USER_KEYS, settings.cohort_keys)
    return sinks.write_table(rolled, paths.table("cohort_level"))


def build_targets(spark: SparkSession, paths: Paths, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Target with features, written once and partitioned by split."""
    full = C.target_roll_up(
        _users(spark, paths, settings),
        USER_KEYS,
        list(settings.target_keys),
        train_start=settings.train_start,
        test_start=settings.test_start,
        test_end=settings.test_end,
    )
    return sinks.write_split(full, paths.table("targets"))


def clean_targets(spark: SparkSession, paths: Paths, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Cleaned train and test tables, and a report on each."""
    full = spark.read.parquet(paths.table("targets"))
    reports = {}
    for name in ("train", "test"):
        part, path = full.filter(F.col("split") == name).drop("split"), paths.table(f"{name}_clean")
        reports[name] = reported_write(
            part, lambda df: C.clean(df, settings), sinks.staged(path), settings.target, settings.weight
        )
    return reports


def _clean(spark: SparkSession, paths: Paths, settings: Settings) -> tuple[DataFrame, DataFrame, list[str]]:
    train, test = [spark.read.parquet(paths.table(f"{n}_clean")) for n in ("train", "test")]
    return train, test, [c for c in settings.features if c in train.columns]


def _score_tables(scored: Mapping[str, DataFrame], paths: Paths, model: str, settings: Settings) -> dict[str, DataFrame]:
    """Write predictions per split; metrics and error tables read them back."""
    out = {}
    keep = [*settings.keep_keys, settings.target, settings.weight, "pred", "abs_err", "pe"]
    for name, df in scored.items():
        table = X.with_errors(df, settings.target, "pred").select(*keep)
        sinks.write_table(table, paths.result(f"{model}_{name}"))
        rows = df.sparkSession.read.parquet(paths.result(f"{model}_{name}"))
        out[f"{name}_metrics"] = X.regression_report(rows, settings.target, "pred", settings.weight)
        out[f"{name}_summary"] = X.error_summary(rows, "pe")
        out[f"{name}_buckets"] = X.error_bins(rows, "pe", settings.weight)
        out[f"{name}_worst_geos"] = X.errors_by_group(
            rows, settings.target, "pred", settings.weight, ["platform", "country_code"]
        )
    rows = scored["test"].sparkSession.read.parquet(paths.result(f"{model}_test"))
    out["calibration"] = X.calibration_table(rows, settings.target, "pred", settings.weight)
    out["error_histogram"] = X.error_histogram(rows, "pe")
    return out


def _score_every(spark: SparkSession, paths: Paths, model: str, settings: Settings, predict) -> None:
    """Predictions of all cohorts of the two windows, small ones included, for the combination with the halo."""
    full = spark.read.parquet(paths.table("targets")).filter(F.col("split").isin("train", "test"))
    scored = predict(full).select(*settings.keep_keys, settings.target, settings.weight, "pred")
    sinks.write_table(scored, paths.result(f"{model}_all"))


def run_baseline(spark: SparkSession, paths: Paths, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Ridge fit, predictions and report."""
    train, test, features = _clean(spark, paths, settings)
    model = G.fit_ridge(
        train, target=settings.target, weight=settings.weight, features=features, alpha=settings.ridge_alpha,
        stage=sinks.staged(paths.result("baseline_country_means")),
    )
    scored = {"train": G.predict_ridge(model, train), "test": G.predict_ridge(model, test)}
    _score_every(spark, paths, "baseline", settings, lambda df: G.predict_ridge(model, df))
    return _score_tables(scored, paths, "baseline", settings) | {"coefficients": G.coefficient_table(model, train)}


def run_binomial(spark: SparkSession, paths: Paths, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Hierarchical fit, predictions, draws, diagnostics and report."""
    train, test, features = _clean(spark, paths, settings)
    least = settings.binomial.pool_min_rows

    def pooled(df: DataFrame) -> DataFrame:
        return T.pool_rare(df, "country_code", least, OTHER_COUNTRY, by=train) if least else df

    counted = B.counts_from_share(pooled(train), settings.target, settings.weight)
    model = B.fit_binomial(counted, features=features, total=settings.weight, settings=settings.binomial)
    sinks.write_table(B.posterior_draws(model, spark, settings.binomial), paths.result("binomial_draws"))
    draws = spark.read.parquet(paths.result("binomial_draws"))

    def predict(df: DataFrame) -> DataFrame:
        """Predictions under the country's own name; the effect is that of the pool where it was pooled."""
        named = df.withColumn("_country", F.col("country_code"))
        return B.predict_binomial(model, pooled(named)).withColumn("country_code", F.col("_country")).drop("_country")

    scored = {"train": predict(train), "test": predict(test)}
    _score_every(spark, paths, "binomial", settings, predict)
    sinks.write_table(
        B.importance_weights(model, counted, settings.binomial, total=settings.weight), paths.result("binomial_weights")
    )
    weights = spark.read.parquet(paths.result("binomial_weights"))
    return _score_tables(scored, paths, "binomial", settings) | {
        "effects": B.effects_table(model, spark),
        "importance": B.importance_summary(weights),
        "weighted": B.weighted_summary(draws, weights),
        "fit": B.fit_table(model, spark),
        "coefficients": D.top_coefficients(draws.filter(F.col("param").startswith("beta"))),
        "diagnostics": D.diagnostics(draws),
    }


def build_mix_panel(spark: SparkSession, paths: Paths, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Panel from install features and raw costs (cost features lost their keys), cut at the test start."""
    geo_day = ["platform", "country_code", "install_date", "media_source"]
    day = F.to_date("install_date").alias("install_date")
    columns = [day if c == "install_date" else F.col(c) for c in geo_day]
    installs = readers.scan(spark, paths.feature("installs")).select(*columns)
    costs = readers.scan_window(spark, paths.raw("costs"), settings.train_start, settings.test_end).select(*columns, "spend")
    panel = P.build_panel(
        installs, costs, date_from=settings.train_start, date_to=settings.test_end, mix=settings.mix,
        stage=sinks.staged(paths.table("mmm_geo_days")),
    )
    label = F.when(F.col("install_date") < F.lit(settings.test_start), "train").otherwise("test")
    return sinks.write_split(P.ordered(panel.withColumn("split", label)), paths.table("mmm_panel"))


def _panel(spark: SparkSession, paths: Paths) -> tuple[DataFrame, DataFrame]:
    full = spark.read.parquet(paths.table("mmm_panel"))
    return tuple(full.filter(F.col("split") == n).drop("split") for n in ("train", "test"))


def run_mix(
    spark: SparkSession, paths: Paths, settings: Settings = Settings(), draws: int = 500
) -> dict[str, DataFrame]:
    """Mix model: fit, attribution, out-of-sample evaluation, intervals, checks."""
    train, test = _panel(spark, paths)
    target = settings.mix.target
    model = M.fit_mix(train, settings.mix, sinks.staged(paths.result("mmm_coefficients")))
    sinks.write_table(M.contributions(model, train), paths.result("mmm_contributions"))
    parts = spark.read.parquet(paths.result("mmm_contributions"))
    fitted = T.predictions_from_contributions(parts)
    ready = M.model_panel(train, settings.mix)
    scale = T.geo_scale(ready, fitted, target)
    table = T.attribute(M.channel_contributions(model, parts), scale, ready)
    sinks.write_table(table, paths.result("mmm_attribution"))
    attribution = spark.read.parquet(paths.result("mmm_attribution"))
    summary = T.channel_summary(attribution, ready, target)
    sinks.write_summary_csv(summary, paths.result("mmm_attribution_summary"))

    sinks.write_table(M.test_contributions(model, train, test), paths.result("mmm_contributions_test"))
    test_parts = spark.read.parquet(paths.result("mmm_contributions_test"))
    test_ready = M.model_panel(test, settings.mix)
    later = T.attribute(M.channel_contributions(model, test_parts), scale, test_ready)
    sinks.write_table(later, paths.result("mmm_attribution_test"))
    predicted = T.calibrated(T.predictions_from_contributions(test_parts), scale)
    matched = T.match_test(test_ready, predicted)
    sinks.write_table(X.with_errors(matched, target, "pred"), paths.result("mmm_test"))
    tested = spark.read.parquet(paths.result("mmm_test"))
    in_sample = X.with_errors(
        T.match_test(ready, fitted.withColumnRenamed("pred_scaled", "pred")), target, "pred"
    ).withColumn("one", F.lit(1.0))
    halo = M.halo_draws(model, train, draws, scale=scale)
    return {
        "grid": model.grid_scores,
        "sweep": M.sweep(train, settings.mix),
        "coefficients": M.coefficient_rows(model),
        "channel_effects": D.channel_effects(M.coefficient_draws(model, draws)),
        "scale": T.scale_overview(scale),
        "summary": summary,
        "totals": T.halo_totals(attribution, ready, target),
        "over_time": T.halo_over_time(attribution, T.channels_by_halo(attribution)),
        "in_sample": X.regression_report(in_sample, target, "pred", "one"),
        "test_metrics": X.regression_report(tested, target, "pred", "total_installs"),
        "test_summary": X.error_summary(tested, "pe"),
        "test_buckets": X.error_bins(tested, "pe", "total_installs"),
        "roas": M.roas_table(halo, P.spend_totals(ready)),
        "checks": T.attribution_checks(
            summary, 1000.0, spark.createDataFrame([(model.decay,)], "decay double"), M.response_curve(model)
        ).unionByName(M.grid_edges(model)),
        "diagnostics": D.diagnostics(
            M.coefficient_draws(model, draws).withColumn("param", F.concat_ws("|", "geo", "channel"))
        ),
    }


def analyse_draws(draws: DataFrame, path: str) -> dict[str, DataFrame]:
    """Diagnostics table (also as CSV), its overview and the parameters without an index."""
    table = D.diagnostics(draws)
    sinks.write_summary_csv(table, path)
    saved = draws.sparkSession.read.option("header", True).option("inferSchema", True).csv(path)
    return {"table": saved, "overview": D.convergence_overview(saved), "scalars": D.scalar_parameters(saved)}


def combine(spark: SparkSession, paths: Paths, settings: Settings = Settings(), model: str = "binomial") -> DataFrame:
    """True organic installs: predicted share times installs minus the attributed halo, per geo and bucket.

    Shares are those of all cohorts, as the halo was fitted on all installs, and the halo is that of training and test
    buckets. A geo or bucket that the mix model does not know has no halo and no result (``halo_known`` false).
    """
    shares = spark.read.parquet(paths.result(f"{model}_all"))
    attribution = spark.read.parquet(paths.result("mmm_attribution"), paths.result("mmm_attribution_test"))
    named = shares.withColumn("geo", P.geo_name()).withColumn("install_date", F.to_date("install_date"))
    anchor = spark.read.parquet(paths.table("mmm_panel")).agg(F.min("install_date")).scalar()
    step = max(settings.mix.cadence_days, 1)
    bucketed = named.withColumn("_anchor", anchor).withColumn(
        "install_date", date_bucket(F.col("install_date"), F.col("_anchor"), step)
    )
    weight = F.col(settings.weight)
    rolled = bucketed.groupBy("geo", "install_date").agg(
        F.try_divide(F.sum(F.col("pred") * weight), F.sum(weight)).alias("organic_share"),
        F.sum(weight).alias("total_installs"),
    )
    return T.true_organic(rolled, attribution)


def explore(spark: SparkSession, paths: Paths, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Tables behind the exploration charts of the cleaned training rows."""
    train, _, features = _clean(spark, paths, settings)
    share, size = settings.target, settings.weight
    ranked = K.correlation_table(train, [*features, share], list(settings.keep_keys))
    return {
        "null_map": O.null_map(train),
        "describe": N.describe(train, [size], [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]),
        "share_histogram": N.histogram(train, share, 50),
        "logit_histogram": N.histogram(train, logit(F.col(share)), 60),
        "size_histogram": N.histogram(train, size, 80),
        "log_size_histogram": N.histogram(train, F.log10(size), 60),
        "platforms": O.group_profile(train, share, "platform"),
        "boxes": O.box_stats(train, share, "platform"),
        "countries": O.top_countries(train),
        "correlations": K.with_target(ranked, share),
        "pairs": K.strongest_pairs(K.among_best(ranked, share, 20), 30),
        "daily": O.daily_profile(train, share, size),
    }

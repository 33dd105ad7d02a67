"""The batch jobs end to end on generated raw tables."""

import dataclasses
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.config import USER_KEYS, MixSettings, Settings
from halocline.operators import attribution as T
from halocline.operators.cleaning_report import cleaning_report, reported_write
from halocline.operators.keys import merge_on_keys
from halocline.plans import jobs as J
from halocline.sources import readers, sinks
from tests.conftest import rows

RNG = np.random.default_rng(3)
SETTINGS = dataclasses.replace(
    Settings(),
    min_total_installs=6,
    train_start=dt.date(2025, 1, 1),
    test_start=dt.date(2025, 3, 1),
    test_end=dt.date(2025, 4, 1),
    mix=MixSettings(decay_grid=(0.3, 0.6), shape_grid=(1.0, 3.0), refine_steps=1),
)


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    p = J.Paths(str(tmp_path_factory.mktemp("data")))
    start = dt.datetime(2025, 1, 1)
    users = []
    for i in range(3000):
        day = start + dt.timedelta(days=int(RNG.integers(0, 90)))
        source = str(RNG.choice(["organic", "ads_a", "ads_b"], p=[0.4, 0.4, 0.2]))
        users.append((f"u{i}", day, str(RNG.choice(["ios", "android"])), source, str(RNG.choice(["US", "DE"])),
                      None if source == "organic" else "c1", None, None))
    installs = spark.createDataFrame(
        users, "match_id string, install_date timestamp_ntz, platform string, media_source string, "
        "country_code string, campaign string, af_adset string, af_ad string")
    sinks.write_table(installs, p.raw("installs"))
    plus = lambda d: F.col("install_date") + F.expr(f"INTERVAL {d} DAY")
    buyers = installs.filter("hash(match_id) % 3 = 0").select("match_id", "install_date")
    sinks.write_table(buyers.withColumns({
        "purchase_time_list": F.array(plus(1), plus(3)), "purchase_iap_list": F.array(F.lit(2.0), F.lit(5.0))}), p.raw("iap"))
    sinks.write_table(buyers.withColumns({
        "purchase_date_list": F.array(plus(0)), "purchase_ads_list": F.array(F.lit(0.5))}), p.raw("ads"))
    sinks.write_table(installs.select("match_id", "install_date", *[
        (F.abs(F.hash("match_id", F.lit(d))) % 3).cast("double").alias(f"sessions_{d}") for d in range(8)]), p.raw("sessions"))
    for name in ("devices", "personal"):
        sinks.write_table(installs.select("match_id", "install_date", "country_code"), p.raw(name))
    keys = ["install_date", "platform", "media_source", "country_code", "campaign", "af_adset", "af_ad"]
    sinks.write_table(installs.groupBy(*keys).agg(F.count(F.lit(1)).alias("installs")).withColumns({
        "spend": F.when(F.col("media_source") == "organic", 0.0).otherwise(F.col("installs") * 3.0),
        "clicks": F.col("installs") * 20, "impressions": F.col("installs") * 500}), p.raw("costs"))
    return p


def test_pipeline(spark, paths):
    done = J.build_features(spark, paths, SETTINGS)
    assert done[0] == "installs" and set(done) == {"installs", "iap", "ads", "sessions", "costs", "devices", "personal"}
    iap = spark.read.parquet(paths.feature("iap"))
    assert "_raw_rows" not in iap.columns and iap.filter("iap_cum_learn <> 7.0").count() == 0

    J.build_cohorts(spark, paths, SETTINGS)
    cohort = spark.read.parquet(paths.table("cohort_level"))
    assert cohort.agg(F.sum("cohort_size")).first()[0] == 3000

    parts = J.build_targets(spark, paths, SETTINGS)
    assert parts["full"].agg(F.sum("total_installs")).first()[0] == 3000
    assert "split" not in parts["train"].columns
    reports = J.clean_targets(spark, paths, SETTINGS)
    (r,) = rows(reports["train"])
    assert r["rows_before"] == parts["train"].count() and r["size_min"] >= 3

    base = J.run_baseline(spark, paths, SETTINGS)
    assert rows(base["test_metrics"])[0]["n"] > 0 and base["coefficients"].count() == 20
    assert sum(b["pct"] for b in rows(base["test_buckets"])) == pytest.approx(1.0)
    binom = J.run_binomial(spark, paths, SETTINGS)
    assert rows(binom["train_metrics"])[0]["rmse_w"] < 0.4
    assert binom["diagnostics"].filter("r_hat > 1.05").count() == 0

    split = J.build_mix_panel(spark, paths, SETTINGS)
    assert split["full"].filter("geo = 'ios_US'").count() >= 12
    mix = J.run_mix(spark, paths, SETTINGS, draws=50)
    checks = {c["check_name"]: c["passed"] for c in rows(mix["checks"])}
    assert all(checks[c] for c in ("halo_bounded", "decay_in_unit_range", "saturation_monotone"))
    assert {"decay_inside_grid", "shape_inside_grid"} <= set(checks)
    assert mix["diagnostics"].filter("r_hat is null").count() == 0 and rows(binom["fit"])[0]["converged"]
    (tot,) = rows(mix["totals"])
    assert tot["observed"] == split["train"].agg(F.sum("organic_installs")).first()[0]
    assert rows(mix["in_sample"])[0]["n"] == split["train"].count()
    assert mix["over_time"].columns[0] == "install_date" and mix["roas"].count() == 3
    csv = spark.read.option("header", True).csv(paths.result("mmm_attribution_summary"))
    assert csv.count() == 3

    combined = J.combine(spark, paths, SETTINGS)
    bad = combined.filter(F.abs(F.col("organic") - F.col("paid_induced") - F.col("true_organic")) > 1e-9)
    assert combined.count() > 0 and bad.count() == 0
    # all cohorts are in it, the small ones too, and test buckets have a halo of their own
    full = spark.read.parquet(paths.table("targets")).filter("split in ('train', 'test')")
    small = full.filter(f"total_installs < {SETTINGS.min_total_installs}").count()
    every = spark.read.parquet(paths.result("binomial_all"))
    assert small > 0 and every.count() == full.count()
    want = every.agg(F.sum(F.col("pred") * F.col("total_installs"))).first()[0]
    assert combined.agg(F.sum("organic")).first()[0] == pytest.approx(want)
    later = combined.filter(F.col("install_date") >= F.lit(SETTINGS.test_start))
    assert later.filter("halo_known and paid_induced > 0").count() > 0
    # a geo that the panel does not hold has no result rather than a halo of zero
    part = spark.read.parquet(paths.result("mmm_attribution")).filter("geo <> 'ios_US'")
    gone = T.true_organic(combined.withColumns({"organic_share": F.lit(0.5), "total_installs": F.lit(10)}), part).filter("geo = 'ios_US'")
    assert gone.count() > 0 and gone.filter("halo_known or true_organic is not null").count() == 0
    views = J.explore(spark, paths, SETTINGS)
    assert rows(binom["importance"])[0]["n_effective"] > 10 and binom["weighted"].count() == binom["effects"].count()
    assert {r["grid"] for r in rows(mix["sweep"])} == {0, 1, 2, 3}  # a fold without a test week has no row
    assert views["pairs"].count() <= 30 and views["daily"].count() > 0
    draws = spark.read.parquet(paths.result("binomial_draws")).filter("param in ('alpha', 'beta[spend]')")
    table = J.analyse_draws(draws, paths.result("summary"))
    assert [r["param"] for r in rows(table["scalars"])] == ["alpha"]

    rare = dataclasses.replace(SETTINGS, binomial=dataclasses.replace(SETTINGS.binomial, pool_min_rows=10**6, quadrature_rounds=0, draws=20))
    pooled = J.run_binomial(spark, paths, rare)  # every country is rare, and all share one effect
    names = {r["param"] for r in rows(pooled["effects"]) if r["param"].startswith("u_country")}
    assert names == {f"u_country[{J.OTHER_COUNTRY}]"}
    assert {r["country_code"] for r in rows(spark.read.parquet(paths.result("binomial_all")))} == {"US", "DE"}


def test_baseline_without_training_rows(spark, tmp_path):
    """An empty training window gives a report without predictions."""
    p = J.Paths(str(tmp_path))
    row = [("ios", "US", dt.date(2025, 3, 2), 40, 10, 0.25, "test", 3.0)]
    full = spark.createDataFrame(row, "platform string, country_code string, install_date date, total_installs bigint, "
                                 "organic_installs bigint, organic_share double, split string, spend double")  # fmt: skip
    sinks.write_table(full, p.table("targets"))
    J.clean_targets(spark, p, SETTINGS)
    out = J.run_baseline(spark, p, SETTINGS)
    assert out["coefficients"].count() == 0 and out["train_metrics"].count() == 1
    (r,) = spark.read.parquet(p.result("baseline_test")).collect()
    assert r["pred"] is None and r["pe"] is None
    assert rows(out["test_summary"])[0]["n"] == 0 and out["calibration"].count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_user_tables_in_buckets_join_without_a_shuffle(spark, paths, tmp_path):
    """The n-way join and the users' groups read bucketed tables in place."""
    settings = dataclasses.replace(SETTINGS, user_buckets=5)
    p = J.Paths(str(tmp_path))
    for name in ("installs", "iap", "ads", "sessions", "devices"):
        sinks.write_table(spark.read.parquet(paths.raw(name)), p.raw(name))
    J.build_features(spark, p, settings)
    plain = J.Paths(str(tmp_path / "plain"))
    for name in ("installs", "iap", "ads", "sessions", "devices"):
        sinks.write_table(spark.read.parquet(paths.raw(name)), plain.raw(name))
    J.build_features(spark, plain, SETTINGS)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = merge_on_keys(J._users(spark, p, settings), USER_KEYS)
        assert "Exchange" not in plan_of(merged) and "SortMergeJoin" in plan_of(merged)
        assert "Exchange" in plan_of(merge_on_keys(J._users(spark, plain, SETTINGS), USER_KEYS))
        grouped = J._users(spark, p, settings)["ads"].groupBy(*USER_KEYS).agg(F.max("ads_0"))
        assert "Exchange" not in plan_of(grouped)
        total = F.sum("ads_cum_learn"), F.count(F.lit(1))
        assert merged.agg(*total).first() == merge_on_keys(J._users(spark, plain, SETTINGS), USER_KEYS).agg(*total).first()
        spark.sql(f"DROP TABLE {sinks.bucketed_name(p.feature('ads'))}")  # another session's catalog does not know it
        again = merge_on_keys(J._users(spark, p, settings), USER_KEYS)
        assert "Exchange" not in plan_of(again) and again.count() == 3000
        J.build_features(spark, p, settings)  # a rerun replaces the tables
        assert merge_on_keys(J._users(spark, p, settings), USER_KEYS).count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_months_are_replaced_and_pruned_one_by_one(spark, tmp_path):
    path = str(tmp_path / "costs")
    days = spark.range(90).select(F.date_add(F.lit("2025-01-01").cast("date"), F.col("id").cast("int")).alias("install_date"), F.lit(1.0).alias("spend"))
    sinks.write_months(days, path)

    def files():
        return {f.relative_to(path): f.stat().st_mtime_ns for f in (tmp_path / "costs").rglob("*.parquet")}

    before = files()
    sinks.write_months(days.filter("month(install_date) = 2").withColumn("spend", F.lit(5.0)), path)
    after = files()
    assert {k for k in before if "2025-02" not in str(k)} == {k for k in after if before.get(k) == after[k]}
    got = readers.scan_window(spark, path, "2025-02-10", "2025-03-01")
    assert got.columns == ["install_date", "spend"] and got.agg(F.sum("spend")).first()[0] == 19 * 5.0
    assert len(got.inputFiles()) < len(after) or "PartitionFilters: [isnotnull(month" in plan_of(got)
    metrics = [n for n in plan_of(got).splitlines() if "PartitionFilters" in n][0]
    assert "month" in metrics.split("PartitionFilters")[1].split("PushedFilters")[0]
    sinks.write_table(days, str(tmp_path / "plain"))
    assert readers.scan_window(spark, str(tmp_path / "plain"), "2025-02-10", "2025-03-01").count() == 19
    assert sinks.ingest(spark, {"costs": {"remote": str(tmp_path / "plain"), "local": str(tmp_path / "in"), "day": "install_date"}}) == ["costs"]
    assert readers.scan_window(spark, str(tmp_path / "in"), "2025-03-01", "2025-04-01").count() == 31


def test_a_write_reports_what_a_second_reading_would(spark, tmp_path):
    df = spark.range(200).selectExpr("id % 50 total_installs", "id / 200 organic_share", "'ios' platform")
    clean = lambda t: t.filter("total_installs >= 30")
    got = reported_write(df, clean, sinks.staged(str(tmp_path / "kept")))
    want = cleaning_report(df, clean(df))
    assert got.schema.simpleString() == want.schema.simpleString()
    for a, b in zip(got.first(), want.first()):
        assert a == pytest.approx(b)
    none = reported_write(df.limit(0), clean, sinks.staged(str(tmp_path / "none"))).first()
    assert none["rows_before"] == none["rows_after"] == 0 and none["target_mean"] is None


def test_sinks_and_scans(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(3), path)
    sinks.write_table(spark.range(9), path, overwrite=False)
    assert spark.read.parquet(path).count() == 3
    assert any("zstd" in f.name for f in (tmp_path / "t").iterdir())
    with pytest.raises(FileNotFoundError):
        readers.ordered_feature_scans(spark, {"installs": path, "iap": str(tmp_path / "none")})
    with pytest.raises(KeyError):
        readers.ordered_feature_scans(spark, {"iap": path})
    order = list(readers.ordered_feature_scans(spark, {"ads": path, "installs": path}))
    assert order == ["installs", "ads"]
    p = J.Paths(str(tmp_path / "root"))
    assert J.ingest(spark, p, {"a": path, "b": ""}) == ["a"] and spark.read.parquet(p.raw("a")).count() == 3


def test_nanosecond_files(spark, tmp_path):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    stamps = pa.array(pd.to_datetime(["2025-01-01 10:00:00.5", None]), pa.timestamp("ns"))
    pq.write_table(pa.table({"t": stamps}), tmp_path / "n.parquet", version="2.6")
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        got = rows(readers.scan_nanos(spark, str(tmp_path / "n.parquet"), ["t"]), F.desc("t"))
    finally:
        spark.conf.unset("spark.sql.legacy.parquet.nanosAsLong")
    assert got[0]["t"] == dt.datetime(2025, 1, 1, 10, 0, 0, 500000) and got[1]["t"] is None

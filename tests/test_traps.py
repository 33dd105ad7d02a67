"""Small fixtures for semantics that a plain translation gets wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from halocline.config import MixSettings, Settings, load_settings
from halocline.functions import scalar as S
from halocline.functions.policy import cohort_aggregate
from halocline.operators import adstock as A
from halocline.operators import attribution as T
from halocline.operators import cohorts as C
from halocline.operators import panel as P
from halocline.operators.costs import build_costs
from halocline.operators.keys import first_per_key, lookup_join, merge_on_keys
from halocline.operators.purchases import build_ads, build_iap
from halocline.operators.sessions import build_sessions
from pyspark.sql import types as Ty
from pyspark.sql.window import Window
from tests.conftest import rows

DAY = dt.date(2025, 1, 1)
T0 = dt.datetime(2025, 1, 1)
IAP = "match_id string, install_date date, purchase_time_list array<timestamp_ntz>, purchase_iap_list array<double>"


def at(day, minute=0):
    return T0 + dt.timedelta(days=day, minutes=minute)


def iap(spark, data, **kw):
    return {r["match_id"]: r for r in rows(build_iap(spark.createDataFrame(data, IAP), **kw))}


def test_null_cost_key_matches(spark):
    installs = spark.createDataFrame(
        [("u", DAY, "ios", "organic", "US", None, None, None)],
        "match_id string, install_date date, platform string, media_source string, country_code string, "
        "campaign string, af_adset string, af_ad string",
    )
    costs = spark.createDataFrame(
        [(DAY, "ios", "organic", "US", None, None, None, 0.0, 0, 0, 0)],
        "install_date date, platform string, media_source string, country_code string, campaign string, "
        "af_adset string, af_ad string, spend double, installs bigint, clicks bigint, impressions bigint",
    )
    (r,) = rows(build_costs(costs, installs))
    assert r["spend"] == 0.0 and r["installs_spend"] == 0
    assert r["cpi"] is None and r["ctr"] is None and r["cvr"] is None and r["cpm"] is None
    # a second cost row for the key neither multiplies users nor wins over the smaller one
    (again,) = rows(build_costs(costs.union(costs.withColumn("spend", F.lit(9.0))), installs))
    assert again["spend"] == 0.0


def test_empty_lists_keep_day_columns_null(spark):
    got = iap(spark, [("a", DAY, [], []), ("b", DAY, None, None), ("c", DAY, [at(1)], [5.0])])
    for u in "ab":
        assert got[u]["iap_0"] is None and got[u]["iap_count_3"] is None
        assert got[u]["iap_cum_learn"] == 0.0 and got[u]["iap_purchase_count_learn"] == 0
        assert got[u]["time_to_first_iap_minutes"] == 0.0
    assert got["c"]["iap_0"] == 0.0 and got["c"]["iap_1"] == 5.0


def test_null_amount_counts(spark):
    r = iap(spark, [("a", DAY, [at(0), at(0, 5)], [1.0, None])])["a"]
    assert r["iap_count_0"] == 2 and r["iap_0"] == 1.0 and r["iap_purchase_count_learn"] == 2


def test_unequal_lists_raise(spark):
    with pytest.raises(Exception, match="differ in length"):
        build_iap(spark.createDataFrame([("a", DAY, [at(0), at(1)], [1.0])], IAP)).collect()


def test_window_edges(spark):
    days = [-1, 0, 7, 8, 360, 361]
    r = iap(spark, [("a", DAY, [at(d) for d in days], [1.0] * 6), ("b", DAY, [at(360)], [2.0])])
    assert r["a"]["iap_purchase_count_learn"] == 2 and r["a"]["iap_7"] == 1.0
    # the first purchase is looked for over days 0..360
    assert r["b"]["time_to_first_iap_minutes"] == 360 * 1440.0
    assert r["b"]["iap_0"] == 0.0 and r["b"]["iap_cum_learn"] == 0.0


def test_second_and_third_purchase(spark):
    r = iap(
        spark,
        [
            ("a", DAY, [at(2), at(0, 10), at(1)], [1.0, 1.0, 1.0]),
            ("b", DAY, [at(0), at(9)], [1.0, 1.0]),
            ("c", DAY, [at(0, 3), at(0, 3), at(0, 4)], [1.0, 1.0, 1.0]),
        ],
    )
    assert r["a"]["time_to_first_iap_minutes"] == 10.0
    assert r["a"]["time_first_and_second_iap_minutes"] == 1430.0
    assert r["a"]["time_between_iap_2_3"] == 1440.0
    assert r["b"]["time_first_and_second_iap_minutes"] == 0.0 and r["b"]["has_second_iap"] == 0
    assert r["c"]["time_first_and_second_iap_minutes"] == 0.0 and r["c"]["time_between_iap_2_3"] == 1.0


def test_time_of_day_of_the_install_counts_for_minutes_only(spark):
    schema = IAP.replace("install_date date", "install_date timestamp_ntz")
    raw = spark.createDataFrame([("a", at(0, 600), [at(1, 0)], [4.0])], schema)
    (r,) = rows(build_iap(raw))
    assert r["iap_1"] == 4.0 and r["time_to_first_iap_minutes"] == 840.0


def test_repeated_keys_are_pooled_unless_deduped_first(spark):
    data = [("a", DAY, [at(0)], [2.0]), ("a", DAY, [at(1)], [3.0]), ("b", DAY, [at(5)], [5.0])]
    pooled = iap(spark, data)
    assert pooled["a"]["iap_cum_learn"] == 5.0 and pooled["a"]["has_second_iap"] == 1
    assert pooled["a"]["time_first_and_second_iap_minutes"] == 1440.0
    # the date mean weighs every raw row: (1 + 1 + 0) / 3
    assert pooled["b"]["d1_share_iap"] == pytest.approx(2 / 3, abs=1e-6)
    assert iap(spark, data, dedupe_first=True)["a"]["iap_cum_learn"] == 2.0


def test_pass_through_columns_come_from_the_first_row(spark):
    raw = spark.createDataFrame(
        [("a", DAY, [at(0)], [2.0], "z"), ("a", DAY, [at(0)], [1.0], "y")], IAP + ", carrier string"
    )
    (r,) = rows(build_iap(raw))
    assert r["carrier"] == "y" and r["iap_0"] == 3.0
    ads = raw.withColumnsRenamed({"purchase_time_list": "purchase_date_list", "purchase_iap_list": "purchase_ads_list"})
    (r,) = rows(build_ads(ads))
    assert r["carrier"] == "y" and r["ads_rev_d1"] == 3.0 and r["ads_avg_check_learn"] == 1.5


def test_dedupe_states_its_choice(spark):
    df = spark.createDataFrame(
        [("u", DAY, "b", None), ("u", DAY, "a", "x"), (None, DAY, "c", "x"), (None, DAY, "d", "x")],
        "match_id string, install_date date, p string, q string",
    )
    got = rows(first_per_key(df, ["match_id", "install_date"]), "p")
    assert [(r["match_id"], r["p"], r["q"]) for r in got] == [("u", "a", "x"), (None, "c", "x")]
    by_q = rows(first_per_key(df, ["match_id", "install_date"], ["q"]).filter("match_id = 'u'"))
    assert by_q[0]["p"] == "b"
    assert first_per_key(df.select("p"), ["match_id"]).count() == 4


def test_sums_of_nulls_are_zero_and_means_null(spark):
    df = spark.createDataFrame(
        [("g", DAY, None, None, True, "x")],
        "k string, install_date date, spend double, cpi double, flag boolean, name string",
    )
    (r,) = rows(C.roll_up(df, ["k"]))
    assert r == {"k": "g", "cohort_size": 1, "n_calendar_days": 1, "spend": 0.0, "cpi": None}


def test_calendar_days_count_null(spark):
    df = spark.createDataFrame([("g", DAY), ("g", None), ("g", DAY)], "k string, install_date date")
    assert rows(C.roll_up(df, ["k"]))[0]["n_calendar_days"] == 2


@pytest.mark.parametrize(
    "name,kind",
    [
        ("rev_d1_iap", "sum"),
        ("iap_days_with_purchase_learn", "mean"),
        ("has_second_iap", "mean"),
        ("sessions_d1", "mean"),
        ("log1p_ads_cum_learn", "sum"),
        ("ads_rev_d3", "sum"),
        ("spend", "sum"),
        ("installs_spend", "sum"),
        ("cpi", "mean"),
        ("iap_check_size_4", "sum"),
        ("sessions_11", "sum"),
        ("ret_1", "mean"),
        ("iap_purchase_count_learn", "sum"),
    ],
)
def test_name_policy(name, kind):
    assert cohort_aggregate(name, Ty.DoubleType()) == kind
    assert cohort_aggregate(name, Ty.BooleanType()) is None
    assert cohort_aggregate(name, Ty.DecimalType(10, 2)) is None


def test_split_edges(spark):
    days = ["2024-10-31", "2024-11-01", "2025-04-30", "2025-05-01", "2025-05-31", "2025-06-01"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "d date")
    s = Settings()
    got = df.select("d", C.split_label(F.col("d"), s.train_start, s.test_start, s.test_end).alias("s"))
    assert [r["s"] for r in rows(got, "d")] == ["unused", "train", "train", "test", "test", "unused"]


def test_target_counts_null_sources(spark):
    df = spark.createDataFrame(
        [("ios", "US", DAY, "organic"), ("ios", "US", DAY, None), ("ios", "US", DAY, "x")],
        "platform string, country_code string, install_date date, media_source string",
    )
    s = Settings()
    (r,) = rows(
        C.build_target(
            df, s.target_keys, train_start=s.train_start, test_start=s.test_start, test_end=s.test_end
        )
    )
    assert r["total_installs"] == 3 and r["organic_installs"] == 1 and r["split"] == "train"
    with pytest.raises(KeyError):
        C.build_target(df.drop("media_source"), s.target_keys, train_start=DAY, test_start=DAY, test_end=DAY)


def test_cleaning_guards(spark):
    df = spark.createDataFrame([(1, 0.5)], "total_installs bigint, organic_share double")
    assert C.drop_small(df, 1).count() == 1 and C.drop_small(df, 2).count() == 0
    with pytest.raises(KeyError):
        C.drop_small(df.drop("total_installs"), 30)
    kept = C.modelling_columns(df, keep_keys=[], target="organic_share", weight="total_installs", features=["nope"])
    assert kept.columns == ["total_installs", "organic_share"]
    with pytest.raises(KeyError):
        C.modelling_columns(df, keep_keys=["platform"], target="organic_share", weight="total_installs", features=[])


def sessions(spark, columns, *data):
    schema = "match_id string, install_date date, " + ", ".join(f"{c} double" for c in columns)
    return rows(build_sessions(spark.createDataFrame([(f"u{i}", DAY, *r) for i, r in enumerate(data)], schema)), "match_id")


def test_session_gap_uses_positions(spark):
    (r,) = sessions(spark, ["sessions_0", "sessions_1", "sessions_2", "sessions_4"], (1.0, 0.0, 0.0, 2.0))
    assert r["last_active_day"] == 4
    assert r["session_velocity_slope"] == pytest.approx((-1.5 * 1 + 1.5 * 2) / 5.0)
    assert r["sessions_3"] == 0.0 and r["sessions_6"] == 0.0 and "sessions_7" not in r
    assert r["sessions_d1"] == 1.0 and r["zero_session_days"] == 5


def test_session_last_day_is_not_filled(spark):
    names = [f"sessions_{d}" for d in range(8)]
    idle, busy = sessions(spark, names, (None,) * 8, (1.0,) * 8)
    assert idle["sessions_7"] is None and idle["sessions_0"] == 0.0
    assert idle["last_active_day"] == 0 and idle["zero_session_days"] == 7
    assert busy["zero_session_days"] == 0 and busy["last_active_day"] == 8


def test_active_days_column_wins(spark):
    a, b, c = sessions(spark, ["sessions_0", "active_days_7d"], (1.0, 9.0), (1.0, 2.0), (1.0, None))
    assert a["zero_session_days"] == 0 and b["zero_session_days"] == 5 and c["zero_session_days"] is None
    assert a["session_velocity_slope"] == 0.0


def test_merge_renames_collisions_and_needs_input(spark):
    a = spark.createDataFrame([(1, "x")], "k int, c string")
    b = spark.createDataFrame([(1, "y")], "k int, c string")
    out = merge_on_keys({"a": a, "b": b, "d": b}, ["k"])
    assert out.columns == ["k", "c", "c_right", "c_d"]
    assert merge_on_keys({"a": a, "b": b.filter("k = 2")}, ["k"], "inner").count() == 0
    with pytest.raises(ValueError):
        merge_on_keys({}, ["k"])


def test_lookup_join_keeps_every_row_of_a_hot_key(spark):
    hot = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "h").alias("k"))
    lookup = spark.createDataFrame([("h", 1), (None, 2)], "k string, v int")
    got = lookup_join(hot, lookup, ["k"], spread_by=["id"])
    counts = {r["v"]: r["n"] for r in rows(got.groupBy("v").agg(F.count(F.lit(1)).alias("n")))}
    assert counts == {1: 3333, 2: 1667}


COSTS = "platform string, country_code string, install_date date, media_source string, spend double"


def day(n):
    return DAY + dt.timedelta(days=n)


def test_tied_channels_and_other_bucket(spark):
    costs = spark.createDataFrame(
        [("ios", "US", DAY, s, v) for s, v in [("b", 5.0), ("a", 5.0), ("c", 1.0), ("z", 0.0), ("organic", 9.0), (None, 7.0)]],
        COSTS,
    )
    assert P.channel_names(costs, 1) == ["a"]
    assert P.channel_names(costs, 10) == ["a", "b", "c"]
    (r,) = rows(P.spend_wide(costs, ["a", "ghost"]))
    assert r["spend_a"] == 5.0 and r["spend_ghost"] == 0.0 and r["spend_other_paid"] == 6.0
    long = rows(P.spend_by_channel(costs, ["a"]), "channel")
    assert [(x["channel"], x["spend"]) for x in long] == [("a", 5.0), ("other_paid", 6.0)]


def test_spend_without_installs(spark):
    installs = spark.createDataFrame([("ios", "US", DAY, "organic")], COSTS.rsplit(",", 1)[0])
    costs = spark.createDataFrame([("ios", "US", day(1), "a", 3.0)], COSTS)
    mix = MixSettings(cadence_days=1, top_n_geos=0)
    kw = {"date_from": DAY, "date_to": day(30), "mix": mix}
    (r,) = rows(P.build_panel(installs, costs, **kw))
    assert r["spend_a"] == 0.0 and r["dow_2"] == 1.0 and r["geo"] == "ios_US"
    both = rows(P.build_panel(installs, costs, spend_join="full_outer", **kw), "install_date")
    assert [(x["total_installs"], x["spend_a"]) for x in both] == [(1, 0.0), (0, 3.0)]


def test_cadence_is_anchored_on_the_first_date(spark):
    schema = "platform string, country_code string, install_date date, organic_installs bigint, total_installs bigint, spend_a double"
    panel = spark.createDataFrame([("ios", "US", day(n), 1, 2, 1.5) for n in range(15)], schema)
    got = rows(P.bucket_days(panel, 7), "install_date")
    assert [r["install_date"] for r in got] == [day(0), day(7), day(14)]
    assert [r["total_installs"] for r in got] == [14, 14, 2]
    assert P.bucket_days(panel, 1) is panel
    assert sum(r["spend_a"] for r in got) == 22.5


def test_geo_and_country_filters(spark):
    schema = "platform string, country_code string, total_installs bigint"
    panel = spark.createDataFrame([("ios", "US", 5), ("ios", "DE", 5), ("android", "US", 3), ("ios", "FR", 1)], schema)
    assert {r["country_code"] for r in rows(P.keep_countries(panel, 5))} == {"US", "DE"}
    assert [(r["platform"], r["country_code"]) for r in rows(P.keep_top_geos(panel, 2), "country_code")] == [("ios", "DE"), ("ios", "US")]
    assert P.keep_top_geos(panel, 0) is panel


def test_adstock_impulse_and_identity(spark):
    df = spark.createDataFrame([("g", day(i), x) for i, x in enumerate([10.0, 0.0, 0.0, 5.0, 0.0])], "geo string, install_date date, x double")
    w = Window.partitionBy("geo").orderBy("install_date")
    got = [r["x"] for r in rows(A.adstock_columns(df, ["x"], 0.5, 4), "install_date")]
    assert got == [10.0, 5.0, 2.5, 6.25, 2.5]
    same = rows(df.withColumn("y", A.adstock(F.col("x"), w, 0.5, 1)), "install_date")
    assert [r["y"] for r in same] == [r["x"] for r in same]
    assert sum(A.geometric_weights(0.5, 4, normalize=True)) == pytest.approx(1.0)


def test_missing_buckets_are_completed(spark):
    df = spark.createDataFrame([("g", day(0), 8.0), ("g", day(14), 0.0), ("h", day(7), 1.0)], "geo string, install_date date, x double")
    full = A.complete_buckets(df, ["x"], 7)
    assert full.count() == 6 and full.filter("observed").count() == 3
    got = rows(A.adstock_columns(full, ["x"], 0.5, 4).filter("geo = 'g'"), "install_date")
    assert [r["x"] for r in got] == [8.0, 4.0, 2.0]


def test_saturation_curves(spark):
    x = spark.range(50).select((F.col("id") / 10).alias("x"))
    for kind in ("logistic", "michaelis_menten", "hill"):
        y = [r["y"] for r in x.orderBy("x").select(S.saturate(kind, F.col("x"), 1.5).alias("y")).collect()]
        assert y[0] == 0.0 and all(a < b for a, b in zip(y, y[1:])) and y[-1] < 1.0
    with pytest.raises(ValueError):
        S.saturate("tanh", F.col("x"), 1.0)


def test_scale_is_clamped_and_missing_geos_stay(spark):
    panel = spark.createDataFrame([("g", DAY, 4, 0.0), ("h", DAY, 6, 1.0)], "geo string, install_date date, organic_installs bigint, spend_a double")
    pred = spark.createDataFrame([("g", DAY, 0.0), ("h", DAY, 3.0), ("k", DAY, 2.0)], "geo string, install_date date, pred_scaled double")
    scale = T.geo_scale(panel, pred)
    assert {r["geo"]: r["scale"] for r in rows(scale)} == {"g": 4 / 1e-9, "h": 2.0}
    got = {r["geo"]: r["pred"] for r in rows(T.calibrated(pred, scale))}
    assert got["h"] == 6.0 and got["k"] == 2.0
    parts = pred.select("geo", "install_date", F.lit("spend_a").alias("channel"), F.col("pred_scaled").alias("contribution"))
    halo = {r["geo"]: r for r in rows(T.attribute(parts, scale, panel))}
    assert halo["k"]["halo_organic"] is None and halo["h"]["halo_organic"] == 6.0
    summary = rows(T.channel_summary(T.attribute(parts, scale, panel), panel))[0]
    assert summary["spend_total"] == 1.0 and summary["halo_per_1k_spend"] == 6000.0


def test_zero_spend_has_no_rate(spark):
    panel = spark.createDataFrame([("g", DAY, 4, 0.0)], "geo string, install_date date, organic_installs bigint, spend_a double")
    att = spark.createDataFrame([(DAY, "g", "spend_a", 1.0, 0.0)], "install_date date, geo string, channel string, halo_organic double, spend double")
    assert rows(T.channel_summary(att, panel))[0]["halo_per_1k_spend"] is None


def test_bad_timestamps_become_null(spark):
    df = spark.createDataFrame([("2025-01-01 10:00:00",), ("junk",)], "t string")
    got = [r["t"] for r in S.coerce_timestamps(df, ["t", "absent"]).collect()]
    assert got == [dt.datetime(2025, 1, 1, 10), None]


def test_numbers_and_utc_instants(spark):
    df = spark.createDataFrame([("2025-01-01 10:00:00", 1_735_725_600_000_000_000)], "t string, n bigint")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        (r,) = rows(S.coerce_timestamps(df, ["t", "n"], utc=True).selectExpr("unix_micros(t) t", "unix_micros(n) n"))
        (w,) = rows(S.coerce_timestamps(df, ["t", "n"]))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert r == {"t": 1_735_725_600_000_000, "n": 1_735_725_600_000_000}
    assert w["t"] == w["n"] == dt.datetime(2025, 1, 1, 10)


def test_minutes_keep_fractions(spark):
    df = spark.createDataFrame([(T0, T0 + dt.timedelta(hours=24, minutes=1, seconds=30.5))], "a timestamp_ntz, b timestamp_ntz")
    (r,) = rows(df.select(S.minutes_between(F.col("b"), F.col("a")).alias("m")))
    assert r["m"] == pytest.approx(1441.0 + 30.5 / 60)


def test_settings_overrides(tmp_path):
    path = tmp_path / "o.json"
    path.write_text('{"min_total_installs": 5, "mix": {"cadence_days": 1}, "test_end": "2025-07-01"}')
    s = load_settings(str(path), {"ridge_alpha": 2.0})
    assert (s.min_total_installs, s.mix.cadence_days, s.ridge_alpha) == (5, 1, 2.0)
    assert s.test_end == dt.date(2025, 7, 1) and s.target_keys == ("platform", "country_code", "install_date")
    with pytest.raises(KeyError):
        load_settings(overrides={"nope": 1})

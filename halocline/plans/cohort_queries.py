"""Queries over sources, user features and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.config import USER_KEYS, Settings
from halocline.operators import cohorts, purchases
from halocline.operators.cleaning_report import cleaning_report
from halocline.operators.costs import build_costs, cost_ratios
from halocline.operators.features import build_users
from halocline.operators.keys import first_per_key, merge_on_keys
from halocline.operators.sessions import build_sessions
from halocline.plans import star_sql as Q
from halocline.plans.registry import query
from halocline.sources import star

TARGET_KEYS = ["platform", "country_code", "install_date"]
DAYS = range(8)

IAP_COLUMNS = " ".join(
    ["match_id:int install_date"]
    + [f"iap_{d}:4 iap_count_{d}:int iap_check_size_{d}:4" for d in DAYS]
    + ["time_to_first_iap_minutes:4 time_first_and_second_iap_minutes:4 time_between_iap_2_3:4"]
    + ["iap_cum_learn:4 log1p_iap_cum_learn:6 iap_days_with_purchase_learn:int iap_purchase_count_learn:int"]
    + ["iap_avg_check_learn:6 rev_d1_iap:4 rev_d3_iap:4 d1_share_iap:6"]
    + ["avg_check_d1_3_iap:3 avg_check_d4_7_iap:3 acceleration_iap:log has_second_iap:int"]
)
ADS_COLUMNS = " ".join(
    ["match_id:int install_date"]
    + [f"ads_{d}:4 ads_count_{d}:int" for d in DAYS]
    + ["ads_cum_learn:4 log1p_ads_cum_learn:6 ads_days_with_purchase_learn:int ads_purchase_count_learn:int"]
    + ["ads_avg_check_learn:6 ads_rev_d1:4 ads_rev_d3:4"]
)
COHORT_VALUES = "cohort_size:int n_calendar_days:int " + Q.rounded(Q.SUMMED + Q.AVERAGED)


def user_installs(spark: SparkSession, d: str, grain: str = "quarter") -> DataFrame:
    return build_users(star.installs(spark, d, grain))


def user_iap(spark: SparkSession, d: str, grain: str = "quarter") -> DataFrame:
    return purchases.iap_features(None, star.events(spark, d, "R", grain))


def user_ads(spark: SparkSession, d: str, grain: str = "quarter") -> DataFrame:
    return purchases.ads_features(None, star.events(spark, d, "A", grain))


def user_sources(spark: SparkSession, d: str, grain: str = "quarter") -> dict[str, DataFrame]:
    """Features of all seven sources, installs first."""
    installs = user_installs(spark, d, grain)
    return {
        "installs": installs,
        "ads": user_ads(spark, d, grain),
        "iap": user_iap(spark, d, grain),
        "sessions": build_sessions(star.sessions(spark, d, grain)),
        "personal": build_users(star.user_list(spark, d, grain)),
        "costs": build_costs(star.costs(spark, d, grain), installs),
        "devices": build_users(star.user_list(spark, d, grain)),
    }


def user_table(spark: SparkSession, d: str, grain: str = "quarter") -> DataFrame:
    """All seven sources joined at user grain."""
    return merge_on_keys(user_sources(spark, d, grain), USER_KEYS)


def target_table(spark: SparkSession, d: str, grain: str = "quarter") -> DataFrame:
    return cohorts.build_target(
        user_installs(spark, d, grain),
        TARGET_KEYS,
        train_start=star.TRAIN_START,
        test_start=star.TEST_START,
        test_end=star.TEST_END,
    )


def feature_table(spark: SparkSession, d: str, grain: str = "quarter") -> DataFrame:
    """Target with the rolled-up features of every source."""
    return cohorts.target_roll_up(
        user_sources(spark, d, grain),
        USER_KEYS,
        TARGET_KEYS,
        train_start=star.TRAIN_START,
        test_start=star.TEST_START,
        test_end=star.TEST_END,
    )


def clean_features(spark: SparkSession, d: str, grain: str = "quarter", min_size: int = 30) -> DataFrame:
    """Cleaned modelling table with its split label."""
    s = Settings()
    return cohorts.modelling_columns(
        cohorts.drop_small(feature_table(spark, d, grain), min_size),
        keep_keys=[*s.keep_keys, "split", "organic_installs"],
        target=s.target,
        weight=s.weight,
        features=[c for c in s.features if c in Q.SUMMED or c in Q.AVERAGED],
    )


@query(
    "platform country_code install_date total_installs:int organic_installs:int organic_share:6 split",
    f"WITH {Q.installs()}, {Q.target('final')}",
)
def target_build(spark, d):
    return target_table(spark, d)


@query(
    "platform country_code install_date total_installs:int organic_share:6",
    f"WITH {Q.installs()}, {Q.target()}, final AS (SELECT * FROM target WHERE total_installs >= 30)",
)
def small_cohort_filter(spark, d):
    return cohorts.drop_small(target_table(spark, d), 30)


@query(
    "split n_cohorts:int first_date last_date",
    f"""WITH {Q.installs()}, {Q.target()}, final AS (
  SELECT split, count(*) AS n_cohorts, min(install_date) AS first_date, max(install_date) AS last_date
  FROM target GROUP BY split)""",
)
def split_counts(spark, d):
    return cohorts.split_counts(target_table(spark, d))


@query(
    "platform country_code install_date total_installs:int organic_installs:int organic_share:6",
    f"WITH {Q.installs()}, {Q.target()}, final AS (SELECT * FROM target WHERE split = 'test')",
)
def test_split(spark, d):
    return target_table(spark, d).filter(F.col("split") == "test").drop("split")


@query(
    "match_id:int install_date platform media_source country_code campaign",
    f"""WITH {Q.installs()}, ranked AS (
  SELECT custkey AS match_id, install_date, platform, media_source, country_code, campaign,
         row_number() OVER (PARTITION BY custkey, install_date ORDER BY platform NULLS FIRST,
           media_source NULLS FIRST, country_code NULLS FIRST, campaign NULLS FIRST) AS rn
  FROM installs), final AS (SELECT * FROM ranked WHERE rn = 1)""",
)
def installs_dedupe(spark, d):
    """Customers as users: several orders a quarter repeat the key."""
    raw = star.installs(spark, d).withColumnRenamed("match_id", "o_orderkey")
    owner = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("match_id"))
    rows = raw.join(owner, "o_orderkey").drop("o_orderkey")
    return first_per_key(rows, USER_KEYS, ["platform", "media_source", "country_code", "campaign"])


@query(
    "platform media_source country_code install_date",
    f"""WITH {Q.installs()}, final AS (
  SELECT DISTINCT platform, media_source, country_code, install_date FROM installs)""",
)
def full_row_dedupe(spark, d):
    """Without the user key whole rows are made distinct."""
    rows = star.installs(spark, d).select("platform", "media_source", "country_code", "install_date")
    return first_per_key(rows, USER_KEYS)


@query(
    "match_id:int install_date",
    f"WITH {Q.installs()}, final AS (SELECT DISTINCT match_id, install_date FROM installs)",
)
def device_users(spark, d):
    return build_users(star.user_list(spark, d))


def _line_lists(spark: SparkSession, d: str) -> DataFrame:
    """Raw list rows: every line item carries two events, so a user key repeats and its lists are pooled."""
    ev = star.events(spark, d, "R")
    return ev.select(
        *USER_KEYS,
        F.array("time", F.col("time") + F.expr("INTERVAL 1 DAY")).alias("purchase_time_list"),
        F.array(F.col("amount"), F.col("amount") / 2).alias("purchase_iap_list"),
    )


_LINE_EVENTS = """SELECT match_id, install_date, time, day, amount FROM events WHERE flag = 'R'
  UNION ALL SELECT match_id, install_date, time + INTERVAL 1 DAY, day + 1, amount / 2 FROM events WHERE flag = 'R'"""


@query(
    "match_id:int install_date n_events:int amount:4 first_time last_time",
    f"""WITH {Q.events()}, pooled AS ({_LINE_EVENTS}), final AS (
  SELECT match_id, install_date, count(*) AS n_events, sum(amount) AS amount, min(time) AS first_time,
         max(time) AS last_time FROM pooled GROUP BY match_id, install_date)""",
)
def event_explode(spark, d):
    events = purchases.explode_lists(_line_lists(spark, d), *purchases.IAP_LISTS)
    return events.groupBy(*USER_KEYS).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum("amount").alias("amount"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
    )


@query(
    "match_id:int install_date day:int amount:4 n_events:int",
    f"""WITH {Q.events()}, final AS (
  SELECT match_id, install_date, day, sum(amount) AS amount, count(*) AS n_events
  FROM events WHERE flag = 'R' AND day BETWEEN 0 AND 360 GROUP BY match_id, install_date, day)""",
)
def iap_daily(spark, d):
    return purchases.daily_totals(star.events(spark, d, "R"), Settings().max_event_day)


@query(
    "match_id:int install_date second_time third_time",
    f"WITH {Q.events()}, {Q.iap_features()}, final AS (SELECT * FROM iap_later)",
)
def nth_purchase(spark, d):
    return purchases.nth_times(star.events(spark, d, "R"), Settings().learn_days)


@query(IAP_COLUMNS, f"WITH {Q.events()}, {Q.iap_features()}, final AS (SELECT * FROM iap_features)")
def iap_features(spark, d):
    return user_iap(spark, d)


@query(
    IAP_COLUMNS,
    f"WITH {Q.events()}, {Q.iap_features(_LINE_EVENTS, raw_rows='count(*) / 2')}, "
    "final AS (SELECT * FROM iap_features)",
)
def iap_features_lists(spark, d):
    """The raw list source, with repeated user keys."""
    return purchases.build_iap(_line_lists(spark, d))


@query(ADS_COLUMNS, f"WITH {Q.events()}, {Q.ads_features()}, final AS (SELECT * FROM ads_features)")
def ads_features(spark, d):
    return user_ads(spark, d)


@query(
    "install_date d1_share_iap:6 n_users:int",
    f"""WITH {Q.events()}, {Q.iap_features()}, final AS (
  SELECT install_date, max(d1_share_iap) AS d1_share_iap, count(*) AS n_users
  FROM iap_features GROUP BY install_date)""",
)
def d1_share(spark, d):
    return user_iap(spark, d).groupBy("install_date").agg(
        F.max("d1_share_iap").alias("d1_share_iap"), F.count(F.lit(1)).alias("n_users")
    )


@query(
    "match_id:int install_date "
    + " ".join(f"sessions_{x}:4" for x in DAYS)
    + " n_sessions_total:4 sessions_d1:4 session_velocity_slope:6 last_active_day:int zero_session_days:int",
    f"WITH {Q.events()}, {Q.session_features()}, final AS (SELECT * FROM session_features)",
)
def session_features(spark, d):
    return build_sessions(star.sessions(spark, d))


@query(
    "install_date platform media_source country_code campaign spend:2 installs_spend:int clicks:int "
    "impressions:int cpi:6 ctr:6 cvr:6 cpm:6",
    f"WITH {Q.installs()}, {Q.costs()}, {Q.cost_ratios()}, final AS (SELECT * FROM ratios)",
)
def cost_ratio_rows(spark, d):
    return cost_ratios(star.costs(spark, d))


@query(
    "match_id:int install_date spend:2 installs_spend:int clicks:int impressions:int cpi:6 ctr:6 cvr:6 cpm:6",
    f"WITH {Q.installs()}, {Q.costs()}, {Q.cost_ratios()}, {Q.cost_features()}, "
    "final AS (SELECT * FROM cost_features)",
)
def cost_attach(spark, d):
    return build_costs(star.costs(spark, d), user_installs(spark, d))


@query(
    "match_id:int install_date platform media_source country_code "
    + Q.rounded(Q.SUMMED + Q.AVERAGED),
    f"WITH {Q.all_sources()}, {Q.roll_up('platform, country_code, install_date')}, "
    "final AS (SELECT * FROM users)",
)
def merge_sources(spark, d):
    return user_table(spark, d)


@query(
    f"platform media_source country_code install_date {COHORT_VALUES}",
    f"WITH {Q.all_sources()}, {Q.roll_up('platform, media_source, country_code, install_date', 'final')}",
)
def cohort_rollup(spark, d):
    return cohorts.roll_up_sources(user_sources(spark, d), USER_KEYS, list(Settings().cohort_keys))


@query(
    f"platform country_code {COHORT_VALUES}",
    f"WITH {Q.all_sources()}, {Q.roll_up('platform, country_code', 'final')}",
)
def geo_rollup(spark, d):
    """Keys without the date, so calendar days are counted."""
    return cohorts.roll_up(user_table(spark, d), ["platform", "country_code"])


@query(
    f"platform country_code install_date total_installs:int organic_installs:int organic_share:6 split {COHORT_VALUES}",
    f"""WITH {Q.all_sources()}, {Q.roll_up('platform, country_code, install_date')}, {Q.target()}, final AS (
  SELECT t.*, c.* EXCLUDE (platform, country_code, install_date)
  FROM target t LEFT JOIN cohorts c ON t.platform = c.platform AND t.country_code = c.country_code
   AND t.install_date = c.install_date)""",
)
def target_with_features(spark, d):
    return feature_table(spark, d)


@query(
    "platform country_code install_date total_installs:int organic_share:6 split cohort_size:int spend:3 cpi:9",
    f"""WITH {Q.installs()}, {Q.costs()}, {Q.cost_ratios()}, {Q.cost_features()}, {Q.target()}, rolled AS (
  SELECT platform, country_code, i.install_date, count(*) AS cohort_size, coalesce(sum(spend), 0) AS spend,
         avg(cpi) AS cpi
  FROM installs i JOIN cost_features c ON i.match_id = c.match_id AND i.install_date = c.install_date
  GROUP BY platform, country_code, i.install_date),
final AS (
  SELECT t.*, r.cohort_size, r.spend, r.cpi FROM target t LEFT JOIN rolled r ON t.platform = r.platform
   AND t.country_code = r.country_code AND t.install_date = r.install_date)""",
)
def target_join_features(spark, d):
    """The two tables built apart and joined on the target keys."""
    installs = user_installs(spark, d)
    users = merge_on_keys({"installs": installs, "costs": build_costs(star.costs(spark, d), installs)}, USER_KEYS)
    rolled = cohorts.roll_up(users, TARGET_KEYS, ["spend", "cpi"])
    return cohorts.target_with_features(target_table(spark, d), rolled, TARGET_KEYS)


_CLEAN = [c for c in Settings().features if c in Q.SUMMED or c in Q.AVERAGED]


def clean_sql() -> str:
    """``clean`` relation: cohorts of at least 30 installs with the modelling features and the split."""
    columns = ", ".join(f"c.{c}" for c in _CLEAN)
    return f"""{Q.all_sources()}, {Q.roll_up('platform, country_code, install_date')}, {Q.target()}, clean AS (
  SELECT t.platform, t.country_code, t.install_date, t.split, t.organic_installs, t.total_installs, t.organic_share,
         {columns}
  FROM target t LEFT JOIN cohorts c ON t.platform = c.platform AND t.country_code = c.country_code
   AND t.install_date = c.install_date WHERE t.total_installs >= 30)"""


CLEAN_FEATURES = tuple(_CLEAN)


@query(
    "platform country_code install_date total_installs:int organic_share:6 " + Q.rounded(_CLEAN),
    f"WITH {clean_sql()}, final AS (SELECT * FROM clean)",
)
def clean_table(spark, d):
    return clean_features(spark, d)


@query(
    "rows_before:int rows_after:int rows_dropped:int pct_dropped:6 target_mean:6 target_std:6 target_median:6 "
    "size_min:int size_median:4 size_max:int",
    f"""WITH {Q.installs()}, {Q.target()}, kept AS (SELECT * FROM target WHERE total_installs >= 30), final AS (
  SELECT (SELECT count(*) FROM target) AS rows_before, count(*) AS rows_after,
         (SELECT count(*) FROM target) - count(*) AS rows_dropped,
         ((SELECT count(*) FROM target) - count(*)) * 100.0 / (SELECT count(*) FROM target) AS pct_dropped,
         avg(organic_share) AS target_mean, stddev_samp(organic_share) AS target_std,
         quantile_cont(organic_share, 0.5) AS target_median, min(total_installs) AS size_min,
         quantile_cont(total_installs, 0.5) AS size_median, max(total_installs) AS size_max
  FROM kept)""",
)
def clean_report(spark, d):
    target = target_table(spark, d)
    return cleaning_report(target, cohorts.drop_small(target, 30))

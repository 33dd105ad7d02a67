"""SQL text of the star-schema sources, shared by the oracle queries."""

from __future__ import annotations

DAYS = range(8)


def installs(grain: str = "quarter") -> str:
    return f"""installs AS (
  SELECT o.o_orderkey AS match_id, CAST(date_trunc('{grain}', o.o_orderdate) AS DATE) AS install_date,
         CASE WHEN o.o_orderpriority < '3' THEN 'ios' ELSE 'android' END AS platform,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'organic' ELSE lower(c.c_mktsegment) END AS media_source,
         r.r_name AS country_code,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN NULL ELSE o.o_orderstatus END AS campaign,
         CAST(NULL AS VARCHAR) AS af_adset, CAST(NULL AS VARCHAR) AS af_ad, o.o_totalprice AS price,
         o.o_custkey AS custkey
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def events(grain: str = "quarter") -> str:
    return f"""event_rows AS (
  SELECT o.o_orderkey AS match_id, CAST(date_trunc('{grain}', o.o_orderdate) AS DATE) AS install_date,
         (l.l_linenumber * 3 + l.l_partkey) % 12 AS day, l.l_suppkey % 1440 AS minute,
         l.l_extendedprice AS amount, l.l_returnflag AS flag
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
events AS (
  SELECT match_id, install_date, day, amount, flag,
         CAST(install_date AS TIMESTAMP) + day * INTERVAL 1 DAY + minute * INTERVAL 1 MINUTE AS time
  FROM event_rows)"""


def costs() -> str:
    return """costs AS (
  SELECT install_date, platform, media_source, country_code, campaign, af_adset, af_ad,
         CASE WHEN media_source = 'organic' THEN 0.0
              ELSE ((CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) + 500) // 1000) / 100.0 END AS spend,
         count(*) AS installs, 20 * count(*) AS clicks,
         CASE WHEN campaign = 'P' THEN 0 ELSE 1000 * count(*) END AS impressions
  FROM installs GROUP BY install_date, platform, media_source, country_code, campaign, af_adset, af_ad)"""


def cost_ratios() -> str:
    return """ratios AS (
  SELECT install_date, platform, media_source, country_code, campaign, af_adset, af_ad, spend,
         installs AS installs_spend, clicks, impressions,
         spend / nullif(installs, 0) AS cpi, clicks / nullif(impressions, 0) AS ctr,
         installs / nullif(clicks, 0) AS cvr, spend * 1000 / nullif(impressions, 0) AS cpm
  FROM costs)"""


def cost_features() -> str:
    return """cost_features AS (
  SELECT i.match_id, i.install_date, r.spend, r.installs_spend, r.clicks, r.impressions, r.cpi, r.ctr, r.cvr, r.cpm
  FROM installs i LEFT JOIN ratios r ON i.install_date IS NOT DISTINCT FROM r.install_date
   AND i.platform IS NOT DISTINCT FROM r.platform AND i.media_source IS NOT DISTINCT FROM r.media_source
   AND i.country_code IS NOT DISTINCT FROM r.country_code AND i.campaign IS NOT DISTINCT FROM r.campaign
   AND i.af_adset IS NOT DISTINCT FROM r.af_adset AND i.af_ad IS NOT DISTINCT FROM r.af_ad)"""


def _day_sums(prefix: str) -> str:
    sums = [f"sum(CASE WHEN day = {d} THEN amount ELSE 0 END) AS {prefix}_{d}" for d in DAYS]
    counts = [f"count(*) FILTER (WHERE day = {d}) AS {prefix}_count_{d}" for d in DAYS]
    return ", ".join(sums + counts)


def _plus(prefix: str, days=DAYS) -> str:
    return "(" + " + ".join(f"{prefix}_{d}" for d in days) + ")"


def _positive(prefix: str) -> str:
    return "(" + " + ".join(f"CAST({prefix}_{d} > 0 AS INTEGER)" for d in DAYS) + ")"


def _minutes(later: str, earlier: str) -> str:
    return f"coalesce(date_diff('microsecond', {earlier}, {later}) / 6e7, 0)"


def iap_features(events_from: str = "SELECT * FROM events WHERE flag = 'R'", raw_rows: str = "1") -> str:
    """``iap_features`` over long events; ``raw_rows`` counts the raw rows behind a user."""
    check = ", ".join(f"iap_{d} / (iap_count_{d} + 1e-8) AS iap_check_size_{d}" for d in DAYS)
    avg03 = f"({_plus('iap', range(4))} / ({_plus('iap_count', range(4))} + 1e-8))"
    avg47 = f"({_plus('iap', range(4, 8))} / ({_plus('iap_count', range(4, 8))} + 1e-8))"
    return f"""iap_events AS ({events_from}),
iap_facts AS (
  SELECT match_id, install_date, {raw_rows} AS raw_rows, min(time) AS first_time, {_day_sums('iap')}
  FROM iap_events WHERE day BETWEEN 0 AND 360 GROUP BY match_id, install_date),
iap_ranked AS (
  SELECT match_id, install_date, time,
         row_number() OVER (PARTITION BY match_id, install_date ORDER BY time) AS rn
  FROM iap_events WHERE day BETWEEN 0 AND 7),
iap_later AS (
  SELECT match_id, install_date, max(time) FILTER (WHERE rn = 2) AS second_time,
         max(time) FILTER (WHERE rn = 3) AS third_time
  FROM iap_ranked GROUP BY match_id, install_date),
iap_derived AS (
  SELECT f.*, {check},
         {_minutes('f.first_time', 'CAST(f.install_date AS TIMESTAMP)')} AS time_to_first_iap_minutes,
         {_minutes('l.second_time', 'f.first_time')} AS time_first_and_second_iap_minutes,
         {_plus('iap')} AS iap_cum_learn, ln(1 + {_plus('iap')}) AS log1p_iap_cum_learn,
         {_positive('iap')} AS iap_days_with_purchase_learn,
         {_plus('iap_count')} AS iap_purchase_count_learn,
         coalesce({_plus('iap')} / nullif({_plus('iap_count')}, 0), 0) AS iap_avg_check_learn,
         iap_0 + iap_1 AS rev_d1_iap, {_plus('iap', range(4))} AS rev_d3_iap,
         {avg03} AS avg_check_d1_3_iap, {avg47} AS avg_check_d4_7_iap,
         {avg47} / ({avg03} + 1e-8) AS acceleration_iap,
         CAST({_plus('iap_count')} >= 2 AS INTEGER) AS has_second_iap,
         {_minutes('l.third_time', 'l.second_time')} AS time_between_iap_2_3
  FROM iap_facts f LEFT JOIN iap_later l ON f.match_id = l.match_id AND f.install_date = l.install_date),
iap_d1 AS (
  SELECT install_date, sum(rev_d1_iap / (iap_cum_learn + 1e-8) * raw_rows) / sum(raw_rows) AS d1_share_iap
  FROM iap_derived GROUP BY install_date),
iap_features AS (
  SELECT d.*, s.d1_share_iap FROM iap_derived d JOIN iap_d1 s ON d.install_date = s.install_date)"""


def ads_features() -> str:
    return f"""ads_facts AS (
  SELECT match_id, install_date, {_day_sums('ads')}
  FROM events WHERE flag = 'A' AND day BETWEEN 0 AND 360 GROUP BY match_id, install_date),
ads_features AS (
  SELECT *, {_plus('ads')} AS ads_cum_learn, ln(1 + {_plus('ads')}) AS log1p_ads_cum_learn,
         {_positive('ads')} AS ads_days_with_purchase_learn,
         {_plus('ads_count')} AS ads_purchase_count_learn,
         coalesce({_plus('ads')} / nullif({_plus('ads_count')}, 0), 0) AS ads_avg_check_learn,
         ads_0 + ads_1 AS ads_rev_d1, {_plus('ads', range(4))} AS ads_rev_d3
  FROM ads_facts)"""


def session_features() -> str:
    raw = ", ".join(f"nullif(count(*) FILTER (WHERE day = {d}), 0) AS raw_{d}" for d in DAYS)
    filled = ", ".join(f"coalesce(raw_{d}, 0) AS sessions_{d}" for d in range(7))
    slope = " + ".join(f"coalesce(raw_{d}, 0) * ({d} - 3.5)" for d in DAYS)
    last = " ".join(f"WHEN raw_{d} > 0 THEN {d + 1}" for d in reversed(DAYS))
    active = " + ".join(f"CAST(coalesce(raw_{d}, 0) > 0 AS INTEGER)" for d in range(7))
    return f"""session_raw AS (
  SELECT match_id, install_date, {raw}, count(*) FILTER (WHERE day BETWEEN 0 AND 7) AS n_sessions_total
  FROM events WHERE flag = 'N' GROUP BY match_id, install_date),
session_features AS (
  SELECT match_id, install_date, {filled}, raw_7 AS sessions_7, n_sessions_total,
         coalesce(raw_0, 0) + coalesce(raw_1, 0) AS sessions_d1,
         ({slope}) / 42.0 AS session_velocity_slope,
         CASE {last} ELSE 0 END AS last_active_day,
         greatest(7 - ({active}), 0) AS zero_session_days
  FROM session_raw)"""


# Columns of the merged user table that the cohort queries report.
SUMMED = (
    [f"{p}_{d}" for p in ("iap", "iap_count", "iap_check_size", "ads", "ads_count", "sessions") for d in DAYS]
    + ["iap_cum_learn", "log1p_iap_cum_learn", "iap_purchase_count_learn", "rev_d1_iap", "rev_d3_iap"]
    + ["ads_cum_learn", "log1p_ads_cum_learn", "ads_purchase_count_learn", "ads_rev_d1", "ads_rev_d3"]
    + ["spend", "installs_spend", "clicks", "impressions"]
)
AVERAGED = (
    ["iap_days_with_purchase_learn", "iap_avg_check_learn", "d1_share_iap", "has_second_iap"]
    + ["time_to_first_iap_minutes", "time_first_and_second_iap_minutes", "time_between_iap_2_3"]
    + ["ads_days_with_purchase_learn", "ads_avg_check_learn", "n_sessions_total", "sessions_d1"]
    + ["session_velocity_slope", "last_active_day", "zero_session_days", "cpi", "ctr", "cvr", "cpm"]
)

# Digits that keep exact halves out of the comparison (means of cents over a cohort).
_DIGITS = {"cpi": 9, "cpm": 9, "iap_avg_check_learn": "log", "ads_avg_check_learn": "log"}
_DIGITS |= {c: 6 for c in AVERAGED if c.endswith("minutes") or c == "time_between_iap_2_3"}


def rounded(columns) -> str:
    """Column list for ``pick``: sums to 3 digits, means to enough digits (or on a log scale) to avoid ties."""
    return " ".join(f"{c}:3" if c in SUMMED else f"{c}:{_DIGITS.get(c, 8)}" for c in columns)


def roll_up(keys: str, name: str = "cohorts") -> str:
    """Sources to cohorts: all user features joined to the installs and reduced on ``keys``."""
    sums = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in SUMMED)
    means = ", ".join(f"avg({c}) AS {c}" for c in AVERAGED)
    return f"""users AS (
  SELECT i.* EXCLUDE (price, custkey), iap.* EXCLUDE (match_id, install_date, raw_rows, first_time),
         ads.* EXCLUDE (match_id, install_date), ses.* EXCLUDE (match_id, install_date),
         cost.* EXCLUDE (match_id, install_date)
  FROM installs i
  LEFT JOIN iap_features iap ON i.match_id = iap.match_id AND i.install_date = iap.install_date
  LEFT JOIN ads_features ads ON i.match_id = ads.match_id AND i.install_date = ads.install_date
  LEFT JOIN session_features ses ON i.match_id = ses.match_id AND i.install_date = ses.install_date
  LEFT JOIN cost_features cost ON i.match_id = cost.match_id AND i.install_date = cost.install_date),
{name} AS (
  SELECT {keys}, count(*) AS cohort_size, count(DISTINCT install_date) AS n_calendar_days, {sums}, {means}
  FROM users GROUP BY {keys})"""


def all_sources(grain: str = "quarter") -> str:
    return ",\n".join(
        [
            installs(grain),
            events(grain),
            costs(),
            cost_ratios(),
            cost_features(),
            iap_features(),
            ads_features(),
            session_features(),
        ]
    )


def target(name: str = "target") -> str:
    return f"""{name} AS (
  SELECT platform, country_code, install_date, count(*) AS total_installs,
         count(*) FILTER (WHERE media_source = 'organic') AS organic_installs,
         count(*) FILTER (WHERE media_source = 'organic') / count(*) AS organic_share,
         CASE WHEN install_date < DATE '1995-01-01' THEN 'unused' WHEN install_date < DATE '2000-07-01' THEN 'train'
              WHEN install_date < DATE '2001-07-01' THEN 'test' ELSE 'unused' END AS split
  FROM installs GROUP BY platform, country_code, install_date)"""

"""Queries over the marketing panel: channels, spend, buckets, carry-over, attribution."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halocline.config import MixSettings
from halocline.functions import scalar as S
from halocline.operators import adstock as A
from halocline.operators import attribution as T
from halocline.operators import draws as D
from halocline.operators import metrics as X
from halocline.operators import panel as P
from halocline.operators.cohorts import install_counts
from halocline.plans import star_sql as Q
from halocline.plans.registry import query
from halocline.sources import star

WINDOW = {"date_from": star.TRAIN_START, "date_to": star.TEST_END}
# The paid sources of the star schema.
CHANNELS = ["automobile", "furniture", "household", "machinery"]
DAILY = f"{Q.installs('day')}, {Q.costs()}"
COUNTS = "organic_installs:int total_installs:int"
GEO_DAY = "platform country_code install_date"


def daily_costs(spark: SparkSession, d: str) -> DataFrame:
    return star.costs(spark, d, "day")


def daily_panel(spark: SparkSession, d: str, channels=CHANNELS, how: str = "left") -> DataFrame:
    counts = install_counts(star.installs(spark, d, "day"), P.GEO_DAY)
    return P.join_spend(counts, P.spend_wide(daily_costs(spark, d), channels), how)


def weekly_panel(spark: SparkSession, d: str, mix: MixSettings = MixSettings()) -> DataFrame:
    return P.build_panel(
        star.installs(spark, d, "day"), daily_costs(spark, d), mix=mix, channels=CHANNELS, stage=DataFrame.persist, **WINDOW
    )


def _spend_sums(channels) -> str:
    named = [f"coalesce(sum(spend) FILTER (WHERE media_source = '{c}'), 0) AS spend_{c}" for c in channels]
    listed = ", ".join(f"'{c}'" for c in channels)
    rest = f"coalesce(sum(spend) FILTER (WHERE media_source NOT IN ({listed})), 0) AS spend_other_paid"
    return ", ".join([*named, rest])


def _columns(channels) -> list[str]:
    return [f"spend_{c}" for c in [*channels, "other_paid"]]


def panel_sql(channels=CHANNELS, window: bool = True) -> str:
    """``daily`` panel relation."""
    cut = "WHERE i.install_date >= DATE '1995-01-01' AND i.install_date < DATE '2001-07-01'" if window else ""
    filled = ", ".join(f"coalesce(s.{c}, 0) AS {c}" for c in _columns(channels))
    return f"""{DAILY}, counts AS (
  SELECT platform, country_code, install_date, count(*) AS total_installs,
         count(*) FILTER (WHERE media_source = 'organic') AS organic_installs
  FROM installs GROUP BY platform, country_code, install_date),
spend AS (
  SELECT platform, country_code, install_date, {_spend_sums(channels)}
  FROM costs WHERE media_source <> 'organic' GROUP BY platform, country_code, install_date),
daily AS (
  SELECT i.*, {filled} FROM counts i LEFT JOIN spend s ON i.platform = s.platform
   AND i.country_code = s.country_code AND i.install_date = s.install_date {cut})"""


def weekly_sql(channels=CHANNELS) -> str:
    """``panel`` relation: seven-day buckets from the first date."""
    sums = ", ".join(f"sum({c}) AS {c}" for c in ["organic_installs", "total_installs", *_columns(channels)])
    return f"""{panel_sql(channels)}, anchor AS (SELECT min(install_date) AS a FROM daily),
bucketed AS (
  SELECT d.* EXCLUDE (install_date), a + CAST((date_diff('day', a, d.install_date) // 7) * 7 AS INTEGER) AS install_date
  FROM daily d, anchor),
panel AS (
  SELECT platform, country_code, install_date, {sums}, platform || '_' || country_code AS geo
  FROM bucketed GROUP BY platform, country_code, install_date)"""


SPEND4 = " ".join(f"{c}:2" for c in _columns(CHANNELS))


@query(
    "media_source total_spend:2",
    f"""WITH {DAILY}, final AS (
  SELECT media_source, sum(spend) AS total_spend FROM costs
  WHERE media_source <> 'organic' AND install_date >= DATE '1995-01-01' AND install_date < DATE '2001-07-01'
  GROUP BY media_source HAVING sum(spend) > 0)""",
)
def channel_spend(spark, d):
    return P.channel_totals(daily_costs(spark, d), star.TRAIN_START, star.TEST_END)


@query(
    "media_source total_spend:2",
    f"""WITH {DAILY}, final AS (
  SELECT media_source, sum(spend) AS total_spend FROM costs
  WHERE media_source <> 'organic' AND install_date >= DATE '1995-01-01' AND install_date < DATE '2001-07-01'
  GROUP BY media_source HAVING sum(spend) > 0 ORDER BY total_spend DESC, media_source LIMIT 2)""",
)
def top_channels(spark, d):
    return P.top_channels(daily_costs(spark, d), 2, star.TRAIN_START, star.TEST_END)


@query(
    f"{GEO_DAY} {COUNTS}",
    f"""WITH {Q.installs('day')}, final AS (
  SELECT platform, country_code, install_date, count(*) AS total_installs,
         count(*) FILTER (WHERE media_source = 'organic') AS organic_installs
  FROM installs GROUP BY platform, country_code, install_date)""",
)
def installs_daily(spark, d):
    return install_counts(star.installs(spark, d, "day"), P.GEO_DAY)


@query(
    f"{GEO_DAY} channel spend:2",
    f"""WITH {DAILY}, final AS (
  SELECT platform, country_code, install_date,
         CASE WHEN media_source IN ('household', 'machinery') THEN media_source ELSE 'other_paid' END AS channel,
         coalesce(sum(spend), 0) AS spend
  FROM costs WHERE media_source <> 'organic' GROUP BY ALL)""",
)
def spend_by_channel(spark, d):
    return P.spend_by_channel(daily_costs(spark, d), ["household", "machinery"])


@query(
    f"{GEO_DAY} spend_household:2 spend_machinery:2 spend_other_paid:2",
    f"""WITH {DAILY}, final AS (
  SELECT platform, country_code, install_date, {_spend_sums(['household', 'machinery'])}
  FROM costs WHERE media_source <> 'organic' GROUP BY platform, country_code, install_date)""",
)
def spend_wide(spark, d):
    """Channels found in the data: the two with most spend, the rest pooled."""
    return P.spend_wide(daily_costs(spark, d), ["household", "machinery"])


@query(f"{GEO_DAY} {COUNTS} {SPEND4}", f"WITH {panel_sql(window=False)}, final AS (SELECT * FROM daily)")
def panel_daily(spark, d):
    return daily_panel(spark, d)


@query(
    f"{GEO_DAY} {COUNTS} {SPEND4}",
    f"""WITH {panel_sql(window=False)}, final AS (
  SELECT coalesce(i.platform, s.platform) AS platform, coalesce(i.country_code, s.country_code) AS country_code,
         coalesce(i.install_date, s.install_date) AS install_date, coalesce(total_installs, 0) AS total_installs,
         coalesce(organic_installs, 0) AS organic_installs,
         {", ".join(f"coalesce(s.{c}, 0) AS {c}" for c in _columns(CHANNELS))}
  FROM (SELECT * FROM counts WHERE organic_installs > 0) i
  FULL OUTER JOIN spend s ON i.platform = s.platform AND i.country_code = s.country_code
   AND i.install_date = s.install_date)""",
)
def panel_outer(spark, d):
    """Keeps spend on days without (here: organic) installs."""
    counts = install_counts(star.installs(spark, d, "day"), P.GEO_DAY).filter("organic_installs > 0")
    return P.join_spend(counts, P.spend_wide(daily_costs(spark, d), CHANNELS), "full_outer")


@query(
    f"{GEO_DAY} {COUNTS}",
    f"""WITH {panel_sql()}, keep AS (
  SELECT country_code FROM daily GROUP BY country_code
  HAVING sum(total_installs) >= (SELECT sum(total_installs) / 5 FROM daily)),
final AS (SELECT * FROM daily WHERE country_code IN (SELECT country_code FROM keep))""",
)
def country_filter(spark, d):
    """Countries with at least a fifth of all installs, the threshold read from the data."""
    panel = daily_panel(spark, d).filter(P.in_window(F.col("install_date"), *WINDOW.values()))
    return P.keep_countries(panel, F.ceil(panel.agg(F.sum("total_installs")).scalar() / 5))


@query(
    "platform country_code geo_total:int",
    f"""WITH {panel_sql()}, final AS (
  SELECT platform, country_code, sum(total_installs) AS geo_total FROM daily
  GROUP BY platform, country_code ORDER BY geo_total DESC, platform, country_code LIMIT 3)""",
)
def top_geos(spark, d):
    panel = daily_panel(spark, d).filter(P.in_window(F.col("install_date"), *WINDOW.values()))
    return P.top_geos(panel, 3)


@query(
    f"{GEO_DAY} {COUNTS} {SPEND4} geo",
    f"WITH {weekly_sql()}, final AS (SELECT * FROM panel)",
)
def mmm_panel(spark, d):
    """Channels picked from the data, as the job does."""
    return P.build_panel(star.installs(spark, d, "day"), daily_costs(spark, d), stage=DataFrame.persist, **WINDOW)


@query(
    f"{GEO_DAY} {COUNTS} {SPEND4}",
    f"WITH {weekly_sql()}, final AS (SELECT * FROM panel)",
)
def cadence_rollup(spark, d):
    panel = daily_panel(spark, d).filter(P.in_window(F.col("install_date"), *WINDOW.values()))
    return P.bucket_days(panel, 7)


@query(
    f"{GEO_DAY} total_installs:int geo " + " ".join(f"dow_{i}:1" for i in range(7)),
    f"""WITH {panel_sql()}, final AS (
  SELECT *, platform || '_' || country_code AS geo,
  {", ".join(f"CASE WHEN isodow(install_date) = {i + 1} THEN 1.0 ELSE 0.0 END AS dow_{i}" for i in range(7))}
  FROM daily)""",
)
def weekday_dummies(spark, d):
    """The daily panel, which carries weekday controls."""
    return weekly_panel(spark, d, replace(MixSettings(), cadence_days=1))


@query(
    "install_date year_sin_1:6 year_cos_1:6 year_sin_2:6 year_cos_2:6",
    f"""WITH {Q.installs('day')}, final AS (
  SELECT DISTINCT install_date,
  {", ".join(f"{f}(2 * pi() * {k} * dayofyear(install_date) / 365.25) AS year_{f}_{k}" for k in (1, 2) for f in ("sin", "cos"))}
  FROM installs)""",
)
def yearly_terms(spark, d):
    days = star.installs(spark, d, "day").select("install_date").distinct()
    return days.withColumns(S.yearly_terms(F.col("install_date"), 2))


@query(
    "n_rows:int n_geos:int first_date last_date",
    f"""WITH {weekly_sql()}, final AS (
  SELECT count(*) AS n_rows, count(DISTINCT geo) AS n_geos, min(install_date) AS first_date,
         max(install_date) AS last_date FROM panel)""",
)
def panel_facts(spark, d):
    return P.panel_facts(weekly_panel(spark, d))


@query(
    "channel total_spend:2",
    f"""WITH {weekly_sql()}, final AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS channel, sum({c}) AS total_spend FROM panel" for c in _columns(CHANNELS))})""",
)
def spend_per_channel(spark, d):
    return P.spend_totals(weekly_panel(spark, d))


@query(
    "platform country_code",
    f"WITH {Q.installs('day')}, final AS (SELECT DISTINCT platform, country_code FROM installs)",
)
def distinct_geos(spark, d):
    return star.installs(spark, d, "day").select("platform", "country_code").distinct()


DECAY, L_MAX, SHAPE = 0.5, 4, 2.0


def completed_sql() -> str:
    """``filled`` relation: every geo with every bucket, zero spend where it had none."""
    cols = ", ".join(f"coalesce(p.{c}, 0) AS {c}" for c in _columns(CHANNELS))
    return f"""{weekly_sql()}, span AS (SELECT min(install_date) AS lo, max(install_date) AS hi FROM panel),
calendar AS (
  SELECT geo, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE)
         AS install_date
  FROM (SELECT DISTINCT geo FROM panel), span),
filled AS (
  SELECT c.geo, c.install_date, p.geo IS NOT NULL AS observed, p.organic_installs, p.total_installs, {cols}
  FROM calendar c LEFT JOIN panel p ON c.geo = p.geo AND c.install_date = p.install_date)"""


def _adstock_sql(column: str, total: float = 1.0) -> str:
    terms = [f"{column} * {1.0 / total!r}::DOUBLE"]
    terms += [
        f"coalesce(lag({column}, {k}) OVER (PARTITION BY geo ORDER BY install_date), 0) * {DECAY ** k / total!r}::DOUBLE"
        for k in range(1, L_MAX)
    ]
    return " + ".join(terms)


@query(
    "geo install_date observed " + " ".join(f"{c}:6" for c in _columns(CHANNELS)),
    f"""WITH {completed_sql()}, final AS (
  SELECT geo, install_date, observed, {", ".join(f"{_adstock_sql(c)} AS {c}" for c in _columns(CHANNELS))}
  FROM filled)""",
)
def adstock(spark, d):
    columns = _columns(CHANNELS)
    full = A.complete_buckets(weekly_panel(spark, d), columns, 7)
    return A.adstock_columns(full, columns, DECAY, L_MAX)


_TOTAL = sum(DECAY**k for k in range(L_MAX))


@query(
    "geo install_date observed " + " ".join(f"{c}:6" for c in _columns(CHANNELS)),
    f"""WITH {completed_sql()}, final AS (
  SELECT geo, install_date, observed, {", ".join(f"{_adstock_sql(c, _TOTAL)} AS {c}" for c in _columns(CHANNELS))}
  FROM filled)""",
)
def adstock_normalised(spark, d):
    """Weights that sum to 1, the form that the model uses."""
    columns = _columns(CHANNELS)
    full = A.complete_buckets(weekly_panel(spark, d).persist(), columns, 7)
    return A.adstock_columns(full, columns, DECAY, L_MAX, normalize=True)


@query(
    f"{GEO_DAY} geo {COUNTS}",
    f"""WITH {weekly_sql()}, best AS (
  SELECT platform, country_code, sum(total_installs) AS n FROM panel GROUP BY platform, country_code
  ORDER BY n DESC, platform, country_code LIMIT 3),
final AS (SELECT p.* FROM panel p JOIN best b ON p.platform = b.platform AND p.country_code = b.country_code)""",
)
def top_geo_panel(spark, d):
    """The panel cut to its three largest geos."""
    return P.keep_top_geos(weekly_panel(spark, d).persist(), 3)


@query(
    "geo install_date place:int",
    f"""WITH {weekly_sql()}, final AS (
  SELECT geo, install_date, row_number() OVER (PARTITION BY geo ORDER BY install_date) AS place FROM panel)""",
)
def panel_order(spark, d):
    """Rows as the sink would write them: the place of each in its geo, by the order of partitions and rows."""
    ordered = P.ordered(weekly_panel(spark, d).persist()).withColumn("_at", F.monotonically_increasing_id())
    return ordered.withColumn("place", F.row_number().over(Window.partitionBy("geo").orderBy("_at")))


@query(
    "geo install_date logistic:6 michaelis_menten:6 hill:6",
    f"""WITH {weekly_sql()}, final AS (
  SELECT geo, install_date, (1 - exp(-2 * x)) / (1 + exp(-2 * x)) AS logistic, x / (2 + x) AS michaelis_menten,
         x * x / (4 + x * x) AS hill
  FROM (SELECT geo, install_date, spend_machinery / 1000.0 AS x FROM panel))""",
)
def saturation(spark, d):
    x = F.col("spend_machinery") / 1000.0
    curves = {k: S.saturate(k, x, SHAPE) for k in ("logistic", "michaelis_menten", "hill")}
    return weekly_panel(spark, d).withColumns(curves)


# Fixed coefficients, so that SQL can follow the attribution step by step.
INTERCEPT = 0.4
EFFECTS = {"spend_automobile": 0.3, "spend_furniture": 0.1, "spend_household": 0.2, "spend_machinery": 0.5,
           "spend_other_paid": 0.05}


def _split(panel: DataFrame, test: bool) -> DataFrame:
    cut = F.col("install_date") >= F.lit(star.TEST_START).cast("date")
    return panel.filter(cut if test else ~cut)


def fixed_contributions(panel: DataFrame) -> DataFrame:
    """Contributions of a model with the fixed coefficients: carry-over, curve, effect."""
    full = A.complete_buckets(panel, list(EFFECTS), 7)
    window = Window.partitionBy("geo").orderBy("install_date")
    carried = full.withColumns(
        {c: A.adstock(F.col(c) / 1000.0, window, DECAY, L_MAX) for c in EFFECTS}
    ).filter("observed")
    rows = [F.struct(F.lit("intercept").alias("part"), F.lit(INTERCEPT).alias("contribution"))]
    rows += [
        F.struct(F.lit(c).alias("part"), (S.saturate("logistic", F.col(c), SHAPE) * b).alias("contribution"))
        for c, b in EFFECTS.items()
    ]
    return carried.select("geo", "install_date", F.inline(F.array(*rows)))


def _channels_only(parts: DataFrame) -> DataFrame:
    return parts.filter(F.col("part") != "intercept").withColumnRenamed("part", "channel")


def fixed_attribution(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    panel = weekly_panel(spark, d).persist()
    parts = fixed_contributions(panel)
    scale = T.geo_scale(panel, T.predictions_from_contributions(parts))
    return T.attribute(_channels_only(parts), scale, panel), panel


def _attribution_sql() -> str:
    carried = ", ".join(
        f"({_adstock_sql(c)}) / 1000.0 AS {c}" for c in EFFECTS
    )
    curves = " UNION ALL ".join(
        f"SELECT geo, install_date, '{c}' AS channel, {b} * (1 - exp(-2 * {c})) / (1 + exp(-2 * {c})) AS contribution "
        f"FROM carried WHERE observed"
        for c, b in EFFECTS.items()
    )
    return f"""{completed_sql()}, carried AS (SELECT geo, install_date, observed, {carried} FROM filled),
contributions AS ({curves}),
predicted AS (
  SELECT geo, install_date, {INTERCEPT} + sum(contribution) AS pred_scaled
  FROM contributions GROUP BY geo, install_date)"""


def _scaled_sql() -> str:
    spend = " UNION ALL ".join(f"SELECT geo, install_date, '{c}' AS channel, {c} AS spend FROM panel" for c in EFFECTS)
    return f"""{_attribution_sql()}, scale AS (
  SELECT p.geo, sum(p.organic_installs) / greatest(sum(q.pred_scaled), 1e-9) AS scale
  FROM panel p JOIN predicted q ON p.geo = q.geo AND p.install_date = q.install_date GROUP BY p.geo),
spend_long AS ({spend}),
attribution AS (
  SELECT c.install_date, c.geo, c.channel, c.contribution * s.scale AS halo_organic, x.spend
  FROM contributions c LEFT JOIN scale s ON c.geo = s.geo LEFT JOIN spend_long x
    ON c.geo = x.geo AND c.install_date = x.install_date AND c.channel = x.channel)"""


@query(
    "geo install_date pred_scaled:6",
    f"WITH {_attribution_sql()}, final AS (SELECT * FROM predicted)",
)
def contribution_totals(spark, d):
    return T.predictions_from_contributions(fixed_contributions(weekly_panel(spark, d)))


@query("geo scale:6", f"WITH {_scaled_sql()}, final AS (SELECT * FROM scale)")
def geo_scale(spark, d):
    panel = weekly_panel(spark, d).persist()
    return T.geo_scale(panel, T.predictions_from_contributions(fixed_contributions(panel)))


@query(
    "n_geos:int mean:6 std:6 min:6 max:6",
    f"""WITH {_scaled_sql()}, final AS (
  SELECT count(*) AS n_geos, avg(scale) AS mean, stddev_samp(scale) AS std, min(scale) AS min, max(scale) AS max
  FROM scale)""",
)
def scale_overview(spark, d):
    return T.scale_overview(geo_scale(spark, d))


@query(
    "install_date geo channel halo_organic:6 spend:2",
    f"WITH {_scaled_sql()}, final AS (SELECT * FROM attribution)",
)
def halo_long(spark, d):
    return fixed_attribution(spark, d)[0]


@query(
    "install_date geo channel spend:2",
    f"WITH {_scaled_sql()}, final AS (SELECT * FROM spend_long)",
)
def spend_long(spark, d):
    return P.spend_long(weekly_panel(spark, d))


_SUMMARY = """summary AS (
  SELECT channel, sum(halo_organic) AS halo_total, sum(spend) AS spend_total,
         sum(halo_organic) / (SELECT sum(organic_installs) FROM panel) AS share_of_total_organic,
         sum(halo_organic) / nullif(sum(spend) / 1000.0, 0) AS halo_per_1k_spend
  FROM attribution GROUP BY channel)"""


@query(
    "channel halo_total:4 spend_total:2 share_of_total_organic:6 halo_per_1k_spend:6",
    f"WITH {_scaled_sql()}, {_SUMMARY}, final AS (SELECT * FROM summary)",
)
def channel_summary(spark, d):
    return T.channel_summary(*fixed_attribution(spark, d))


@query(
    "observed:2 halo:4 baseline:4 halo_share:6",
    f"""WITH {_scaled_sql()}, totals AS (
  SELECT (SELECT sum(organic_installs) FROM panel) AS observed, sum(halo_organic) AS halo FROM attribution),
final AS (SELECT observed, halo, observed - halo AS baseline, halo / observed AS halo_share FROM totals)""",
)
def halo_totals(spark, d):
    return T.halo_totals(*fixed_attribution(spark, d))


@query(
    "install_date " + " ".join(f"{c}:6" for c in EFFECTS),
    f"""WITH {_scaled_sql()}, final AS (
  SELECT install_date,
  {", ".join(f"coalesce(sum(halo_organic) FILTER (WHERE channel = '{c}'), 0) AS {c}" for c in EFFECTS)}
  FROM attribution GROUP BY install_date)""",
)
def halo_over_time(spark, d):
    return T.halo_over_time(fixed_attribution(spark, d)[0], list(EFFECTS))


@query(
    "place:int channel",
    f"""WITH {_scaled_sql()}, {_SUMMARY}, final AS (
  SELECT row_number() OVER (ORDER BY halo_total DESC, channel) - 1 AS place, channel FROM summary)""",
)
def halo_order(spark, d):
    """Channels in the order of their columns over time, largest halo first."""
    names = T.channels_by_halo(fixed_attribution(spark, d)[0])
    return spark.createDataFrame(list(enumerate(names)), "place int, channel string")


@query(
    "geo install_date organic:6 paid_induced:6 true_organic:6",
    f"""WITH {_scaled_sql()}, halo AS (
  SELECT geo, install_date, sum(halo_organic) AS paid_induced FROM attribution GROUP BY geo, install_date),
final AS (
  SELECT p.geo, p.install_date, CAST(organic_installs AS DOUBLE) AS organic, paid_induced,
         organic_installs - paid_induced AS true_organic
  FROM panel p LEFT JOIN halo h ON p.geo = h.geo AND p.install_date = h.install_date)""",
)
def true_organic(spark, d):
    attribution, panel = fixed_attribution(spark, d)
    shares = panel.select(
        "geo", "install_date", (F.col("organic_installs") / F.col("total_installs")).alias("organic_share"),
        "total_installs",
    )
    return T.true_organic(shares, attribution)


@query(
    "check_name violations:int passed",
    f"""WITH {_scaled_sql()}, {_SUMMARY}, points AS (
  SELECT channel, i / 10.0 AS x, (1 - exp(-2 * i / 10.0)) / (1 + exp(-2 * i / 10.0)) AS y
  FROM summary, range(21) AS r(i)),
steps AS (SELECT y - lag(y) OVER (PARTITION BY channel ORDER BY x) AS step FROM points),
counted AS (
  SELECT 'halo_bounded' AS check_name, count(*) FILTER (WHERE halo_per_1k_spend > 1000) AS violations FROM summary
  UNION ALL SELECT 'decay_in_unit_range', count(*) FILTER (WHERE NOT {DECAY} BETWEEN 0 AND 1) FROM summary
  UNION ALL SELECT 'saturation_monotone', count(*) FILTER (WHERE step < 0) FROM steps),
final AS (SELECT check_name, violations, violations = 0 AS passed FROM counted)""",
)
def attribution_checks(spark, d):
    attribution, panel = fixed_attribution(spark, d)
    summary = T.channel_summary(attribution, panel)
    decays = summary.select(F.lit(DECAY).alias("decay"))
    points = F.explode(F.array(*[F.lit(i / 10.0) for i in range(21)]))
    curve = summary.select("channel", points.alias("x")).withColumn("y", S.saturate("logistic", F.col("x"), SHAPE))
    return T.attribution_checks(summary, 1000.0, decays, curve)


def _test_predictions_sql() -> str:
    return f"""{_attribution_sql()}, train_scale AS (
  SELECT p.geo, sum(p.organic_installs) / greatest(sum(q.pred_scaled), 1e-9) AS scale
  FROM panel p JOIN predicted q ON p.geo = q.geo AND p.install_date = q.install_date
  WHERE p.install_date < DATE '2000-07-01' GROUP BY p.geo),
tested AS (
  SELECT p.geo, p.install_date, p.organic_installs, p.total_installs,
         q.pred_scaled * coalesce(s.scale, 1.0) AS pred,
         abs(p.organic_installs - q.pred_scaled * coalesce(s.scale, 1.0)) AS abs_err
  FROM panel p JOIN predicted q ON p.geo = q.geo AND p.install_date = q.install_date
  LEFT JOIN train_scale s ON p.geo = s.geo WHERE p.install_date >= DATE '2000-07-01')"""


def test_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Fixed model on the test weeks: carry-over warmed up on train, calibrated per geo on train."""
    panel = weekly_panel(spark, d).persist()
    train, test = _split(panel, False), _split(panel, True)
    both = A.with_warmup(train, test).drop("is_test")
    predicted = T.predictions_from_contributions(fixed_contributions(both))
    scale = T.geo_scale(train, predicted)
    matched = T.match_test(test, T.calibrated(predicted, scale))
    return X.with_errors(matched, "organic_installs", "pred")


@query(
    "geo install_date organic_installs:int total_installs:int pred:6 abs_err:6",
    f"WITH {_test_predictions_sql()}, final AS (SELECT * FROM tested)",
)
def mmm_test_predictions(spark, d):
    return test_predictions(spark, d)


@query(
    "n:int rmse_w:6 mae_w:6 r2_w:6 wmape:6 rmse_u:6 mae_u:6",
    f"""WITH {_test_predictions_sql()}, centre AS (
  SELECT sum(total_installs * organic_installs) / sum(total_installs) AS m FROM tested), final AS (
  SELECT count(*) AS n, sqrt(sum(total_installs * abs_err * abs_err) / sum(total_installs)) AS rmse_w,
         sum(total_installs * abs_err) / sum(total_installs) AS mae_w,
         1 - sum(total_installs * abs_err * abs_err) / sum(total_installs * (organic_installs - m) ** 2) AS r2_w,
         sum(total_installs * abs_err) / sum(total_installs * organic_installs) AS wmape,
         sqrt(avg(abs_err * abs_err)) AS rmse_u, avg(abs_err) AS mae_u
  FROM tested, centre)""",
)
def mmm_test_metrics(spark, d):
    return X.regression_report(test_predictions(spark, d), "organic_installs", "pred", "total_installs")


@query(
    "platform country_code country_pooled n:int",
    f"""WITH {Q.installs('day')}, counted AS (SELECT country_code, count(*) AS n FROM installs GROUP BY country_code),
final AS (
  SELECT i.platform, CASE WHEN c.n >= (SELECT max(n) FROM counted) THEN i.country_code ELSE 'country_other' END
         AS country_pooled, i.country_code, count(*) AS n
  FROM installs i JOIN counted c ON i.country_code = c.country_code GROUP BY ALL)""",
)
def pool_countries(spark, d):
    """All but the largest country pooled, the threshold read from the data."""
    rows = star.installs(spark, d, "day").select("platform", "country_code")
    largest = rows.groupBy("country_code").count().agg(F.max("count")).scalar()
    pooled = T.pool_rare(
        rows.withColumn("country_pooled", F.col("country_code")), "country_pooled", largest, "country_other"
    )
    return pooled.groupBy("platform", "country_code", "country_pooled").agg(F.count(F.lit(1)).alias("n"))


# The weekly series of a geo stands in for draws: even and odd years as two chains.
_SERIES = f"""{weekly_sql()}, series AS (
  SELECT year(install_date) % 2 AS chain, date_diff('day', DATE '1995-01-01', install_date) AS draw, geo AS param,
         CAST(total_installs AS DOUBLE) AS value FROM panel)"""


def series_draws(spark: SparkSession, d: str) -> DataFrame:
    return weekly_panel(spark, d).select(
        (F.year("install_date") % 2).alias("chain"),
        F.datediff("install_date", F.lit("1995-01-01").cast("date")).alias("draw"),
        F.col("geo").alias("param"),
        F.col("total_installs").cast("double").alias("value"),
    )


@query(
    "param mean:6 sd:6 hdi_lo:4 hdi_hi:4",
    f"""WITH {_SERIES}, ranked AS (
  SELECT param, value, row_number() OVER (PARTITION BY param ORDER BY value) AS r,
         CAST(floor(0.94 * count(*) OVER (PARTITION BY param)) AS BIGINT) AS steps FROM series),
spans AS (
  SELECT a.param, a.value AS lo, b.value AS hi,
         row_number() OVER (PARTITION BY a.param ORDER BY b.value - a.value, a.r) AS pick
  FROM ranked a JOIN ranked b ON a.param = b.param AND b.r = a.r + a.steps),
stats AS (SELECT param, avg(value) AS mean, stddev_pop(value) AS sd FROM series GROUP BY param),
final AS (
  SELECT s.param, mean, sd, lo AS hdi_lo, hi AS hdi_hi FROM stats s JOIN spans x ON s.param = x.param WHERE pick = 1)""",
)
def posterior_summary(spark, d):
    return D.summary(series_draws(spark, d))


@query(
    "param rhat:6",
    f"""WITH {_SERIES}, halves AS (
  SELECT *, CASE WHEN draw < floor((max(draw) OVER (PARTITION BY param, chain) + 1) / 2) THEN 0 ELSE 1 END AS half
  FROM series),
parts AS (
  SELECT param, chain, half, avg(value) AS m, var_samp(value) AS v, count(*) AS n
  FROM halves GROUP BY param, chain, half),
final AS (
  SELECT param, sqrt(((min(n) - 1) / min(n) * avg(v) + var_samp(m)) / avg(v)) AS rhat FROM parts GROUP BY param)""",
)
def split_rhat(spark, d):
    return D.split_rhat(series_draws(spark, d))


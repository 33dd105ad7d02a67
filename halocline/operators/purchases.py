"""User features from purchase and ad-revenue events.

Input is either the raw source, one row per user with two parallel lists, or
long events. Every aggregate combines map-side, and the second and third
purchase come from a ranking with a group limit that also runs before the
shuffle, so no key is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from halocline.config import USER_KEYS, Settings
from halocline.functions import scalar as S
from halocline.operators.keys import first_per_key, lookup_join

# List columns of the raw sources, unused once exploded.
IAP_LISTS = ("purchase_time_list", "purchase_iap_list")
ADS_LISTS = ("purchase_date_list", "purchase_ads_list")
DROPPED = ("country_code_list", "purchase_iap_content_id_list", "next_install_date", "purchase_usd_raw_list")

RANKED_PURCHASES = 3


def explode_lists(raw: DataFrame, time_list: str, amount_list: str, keys: Sequence[str] = USER_KEYS) -> DataFrame:
    """Long events ``(keys, time, amount)`` from two parallel lists; unequal lengths raise."""
    length = [F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(1)) for c in (time_list, amount_list)]
    zipped = F.when(length[0] == length[1], F.arrays_zip(F.col(time_list).alias("t"), F.col(amount_list).alias("a")))
    checked = zipped.otherwise(F.raise_error(F.lit(f"{time_list} and {amount_list} differ in length")))
    pairs = raw.select(*keys, F.explode(checked).alias("_pair"))
    names = pairs.schema["_pair"].dataType.names
    return pairs.select(
        *keys, F.col("_pair")[names[0]].alias("time"), F.col("_pair")[names[1]].cast("double").alias("amount")
    )


def earliest_times(
    raw: DataFrame, time_list: str, learn_days: int, keys: Sequence[str] = USER_KEYS, k: int = RANKED_PURCHASES
) -> DataFrame:
    """The ``k`` earliest in-window times of every raw row, cut inside the row before any exploding."""
    in_window = F.filter(time_list, lambda t: S.day_offset(t, F.col("install_date")).between(0, learn_days))
    return raw.select(*keys, F.explode(F.slice(F.array_sort(in_window), 1, k)).alias("time"))


def with_day(events: DataFrame) -> DataFrame:
    if "day" in events.columns:
        return events
    return events.withColumn("day", S.day_offset(F.col("time"), F.col("install_date")))


def daily_totals(events: DataFrame, max_day: int, keys: Sequence[str] = USER_KEYS) -> DataFrame:
    """Amount and number of events per user and day, days ``0..max_day``."""
    return (
        with_day(events)
        .filter(F.col("day").between(0, max_day))
        .groupBy(*keys, "day")
        .agg(S.zero_if_null(F.sum("amount")).alias("amount"), F.count(F.lit(1)).alias("n_events"))
    )


def nth_times(events: DataFrame, learn_days: int, keys: Sequence[str] = USER_KEYS) -> DataFrame:
    """Times of the second and third learn-window event per user.

    ``rank <= 3`` lets the planner place a group limit below the shuffle: a task
    ships at most three rows per user whatever the user's volume.
    """
    order = Window.partitionBy(*keys).orderBy("time")
    ranked = (
        with_day(events)
        .filter(F.col("day").between(0, learn_days))
        .select(*keys, "time")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= RANKED_PURCHASES)
    )
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_rank") == 2, F.col("time"))).alias("second_time"),
        F.max(F.when(F.col("_rank") == 3, F.col("time"))).alias("third_time"),
    )


def day_columns(
    events: DataFrame, prefix: str, last_day: int, settings: Settings, keys: Sequence[str] = USER_KEYS
) -> DataFrame:
    """``<prefix>_d``, ``<prefix>_count_d`` and the first event time, in one aggregate.

    A user with any event in ``0..max_event_day`` gets zeros on idle days; a user
    without one does not appear here and keeps nulls after the left join.
    """
    aggs = [F.min("time").alias("first_time")]
    for d in range(max(last_day, settings.learn_days) + 1):
        aggs.append(F.expr(f"coalesce(sum(amount) filter (where day = {d}), 0.0D) as {prefix}_{d}"))
        aggs.append(F.expr(f"count(case when day = {d} then 1 end) as {prefix}_count_{d}"))
    in_range = F.col("day").between(0, settings.max_event_day)
    return with_day(events).filter(in_range).groupBy(*keys).agg(*aggs)


def user_rows(raw: DataFrame, keys: Sequence[str] = USER_KEYS, drop: Sequence[str] = ()) -> DataFrame:
    """One row per user: pass-through columns of the first raw row, and the number of raw rows."""
    passed = [c for c in raw.columns if c not in keys and c not in drop]
    aggs = [F.count(F.lit(1)).alias("_raw_rows")]
    if passed:
        aggs.append(F.min(F.struct(*passed)).alias("_first"))
    grouped = raw.groupBy(*keys).agg(*aggs)
    return grouped.select(*keys, *[F.col(f"_first.`{c}`").alias(c) for c in passed], "_raw_rows")


def _names(prefix: str, days) -> list[str]:
    return [f"{prefix}_{d}" for d in days]


def mean_per_date(
    users: DataFrame, ratio: Column, name: str, weight: Column, alive: Sequence[str] = ()
) -> DataFrame:
    """Mean of a user ratio per install date, put back on the users.

    Dates are bounded by the calendar (under 4 million values), so the table of
    means is broadcast; a timestamp column has no such bound and joins by shuffle, where the
    users of a hot date are spread over several tasks.
    Naming the columns of an aggregate below in ``alive`` (counts, so a filter on
    them holds) stops their pruning: both readers then share that aggregate's exchange.
    """
    rows = users
    for c in alive:
        rows = rows.filter(F.coalesce(F.col(c), F.lit(0)) >= 0)
    means = rows.groupBy("install_date").agg(
        (F.sum(ratio * weight) / F.sum(F.when(ratio.isNotNull(), weight))).alias(name)
    )
    if not isinstance(users.schema["install_date"].dataType, T.DateType):
        spread = [c for c in users.columns if c != "install_date"][:1] or ["install_date"]
        found = lookup_join(users, means, ["install_date"], spread_by=spread)
        return found.withColumn(name, F.when(F.col("install_date").isNotNull(), F.col(name)))
    means = F.broadcast(means)
    # null-safe, since a plain join would push "date is not null" into one reader's scan only
    same_date = F.col("u.install_date").eqNullSafe(F.col("m.install_date"))
    joined = users.alias("u").join(means.alias("m"), same_date, "left")
    mean = F.when(F.col("u.install_date").isNotNull(), F.col(f"m.{name}"))
    return joined.select("u.*", mean.alias(name))


def _attach(users: DataFrame | None, facts: DataFrame) -> tuple[DataFrame, list[str]]:
    """Facts on every raw user (left join on the shared key partitioning), or the facts alone."""
    if users is None:
        return facts.withColumn("_raw_rows", F.lit(1).cast("bigint")), []
    base = user_rows(users)
    passed = [c for c in base.columns if c not in USER_KEYS and c != "_raw_rows"]
    return base.join(facts, list(USER_KEYS), "left"), passed


def iap_features(
    users: DataFrame | None,
    events: DataFrame,
    settings: Settings = Settings(),
    ranked_from: DataFrame | None = None,
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """In-app purchase features at user grain.

    ``users`` holds every raw user row, ``events`` the long events; without
    ``users`` only users with events come out. ``ranked_from`` may narrow the events
    that the second and third purchase are looked up in. The mean per install date
    reads the user rows a second time: ``stage`` may save them in between (see
    ``sources.sinks.staged``), else both readers share the exchange of the day sums.
    """
    learn = range(settings.learn_days + 1)
    last_day = settings.horizon if settings.predict_target == "iap" else settings.learn_days
    shown = range(last_day + 1)
    horizon = range(settings.horizon + 1)

    joined, passed = _attach(users, day_columns(events, "iap", last_day, settings))
    later = nth_times(ranked_from if ranked_from is not None else events, settings.learn_days)
    joined = joined.join(later, list(USER_KEYS), "left")

    start = F.col("install_date").cast("timestamp_ntz")
    cum = S.row_sum(_names("iap", learn))
    count = S.row_sum(_names("iap_count", learn)).cast("bigint")

    def window_check(days) -> str:
        days = [d for d in days if d in learn]
        amount, number = S.row_sum_sql(_names("iap", days)), S.row_sum_sql(_names("iap_count", days))
        return f"({amount} / ({number} + {S.RATIO_EPS}D))"

    early, late = window_check(range(0, 4)), window_check(range(4, 8))
    derived = joined.select(
        *USER_KEYS,
        *passed,
        "_raw_rows",
        *_names("iap", shown),
        *_names("iap_count", shown),
        *[F.expr(f"iap_{d} / (iap_count_{d} + {S.RATIO_EPS}D) as iap_check_size_{d}") for d in shown],
        S.zero_if_null(S.minutes_between(F.col("first_time"), start)).alias("time_to_first_iap_minutes"),
        S.zero_if_null(S.minutes_between(F.col("second_time"), F.col("first_time"))).alias(
            "time_first_and_second_iap_minutes"
        ),
        cum.alias("iap_cum_learn"),
        F.log1p(cum).alias("log1p_iap_cum_learn"),
        S.row_count_positive(_names("iap", learn)).alias("iap_days_with_purchase_learn"),
        count.alias("iap_purchase_count_learn"),
        S.zero_if_null(S.safe_ratio(cum, count)).alias("iap_avg_check_learn"),
        S.row_sum(_names("iap", [d for d in range(2) if d in horizon])).alias("rev_d1_iap"),
        S.row_sum(_names("iap", [d for d in range(4) if d in horizon])).alias("rev_d3_iap"),
        F.expr(f"{early} as avg_check_d1_3_iap"),
        F.expr(f"{late} as avg_check_d4_7_iap"),
        F.expr(f"{late} / ({early} + {S.RATIO_EPS}D) as acceleration_iap"),
        (count >= 2).cast("bigint").alias("has_second_iap"),
        S.zero_if_null(S.minutes_between(F.col("third_time"), F.col("second_time"))).alias("time_between_iap_2_3"),
    )
    if stage is not None:
        derived = stage(derived)
    share = S.eps_ratio(F.col("rev_d1_iap"), F.col("iap_cum_learn"))
    alive = [] if stage is not None else [*_names("iap_count", shown), "time_to_first_iap_minutes"]
    out = mean_per_date(derived, share, "d1_share_iap", F.col("_raw_rows"), alive)
    return out.select(*[c for c in derived.columns if c != "_raw_rows"], "d1_share_iap")


def ads_features(users: DataFrame | None, events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Ad-revenue features at user grain; without ``users`` only users with events come out."""
    learn = range(settings.learn_days + 1)
    last_day = settings.horizon if settings.predict_target == "ads" else settings.learn_days
    horizon = range(settings.horizon + 1)

    joined, passed = _attach(users, day_columns(events, "ads", last_day, settings))
    cum = S.row_sum(_names("ads", learn))
    count = S.row_sum(_names("ads_count", learn)).cast("bigint")
    return joined.select(
        *USER_KEYS,
        *passed,
        *_names("ads", range(last_day + 1)),
        *_names("ads_count", learn),
        cum.alias("ads_cum_learn"),
        F.log1p(cum).alias("log1p_ads_cum_learn"),
        S.row_count_positive(_names("ads", learn)).alias("ads_days_with_purchase_learn"),
        count.alias("ads_purchase_count_learn"),
        S.zero_if_null(S.safe_ratio(cum, count)).alias("ads_avg_check_learn"),
        S.row_sum(_names("ads", [d for d in range(2) if d in horizon])).alias("ads_rev_d1"),
        S.row_sum(_names("ads", [d for d in range(4) if d in horizon])).alias("ads_rev_d3"),
    )


def build_iap(
    raw: DataFrame,
    settings: Settings = Settings(),
    dedupe_first: bool = False,
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """IAP features from the raw list source. Lists of repeated keys are pooled unless ``dedupe_first``."""
    if dedupe_first:
        raw = first_per_key(raw, USER_KEYS)
    time_list, amount_list = IAP_LISTS
    return iap_features(
        raw.drop(*IAP_LISTS, *DROPPED),
        explode_lists(raw, time_list, amount_list),
        settings,
        ranked_from=earliest_times(raw, time_list, settings.learn_days),
        stage=stage,
    )


def build_ads(raw: DataFrame, settings: Settings = Settings(), dedupe_first: bool = False) -> DataFrame:
    """Ads features from the raw list source."""
    if dedupe_first:
        raw = first_per_key(raw, USER_KEYS)
    return ads_features(
        raw.drop(*ADS_LISTS, "next_install_date"), explode_lists(raw, *ADS_LISTS), settings
    )

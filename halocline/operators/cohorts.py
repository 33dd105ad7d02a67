"""From users to cohorts: roll-up by name policy, target, split, cleaning."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.config import ORGANIC, Settings
from halocline.functions.policy import cohort_aggregate
from halocline.operators.keys import null_safe_match, without_collisions

log = logging.getLogger(__name__)

SIZE_COLUMN = "total_installs"


def _require(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{what} missing: {missing}")


def roll_up(users: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Users to cohorts: numeric columns summed or averaged by name, the rest dropped.

    A sum over nothing but nulls is 0, a mean is null. ``columns`` limits the
    output to what is needed, and with it what the joins below have to carry.
    All aggregates combine map-side, so one cohort may hold most users.
    """
    _require(users, keys, "Cohort keys")
    aggs = [F.count(F.lit(1)).alias("cohort_size")]
    if "install_date" in keys:
        aggs.append(F.lit(1).cast("bigint").alias("n_calendar_days"))
    elif "install_date" in users.columns:
        has_null = F.max(F.when(F.col("install_date").isNull(), 1).otherwise(0))
        aggs.append((F.count_distinct("install_date") + has_null).alias("n_calendar_days"))
    for f in users.schema.fields:
        kind = cohort_aggregate(f.name, f.dataType)
        if f.name in keys or kind is None or (columns is not None and f.name not in columns):
            continue
        c = f"`{f.name}`"
        aggs.append(F.expr(f"coalesce(sum({c}), 0) as {c}" if kind == "sum" else f"avg({c}) as {c}"))
    return users.groupBy(*keys).agg(*aggs)


def split_label(day: Column, train_start, test_start, test_end) -> Column:
    """``train``, ``test`` or ``unused`` by half-open date ranges."""
    d = F.to_date(day)
    a, b, c = [F.lit(dt.date.fromisoformat(str(x))) for x in (train_start, test_start, test_end)]
    return (
        F.when(d < a, "unused").when(d < b, "train").when(d < c, "test").otherwise("unused")
    )


def install_counts(installs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total and organic installs per key."""
    return installs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(SIZE_COLUMN),
        F.count_if(F.col("media_source") == ORGANIC).alias("organic_installs"),
    )


def build_target(installs: DataFrame, keys: Sequence[str], *, train_start, test_start, test_end) -> DataFrame:
    """Organic share per cohort, with the split it belongs to."""
    _require(installs, ["media_source"], "Source column")
    _require(installs, keys, "Target keys")
    return (
        install_counts(installs, keys)
        .withColumn("organic_share", F.col("organic_installs") / F.col(SIZE_COLUMN))
        .withColumn("split", split_label(F.col("install_date"), train_start, test_start, test_end))
    )


def roll_up_sources(
    sources: Mapping[str, DataFrame],
    on: Sequence[str],
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Equal to ``roll_up(merge_on_keys(sources, on), keys)`` for sources with one row per user.

    Sums and means ignore absent users, so each source is reduced on its own and the
    small cohort tables are joined. No user row ever carries the columns of all
    sources, and every aggregate stays narrow enough to be compiled well.
    """
    named = without_collisions(sources, on)
    base_name = next(iter(named))
    base = named.pop(base_name)
    _require(base, keys, "Cohort keys")
    owner = base.select(*dict.fromkeys([*on, *keys]))
    out = roll_up(base, keys, columns)
    for df in named.values():
        values = {f.name: cohort_aggregate(f.name, f.dataType) for f in df.schema.fields if f.name not in on}
        wanted = [c for c, kind in values.items() if kind and (columns is None or c in columns)]
        if not wanted:
            continue
        part = roll_up(owner.join(df.select(*on, *wanted), list(on)), keys, wanted).select(*keys, *wanted)
        joined = out.alias("l").join(part.alias("r"), null_safe_match("l", "r", keys), "left")
        filled = [
            F.expr(f"coalesce(r.`{c}`, 0) as `{c}`" if values[c] == "sum" else f"r.`{c}` as `{c}`") for c in wanted
        ]
        out = joined.select("l.*", *filled)
    return out


def target_roll_up(
    sources: Mapping[str, DataFrame],
    on: Sequence[str],
    keys: Sequence[str],
    *,
    train_start,
    test_start,
    test_end,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Target and features together; the organic count is one more sum over the base source.

    Equal to ``target_with_features`` of the two tables, without its second pass
    over installs and its join.
    """
    name, base = next(iter(sources.items()))
    _require(base, ["media_source"], "Source column")
    organic = F.coalesce((F.col("media_source") == ORGANIC).cast("bigint"), F.lit(0))
    flagged = {**sources, name: base.withColumn("_organic_count", organic)}
    wanted = None if columns is None else [*columns, "_organic_count"]
    rolled = roll_up_sources(flagged, on, keys, wanted)
    rest = [c for c in rolled.columns if c not in keys and c != "_organic_count"]
    return rolled.select(
        *keys,
        F.col("cohort_size").alias(SIZE_COLUMN),
        F.col("_organic_count").alias("organic_installs"),
        (F.col("_organic_count") / F.col("cohort_size")).alias("organic_share"),
        split_label(F.col("install_date"), train_start, test_start, test_end).alias("split"),
        *rest,
    )


def target_with_features(target: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(features, list(keys), "left")


def split_counts(target: DataFrame) -> DataFrame:
    return target.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_cohorts"),
        F.min("install_date").alias("first_date"),
        F.max("install_date").alias("last_date"),
    )


def drop_small(df: DataFrame, min_total_installs: int) -> DataFrame:
    """Cohorts of at least the given size; no filter for a threshold of 1 or less."""
    _require(df, [SIZE_COLUMN], "Size column")
    return df if min_total_installs <= 1 else df.filter(F.col(SIZE_COLUMN) >= min_total_installs)


def modelling_columns(
    df: DataFrame, *, keep_keys: Sequence[str], target: str, weight: str, features: Sequence[str]
) -> DataFrame:
    """Keys, weight, target and the whitelisted features that exist, in that order."""
    _require(df, [*keep_keys, weight, target], "Required columns")
    absent = [c for c in features if c not in df.columns]
    if absent:
        log.warning("%d feature columns missing, skipped: %s", len(absent), ", ".join(absent))
    return df.select(*keep_keys, weight, target, *[c for c in features if c in df.columns])


def clean(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return modelling_columns(
        drop_small(df, settings.min_total_installs),
        keep_keys=settings.keep_keys,
        target=settings.target,
        weight=settings.weight,
        features=settings.features,
    )

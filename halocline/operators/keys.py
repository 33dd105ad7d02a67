"""Key-level operators: dedupe, n-way join and skew-proof lookup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """One row per key: the smallest by ``order_by``, then by the other columns, nulls first.

    File order means nothing on a cluster, so the choice is stated instead. It is
    an aggregate with a map-side combine: a key that repeats a billion times still
    sends one row per task. Without all keys, whole rows are made distinct.
    """
    if any(k not in df.columns for k in keys):
        return df.dropDuplicates()
    rest = list(order_by) + [c for c in df.columns if c not in keys and c not in order_by]
    if not rest:
        return df.select(*keys).distinct()
    best = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_first"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_first.`{c}`").alias(c) for c in df.columns])


def merge_on_keys(sources: Mapping[str, DataFrame], on: Sequence[str], how: str = "left") -> DataFrame:
    """Join every source to the first one on ``on``.

    All joins use the same keys, so sources that come out of a key-level
    aggregate keep that partitioning and are not shuffled again. A non-key name
    that already exists gets ``_right``, then ``_<source>``.
    """
    if not sources:
        raise ValueError("'sources' is empty: at least the base table is needed")
    base, *others = without_collisions(sources, on).values()
    for df in others:
        base = base.join(df, on=list(on), how=how)
    return base


def without_collisions(sources: Mapping[str, DataFrame], on: Sequence[str]) -> dict[str, DataFrame]:
    """The sources with every non-key name unique, as ``merge_on_keys`` names them."""
    taken: set[str] = set()
    out = {}
    for name, df in sources.items():
        renames = {}
        for c in df.columns:
            if c in on or c not in taken:
                continue
            new = f"{c}_right" if f"{c}_right" not in taken | set(df.columns) else f"{c}_{name}"
            renames[c] = new
        out[name] = df.withColumnsRenamed(renames)
        taken.update(out[name].columns)
    return out


def null_safe_match(left: str, right: str, keys: Sequence[str]) -> Column:
    return reduce(
        lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    )


def hot_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that own more than one shuffle partition's even share of the rows, and over how many partitions each is spread.

    By that definition there are fewer of them than shuffle partitions. ``_salts`` is the key's size in such shares.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    shares = F.col("_n") * parts / counts.agg(F.sum("_n")).scalar()
    return counts.filter(shares > 1).select(*keys, F.ceil(shares).cast("int").alias("_salts"))


def lookup_join(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], *, spread_by: Sequence[str]
) -> DataFrame:
    """Left join of many rows to a lookup that has one row per key; null keys match null keys.

    A single key may own a large part of ``rows`` (all organic installs of a big
    market share one cost key). Such keys are found by a map-side combined count and
    broadcast, fewer than shuffle partitions. Their rows are split by a hash of ``spread_by`` over as
    many partitions as their size asks for, and only their lookup rows are repeated; all other
    keys join as they are.
    """
    hot = F.broadcast(hot_keys(rows, keys))
    left = rows.alias("l").join(hot.alias("h"), null_safe_match("l", "h", keys), "left").select("l.*", "h._salts")
    right = lookup.alias("r").join(hot.alias("h"), null_safe_match("r", "h", keys), "left").select("r.*", "h._salts")
    salts = F.coalesce("_salts", F.lit(1))
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    joined = salted.alias("l").join(copies.alias("r"), null_safe_match("l", "r", [*keys, "_salt"]), "left")
    extra = [c for c in lookup.columns if c not in keys]
    return joined.select(*[F.col(f"l.`{c}`") for c in rows.columns], *[F.col(f"r.`{c}`") for c in extra])

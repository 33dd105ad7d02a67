"""Pearson and Spearman coefficients of all pairs of columns, over the rows where both are there.

The work is linear in rows and columns: every column is ranked once (exact ranks, averages over ties), and one pass of
block products adds up what all pairs need. A rank over a pair's complete rows differs from the column's own rank
only where the partner is missing in rows that the column has; for each such pattern of missing rows, which columns
usually share, the column is ranked once more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.operators.quantiles import value_positions

#: Deviations below this share of the mean are rounding of a constant.
ROUNDING = 1e-9


def products(rows: DataFrame, left: str, right: str, m: int, n: int) -> np.ndarray:
    """Sum over rows of the outer product of two array columns of sizes ``m`` and ``n``; tasks send one block each."""

    def reduce_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((m, n))
        for pdf in batches:
            if len(pdf):
                a = np.vstack(pdf["a"].to_numpy()).astype(float)
                b = a if left == right else np.vstack(pdf["b"].to_numpy()).astype(float)
                total += a.T @ b
        yield pd.DataFrame({"i": np.arange(m), "v": list(total)})

    columns = [F.col(left).alias("a")] + ([] if left == right else [F.col(right).alias("b")])
    blocks = rows.select(*columns).mapInPandas(reduce_task, "i int, v array<double>")
    sums = blocks.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((m, n))
    for i, j, v in sums.collect():  # a number per pair of columns
        out[i, j] = v
    return out


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean of each column, and its deviation with 1 in place of rounding or nothing."""
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    row = df.agg(*[F.avg(v) for v in values], *[F.stddev_pop(v) for v in values]).first()
    mean = np.array([x or 0.0 for x in row[: len(columns)]])
    sd = np.array([x or 0.0 for x in row[len(columns) :]])
    return mean, np.where(sd <= ROUNDING * np.abs(mean), 0.0, sd)


def rank_slots(counts: np.ndarray) -> tuple[list[tuple[int, int]], dict[tuple[int, int], int]]:
    """Which ranks are needed: (column, partner that cuts its rows or -1) per slot, and the slot of each ordered pair.

    ``counts`` holds the complete rows of every pair. Partners that are there in the same rows share a slot.
    """
    n = len(counts)
    pattern = {}
    for j in range(n):
        pattern[j] = next((k for k in range(j) if counts[k, k] == counts[j, j] == counts[k, j]), j)
    slots = [(i, -1) for i in range(n)]
    known = {slot: i for i, slot in enumerate(slots)}
    of_pair = {}
    for i in range(n):
        for j in range(n):
            slot = (i, -1) if counts[i, j] == counts[i, i] else (i, pattern[j])
            if slot not in known:
                known[slot] = len(slots)
                slots.append(slot)
            of_pair[i, j] = known[slot]
    return slots, of_pair


def centred_ranks(df: DataFrame, columns: Sequence[str], keys: Sequence[str], slots: Sequence[tuple[int, int]]) -> DataFrame:
    """An array ``r`` per row: the rank less its mean for every slot, 0 where the slot does not have the row."""

    def value(i: int, cut: int) -> Column:
        own = F.col(f"`{columns[i]}`").cast("double")
        return own if cut < 0 else F.when(F.col(f"`{columns[cut]}`").isNotNull(), own)

    cells = F.array(*[F.struct(F.lit(s).alias("slot"), value(*slot).alias("value")) for s, slot in enumerate(slots)])
    long = df.select(*keys, F.inline(cells)).filter(F.col("value").isNotNull())
    middle = F.col("before") + (F.col("n") + 1) / 2 - (F.col("total") + 1) / 2
    ranks = value_positions(long, "value", ["slot"], bounded_groups=True).select("slot", "value", middle.alias("r"))
    ranked = long.join(ranks, ["slot", "value"]).groupBy(*keys)
    wide = ranked.agg(*[F.coalesce(F.max(F.when(F.col("slot") == s, F.col("r"))), F.lit(0.0)).alias(f"r{s}") for s in range(len(slots))])
    return wide.select(F.array(*[F.col(f"r{s}") for s in range(len(slots))]).alias("r"))


def ratio(product: float, a: float, b: float) -> float | None:
    return float(product / np.sqrt(a * b)) if a > 0 and b > 0 else None


def correlation_table(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``feat_a, feat_b, n, pearson, spearman`` for every pair of ``columns``, in their order.

    ``keys`` name a row. Two columns that never meet, or one that does not vary over their rows, have no coefficient. ``df`` is
    read four times; it should be a stored or persisted table.
    """
    columns, size = list(columns), len(columns)
    mean, sd = moments(df, columns)
    x = [(F.col(f"`{c}`").cast("double") - m) / (s or 1.0) if s else F.col(f"`{c}`").cast("double") * 0.0 for c, m, s in zip(columns, mean.tolist(), sd.tolist())]
    filled = [F.coalesce(v, F.lit(0.0)) for v in x]
    there = [F.col(f"`{c}`").isNotNull().cast("double") for c in columns]
    squares = [v * v for v in filled]
    blocks = df.select(F.array(*filled, *there, *squares).alias("a"), F.array(*filled, *there).alias("b"))
    sums = products(blocks, "a", "b", 3 * size, 2 * size)
    cross, counts = sums[:size, :size], np.rint(sums[size : 2 * size, size:])
    first, second = sums[:size, size:], sums[2 * size :, size:]  # [i, j]: sums of column i and of its square over the rows of j

    slots, of_pair = rank_slots(counts)
    rank_sums = products(centred_ranks(df, columns, keys, slots), "r", "r", len(slots), len(slots))

    rows = []
    for i, j in combinations(range(size), 2):
        n = counts[i, j]
        pearson = spearman = None
        if n:
            spread = [second[a, b] - first[a, b] ** 2 / n for a, b in ((i, j), (j, i))]
            spread = [s if s > 1e-14 * n else 0.0 for s in spread]
            pearson = ratio(cross[i, j] - first[i, j] * first[j, i] / n, *spread)
            a, b = of_pair[i, j], of_pair[j, i]
            spearman = ratio(rank_sums[a, b], rank_sums[a, a], rank_sums[b, b])
        rows.append((columns[i], columns[j], int(n), pearson, spearman))
    return df.sparkSession.createDataFrame(rows, "feat_a string, feat_b string, n bigint, pearson double, spearman double")


def by_strength() -> list[Column]:
    """Strongest first; coefficients of monotone transforms agree up to rounding, so ties go by name."""
    return [F.desc_nulls_last(F.round("abs_spearman", 9))]


def target_correlations(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """Each feature against the target, with ``abs_spearman`` to rank by."""
    return with_target(correlation_table(df, [*features, target], keys), target)


def with_target(table: DataFrame, target: str) -> DataFrame:
    """The rows of a correlation table that name the target."""
    of_target = table.filter((F.col("feat_a") == target) | (F.col("feat_b") == target))
    feature = F.when(F.col("feat_a") == target, F.col("feat_b")).otherwise(F.col("feat_a"))
    return of_target.select(feature.alias("feature"), "pearson", "spearman", F.abs("spearman").alias("abs_spearman"))


def top_correlated(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], n: int = 25) -> DataFrame:
    return target_correlations(df, features, target, keys).orderBy(*by_strength(), "feature").limit(n)


def feature_pairs(df: DataFrame, features: Sequence[str], keys: Sequence[str], top: int | None = 30) -> DataFrame:
    """Absolute Spearman of every feature pair (upper triangle), strongest first."""
    return strongest_pairs(correlation_table(df, features, keys), top)


def strongest_pairs(table: DataFrame, top: int | None) -> DataFrame:
    pairs = table.select("feat_a", "feat_b", F.abs("spearman").alias("abs_spearman"))
    return pairs if top is None else pairs.orderBy(*by_strength(), "feat_a", "feat_b").limit(top)


def among_best(table: DataFrame, target: str, n: int) -> DataFrame:
    """The pairs of a correlation table among the ``n`` features that correlate most with the target."""
    best = with_target(table, target).orderBy(*by_strength(), "feature").limit(n).select("feature")
    inside = table.join(best.withColumnRenamed("feature", "feat_a"), "feat_a", "left_semi")
    return inside.join(best.withColumnRenamed("feature", "feat_b"), "feat_b", "left_semi")


def top_pairs(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], n: int = 20, top: int | None = 30) -> DataFrame:
    """The strongest pairs among the ``n`` features that correlate most with the target; all from one table."""
    return strongest_pairs(among_best(correlation_table(df, [*features, target], keys), target, n), top)

"""Baseline: weighted ridge regression on the logit of the organic share."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.functions import scalar as S
from halocline.models.prep import Lookup, Prep, fit_prep, lookup, scaled, target_encoding

ENCODED = "country_te"


@dataclass(frozen=True)
class RidgeModel:
    """A fit without training rows knows nothing: it has no coefficients and predicts null."""

    prep: Prep
    country_te: Lookup | None
    global_mean: float | None
    platforms: tuple[str, ...]
    intercept: float | None
    coefficients: tuple[float, ...]

    @property
    def feature_names(self) -> list[str]:
        return [*self.prep.features, *[f"platform_{p}" for p in self.platforms]]


NO_FIT = RidgeModel(Prep((), (), (), ()), None, None, (), None, ())


def _encode(df: DataFrame, table: Lookup, global_mean: float) -> DataFrame:
    """Join the fitted means by name; a country without one gets the global mean."""
    return table.attach(df, "country_code", ENCODED, F.lit(global_mean))


def _inputs(prep: Prep, platforms: Sequence[str]) -> dict[str, Column]:
    """Model columns: scaled features, then one indicator per known platform (unknown ones get zeros)."""
    one_hot = {f"platform_{p}": F.when(F.col("platform") == p, 1.0).otherwise(0.0) for p in platforms}
    return scaled(prep) | one_hot


def fit_ridge(
    train: DataFrame, *, target: str, weight: str, features: Sequence[str], alpha: float = 1.0,
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> RidgeModel:
    """Fit on the cluster: one pass for totals, then target encoding, preparation, and one pass for the normal equations.

    The solver minimises mean squared error plus its own penalty on a target scaled
    to unit deviation, so the penalty of a textbook ridge (``alpha`` on the sum of
    weighted squares) is ``alpha / sum(w) * std(y)``. ``stage`` stores the countries' means.
    """
    w, share, y = F.col(weight).cast("double"), F.col(target), S.logit(F.col(target))
    sums = [F.sum(w), F.sum(w * share), F.sum(w * y), F.sum(w * y * y), F.array_sort(F.collect_set(F.col("platform").cast("string")))]
    total, of_share, of_y, of_square, platforms = train.agg(*sums).first()
    if not total:
        return NO_FIT
    global_mean, spread = of_share / total, math.sqrt(max(of_square / total - (of_y / total) ** 2, 0.0))
    table = lookup(target_encoding(train, target, weight), "country_code", ENCODED, stage)
    encoded = _encode(train, table, global_mean)
    prep = fit_prep(encoded, [*features, ENCODED], country=None, platform=None)

    inputs = _inputs(prep, platforms)
    matrix = encoded.select(*[c.alias(f"f{i}") for i, c in enumerate(inputs.values())], y.alias("label"), w.alias("w"))
    assembled = VectorAssembler(inputCols=[f"f{i}" for i in range(len(inputs))], outputCol="features")
    model = LinearRegression(
        weightCol="w",
        regParam=alpha / total * spread,
        elasticNetParam=0.0,
        standardization=False,
        solver="normal",
    ).fit(assembled.transform(matrix).select("features", "label", "w"))
    return RidgeModel(
        prep=prep,
        country_te=table,
        global_mean=global_mean,
        platforms=tuple(platforms),
        intercept=float(model.intercept),
        coefficients=tuple(float(c) for c in model.coefficients),
    )


def predict_ridge(model: RidgeModel, df: DataFrame) -> DataFrame:
    """Add ``pred``, the predicted share. A projection: coefficients are literals."""
    if model.intercept is None:
        return df.withColumn("pred", F.lit(None).cast("double"))
    encoded = _encode(df, model.country_te, model.global_mean)
    z = F.lit(model.intercept)
    for c, column in zip(model.coefficients, _inputs(model.prep, model.platforms).values()):
        z = z + column * F.lit(c)
    return encoded.withColumn("pred", S.inv_logit(z)).drop(ENCODED)


def coefficient_table(model: RidgeModel, like: DataFrame, top: int | None = 20) -> DataFrame:
    """Coefficients by absolute size."""
    rows = [(n, c, abs(c)) for n, c in zip(model.feature_names, model.coefficients)]
    table = like.sparkSession.createDataFrame(rows, "feature string, coef double, abs_coef double")
    ordered = table.orderBy(F.desc("abs_coef"), "feature")
    return ordered if top is None else ordered.limit(top)

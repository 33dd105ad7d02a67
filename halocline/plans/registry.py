"""Registered queries: a Spark plan, its output columns, and the same result in SQL.

A column list such as ``"platform total_installs:int organic_share:6"`` is applied
to both sides, so types and rounding agree: ``int`` casts to bigint, a digit rounds
a double, ``log`` compares ``ln(1 + x)`` of values spread over many magnitudes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    columns: str
    build: Build
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return pick(self.build(spark, sf_dir), self.columns)

    def oracle(self) -> str | None:
        return None if self.sql is None else f"{self.sql}\nSELECT {pick_sql(self.columns)} FROM final"


REGISTRY: dict[str, Query] = {}


def query(columns: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a builder under its function name; ``sql`` defines a ``final`` relation."""

    def add(build: Build) -> Build:
        REGISTRY[build.__name__] = Query(build.__name__, columns, build, sql)
        return build

    return add


def _parse(columns: str) -> list[tuple[str, str]]:
    pairs = []
    for item in columns.split():
        name, _, kind = item.partition(":")
        pairs.append((name, kind))
    return pairs


def pick(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind in _parse(columns):
        c = F.col(f"`{name}`")
        if kind == "int":
            c = c.cast("bigint")
        elif kind == "log":
            c = F.round(F.log1p(c.cast("double")), 6) + 0.0
        elif kind:
            c = F.round(c.cast("double"), int(kind)) + 0.0
        out.append(c.alias(name))
    return df.select(*out)


def pick_sql(columns: str) -> str:
    out = []
    for name, kind in _parse(columns):
        if kind == "int":
            out.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
        elif kind == "log":
            out.append(f'round(ln(1 + CAST("{name}" AS DOUBLE)), 6) + 0.0 AS "{name}"')
        elif kind:
            out.append(f'round(CAST("{name}" AS DOUBLE), {kind}) + 0.0 AS "{name}"')
        else:
            out.append(f'"{name}"')
    return ", ".join(out)

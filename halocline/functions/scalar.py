"""Column expressions shared by the operators. All stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATIO_EPS = 1e-8
SHARE_EPS = 1e-3
ERROR_EPS = 1e-6


def coerce_timestamps(df: DataFrame, columns: Sequence[str], utc: bool = False) -> DataFrame:
    """Cast the named columns to timestamps; unknown columns are skipped and bad values become null.

    Numbers count nanoseconds since 1970 in UTC. With ``utc`` the result is an instant (a text without a zone counts as
    UTC), otherwise a wall-clock time. Columns that are temporal already stay.
    """
    temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
    changes = {}
    for name in columns:
        if name not in df.columns or isinstance(df.schema[name].dataType, temporal):
            continue
        if isinstance(df.schema[name].dataType, T.NumericType):
            micros = F.floor(F.col(name) / 1000)
            wall = F.timestamp_add("MICROSECOND", micros.cast("bigint"), F.lit("1970-01-01").cast("timestamp_ntz"))
        else:
            wall = F.col(name).try_cast("timestamp_ntz")
        changes[name] = wall
        if utc:
            # shown in the session's zone, the instant is what the wall clock of UTC says
            changes[name] = F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall).cast("timestamp")
    return df.withColumns(changes) if changes else df


def day_offset(event: Column, start: Column) -> Column:
    """Whole calendar days between two moments."""
    return F.datediff(F.to_date(event), F.to_date(start))


def minutes_between(later: Column, earlier: Column) -> Column:
    """Elapsed minutes with fractions; null when either side is null."""
    micros = F.timestamp_diff(
        "MICROSECOND", earlier.cast("timestamp_ntz"), later.cast("timestamp_ntz")
    )
    return micros / F.lit(6.0e7)


def zero_if_null(c: Column, zero: float | int = 0.0) -> Column:
    return F.coalesce(c, F.lit(zero))


def safe_ratio(num: Column, den: Column) -> Column:
    """Ratio, null on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def eps_ratio(num: Column, den: Column) -> Column:
    return num / (den + F.lit(RATIO_EPS))


def _quoted(name: str) -> str:
    return f"`{name}`"


def row_sum_sql(names: Sequence[str]) -> str:
    return "(0.0D" + "".join(f" + coalesce({_quoted(n)}, 0.0D)" for n in names) + ")"


def row_sum(names: Sequence[str]) -> Column:
    """Sum across columns, nulls counted as nothing. SQL text, as wide expressions are slow to build by call."""
    return F.expr(row_sum_sql(names))


def row_count_positive(names: Sequence[str]) -> Column:
    """Number of columns above zero."""
    terms = "".join(f" + int(coalesce({_quoted(n)} > 0, false))" for n in names)
    return F.expr(f"bigint(0{terms})")


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def logit(p: Column, eps: float = SHARE_EPS) -> Column:
    p = clip(p, eps, 1 - eps)
    return F.log(p / (1 - p))


def inv_logit(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def percentage_error(y: Column, pred: Column, eps: float = ERROR_EPS) -> Column:
    """Signed relative error; null where the true value is (almost) zero."""
    return F.when(F.abs(y) > eps, F.try_divide(pred - y, y))


def date_bucket(day: Column, anchor: Column, days: int) -> Column:
    """First day of the ``days``-long bucket that holds ``day``, counted from ``anchor``."""
    offset = F.datediff(day, anchor)
    return F.date_add(anchor, (F.floor(offset / F.lit(days)) * days).cast("int"))


def weekday_columns(day: Column) -> dict[str, Column]:
    """Seven 0/1 doubles, Monday first."""
    dow = F.weekday(day)
    return {f"dow_{d}": F.when(dow == d, 1.0).otherwise(0.0) for d in range(7)}


def yearly_terms(day: Column, pairs: int) -> dict[str, Column]:
    """Sine and cosine terms of the year, ``pairs`` of them; none when 0."""
    import math

    angle = F.dayofyear(day) * F.lit(2.0 * math.pi / 365.25)
    out = {}
    for k in range(1, pairs + 1):
        out[f"year_sin_{k}"] = F.sin(angle * k)
        out[f"year_cos_{k}"] = F.cos(angle * k)
    return out


def saturate(kind: str, x: Column, shape: Column | float, slope: float = 2.0, ceiling: float = 1.0) -> Column:
    """Diminishing-returns curve.

    logistic ``(1-e^-sx)/(1+e^-sx)``; michaelis_menten ``c*x/(s+x)``;
    hill ``x^n/(s^n+x^n)`` with exponent ``slope``.
    """
    s = shape if isinstance(shape, Column) else F.lit(float(shape))
    if kind == "logistic":
        decay = F.exp(-s * x)
        return (F.lit(1.0) - decay) / (F.lit(1.0) + decay)
    if kind == "michaelis_menten":
        return F.lit(float(ceiling)) * x / (s + x)
    if kind == "hill":
        return F.pow(x, F.lit(slope)) / (F.pow(s, F.lit(slope)) + F.pow(x, F.lit(slope)))
    raise ValueError(f"no saturation curve is named '{kind}'")


def saturation_slopes(kind: str, x: Column, shape: float, slope: float = 2.0, ceiling: float = 1.0) -> tuple[Column, Column]:
    """Derivatives of ``saturate`` by its input and by its shape."""
    s = float(shape)
    if kind == "logistic":
        rest = F.lit(1.0) - F.pow(saturate(kind, x, s), F.lit(2.0))
        return rest * (s / 2.0), rest * x / 2.0
    if kind == "michaelis_menten":
        below = F.pow(x + s, F.lit(2.0))
        return F.lit(ceiling * s) / below, -x * float(ceiling) / below
    if kind == "hill":
        below = F.pow(F.pow(x, F.lit(slope)) + s**slope, F.lit(2.0))
        rise = F.when(x > 0, F.pow(x, F.lit(slope - 1.0))).otherwise(1.0 if slope == 1 else 0.0)
        return rise * (slope * s**slope) / below, -F.pow(x, F.lit(slope)) * (slope * s ** (slope - 1.0)) / below
    raise ValueError(f"no saturation curve is named '{kind}'")

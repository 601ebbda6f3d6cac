"""Number helpers with the rounding that all results here use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits, on doubles."""
    k = float(10**digits)
    return F.floor(x.cast("double") * k + 0.5) / k


def whole(x: Column) -> Column:
    """Half-up rounding to a BIGINT."""
    return F.floor(x.cast("double") + 0.5)


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(high, x))


def clamp01(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def bar_percent(value: Column, top: Column) -> Column:
    """Length of a bar, 0 to 100, for a value of at most ``top``."""
    return F.least(F.lit(100.0), half_up(value / top * 100.0))


def format_minutes(minutes: Column) -> Column:
    hours, rest = F.floor(minutes / 60), minutes % 60
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .when(rest > 0, F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h")))
    )

"""Numeric column helpers (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import STATUS_ACT, STATUS_OK, STATUS_WATCH, THRESHOLD_AMBER, THRESHOLD_GREEN


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, digits: int = 6) -> Column:
    """``floor(x*10^d + 0.5) / 10^d`` - identical in Spark and DuckDB.

    ``round`` differs between engines on decimal ties, this does not.
    """
    scale = float(10 ** digits)
    return (F.floor(col_(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")


def r6(c) -> Column:
    return round_half_up(c, 6)


def safe_div(n, d) -> Column:
    """Null on a zero or null divisor (ANSI mode raises on x/0)."""
    return F.try_divide(col_(n).cast("double"), col_(d).cast("double"))


def traffic_light(c) -> Column:
    c = col_(c)
    return (F.when(c < F.lit(THRESHOLD_GREEN), F.lit(STATUS_OK))
             .when(c < F.lit(THRESHOLD_AMBER), F.lit(STATUS_WATCH))
             .otherwise(F.lit(STATUS_ACT)))

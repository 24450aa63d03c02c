"""NULL rules: strict aggregates and non-finite cleaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict(agg: Callable[[Column], Column], c: Column | str) -> Column:
    """Aggregate that is NULL as soon as one input is NULL (Spark's own aggregates skip NULL)."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), agg(c))


def strict_sum(c: Column | str) -> Column:
    return strict(F.sum, c)


def strict_max(c: Column | str) -> Column:
    return strict(F.max, c)


def strict_min(c: Column | str) -> Column:
    return strict(F.min, c)


def strict_avg(c: Column | str) -> Column:
    return strict(F.avg, c)


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)

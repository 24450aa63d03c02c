"""Filters and cleaning."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite


def drop_flagged(df: DataFrame, codes: Sequence[int], flags: Sequence[str], null_ok: bool = False) -> DataFrame:
    """Drop rows where a flag column holds an excluded code.

    A NULL flag drops the row too (three-valued comparison) unless ``null_ok``.
    """
    for f in flags:
        keep = ~F.col(f).isin(list(codes))
        df = df.where(keep | F.col(f).isNull() if null_ok else keep)
    return df


def between_time(df: DataFrame, ts: str, lo: object = None, hi: object = None, closed: str = "left") -> DataFrame:
    """Time window [lo, hi), or [lo, hi] with ``closed="both"`` (C4).

    Bounds are cast to the column's own type, so the predicate reaches the scan; a date bound means
    midnight.
    """
    kind = df.schema[ts].dataType
    if lo is not None:
        df = df.where(F.col(ts) >= F.lit(lo).cast(kind))
    if hi is not None:
        bound = F.lit(hi).cast(kind)
        df = df.where(F.col(ts) <= bound if closed == "both" else F.col(ts) < bound)
    return df


def any_window(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    """Rows for which at least one of several windows holds."""
    return df.where(reduce(lambda a, b: a | b, conditions))


def nullify_nonfinite(df: DataFrame, *names: str) -> DataFrame:
    """NaN and infinities become NULL."""
    return df.withColumns({c: finite(c) for c in names})


def where_any(df: DataFrame, names: Sequence[str], test: Callable[[Column], Column]) -> DataFrame:
    """Rows where a test holds for at least one of the columns."""
    return df.where(reduce(lambda a, b: a | b, [test(F.col(c)) for c in names]))


def where_max(df: DataFrame, col: str) -> DataFrame:
    """Rows at the global maximum (C11): an uncorrelated scalar subquery, no join."""
    return df.where(F.col(col) == df.agg(F.max(col)).scalar())


def censor(df: DataFrame, col: str, lo: float, hi: float, out: str | None = None) -> DataFrame:
    """Values outside [lo, hi] become NULL."""
    return df.withColumn(out or col, F.when(F.col(col).between(lo, hi), F.col(col)))


def route_by(
    df: DataFrame,
    col: str,
    branches: dict[str, Callable[[DataFrame], DataFrame]],
    rest: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Send the rows of each site through their own branch and stack the results.

    Rows of another or of no site go through ``rest``, which leaves them as they are unless given.
    """
    parts = [fn(df.where(F.col(col) == value)) for value, fn in branches.items()]
    parts.append(rest(df.where(~F.coalesce(F.col(col).isin(list(branches)), F.lit(False)))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

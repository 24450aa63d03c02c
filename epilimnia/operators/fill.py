"""Calendar filling and interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from .keyed import join_on
from .scan import with_neighbours

BLOCK = 4096


def _is_date(df: DataFrame, ts: str, step_seconds: int | None) -> bool:
    is_date = isinstance(df.schema[ts].dataType, DateType)
    if is_date and step_seconds is not None and step_seconds % 86400:
        raise ValueError("a date series needs a step of whole days")
    return is_date


def _unit(is_date: bool, step_seconds: int) -> Column:
    """A step in days of a date series, else in microseconds."""
    return F.lit(step_seconds // 86400 if is_date else step_seconds * 1_000_000).cast("long")


def _span(lo: Column, hi: Column, is_date: bool) -> Column:
    """Days between dates, else microseconds."""
    if is_date:
        return F.date_diff(hi, lo).cast("long")
    # the difference is taken on the type itself: one without a zone must not pass through the session's
    span = hi - lo
    part = lambda unit: F.extract(F.lit(unit), span)
    minutes = (part("DAY").cast("long") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")


def _steps(lo: Column, hi: Column, is_date: bool, step: Column) -> Column:
    """Whole steps from lo to hi, counting a started one."""
    return F.ceil(_span(lo, hi, is_date) / step).cast("long")


def _at(lo: Column, i: Column, is_date: bool, step: Column) -> Column:
    if is_date:
        return F.date_add(lo, (i * step).cast("int"))
    return lo + F.make_dt_interval(secs=((i * step).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))


def _usual_steps(rows: DataFrame, keys: Sequence[str], ts: str, is_date: bool) -> DataFrame:
    """``__step`` of each series: the most frequent lag to the next row, the shorter of equally frequent ones."""
    lags = rows.select(*keys, _span(F.col(ts), F.col("upcoming"), is_date).alias("__lag")).where("__lag > 0")
    counts = lags.groupBy(*keys, "__lag").agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.max_by("__lag", F.struct("__n", -F.col("__lag"))).alias("__step"))


def series_steps(df: DataFrame, keys: Sequence[str], ts: str, name: str = "step", bounded: bool = False, chunk: Column | None = None) -> DataFrame:
    """The step of each series, found from its rows: days of a date series, else seconds. A series of one row has none.

    Lags are counted per series and length before they move, so the aggregate stays as small as the kinds of lags.
    """
    is_date = _is_date(df, ts, None)
    rows = with_neighbours(df.select(*keys, ts), keys, [ts], ts, at=ts, bounded=bounded, chunk=chunk)
    steps = _usual_steps(rows, keys, ts, is_date)
    return steps.select(*keys, (F.col("__step") if is_date else F.col("__step") / 1_000_000).alias(name))


def unroll(df: DataFrame, count: Column, spread: Sequence[str] = ()) -> DataFrame:
    """``__i`` = 0 .. count - 1 for each row, in blocks, so a long gap never becomes one large array.

    ``spread``: columns to redistribute the blocks by before they are unrolled.
    """
    blocks = df.withColumn("__count", F.greatest(count, F.lit(1).cast("long"))).withColumn(
        "__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__count") - 1) / BLOCK)))
    )
    if spread:
        blocks = blocks.repartition(*spread, "__b")
    first = F.col("__b") * BLOCK
    index = F.explode(F.sequence(first, F.least(first + (BLOCK - 1), F.col("__count") - 1)))
    return blocks.withColumn("__i", index).drop("__b", "__count")


def fill_gaps(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step_seconds: int | None = None,
    interpolated: str | None = None,
    maxgap: int | None = None,
    edges: str = "null",
    bounded: bool = False,
    chunk: Column | None = None,
) -> DataFrame:
    """Add a row for every missing step between the first and last time of each series.

    Without ``step_seconds`` each series has its own step: its most frequent lag, see ``series_steps``. Observed rows all stay; other columns of added rows are NULL. Times are expected on the step grid of
    their series. With ``interpolated`` that column is filled in the same pass (F7, F8): linear in time,
    gaps of more than ``maxgap`` steps stay NULL, ends as in ``interpolate``. Each row yields the steps up
    to the next row, so one window over the observed rows does it all. The missing steps are spread over the
    cluster in blocks before they are unrolled, so no task holds a long gap.
    """
    is_date = _is_date(df, ts, step_seconds)
    columns = df.columns
    value = interpolated or ts
    rows = with_neighbours(df, keys, [ts], value, at=ts, bounded=bounded, chunk=chunk)
    if step_seconds is None:
        rows = join_on(rows, _usual_steps(rows, keys, ts, is_date), keys, "left")
        step = F.coalesce("__step", F.lit(1).cast("long"))
    else:
        step = _unit(is_date, step_seconds)
    here, upcoming = F.col(ts), F.col("upcoming")
    count = F.coalesce(_steps(here, upcoming, is_date, step), F.lit(1).cast("long"))
    rows = unroll(rows, count, () if bounded else [*keys, ts])
    rows = rows.withColumn("__t", _at(here, F.col("__i"), is_date, step))
    observed = F.col("__i") == 0
    new = {c: F.when(observed, F.col(c)) for c in columns if c not in keys and c != ts}
    if interpolated:
        before, after = F.col("before"), F.col("after")
        span = _steps(before["at"], after["at"], is_date, step)
        share = _steps(before["at"], F.col("__t"), is_date, step) / span
        line = before["value"] + (after["value"] - before["value"]) * share
        new[interpolated] = _choose(new[interpolated], before, after, line, span - 1, maxgap, edges)
    return rows.withColumns({**new, ts: F.col("__t")}).select(*columns)


def densify_daily(df: DataFrame, keys: Sequence[str], date: str, **kwargs) -> DataFrame:
    """Full daily calendar per key."""
    return fill_gaps(df, keys, date, 86400, **kwargs)


def _choose(
    value: Column, before: Column, after: Column, line: Column, gap: Column, maxgap: int | None, edges: str
) -> Column:
    if edges not in ("null", "nearest"):
        raise ValueError(edges)
    if edges == "nearest" and maxgap is not None:
        raise ValueError("maxgap goes with edges='null' only")
    inside = before.isNotNull() & after.isNotNull()
    if maxgap is not None:
        inside = inside & (gap <= maxgap)
    out = F.when(value.isNotNull(), value).when(inside, line)
    return F.coalesce(out, before["value"], after["value"]) if edges == "nearest" else out


def interpolate(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    col: str,
    maxgap: int | None = None,
    edges: str = "null",
    out: str | None = None,
    bounded: bool = False,
    chunk: Column | None = None,
) -> DataFrame:
    """Linear interpolation over row positions.

    Gaps of more than ``maxgap`` rows stay NULL. Leading and trailing NULLs stay NULL, or take the
    nearest value with ``edges="nearest"``.
    """
    rows = with_neighbours(df, keys, order, col, bounded=bounded, chunk=chunk)
    before, after, position = F.col("before"), F.col("after"), F.col("position")
    span = after["at"] - before["at"]
    line = before["value"] + (after["value"] - before["value"]) * (position - before["at"]) / span
    value = _choose(F.col(col), before, after, line, span - 1, maxgap, edges)
    return rows.withColumn(out or col, value).drop("position", "before", "after", "upcoming")

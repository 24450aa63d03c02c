"""Ordered scans over series of any length.

A window over ``keys`` puts a whole series into one task. So a series is cut into chunks: the window runs inside a chunk, a small
per-chunk summary carries state across chunk edges, and both are joined back.

Chunks are planned from counts. One aggregate counts the rows of each key and fine bucket of the order (an hour, a day, the leading bits
of a number beyond its key's least); a running sum over those counts cuts chunks of at most ``CHUNK_ROWS`` rows, whatever the order's values are. The number of
buckets of a key is bounded by its range, not by its rows, so the running sum itself is short. The plan is the same for every size. Only rows
that share a bucket can't be parted: more than half of ``CHUNK_ROWS`` rows of one hour, of numbers that agree to 5 digits, or of one
day whose second order column, if it has one, agrees to 2 digits. Texts in front are names: the second column is cut within each.

``chunk`` gives another cut; it must never fall while the order rises. ``bounded=True`` says that the series are short by
construction (for instance one row per site and day of a year) and stay whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pyspark.sql.types import DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from .keyed import join_on

CHUNK_ROWS = 500_000
_HOUR_MICROS = 3_600 * 1_000_000
#: Steps of a number's bucket for each doubling of its size.
_FINE, _COARSE = 1 << 14, 32
_CHUNK = "__chunk"


@dataclass
class Series:
    """Rows of many ordered series, cut into chunks unless they are bounded."""

    df: DataFrame
    keys: list[str]
    order: list[Column]
    chunked: bool

    @property
    def groups(self) -> list[str]:
        return [*self.keys, _CHUNK] if self.chunked else list(self.keys)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.groups).orderBy(*self.order)

    def running(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def behind(self) -> WindowSpec:
        """Rows after the current one, walked backwards: a frame that ends at the last row would be
        evaluated anew for every row."""
        back = Window.partitionBy(*self.groups).orderBy(*[c.desc() for c in self.order])
        return back.rowsBetween(Window.unboundedPreceding, -1)

    def chunk_window(self) -> WindowSpec:
        """Over the chunk summary: at most one row per chunk and key."""
        return Window.partitionBy(*self.keys).orderBy(_CHUNK)

    def earlier_chunks(self) -> WindowSpec:
        return self.chunk_window().rowsBetween(Window.unboundedPreceding, -1)

    def later_chunks(self) -> WindowSpec:
        """Backwards, as in ``behind``."""
        back = Window.partitionBy(*self.keys).orderBy(F.col(_CHUNK).desc())
        return back.rowsBetween(Window.unboundedPreceding, -1)

    def carry(self, df: DataFrame, summary: DataFrame) -> DataFrame:
        return join_on(df, summary, self.groups, "left")

    def done(self, df: DataFrame, *temporary: str) -> DataFrame:
        return df.drop(_CHUNK, *temporary)


def _leading(c: Column, steps: int) -> Column:
    return F.signum(c) * F.floor(F.log2(1 + F.abs(c.cast("double"))) * steps)


def order_bucket(df: DataFrame, order: Sequence[Column], base: Column | None = None) -> Column:
    """Fine bucket of the first order column: the day of a date, the hour of a time, the leading bits of a number beyond ``base``."""
    first = order[0]
    kind = _kinds(df, order)[0]
    if isinstance(kind, DateType):
        return F.unix_date(first)
    if isinstance(kind, TimestampNTZType):
        return F.unix_date(first.cast("date")) * 24 + F.hour(first)
    if isinstance(kind, TimestampType):  # free of the session's zone, whose clocks may go back
        return F.floor(F.unix_micros(first) / _HOUR_MICROS)
    if isinstance(kind, NumericType):
        return _leading(first if base is None else first - base, _FINE)
    raise ValueError(f"give a chunk for an order of {kind.simpleString()}, or declare the series bounded")


def _kinds(df: DataFrame, order: Sequence[Column]) -> list[DataType]:
    return [f.dataType for f in df.select(*[c.alias(f"c{i}") for i, c in enumerate(order[:2])]).schema]


def _with_buckets(df: DataFrame, keys: Sequence[str], order: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """Buckets of the first order column, and of the second one where rows of a bucket all have the same first value.

    Numbers are taken beyond the least of their key, so that a series of large ids or times is cut as finely as one from zero.
    """
    kinds = _kinds(df, order)
    text = isinstance(kinds[0], StringType) and len(kinds) > 1
    cut = order[1:] if text else order
    base = None
    if isinstance(kinds[int(text)], NumericType):
        df = join_on(df, df.groupBy(*keys).agg(F.min(cut[0]).alias("__base")), keys, "left")
        base = F.col("__base")
    if text:
        pair = order[0], order_bucket(df, cut, base)
    elif len(kinds) == 2 and isinstance(kinds[0], DateType) and isinstance(kinds[1], NumericType):
        pair = order_bucket(df, order), _leading(order[1], _COARSE)
    else:
        pair = order_bucket(df, order, base), F.lit(0)
    return df.withColumns(dict(zip(names, pair, strict=True))).drop("__base")


def planned_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All rows with the number of their chunk."""
    buckets = ["__bucket", "__part"]
    rows = _with_buckets(df, keys, order, buckets)
    counts = rows.groupBy(*keys, *buckets).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a bucket that crosses a mark is in the chunk behind it, so a chunk holds half of CHUNK_ROWS and one bucket at most
    cuts = counts.withColumn("__upto", upto).select(*keys, *buckets, F.expr(f"(__upto - 1) div {max(1, CHUNK_ROWS // 2)}").alias(_CHUNK))
    return join_on(rows, cuts, [*keys, *buckets], "inner").drop(*buckets)


def series(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bounded: bool = False, chunk: Column | None = None
) -> Series:
    """``order`` must be total inside a series, else results are not repeatable."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    if bounded:
        return Series(df, list(keys), cols, False)
    rows = planned_chunks(df, keys, cols) if chunk is None else df.withColumn(_CHUNK, chunk)
    return Series(rows, list(keys), cols, True)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: dict[str, Column],
    strict: bool = True,
    bounded: bool = False,
    chunk: Column | None = None,
) -> DataFrame:
    """Cumulative sums (F2). Strict: NULL from the first NULL input on."""
    s = series(df, keys, order, bounded, chunk)
    value = {name: f"__v_{name}" for name in sums}
    gap = {name: f"__g_{name}" for name in sums}
    rows = s.df.withColumns(
        {value[n]: e for n, e in sums.items()}
    ).withColumns({gap[n]: F.col(value[n]).isNull().cast("long") for n in sums})
    out = rows.withColumns(
        {
            **{f"__s_{n}": F.sum(value[n]).over(s.running()) for n in sums},
            **{f"__n_{n}": F.sum(gap[n]).over(s.running()) for n in sums},
        }
    )
    if s.chunked:
        totals = rows.groupBy(*s.groups).agg(
            *[F.sum(value[n]).alias(f"__ts_{n}") for n in sums],
            *[F.sum(gap[n]).alias(f"__tn_{n}") for n in sums],
        )
        offsets = totals.select(
            *s.groups,
            *[F.sum(f"__ts_{n}").over(s.earlier_chunks()).alias(f"__os_{n}") for n in sums],
            *[F.sum(f"__tn_{n}").over(s.earlier_chunks()).alias(f"__on_{n}") for n in sums],
        )
        out = s.carry(out, offsets)
        for n in sums:
            both = F.coalesce(F.col(f"__s_{n}"), F.lit(0)) + F.coalesce(F.col(f"__os_{n}"), F.lit(0))
            none = F.col(f"__s_{n}").isNull() & F.col(f"__os_{n}").isNull()
            out = out.withColumns(
                {
                    f"__s_{n}": F.when(~none, both),
                    f"__n_{n}": F.col(f"__n_{n}") + F.coalesce(F.col(f"__on_{n}"), F.lit(0)),
                }
            ).drop(f"__os_{n}", f"__on_{n}")
    final = {
        n: F.when(F.col(f"__n_{n}") == 0, F.col(f"__s_{n}")) if strict else F.col(f"__s_{n}") for n in sums
    }
    temporary = [f"__{p}_{n}" for n in sums for p in ("v", "g", "s", "n")]
    return s.done(out.withColumns(final), *temporary)


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str = "position",
    bounded: bool = False,
    chunk: Column | None = None,
) -> DataFrame:
    """1-based row number inside each series."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")}, bounded=bounded, chunk=chunk)


def with_run_id(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    value: str,
    name: str = "run_id",
    bounded: bool = False,
    chunk: Column | None = None,
) -> DataFrame:
    """Number the runs of equal neighbouring values (NULL equals NULL) inside each series."""
    s = series(df, keys, order, bounded, chunk)
    v = F.struct(F.col(value))
    changed = ~v.eqNullSafe(F.lag(v).over(s.window()))
    out = s.df.withColumn("__step", changed.cast("long")).withColumn(
        name, F.sum("__step").over(s.running())
    )
    if s.chunked:
        edges = out.groupBy(*s.groups).agg(
            F.max(name).alias("__runs"),
            F.min_by(v, F.struct(*s.order)).alias("__head"),
            F.max_by(v, F.struct(*s.order)).alias("__tail"),
        )
        edges = edges.withColumn(
            "__joined", F.col("__head").eqNullSafe(F.lag("__tail").over(s.chunk_window())).cast("long")
        )
        # a chunk that goes on with the value of the chunk before it opens no new run
        offsets = edges.select(
            *s.groups,
            (
                F.coalesce(F.sum("__runs").over(s.earlier_chunks()), F.lit(0))
                - F.sum("__joined").over(s.chunk_window().rowsBetween(Window.unboundedPreceding, 0))
            ).alias("__offset"),
        )
        out = s.carry(out, offsets).withColumn(name, F.col(name) + F.col("__offset"))
    return s.done(out, "__step", "__offset")


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    value: str,
    at: str | None = None,
    bounded: bool = False,
    chunk: Column | None = None,
) -> DataFrame:
    """Known values around each row, as structs (at, value).

    Adds ``before`` (last non-NULL value up to and with this row), ``after`` (first one behind this row)
    and ``upcoming`` (``at`` of the next row). ``at`` is a column, or the row number when not given; that
    one is added as ``position``.
    """
    s = series(df, keys, order, bounded, chunk)
    out, axis = s.df, at or "position"
    if at is None:
        out = out.withColumn("position", F.row_number().over(s.window()).cast("long"))
        if s.chunked:
            counts = out.groupBy(*s.groups).agg(F.count(F.lit(1)).alias("__rows"))
            offsets = counts.select(*s.groups, F.sum("__rows").over(s.earlier_chunks()).alias("__offset"))
            out = s.carry(out, offsets).withColumn(
                "position", F.col("position") + F.coalesce(F.col("__offset"), F.lit(0))
            ).drop("__offset")
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(axis).alias("at"), F.col(value).alias("value")))
    out = out.withColumn("__known", known)
    out = out.withColumns(
        {
            "before": F.last("__known", ignorenulls=True).over(s.running()),
            "after": F.last("__known", ignorenulls=True).over(s.behind()),
            "upcoming": F.lead(axis).over(s.window()),
        }
    )
    if s.chunked:
        ends = out.groupBy(*s.groups).agg(
            F.min_by("__known", F.when(F.col("__known").isNotNull(), F.struct(*s.order))).alias("__lo"),
            F.max_by("__known", F.when(F.col("__known").isNotNull(), F.struct(*s.order))).alias("__hi"),
            F.min_by(axis, F.struct(*s.order)).alias("__first"),
        )
        reach = ends.select(
            *s.groups,
            F.last("__hi", ignorenulls=True).over(s.earlier_chunks()).alias("__prev"),
            F.last("__lo", ignorenulls=True).over(s.later_chunks()).alias("__next"),
            F.lead("__first").over(s.chunk_window()).alias("__then"),
        )
        out = s.carry(out, reach).withColumns(
            {
                "before": F.coalesce("before", "__prev"),
                "after": F.coalesce("after", "__next"),
                "upcoming": F.coalesce("upcoming", "__then"),
            }
        )
    return s.done(out, "__known", "__prev", "__next", "__then")

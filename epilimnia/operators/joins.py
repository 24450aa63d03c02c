"""Joins: NULL-safe natural joins, lookups, day sets, interval tags, phases.

No join here carries a broadcast hint: Spark broadcasts a side only after its own size check
(``spark.sql.autoBroadcastJoinThreshold``, again at run time under AQE) and otherwise shuffles, where
AQE splits a hot key on the row side.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import join_on
from .scan import running_sums

def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner", on: Sequence[str] | None = None) -> DataFrame:
    """Join on every shared column name, NULL matching NULL.

    A full outer join cannot be split when a key is hot, so it is written as matches + rows of a without a
    match + rows of b without one: three joins that AQE can split. The columns are the keys, then the rest
    of a, then the rest of b.
    """
    on = list(on) if on is not None else shared_columns(a, b)
    if how != "full":
        return join_on(a, b, on, how)
    if set(on) == set(a.columns) == set(b.columns):
        return _merge_equal_rows(a, b, on)
    both = join_on(a, b, on, "inner")
    only_a = join_on(a, b.select(*on).distinct(), on, "left_anti")
    only_b = join_on(b, a.select(*on).distinct(), on, "left_anti")
    out = both.unionByName(only_a, allowMissingColumns=True).unionByName(only_b, allowMissingColumns=True)
    return out.select(*on, *[c for c in (*a.columns, *b.columns) if c not in on])


def _merge_equal_rows(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full join of tables with the same columns: count equal rows, then repeat them; nothing is joined."""
    sides = a.select(*on, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(
        b.select(*on, F.lit(0).alias("__a"), F.lit(1).alias("__b"))
    )
    counts = sides.groupBy(*on).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    product, total = F.col("__a") * F.col("__b"), F.col("__a") + F.col("__b")
    times = F.when(product > 0, product).otherwise(total)
    return counts.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*on)


def lookup(df: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a lookup table, one row per key (D3)."""
    return df.join(dim, list(keys), "left")


def standardise(df: DataFrame, names: DataFrame, col: str, new: str) -> DataFrame:
    """Replace names by standard names; rows without one are dropped.

    ``names`` has the columns ``col`` and ``new``.
    """
    cols = df.columns
    return df.join(names.select(col, new), col, "inner").drop(col).withColumnRenamed(new, col).select(*cols)


def join_flags(obs: DataFrame, flags: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Observations with their flags, many-to-many."""
    return natural_join(obs, flags, "inner", keys)


def exclude_days(df: DataFrame, other: DataFrame, keys: Sequence[str] = ("Date",)) -> DataFrame:
    """Rows whose keys do not occur in the other table."""
    return join_on(df, other.select(*keys).distinct(), keys, "left_anti")


def day_cells(windows: DataFrame, keys: Sequence[str], start: str, end: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per key and calendar day covered by an inclusive date window.

    For control tables whose windows carry a label; ``covered_days`` is the compact form without one.
    """
    day = F.explode(F.sequence(F.col(start).cast("date"), F.col(end).cast("date"))).alias("__day")
    return (
        windows.where(F.col(start) <= F.col(end)).select(*keys, *keep, day).distinct()
    )


_WIDTH = 64


def _block(day: Column) -> Column:
    return F.floor(day / _WIDTH).cast("int")


def covered_days(windows: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Days covered by inclusive date windows: per key and block of 64 days one row with a bit per day.

    Overlapping windows fall together in the bits, so a row matches at most once, without a range
    condition. A window costs one row per 64 days, combined before the shuffle.
    """
    rows = windows.where(F.col(start) <= F.col(end)).select(
        *keys, F.unix_date(F.col(start).cast("date")).alias("__a"), F.unix_date(F.col(end).cast("date")).alias("__b")
    )
    rows = rows.withColumn("__block", F.explode(F.sequence(_block(F.col("__a")), _block(F.col("__b")))))
    first = F.col("__block") * _WIDTH
    lo = F.greatest(F.col("__a") - first, F.lit(0))
    hi = F.least(F.col("__b") - first, F.lit(_WIDTH - 1))
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (_WIDTH - 1) - (hi - lo))
    bits = F.call_function("shiftleft", ones, lo)
    return rows.groupBy(*keys, "__block").agg(F.bit_or(bits).alias("__bits"))


def _with_cover(df: DataFrame, windows: DataFrame, time: Column | str, keys: Sequence[str], start: str, end: str) -> DataFrame:
    time = F.col(time) if isinstance(time, str) else time
    rows = df.withColumn("__day", F.unix_date(F.to_date(time)))
    rows = rows.withColumn("__block", _block(F.col("__day")))
    rows = join_on(rows, covered_days(windows, keys, start, end), [*keys, "__block"], "left")
    bit = F.call_function("shiftrightunsigned", F.col("__bits"), F.col("__day") - F.col("__block") * _WIDTH)
    return rows.withColumn("__hit", F.coalesce(bit.bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))).drop(
        "__day", "__block", "__bits"
    )


def tag_intervals(
    df: DataFrame,
    intervals: DataFrame,
    time: Column | str,
    keys: Sequence[str],
    start: str,
    end: str,
    out: str = "state",
    on: str = "On",
    off: str = "Off",
) -> DataFrame:
    """Tag each row by whether its day lies in an interval of its key (D12); every row comes back once."""
    tagged = _with_cover(df, intervals, time, keys, start, end)
    return tagged.withColumn(out, F.when(F.col("__hit"), F.lit(on)).otherwise(F.lit(off))).drop("__hit")


def within_windows(
    df: DataFrame, windows: DataFrame, time: Column | str, keys: Sequence[str], start: str, end: str
) -> DataFrame:
    """Rows whose day lies in a window of their key."""
    return _with_cover(df, windows, time, keys, start, end).where("__hit").drop("__hit")


def open_intervals(
    df: DataFrame, intervals: DataFrame, time: str, keys: Sequence[str], start: str, end: str, out: str = "open"
) -> DataFrame:
    """Number of intervals of its key that hold each row's time, both ends included, at the resolution of the times.

    One ordered scan over starts, rows and ends together counts what is open, so long, many or overlapping intervals and
    hot keys cost no range join, and every row comes back once. NULL times and ends and reversed intervals hold nothing.
    """
    valid = intervals.where(F.col(start) <= F.col(end))
    mark = lambda at, kind, step: [*keys, F.col(at).alias("__at"), F.lit(kind).alias("__kind"), F.lit(step).alias("__step")]
    rows = df.select(*mark(time, 1, 0), F.struct(*df.columns).alias("__row"))
    marks = valid.select(*mark(start, 0, 1)).unionAll(valid.select(*mark(end, 2, -1)))
    swept = running_sums(rows.unionByName(marks, allowMissingColumns=True), keys, ["__at", "__kind"], {"__open": F.col("__step").cast("long")}, strict=False)
    held = F.when(F.col("__at").isNull(), F.lit(0).cast("long")).otherwise(F.col("__open"))
    return swept.where("__kind = 1").withColumn("__open", held).select("__row.*", F.col("__open").alias(out))


def tag_intervals_at(
    df: DataFrame, intervals: DataFrame, time: str, keys: Sequence[str], start: str, end: str, out: str = "state",
    on: str = "On", off: str = "Off",
) -> DataFrame:
    """``tag_intervals`` for intervals that begin and end within a day."""
    tagged = open_intervals(df, intervals, time, keys, start, end, "__held")
    return tagged.withColumn(out, F.when(F.col("__held") > 0, F.lit(on)).otherwise(F.lit(off))).drop("__held")


def within_intervals(df: DataFrame, intervals: DataFrame, time: str, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Rows whose time lies in an interval of their key."""
    return open_intervals(df, intervals, time, keys, start, end, "__held").where("__held > 0").drop("__held")


def phase_of(
    df: DataFrame,
    events: DataFrame,
    time: str,
    keys: Sequence[str],
    event_date: str,
    windows: DataFrame | None = None,
    window_keys: Sequence[str] = (),
    out: str = "phase",
    before: str = "Pre",
    after: str = "Post",
    rule_order: str | None = None,
) -> DataFrame:
    """Phase of a row relative to the event of its key and year.

    On or after the event: ``after``; before it: ``before``; no event that year: NULL. Where
    ``windows`` (``window_keys``, start, end, phase) names a key and year, the time before the event
    takes its phase from those windows alone, and is NULL outside them. Where they overlap, the last one
    holds: by ``rule_order``, a column of ``windows``, or without one the window that starts last.
    """
    ev = (
        events.withColumn("__year", F.year(event_date))
        .groupBy(*keys, "__year")
        .agg(F.min(event_date).alias("__event"))
    )
    rows = df.withColumns({"__year": F.year(time), "__day": F.to_date(time)})
    rows = join_on(rows, ev, [*keys, "__year"], "left")
    early = F.lit(before)
    temporary = ["__year", "__day", "__event"]
    if windows is not None:
        special = windows.select(*keys, F.year("start").alias("__year"), F.lit(True).alias("__special")).distinct()
        # one phase per key and day: of overlapping windows the last rule holds
        rule = F.col(rule_order) if rule_order else F.struct("start", "end", "phase")
        cells = day_cells(windows.withColumn("__rule", rule), window_keys, "start", "end", keep=["phase", "__rule"])
        cells = cells.groupBy(*window_keys, "__day").agg(F.max_by("phase", "__rule").alias("__phase"))
        rows = join_on(rows, special, [*keys, "__year"], "left")
        rows = join_on(rows, cells, [*window_keys, "__day"], "left")
        early = F.when(F.col("__special"), F.col("__phase")).otherwise(F.lit(before))
        temporary += ["__special", "__phase"]
    phase = F.when(F.col("__day") >= F.col("__event"), F.lit(after)).when(
        F.col("__day") < F.col("__event"), early
    )
    return rows.withColumn(out, phase).drop(*temporary)

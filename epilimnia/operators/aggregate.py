"""Grouped aggregates. All of them combine on the map side before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import strict_avg, strict_max, strict_sum
from ..functions.scalars import half_even, ratio
from .keyed import join_on


def daily_mean(
    df: DataFrame, keys: Sequence[str], ts: str, names: Sequence[str] | str, date: str = "Date"
) -> DataFrame:
    """Mean per key and day, NULLs skipped."""
    names = [names] if isinstance(names, str) else list(names)
    return df.groupBy(*keys, F.to_date(ts).alias(date)).agg(*[F.avg(c).alias(c) for c in names])


def daily_mean_gated(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    col: str,
    min_n: int,
    count_nulls: bool = False,
    date: str = "Date",
    n: str | None = None,
) -> DataFrame:
    """Daily mean that is NULL when the day has fewer than ``min_n`` samples.

    ``count_nulls`` counts rows instead of values. Days without any value are kept only then.
    """
    if not count_nulls:
        df = df.where(F.col(col).isNotNull())
    out = df.groupBy(*keys, F.to_date(ts).alias(date)).agg(
        F.avg(col).alias("__mean"), F.count(F.lit(1)).alias("__n")
    )
    mean = F.when(F.col("__n") >= min_n, F.col("__mean")).alias(col)
    extra = [F.col("__n").alias(n)] if n else []
    return out.select(*keys, date, mean, *extra)


def mean_reps(df: DataFrame, keys: Sequence[str], names: Sequence[str], strict: Sequence[str] = ()) -> DataFrame:
    """Mean over replicates; columns in ``strict`` give NULL when one replicate is NULL."""
    return df.groupBy(*keys).agg(*[(strict_avg(c) if c in strict else F.avg(c)).alias(c) for c in names])


#: Steps of a value's bucket for each doubling of its size.
_STEPS = 1 << 16


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles by linear interpolation between order statistics, one column per entry."""
    return exact_quantiles_of(df, keys, {col: probs})


def exact_quantiles_of(df: DataFrame, keys: Sequence[str], wanted: dict[str, dict[str, float]]) -> DataFrame:
    """Exact quantiles of several columns: ``wanted`` gives result name and share for each column.

    Radix selection: all columns in one pass are counted by the leading bits of their values, a running sum over the counts (as
    many as a group's values have leading bits, not rows) finds the bucket of each wanted rank, and only the values of those
    buckets, equal to five digits, are counted and ranked in a second pass. NULLs are left out, infinite values keep their
    order, and NaN counts as the largest value.
    """
    cells = [F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(wanted)]
    values = df.select(*keys, F.explode(F.array(*cells)).alias("__x")).select(*keys, F.col("__x.c").alias("__c"), F.col("__x.v").alias("__v"))
    v = F.col("__v")
    bucket = F.when(F.isnan(v), F.lit(1e19)).otherwise(F.signum(v) * F.floor(F.log2(1 + F.abs(v)) * _STEPS))
    values = values.where(v.isNotNull()).withColumn("__b", bucket)
    groups = [*keys, "__c"]

    def ranked(counts: DataFrame, within: Sequence[str], by: str, before: Column) -> DataFrame:
        upto = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.withColumn("__to", F.sum("__n").over(upto) + before).withColumn("__from", F.col("__to") - F.col("__n"))

    def at(p: float) -> Column:
        return F.lit(p) * (F.col("__size") - 1)

    def holds(rank: Column) -> Column:
        return (F.col("__from") <= rank) & (rank < F.col("__to"))

    names = [(i, name, p) for i, probs in enumerate(wanted.values()) for name, p in probs.items()]
    counts = values.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__n"))
    sized = ranked(counts, groups, "__b", F.lit(0)).withColumn("__size", F.sum("__n").over(Window.partitionBy(*groups)))
    needed = [(F.col("__c") == i) & (holds(F.floor(at(p))) | holds(F.ceil(at(p)))) for i, _, p in names]
    targets = sized.where(reduce(or_, needed)).select(*groups, "__b", "__size", F.col("__from").alias("__before"))
    inside = join_on(values, targets, [*groups, "__b"], "inner")
    exact = inside.groupBy(*groups, "__b", "__v").agg(F.count(F.lit(1)).alias("__n"), F.max("__size").alias("__size"), F.max("__before").alias("__before"))
    exact = ranked(exact, [*groups, "__b"], "__v", F.col("__before"))
    picks, out = [], []
    for i, name, p in names:
        own = F.col("__c") == i
        picks += [
            F.max(F.when(own & holds(F.floor(at(p))), v)).alias(f"__lo_{name}"),
            F.max(F.when(own & holds(F.ceil(at(p))), v)).alias(f"__hi_{name}"),
            F.max(F.when(own, at(p) - F.floor(at(p)))).alias(f"__w_{name}"),
        ]
        low, high, w = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), F.col(f"__w_{name}")
        out.append(F.when(low == high, low).otherwise(low * (1 - w) + high * w).alias(name))
    return exact.groupBy(*keys).agg(*picks).select(*keys, *out)


def summarise_stats(
    df: DataFrame, keys: Sequence[str], names: dict[str, str], digits: int = 3
) -> DataFrame:
    """Mean, median, min and max per group, rounded half to even (E5).

    ``names``: column -> suffix of the result columns Mean*, Median*, Min*, Max*.
    """
    aggs = []
    for c, s in names.items():
        aggs += [
            half_even(F.avg(c), digits).alias(f"Mean{s}"),
            half_even(F.min(c), digits).alias(f"Min{s}"),
            half_even(F.max(c), digits).alias(f"Max{s}"),
        ]
    medians = exact_quantiles_of(df, keys, {c: {f"Median{s}": 0.5} for c, s in names.items()})
    out = join_on(df.groupBy(*keys).agg(*aggs), medians, keys, "left")
    return out.withColumns({f"Median{s}": half_even(f"Median{s}", digits) for s in names.values()})


def season_summary(
    df: DataFrame, keys: Sequence[str], date: str, days: str, totals: dict[str, str], digits: int = 3
) -> DataFrame:
    """Season totals from cumulative columns: strict max, days, last date, rate per day.

    ``totals``: cumulative column -> name of its rate.
    """
    out = df.groupBy(*keys).agg(
        *[strict_max(c).alias(c) for c in totals],
        strict_sum(days).alias(days),
        F.max(date).alias(date),
    )
    return out.withColumns({r: half_even(ratio(c, days), digits) for c, r in totals.items()})


def profile_ends(df: DataFrame, keys: Sequence[str], depth: str, names: Sequence[str]) -> DataFrame:
    """Top and bottom depth of each profile with the values there (E9), in one aggregate."""
    aggs = [F.min(depth).alias("top"), F.max(depth).alias("bottom")]
    for c in names:
        aggs += [F.min_by(c, depth).alias(f"{c}_top"), F.max_by(c, depth).alias(f"{c}_bottom")]
    return df.groupBy(*keys).agg(*aggs)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First whole row per key (E11): a minimum by the order, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    first = F.min_by(row, F.struct(*[F.col(c) for c in order])).alias("__row")
    return df.groupBy(*keys).agg(first).select(*[
        F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns
    ])


def slice_min(df: DataFrame, keys: Sequence[str], col: str, bounded: bool = False) -> DataFrame:
    """Rows at the minimum of their group, ties kept.

    ``bounded``: groups are small by construction (for instance days of a year), so one ranking window
    replaces the aggregate and join.
    """
    if bounded:
        w = Window.partitionBy(*keys).orderBy(col)
        return df.withColumn("__rank", F.rank().over(w)).where("__rank = 1").drop("__rank")
    low = df.groupBy(*keys).agg(F.min(col).alias(col))
    return join_on(df, low, [*keys, col], "left_semi")


def attach_stats(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Group aggregates attached to every row (F1): aggregate, then join back."""
    return join_on(df, df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]), keys, "left")


def having_rows(df: DataFrame, keys: Sequence[str], n: int, bounded: bool = False) -> DataFrame:
    """Rows of groups with at least ``n`` rows (F10); ``bounded`` as in ``slice_min``."""
    if bounded:
        size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        return df.withColumn("__n", size).where(F.col("__n") >= n).drop("__n")
    enough = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= n)
    return join_on(df, enough.select(*keys), keys, "left_semi")


def mean_ratio(df: DataFrame, keys: Sequence[str], ratios: dict[str, tuple[str, str]], digits: int = 3) -> DataFrame:
    """Rounded mean of a / b per group."""
    return df.groupBy(*keys).agg(
        *[half_even(F.avg(ratio(a, b)), digits).alias(name) for name, (a, b) in ratios.items()]
    )

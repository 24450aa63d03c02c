"""Regression, paired test and density by group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pvalues import t_quantile, two_sided_p
from ..functions.scalars import ratio
from .aggregate import exact_quantiles
from .keyed import join_on


def linear_fit(
    df: DataFrame, y: str, x: Column | str, keys: Sequence[str] = (), summary: bool = False
) -> DataFrame:
    """Least-squares line per group (E17); ``summary`` adds errors, t, p, R2, F.

    Everything comes from mergeable moment aggregates, so a group of any size is one pass.
    """
    x = F.col(x) if isinstance(x, str) else x
    rows = df.select(*keys, F.col(y).cast("double").alias("__y"), x.cast("double").alias("__x"))
    rows = rows.where(F.col("__y").isNotNull() & F.col("__x").isNotNull())
    fit = rows.groupBy(*keys).agg(
        F.regr_slope("__y", "__x").alias("slope"),
        F.regr_intercept("__y", "__x").alias("intercept"),
        *(
            [
                F.count(F.lit(1)).alias("n"),
                F.regr_sxx("__y", "__x").alias("__sxx"),
                F.regr_syy("__y", "__x").alias("__syy"),
                F.regr_sxy("__y", "__x").alias("__sxy"),
                F.avg("__x").alias("__mx"),
            ]
            if summary
            else []
        ),
    )
    if not summary:
        return fit
    sxx, syy, sxy, n = F.col("__sxx"), F.col("__syy"), F.col("__sxy"), F.col("n")
    fit = fit.withColumns(
        {
            "df": (n - 2).cast("int"),
            "r_squared": ratio(sxy * sxy, sxx * syy),
            "__sse": F.greatest(syy - ratio(sxy * sxy, sxx), F.lit(0.0)),
        }
    )
    fit = fit.withColumn("residual_error", F.sqrt(ratio("__sse", "df")))
    fit = fit.withColumns(
        {
            "slope_error": ratio(F.col("residual_error"), F.sqrt(sxx)),
            "intercept_error": F.col("residual_error")
            * F.sqrt(ratio(F.lit(1.0), n) + ratio(F.col("__mx") * F.col("__mx"), sxx)),
        }
    )
    fit = fit.withColumns(
        {"slope_t": ratio("slope", "slope_error"), "intercept_t": ratio("intercept", "intercept_error")}
    )
    return fit.withColumns(
        {
            "slope_p": two_sided_p(F.col("slope_t"), F.col("df")),
            "intercept_p": two_sided_p(F.col("intercept_t"), F.col("df")),
            "f_statistic": F.col("slope_t") * F.col("slope_t"),
        }
    ).drop("__sxx", "__syy", "__sxy", "__sse", "__mx")


def fit_line(
    df: DataFrame, y: str, x: str, keys: Sequence[str], points: int = 80, quantile: float | None = None, level: float | None = None
) -> DataFrame:
    """Fitted line on an even grid of ``points`` x values per group.

    ``level``: confidence level of a band ``low``..``high``, by each group's own t quantile; ``quantile`` gives one for all
    groups instead. Groups of less than three points have no band.
    """
    group = [*keys, "__all"]
    df = df.withColumn("__all", F.lit(1))
    fits = linear_fit(df, y, x, group, summary=True)
    ok = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    span = ok.groupBy(*group).agg(
        F.min(x).cast("double").alias("__lo"),
        F.max(x).cast("double").alias("__hi"),
        F.avg(x).alias("__mx"),
        F.regr_sxx(y, x).alias("__sxx"),
    )
    grid = join_on(fits, span, group, "inner")
    if level is not None:  # it hangs on the degrees of freedom alone, so each of those is solved once
        solved = fits.select("df").distinct().withColumn("__quantile", t_quantile(level, F.col("df")))
        grid = join_on(grid, solved, ["df"], "left")
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    grid = grid.withColumn("__i", i).withColumn(
        "x", F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__i") / (points - 1)
    )
    grid = grid.withColumn("fit", F.col("intercept") + F.col("slope") * F.col("x"))
    out = [*keys, "x", "fit"]
    if quantile is not None or level is not None:
        if level is not None:
            quantile = F.col("__quantile")
        off = F.col("x") - F.col("__mx")
        half = quantile * F.col("residual_error") * F.sqrt(1 / F.col("n") + ratio(off * off, F.col("__sxx")))
        grid = grid.withColumns({"low": F.col("fit") - half, "high": F.col("fit") + half})
        out += ["low", "high"]
    return grid.select(*out)


def paired_t(
    df: DataFrame, pair: str, group: str, first: str, second: str, values: Sequence[str]
) -> DataFrame:
    """Paired t test of ``first`` minus ``second`` over the pair key, one row per value column."""
    sides = {first: "a", second: "b"}
    aggs = [
        F.avg(F.when(F.col(group) == g, F.col(v))).alias(f"__{s}_{v}") for g, s in sides.items() for v in values
    ]
    pairs = df.groupBy(pair).agg(*aggs)
    cells = [
        F.struct(F.lit(v).alias("measure"), (F.col(f"__a_{v}") - F.col(f"__b_{v}")).alias("d")) for v in values
    ]
    diffs = pairs.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where(F.col("d").isNotNull())
    out = diffs.groupBy("measure").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("d").alias("mean_difference"),
        F.stddev_samp("d").alias("__sd"),
    )
    t = ratio(F.col("mean_difference") * F.sqrt(F.col("pairs")), F.col("__sd"))
    out = out.withColumns({"df": (F.col("pairs") - 1).cast("int"), "t": t}).drop("__sd")
    return out.withColumn("p", two_sided_p(F.col("t"), F.col("df")))


def grouped_density(df: DataFrame, keys: Sequence[str], col: str, points: int = 512) -> DataFrame:
    """Gaussian kernel density per group on an even grid from its minimum to its maximum.

    Bandwidth: 0.9 * min(sd, IQR / 1.34) * n^-0.2, where a spread of 0 falls back to the standard deviation,
    then to the size of a value, then to 1, so a group of equal values keeps its rows. Values are first shared out linearly between their
    two grid neighbours, so a group of any size shrinks to at most ``points`` weights.
    """
    rows = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("__x"))
    shape = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("__x").alias("__lo"),
        F.max("__x").alias("__hi"),
        F.stddev_samp("__x").alias("__sd"),
    )
    quartiles = exact_quantiles(rows, keys, "__x", {"__q1": 0.25, "__q3": 0.75})
    shape = join_on(shape, quartiles, keys, "inner")
    iqr = (F.col("__q3") - F.col("__q1")) / 1.34
    deviation, size = F.coalesce("__sd", F.lit(0.0)), F.abs(F.col("__lo"))
    spread = (
        F.when((iqr > 0) & (deviation > 0), F.least(deviation, iqr))
        .when(deviation > 0, deviation)
        .when(size > 0, size)
        .otherwise(1.0)
    )
    shape = shape.withColumns(
        {
            "__h": 0.9 * spread * F.pow(F.col("__n"), F.lit(-0.2)),
            "__step": (F.col("__hi") - F.col("__lo")) / (points - 1),
        }
    )
    at = F.coalesce((F.col("__x") - F.col("__lo")) / F.nullif(F.col("__step"), F.lit(0.0)), F.lit(0.0))
    node = F.least(F.floor(at), F.lit(points - 2)).cast("int")
    binned = join_on(rows, shape, keys, "inner").select(*keys, node.alias("__k"), (at - node).alias("__w"))
    weights = binned.groupBy(*keys, "__k").agg(
        F.count(F.lit(1)).cast("double").alias("__c"), F.sum("__w").alias("__right")
    )
    # at most `points` entries per group
    table = weights.groupBy(*keys).agg(
        F.collect_list(F.struct("__k", (F.col("__c") - F.col("__right")).alias("l"), F.col("__right").alias("r"))).alias("__t")
    )
    grid = join_on(shape, table, keys, "inner").withColumn(
        "__i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    )

    def bell(cells: Column) -> Column:
        u = (F.col("__i") - cells) * F.col("__step") / F.col("__h")
        return F.exp(-u * u / 2)

    def add(total: Column, cell: Column) -> Column:
        return total + cell["l"] * bell(cell["__k"]) + cell["r"] * bell(cell["__k"] + 1)

    mass = F.aggregate("__t", F.lit(0.0), add)
    density = mass / (F.col("__n") * F.col("__h") * math.sqrt(2 * math.pi))
    x = F.col("__lo") + F.col("__i") * F.col("__step")
    return grid.select(*keys, x.alias("x"), density.alias("density"))

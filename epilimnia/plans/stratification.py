"""Stratified periods, turnover, buoyancy, two-site comparison.

All windows here run over one row per site and day (or per profile), so they are bounded by the
calendar: a century of days is 36 525 rows. The readings themselves are only ever aggregated.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.nulls import strict_max
from ..functions.scalars import buoyancy_squared, overlay_day, water_density
from ..operators.aggregate import having_rows, profile_ends, slice_min
from ..operators.fill import densify_daily
from ..operators.reshape import to_wide
from ..operators.runs import longest_run, profile_gradient, runs
from ..operators.select import patch, stack


def daily_stratification(profiles: DataFrame, density_diff: float = S.DENSITY_DIFF) -> DataFrame:
    """Stratified flag per site and calendar day, missing days interpolated.

    1 where the bottom water is denser than the top by more than ``density_diff`` and colder, else 0.
    Days between a 0 and a 1 get a fraction.
    """
    # depths without a reading are no profile end, but their day still belongs to the calendar
    known = profiles.withColumn("depth_m", F.when(F.col("observation").isNotNull(), F.col("depth_m")))
    ends = profile_ends(known, ["site_id", "datetime"], "depth_m", ["observation"])
    top, bottom = F.col("observation_top"), F.col("observation_bottom")
    difference = water_density(bottom) - water_density(top)
    stratified = (difference > density_diff) & (top > bottom)
    flag = F.when(F.col("top").isNotNull(), F.when(stratified, F.lit(1.0)).otherwise(F.lit(0.0)))
    daily = ends.select("site_id", "datetime", flag.alias("strat"))
    return densify_daily(daily, ["site_id"], "datetime", interpolated="strat", edges="nearest", bounded=True)


def periods_from_flags(flags: DataFrame, min_rows: int = S.MIN_ROWS_PER_YEAR) -> DataFrame:
    """Longest stratified run per site and year with enough days."""
    yearly = having_rows(flags.withColumn("year", F.year("datetime")), ["site_id", "year"], min_rows, bounded=True)
    table = runs(yearly, ["site_id", "year"], ["datetime"], "strat", bounded=True)
    best = longest_run(table, ["site_id", "year"], "strat", 1.0)
    return best.select("year", "length", "start", "end", "site_id")


def stratified_periods(
    profiles: DataFrame, density_diff: float = S.DENSITY_DIFF, min_rows: int = S.MIN_ROWS_PER_YEAR
) -> DataFrame:
    """Onset, end and length of the stratified period per site and year (K4)."""
    return periods_from_flags(daily_stratification(profiles, density_diff), min_rows)


def mixed_days(flags: DataFrame) -> DataFrame:
    """Mixed-state series: 1 on days that are not stratified (K6)."""
    return flags.select(
        "datetime", "site_id", F.when(F.col("strat") == 0, F.lit(1)).otherwise(F.lit(0)).alias("observation")
    )


def turnover_dates(
    mixed: DataFrame,
    extra: DataFrame | None = None,
    after_day: int = S.TURNOVER_AFTER_DAY,
    before: str | None = S.SPAN[1],
    ref_year: int = 2001,
) -> DataFrame:
    """First mixed day after ``after_day`` per site and year, plus rows added by hand (K6)."""
    rows = mixed.withColumn("Year", F.year("datetime")).where(
        (F.col("observation") == 1) & (F.dayofyear("datetime") > after_day)
    )
    first = slice_min(rows, ["site_id", "Year"], "datetime", bounded=True)
    if before is not None:
        first = first.where(F.col("datetime") < F.lit(before).cast("date"))
    out = first.select("datetime", F.col("site_id").alias("Reservoir"), "Year").distinct()
    if extra is not None:
        out = stack(extra.select("datetime", "Reservoir", "Year"), out)
    return out.withColumn("MDay", overlay_day("datetime", ref_year))


def buoyancy_daily(profiles: DataFrame) -> DataFrame:
    """Largest squared buoyancy frequency per site and day (K17); NULL if any layer is unknown.

    Daily profiles have one row per sensor or depth bin, so a profile is bounded.
    """
    layers = profile_gradient(
        profiles.select("site_id", "datetime", "depth_m", "observation"),
        ["site_id", "datetime"],
        "depth_m",
        ["observation"],
        bounded=True,
    ).where(F.col("next_depth_m").isNotNull())
    n2 = buoyancy_squared(
        water_density("observation"), water_density("next_observation"), F.col("depth_m"), F.col("next_depth_m")
    )
    return layers.withColumn("n2", n2).groupBy("site_id", "datetime").agg(strict_max("n2").alias("bf"))


def comparable_profiles(profiles: DataFrame, since: int = S.BUOYANCY_SINCE, wrong: list[dict] = S.WRONG_PROFILE_POINTS) -> DataFrame:
    """Profiles of the compared years with known wrong readings set to NULL."""
    rows = profiles.where(F.year("datetime") >= since)
    for point in wrong:
        here = reduce(and_, [F.col(c) == F.lit(v) for c, v in point.items()])
        rows = patch(rows, here, "observation", F.lit(None).cast("double"))
    return rows


def by_site(df: DataFrame, ids: list[str], value: str, sites=S.SITES) -> DataFrame:
    """One column per site, for one-to-one comparison."""
    return to_wide(df, ids, "site_id", value, list(sites))


def period_compare(periods: DataFrame, sites=S.SITES) -> DataFrame:
    """Day of year of onset and end, one column per site."""
    long = periods.select("year", "site_id", "start", "end").unpivot(
        ["year", "site_id"], ["start", "end"], "name", "value"
    )
    return to_wide(long.withColumn("value", F.dayofyear("value")), ["year", "name"], "site_id", "value", list(sites))

"""Daily oxygen, daily weather, casts and the day x depth grids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.nulls import strict_sum
from ..functions.scalars import overlay_day, year_day_as_date
from ..operators.aggregate import daily_mean, first_per_key
from ..operators.grid import grid_interpolate
from ..operators.joins import exclude_days, natural_join
from ..operators.quality import any_window, between_time
from ..operators.reshape import to_long
from ..operators.select import add_rows, patch, stack_strict


@dataclass(frozen=True)
class OxygenSource:
    """One logger column, its depth label and method tag."""

    df: DataFrame
    col: str
    depth: str
    method: str
    since: str | None = None


def oxygen_logger(source: OxygenSource) -> DataFrame:
    """Daily mean oxygen of one logger (K15); days without a value are dropped."""
    df = source.df if source.since is None else between_time(source.df, "DateTime", source.since)
    daily = daily_mean(df, ["Reservoir", "Site"], "DateTime", source.col)
    return daily.select(
        "Reservoir",
        "Site",
        "Date",
        F.year("Date").alias("Year"),
        F.lit(source.depth).alias("Depth_m"),
        F.col(source.col).alias("DO_mgL"),
        F.lit(source.method).alias("Method"),
    ).dropna()


def handheld_windows(windows=S.HANDHELD_WINDOWS) -> list[Column]:
    return [
        (F.col("Reservoir") == site) & (F.col("Depth_m") == z) & F.col("Date").between(F.lit(a), F.lit(b))
        for site, z, a, b in windows
    ]


def oxygen_handheld(handheld: DataFrame, method: str = "edi.198.13") -> DataFrame:
    """Handheld oxygen inside the windows without a logger."""
    rows = handheld.withColumns({"Date": F.to_date("DateTime"), "Year": F.year("DateTime")})
    rows = any_window(rows, handheld_windows())
    return rows.select(
        "Reservoir", "Site", "Date", "Year", F.format_string("%.0f", "Depth_m").alias("Depth_m"), "DO_mgL",
        F.lit(method).alias("Method"),
    ).dropna()


def oxygen_daily(
    sources: Sequence[OxygenSource], breaks: DataFrame | None = None, until: str = "2023-12-31"
) -> DataFrame:
    """Daily oxygen of all loggers, equal rows merged, plus line-break rows."""
    # one row per station and day on either side
    out = reduce(lambda a, b: natural_join(a, b, "full"), [oxygen_logger(s) for s in sources])
    out = out.where(F.col("Date") <= F.lit(until).cast("date"))
    return out if breaks is None else add_rows(out, breaks)


def weather_daily(df: DataFrame, lo: str = S.SPAN[0], hi: str = S.SPAN[1]) -> DataFrame:
    """Daily air temperature, wind and strict rain sum in cm, with calendar columns.

    Means and sum share one pass; joining two daily tables back together is not needed.
    """
    rows = between_time(df, "DateTime", lo, hi)
    daily = rows.groupBy(F.to_date("DateTime").alias("Date")).agg(
        F.avg("AirTemp_C_Average").alias("AirTemp_C_Average"),
        F.avg("WindSpeed_Average_m_s").alias("WindSpeed_Average_m_s"),
        (strict_sum("Rain_Total_mm") / 10).alias("Rain_Total_sum_cm"),
    )
    return daily.withColumns(
        {"DOY": F.dayofyear("Date"), "Year": F.year("Date"), "ddate": year_day_as_date("Date")}
    )


def weather_long(daily: DataFrame, variable: str | None = None) -> DataFrame:
    """Long form, optionally one variable only."""
    long = to_long(daily, ["Date", "DOY", "Year", "ddate"], "variable", "obs")
    return long if variable is None else long.where(F.col("variable") == variable)


def profile_casts(df: DataFrame, sites: Sequence[str] = S.SITES) -> DataFrame:
    """Profiler casts of the study years below the surface (K7)."""
    rows = df.where(
        (F.col("DateTime") > F.lit(S.SPAN[0]).cast("timestamp"))
        & (F.col("DateTime") < F.lit("2023-12-31").cast("timestamp"))
        & F.col("Reservoir").isin(list(sites))
        & (F.col("Site") == S.MAIN_STATION)
        & (F.col("Depth_m") > 0)
    )
    rows = rows.drop(*[c for c in rows.columns if c.lower().startswith("flag")])
    return rows.withColumns({"Year": F.year("DateTime"), "Date": F.to_date("DateTime")})


def handheld_casts(df: DataFrame, sites: Sequence[str] = S.SITES) -> DataFrame:
    """Handheld casts of the study years (K7)."""
    rows = between_time(df, "DateTime", S.SPAN[0], "2023-12-31", closed="both").where(
        F.col("Reservoir").isin(list(sites)) & (F.col("Site") == S.MAIN_STATION) & (F.col("Depth_m") >= 0)
    )
    return rows.withColumns({"Year": F.year("DateTime"), "Date": F.to_date("DateTime")})


def merge_casts(
    profiler: DataFrame, handheld: DataFrame, values: Sequence[str], keys: Sequence[str] = ("Date",),
    drop_null_before: bool = False,
) -> DataFrame:
    """Profiler casts plus handheld casts of days without a profiler cast (K7).

    ``drop_null_before`` drops incomplete rows first, so only complete profiler rows claim a day.
    Handheld samples of 29 Feb 2020 are moved to the day before.
    """
    names = ["Reservoir", "Site", "DateTime", "Depth_m", *values, "Date", "Year"]
    a, b = profiler.select(*names), handheld.select(*names)
    claims = profiler
    if drop_null_before:
        a, b = a.dropna(), b.dropna()
        claims = a
    b = exclude_days(b, claims, keys)
    b = patch(b, F.col("Date") == F.lit("2020-02-29").cast("date"), "Date", F.lit("2020-02-28").cast("date"))
    return stack_strict(a, b).dropna()


def turbidity_casts(profiler: DataFrame, limit: float = S.MAX_TURBIDITY) -> DataFrame:
    """Profiler turbidity up to the sensor's limit; there are no handheld readings of it (K7)."""
    names = ["Reservoir", "Site", "DateTime", "Depth_m", "Turbidity_NTU", "Date", "Year"]
    return profiler.select(*names).dropna().where(F.col("Turbidity_NTU") <= limit)


def cast_days(rows: DataFrame, ref_year: int = 2001) -> DataFrame:
    """First cast per site and day, with its overlay day (K7)."""
    first = first_per_key(rows.select("Reservoir", "Date", "DateTime", "Year"), ["Reservoir", "Date"], ["DateTime"])
    return first.withColumn("MDay", overlay_day("Date", ref_year))


def heatmap_grid(
    rows: DataFrame, variables: Sequence[str], ref_year: int = 2001, limits: dict = S.SCALE_LIMITS,
    dz: float = S.GRID_STEP, min_depth: float = S.GRID_MIN_DEPTH,
) -> DataFrame:
    """Day x depth grids of several variables, per site, year and variable, in one job (K8).

    ``z_shown`` is ``z`` inside the colour scale, else NULL.
    """
    ids = ["Reservoir", "DateTime", "Depth_m"]
    long = to_long(rows.select(*ids, *variables), ids, "variable", "value").withColumn("Year", F.year("DateTime"))
    grid = grid_interpolate(
        long, ["Reservoir", "Year", "variable"], "DateTime", "Depth_m", "value", dz, keep_empty=False, depth_range=S.DEPTH_RANGE
    ).where(F.col("y") > min_depth)
    shown = F.col("z")
    for name, (lo, hi) in limits.items():
        inside = F.when(F.col("z").between(lo, hi), F.col("z"))
        shown = F.when(F.col("variable") == name, inside).otherwise(shown)
    return grid.withColumns({"MDay": overlay_day("x", ref_year), "z_shown": shown})

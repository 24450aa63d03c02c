"""Sediment-trap fluxes: replicate means, phase, cumulative mass, season rates, summary table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..operators.aggregate import mean_reps, season_summary, summarise_stats
from ..operators.joins import natural_join, phase_of, within_windows
from ..operators.reshape import to_long
from ..operators.scan import running_sums
from ..operators.select import layer_at, relabel

SEASON = ["Reservoir", "Layer", "Year"]
CUMULATIVE = {"CumulFe_gm2": "Iron", "CumulMn_gm2": "Manganese"}
FLUXES = {"AvgTFeFlux_gm2d": "Iron", "AvgTMnFlux_gm2d": "Manganese"}


def average_fluxes(traps: DataFrame, events: DataFrame, windows: DataFrame | None) -> DataFrame:
    """Replicate means per trap and day with layer, year and phase before/after turnover."""
    rows = traps.select(
        "Reservoir", "Date", "Depth_m", "Duration_days", "TFeFlux_gm2d", "TMnFlux_gm2d"
    ).dropna()
    rows = rows.withColumns({"Layer": layer_at("Depth_m", S.TRAP_BOUNDARY), "Year": F.year("Date")})
    keys = ["Reservoir", "Date", "Depth_m", "Layer", "Year"]
    means = mean_reps(rows, keys, ["Duration_days", "TFeFlux_gm2d", "TMnFlux_gm2d"], strict=["Duration_days"])
    means = means.withColumnsRenamed({"TFeFlux_gm2d": "AvgTFeFlux_gm2d", "TMnFlux_gm2d": "AvgTMnFlux_gm2d"})
    return phase_of(means, events, "Date", ["Reservoir"], "Date", windows, ["Reservoir", "Layer"], out="TO")


def cumulative_fluxes(average: DataFrame, active: DataFrame | None = None, layer: str = "Hypolimnion") -> DataFrame:
    """Cumulative mass and days per season (K12); ``active`` keeps treatment seasons only.

    One row per site, day and trap depth is left here, so a season is bounded by the calendar.
    """
    rows = average.where((F.col("TO") == "Pre") & (F.col("Layer") == layer))
    if active is not None:
        rows = within_windows(rows, active, "Date", ["Year"], "start", "end")
    days = F.col("Duration_days")
    return running_sums(
        rows,
        SEASON,
        ["Date", "Depth_m"],
        {
            "CumulFe_gm2": F.col("AvgTFeFlux_gm2d") * days,
            "CumulMn_gm2": F.col("AvgTMnFlux_gm2d") * days,
            "CumulDuration_days": days,
        },
        bounded=True,
    )


def flux_season(cumulative: DataFrame) -> DataFrame:
    """Season totals and rates per day."""
    return season_summary(
        cumulative, SEASON, "Date", "Duration_days", {"CumulFe_gm2": "FeFlux", "CumulMn_gm2": "MnFlux"}
    )


def long_cumulative(cumulative: DataFrame) -> DataFrame:
    """Cumulative masses in long form with metal labels."""
    ids = ["Reservoir", "Date", "Depth_m", "Layer", "Year", "Duration_days", "TO", "CumulDuration_days"]
    return relabel(to_long(cumulative.select(*ids, *CUMULATIVE), ids, "Metal", "Fluxes_gm2"), "Metal", CUMULATIVE, True)


def long_fluxes(average: DataFrame) -> DataFrame:
    """Daily fluxes in long form with metal labels."""
    ids = ["Reservoir", "Date", "Depth_m", "Layer", "Year", "Duration_days", "TO"]
    return relabel(to_long(average.select(*ids, *FLUXES), ids, "Metal", "Fluxes_gm2d"), "Metal", FLUXES, True)


def long_season(season: DataFrame) -> DataFrame:
    """Season totals in long form with metal labels."""
    ids = [c for c in season.columns if c not in CUMULATIVE]
    return relabel(to_long(season, ids, "Metal", "Fluxes_gm2"), "Metal", CUMULATIVE, True)


def flux_table(average: DataFrame) -> DataFrame:
    """Report table: mean, median, smallest and largest flux before turnover."""
    rows = average.where(F.col("TO") == "Pre")
    return summarise_stats(rows, SEASON, {"AvgTFeFlux_gm2d": "FeFlux", "AvgTMnFlux_gm2d": "MnFlux"})


def rates_with_oxygen(season: DataFrame, oxygen: DataFrame, site: str = S.TREATED, since: int = 2018) -> DataFrame:
    """Season rates of the treated site next to oxygen at onset."""
    rates = season.where((F.col("Reservoir") == site) & (F.col("Year") >= since))
    return natural_join(rates.select("Reservoir", "Year", "FeFlux", "MnFlux"), oxygen, "full")

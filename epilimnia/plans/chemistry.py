"""Total and soluble metals: quality control, treatment state, onset against maximum, release rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.nulls import strict_max
from ..functions.scalars import overlay_day, ratio
from ..operators.aggregate import attach_stats, daily_mean, mean_ratio, slice_min
from ..operators.joins import join_on, natural_join, phase_of, tag_intervals, within_windows
from ..operators.quality import between_time, drop_flagged
from ..operators.reshape import to_long
from ..operators.scan import positions
from ..operators.select import layer_of, unswap
from ..operators.stats import linear_fit

METALS = ["TFe_mgL", "SFe_mgL", "TMn_mgL", "SMn_mgL"]
METAL_FLAGS = ["Flag_TFe_mgL", "Flag_SFe_mgL", "Flag_TMn_mgL", "Flag_SMn_mgL"]
DIFFS = {"FeDiff": ("TFe_mgL", "SFe_mgL"), "MnDiff": ("TMn_mgL", "SMn_mgL")}


def _unflagged(df: DataFrame) -> DataFrame:
    rows = drop_flagged(df, S.METALS_BAD_FLAGS, METAL_FLAGS)
    return rows.withColumns({d: F.col(t) - F.col(s) for d, (t, s) in DIFFS.items()})


def _layered(df: DataFrame, since: str, sites: Sequence[str]) -> DataFrame:
    rows = between_time(df, "DateTime", since).where(
        (F.col("Site") == S.MAIN_STATION) & F.col("Reservoir").isin(list(sites))
    )
    rows = rows.select("Reservoir", "Site", "DateTime", "Depth_m", *METALS, *METAL_FLAGS)
    rows = _unflagged(rows).withColumns(
        {
            "STFe": ratio("SFe_mgL", "TFe_mgL"),
            "STMn": ratio("SMn_mgL", "TMn_mgL"),
            "Date": F.to_date("DateTime"),
            "Year": F.year("DateTime"),
        }
    )
    return layer_of(rows, "Reservoir", "Depth_m", S.LAYER_BOUNDARY)


def _plausible(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("FeDiff") >= S.FE_TOLERANCE) & (F.col("MnDiff") >= S.MN_TOLERANCE))


def metals_rows(df: DataFrame, since: str = S.SPAN[0], sites: Sequence[str] = S.SITES) -> DataFrame:
    """Unflagged, plausible metals with differences, soluble shares and layers (K9): filters only."""
    return _plausible(_layered(df, since, sites))


def metals_qc(df: DataFrame, since: str = S.SPAN[0], sites: Sequence[str] = S.SITES) -> DataFrame:
    """``metals_rows`` with layer-day means (K9), taken before implausible rows are dropped."""
    means = {"AvgSTFe": F.avg("STFe"), "AvgSTMn": F.avg("STMn")}
    return _plausible(attach_stats(_layered(df, since, sites), ["Reservoir", "Site", "Date", "Layer"], means))


def metals_for_grid(df: DataFrame, since_year: int = 2018, max_depth: float = 9.0) -> DataFrame:
    """Unflagged metals of the day x depth figures (K9)."""
    rows = df.where((F.col("DateTime") >= F.lit(f"{since_year}-01-01").cast("timestamp")) & (F.col("Depth_m") <= max_depth))
    return _unflagged(rows).withColumns({"Year": F.year("DateTime"), "Date": F.to_date("DateTime")})


def metal_ratios(rows: DataFrame) -> DataFrame:
    """Soluble shares after repairing samples whose totals and solubles were both swapped (K9)."""
    fixed = unswap(rows, DIFFS, mode="both")
    return fixed.withColumns(
        {"Fe_ratio": ratio("SFe_mgL", "TFe_mgL"), "Mn_ratio": ratio("SMn_mgL", "TMn_mgL")}
    )


def sample_days(rows: DataFrame, ref_year: int = 2001) -> DataFrame:
    """Distinct sampling times with their overlay day."""
    return (
        rows.select("Reservoir", "DateTime", F.year("DateTime").alias("Year"))
        .distinct()
        .withColumn("MDay", overlay_day(F.to_date("DateTime"), ref_year))
    )


def treatment_intervals(intervals: DataFrame) -> DataFrame:
    """Intervals with number, year and day-of-year columns.

    The number follows site and dates. Only the counts per site and day meet in one place.
    """
    numbered = positions(intervals, [], ["Reservoir", "HOxOn", "HOxOff"], "Group")
    return numbered.withColumns(
        {
            "Group": F.col("Group").cast("string"),
            "Layer": F.lit("Hypolimnion"),
            "Year": F.year("HOxOn"),
            "DOYon": F.dayofyear("HOxOn"),
            "DOYoff": F.dayofyear("HOxOff"),
        }
    )


def treatment_onset(
    intervals: DataFrame, min_days: int = S.ONSET_MIN_DAYS, site: str = "Reservoir", start: str = "HOxOn", end: str = "HOxOff"
) -> DataFrame:
    """First interval of at least ``min_days`` per site and year, ties kept."""
    rows = intervals.where(F.date_diff(end, start) >= min_days)
    rows = rows.select(site, F.year(start).alias("Year"), start)
    return slice_min(rows, [site, "Year"], start)


def oxygen_at_onset(
    oxygen: DataFrame, handheld: DataFrame, onset: DataFrame, col: str = "RDOsat_percent_9_adjusted",
    handheld_at: str = "2018-04-23 09:45:00", handheld_depth: float = 9.0, site: str = S.TREATED,
) -> DataFrame:
    """Oxygen saturation on the onset days, completed by one handheld reading."""
    daily = daily_mean(oxygen, ["Reservoir", "Site"], "DateTime", col, "HOxStart")
    starts = onset.select("Reservoir", F.col("HOxOn").alias("HOxStart")).distinct()
    picked = join_on(daily, starts, ["Reservoir", "HOxStart"], "left_semi")
    logger = picked.select(
        "Reservoir", "Site", "HOxStart", F.col(col).alias("AvgDOsat_percent_9"), F.year("HOxStart").alias("Year")
    )
    hand = handheld.where(
        (F.col("Reservoir") == site)
        & (F.col("DateTime") == F.lit(handheld_at).cast("timestamp"))
        & (F.col("Depth_m") == handheld_depth)
    ).select(
        "Reservoir",
        "Site",
        F.to_date("DateTime").alias("HOxStart"),
        F.year("DateTime").alias("Year"),
        F.col("DOsat_percent").alias("AvgDOsat_percent_9"),
    )
    # both sides are a handful of rows per site and season
    return natural_join(logger, hand, "full")


def season_maximum(metals: DataFrame, windows: DataFrame, depth: float = 9.0, site: str = S.TREATED) -> DataFrame:
    """Strict seasonal maximum of total metals inside the active windows."""
    rows = metals.where((F.col("Depth_m") == depth) & (F.col("Reservoir") == site))
    rows = within_windows(rows, windows, "Date", ["Year"], "start", "end")
    return rows.groupBy("Reservoir", "Site", "Year").agg(
        strict_max("TFe_mgL").alias("MaxTFe_mgL"), strict_max("TMn_mgL").alias("MaxTMn_mgL")
    )


def onset_vs_max(
    oxygen: DataFrame, handheld: DataFrame, metals: DataFrame, onset: DataFrame, windows: DataFrame
) -> DataFrame:
    """Oxygen at treatment onset next to the seasonal metal maxima."""
    return natural_join(oxygen_at_onset(oxygen, handheld, onset), season_maximum(metals, windows), "full")


def ratio_by_state(metals: DataFrame, intervals: DataFrame, layer: str = "Hypolimnion") -> DataFrame:
    """Mean soluble share with treatment on and off."""
    rows = tag_intervals(
        metals.where(F.col("Layer") == layer), intervals, "Date", ["Reservoir"], "HOxOn", "HOxOff", out="HOx"
    )
    return mean_ratio(
        rows, ["Reservoir", "Layer", "HOx"], {"AvgSTFe": ("SFe_mgL", "TFe_mgL"), "AvgSTMn": ("SMn_mgL", "TMn_mgL")}
    )


def year_metals(metals: DataFrame, year: int, events: DataFrame) -> DataFrame:
    """One year's metals with swapped manganese pairs repaired, shares and phase.

    The year is asked for as a range of times, which reaches the scan.
    """
    one = between_time(metals, "DateTime", f"{year}-01-01", f"{year + 1}-01-01")
    rows = unswap(one, {"MnDiff": DIFFS["MnDiff"]}, mode="each")
    rows = rows.withColumns({"STFe": ratio("SFe_mgL", "TFe_mgL"), "STMn": ratio("SMn_mgL", "TMn_mgL")})
    return phase_of(rows, events, "Date", ["Reservoir"], "Date", out="TO")


def long_metal(rows: DataFrame, metal: str, layer: str = "Hypolimnion") -> DataFrame:
    """Total and soluble values of one metal in long form."""
    ids = ["Reservoir", "Date", "Site", "Layer", "Year", "Depth_m", "TO"]
    wide = rows.where(F.col("Layer") == layer).select(
        *ids, F.col(f"T{metal}_mgL").alias("Total"), F.col(f"S{metal}_mgL").alias("Soluble")
    )
    return to_long(wide, ids, "Type", f"{metal}_mgL")


def release_points(rows: DataFrame, from_date: str, metal: str = "Mn", depth: float = 9.0, site: str = S.TREATED) -> DataFrame:
    """Total values at the bottom between a start day and turnover."""
    return long_metal(rows, metal).where(
        (F.col("Type") == "Total")
        & (F.col("Reservoir") == site)
        & (F.col("Depth_m") == depth)
        & (F.col("TO") == "Pre")
        & (F.col("Date") >= F.lit(from_date).cast("date"))
    )


def release_rate(metals: DataFrame, year: int, from_date: str, events: DataFrame, metal: str = "Mn") -> DataFrame:
    """Release rate (slope per day) with its regression summary."""
    points = release_points(year_metals(metals, year, events), from_date, metal)
    return linear_fit(points, f"{metal}_mgL", F.unix_date("Date"), ["Year"], summary=True)

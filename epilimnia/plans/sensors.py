"""Sensor and sample targets, sensor depths, temperature profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.nulls import finite
from ..functions.scalars import depth_bin, half_even, to_number
from ..operators.aggregate import daily_mean_gated
from ..operators.fill import fill_gaps, interpolate
from ..operators.joins import join_on
from ..operators.reshape import to_long
from ..operators.select import cols, rename, rename_matching, stack

TARGET_COLUMNS = ["datetime", "site_id", "depth_m", "observation", "variable"]
TARGET_KEYS = ["site_id", "depth_m", "variable"]


def _main_station(df: DataFrame, names: dict[str, str], sites: Sequence[str]) -> DataFrame:
    df = rename(df.where(F.col("Site") == S.MAIN_STATION), names, missing_ok=True)
    return df.where(F.col("site_id").isin(list(sites))).drop("Site")


def _probe_depth(site: str, default: Column, is_probe: bool) -> Column:
    if not is_probe:
        return default
    out = default
    for name, z in S.PROBE_DEPTH.items():
        out = F.when(F.col(site) == name, F.lit(z)).otherwise(out)
    return out


def _name_depth(column: str) -> float | None:
    """Depth written in a column name as its third part."""
    parts = column.split("_")
    try:
        return float(parts[2])
    except (IndexError, ValueError):
        return None


def _cell(variable: str, depth: Column, value: Column) -> Column:
    return F.struct(
        F.lit(variable).alias("variable"),
        depth.cast("double").alias("depth_m"),
        value.cast("double").alias("observation"),
    )


def _good(flag: str, bad: Sequence[int]) -> Column:
    return F.col(f"`{flag}`").isNotNull() & ~F.col(f"`{flag}`").isin(list(bad))


def _flagged_sensors(df: DataFrame, names: dict[str, str], bad: Sequence[int]) -> list[Column]:
    """Sensors with a flag twin: value and flag sit in the same row, so no self-join is needed."""
    out = []
    for c in cols(df, contains=list(names), exclude=["flag"]):
        flag, base = f"Flag_{c}", c.split(".")[0]
        if flag in df.columns and base in names:
            depth = _probe_depth("site_id", F.lit(_name_depth(c)), "EXO" in c)
            out.append(_cell(names[base], depth, F.when(_good(flag, bad), F.col(f"`{c}`"))))
    return out


def _oxygen(df: DataFrame) -> list[Column]:
    return [
        _cell("DO_mgL", _probe_depth("site_id", F.lit(_name_depth(c)), "EXO" in c), F.col(f"`{c}`"))
        for c in S.OXYGEN_COLUMNS
        if c in df.columns
    ]


def _bottom_temperature(df: DataFrame) -> list[Column]:
    """Deepest thermistor where its flag is 0; the deepest one is known from the column names."""
    depths = {}
    for c in cols(df, starts=["ThermistorTemp"]):
        tail = c.rsplit("_", 1)[-1]
        depths[c] = 0.0 if tail == "surface" else float(tail)
    if not depths:
        return []
    deepest = max(depths, key=depths.get)
    flag = f"Flag_{deepest}"
    if flag not in df.columns:
        return []
    return [_cell("Temp_C", F.lit(depths[deepest]), F.when(F.col(f"`{flag}`") == 0, F.col(f"`{deepest}`")))]


def sensor_targets(
    sources: DataFrame | Sequence[DataFrame],
    interpolate_gaps: bool = True,
    maxgap: int = 12,
    names: dict[str, str] = S.SENSOR_NAMES,
    bad_flags: Sequence[int] = S.SENSOR_BAD_FLAGS,
    sites: Sequence[str] = S.SITES,
    step_seconds: int = S.STEP_SECONDS,
) -> DataFrame:
    """Quality-controlled sensor series on a regular grid (K1).

    Result: datetime, site_id, depth_m, observation, variable. One row per series and time is expected.
    With ``interpolate_gaps`` gaps of up to ``maxgap`` steps are filled.
    """
    sources = [sources] if isinstance(sources, DataFrame) else list(sources)
    out = []
    for raw in sources:
        df = _main_station(raw, {"DateTime": "datetime", "Reservoir": "site_id"}, sites)
        cells = [*_flagged_sensors(df, names, bad_flags), *_oxygen(df), *_bottom_temperature(df)]
        rows = df.select("datetime", "site_id", F.explode(F.array(*cells)).alias("c")).select("datetime", "site_id", "c.*")
        rows = rows.dropna().withColumn("observation", finite("observation")).select(*TARGET_COLUMNS)
        # gaps between files are gaps of no file, but are bridged like any other gap when short enough
        out.append(rows if len(sources) == 1 else fill_gaps(rows, TARGET_KEYS, "datetime", step_seconds))
    filled = stack(*out)
    if len(sources) == 1:
        column = "observation" if interpolate_gaps else None
        gap = maxgap if interpolate_gaps else None
        filled = fill_gaps(filled, TARGET_KEYS, "datetime", step_seconds, column, gap)
    elif interpolate_gaps:
        filled = interpolate(filled, TARGET_KEYS, ["datetime"], "observation", maxgap=maxgap)
    return filled.select(*TARGET_COLUMNS)


def sample_targets(
    sources: DataFrame | Sequence[DataFrame],
    bad_flags: Sequence[int] = S.SAMPLE_BAD_FLAGS,
    sites: Sequence[str] = S.SITES,
    match_rep: bool = False,
) -> DataFrame:
    """Replicate means of unflagged lab values (K5).

    Flags carry no replicate number, so every value of a sample meets the flag of every replicate. In
    that product each value occurs equally often, so the mean is the plain mean of the values as soon as
    one flag of the sample passes: one aggregate, no join. ``match_rep`` judges a value by its own flag.
    """
    sources = [sources] if isinstance(sources, DataFrame) else list(sources)
    out = []
    for raw in sources:
        df = _main_station(raw, S.SAMPLE_NAMES, sites)
        ids = [c for c in ("datetime", "site_id", "depth_m") if c in df.columns]
        flags = cols(df, contains=["flag"])
        values = [c for c in df.columns if f"Flag_{c}" in flags and c not in ids]
        has_rep = F.col("Rep").isNotNull() if "Rep" in df.columns and not match_rep else F.lit(True)
        aggs = []
        for c in values:
            passes = _good(f"Flag_{c}", bad_flags)
            value = F.col(f"`{c}`").cast("double")
            if match_rep:
                aggs.append(F.avg(F.when(passes, value)).alias(c))
            else:
                aggs.append(F.when(F.count(F.when(passes, 1)) > 0, F.avg(F.when(has_rep, value))).alias(c))
        wide = df.dropna(subset=ids).groupBy(*ids).agg(*aggs)
        out.append(to_long(wide, ids).where(F.col("observation").isNotNull()))
    return stack(*out).withColumn("method", F.lit("sample"))


def _offset_column(ts: Column, moved_on: str | None, before: str, after: str | None) -> Column:
    if moved_on is None:
        return F.col(before)
    moved = F.lit(moved_on).cast("timestamp")
    return F.when(ts.cast("timestamp") <= moved, F.col(before)).when(ts.cast("timestamp") > moved, F.col(after))


def _string_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    ids = cols(df, any_of=["Reservoir", "Site", "DateTime"])
    picked = [*ids, *cols(df, starts=["Depth"]), *cols(df, starts=["Ther", "RDO", "Lvl"])]
    rows = rename_matching(df.select(*picked), "Depth_m", "Depth")
    sensors = [c for c in rows.columns if c not in (*ids, "Depth_m")]
    for c in sensors:
        if len(c.split("_")) != 3:
            raise ValueError(f"{c!r} is not variable_units_position")
    return rows, sensors


def sensor_depths(
    df: DataFrame,
    offsets: DataFrame,
    moved_on: str | None = S.SENSORS_MOVED_ON,
    col_before: str = S.OFFSET_BEFORE,
    col_after: str | None = S.OFFSET_AFTER,
    round_digits: int = 2,
    bin_width: float = 0.25,
    wide: bool = False,
) -> DataFrame:
    """True depth of each sensor of a string from its position offset (K2).

    Long: one row per reading with a value and a depth. ``wide``: the input table with readings from
    above the water set to NULL.
    """
    offset_cols = [c for c in dict.fromkeys((col_before, col_after)) if c]
    if wide:
        return _wide_in_water(df, offsets, moved_on, col_before, col_after, offset_cols)
    rows, sensors = _string_columns(df)
    ids = ["Reservoir", "Site", "DateTime", "Depth_m"]
    numeric = rows.select(*ids, *[F.col(c).cast("double").alias(c) for c in sensors])
    long = to_long(numeric, ids, ["variable", "units", "Position"], cols=sensors, sep="_")
    long = long.withColumn("Position", to_number("Position")).where(F.col("observation").isNotNull())
    long = join_on(
        long, offsets.select("Position", "Reservoir", "Site", *offset_cols), ["Position", "Reservoir", "Site"], "left"
    )
    top = rows.agg(F.ceil(F.max("Depth_m")).cast("double")).scalar()
    long = long.withColumn(
        "sensor_depth", F.col("Depth_m") - _offset_column(F.col("DateTime"), moved_on, col_before, col_after)
    ).where(F.col("sensor_depth").isNotNull())
    return long.select(
        "Reservoir",
        "Site",
        half_even("Depth_m", round_digits).alias("Depth_m"),
        "DateTime",
        "variable",
        "Position",
        "observation",
        "sensor_depth",
        half_even("sensor_depth", round_digits).alias("rounded_depth"),
        depth_bin("sensor_depth", bin_width, top).alias("depth_bin"),
    )


def _wide_in_water(df, offsets, moved_on, col_before, col_after, offset_cols) -> DataFrame:
    """Offsets become one map per station, so the wide rows are cleaned in place: no unpivot, no pivot."""
    rows, sensors = _string_columns(df)
    depth = cols(df, starts=["Depth"])[0]
    entry = F.struct(F.col("Position").cast("double").alias("p"), F.struct(*offset_cols).alias("o"))
    maps = offsets.where(F.col("Position").isNotNull()).groupBy("Reservoir", "Site").agg(
        F.map_from_entries(F.collect_list(entry)).alias("__offsets")
    )
    out = join_on(df, maps, ["Reservoir", "Site"], "left")
    new = {}
    for c in sensors:
        position = c.split("_")[2]
        try:
            o = F.try_element_at("__offsets", F.lit(float(position)))
        except ValueError:
            o = None
        if o is None:
            new[c] = F.lit(None).cast("double")
            continue
        if moved_on is None:
            offset = o[col_before]
        else:
            ts, moved = F.col("DateTime").cast("timestamp"), F.lit(moved_on).cast("timestamp")
            offset = F.when(ts <= moved, o[col_before]).when(ts > moved, o[col_after])
        new[c] = F.when(F.col(depth) - offset >= 0, F.col(f"`{c}`"))
    return out.withColumns(new).select(*df.columns)


@dataclass(frozen=True)
class ProfileRule:
    """How one site's thermistors become daily profiles."""

    by_position: bool
    min_n: int
    count_nulls: bool = False


HISTORIC_RULES = {
    S.TREATED: ProfileRule(False, S.MIN_N_TREATED_HISTORIC, count_nulls=True),
    S.CONTROL: ProfileRule(True, S.MIN_N_CONTROL),
}
CURRENT_RULES = {
    S.TREATED: ProfileRule(False, S.MIN_N_TREATED_CURRENT),
    S.CONTROL: ProfileRule(True, S.MIN_N_CONTROL),
}


def _daily_profile(df: DataFrame, site: str, rule: ProfileRule, offsets: DataFrame | None, **depth_args) -> DataFrame:
    rows = df.where((F.col("Site") == S.MAIN_STATION) & (F.col("Reservoir") == site))
    if rule.by_position:
        if offsets is None:
            raise ValueError(f"{site} needs sensor offsets")
        picked = ["Reservoir", "Site", "DateTime", *cols(rows, starts=["Depth", "ThermistorTemp"])]
        long = sensor_depths(rows.select(*picked), offsets, **depth_args)
        long = long.where(F.col("depth_bin").isNotNull()).select(
            "Reservoir", "DateTime", F.col("depth_bin").alias("depth_m"), "observation"
        )
    else:
        names = cols(rows, starts=["ThermistorTemp"])
        cells = []
        for c in names:
            tail = c.removeprefix("ThermistorTemp_C_")
            z = 0.1 if tail == "surface" else float(tail)
            cells.append(F.struct(F.lit(z).alias("depth_m"), F.col(f"`{c}`").cast("double").alias("observation")))
        long = rows.select("Reservoir", "DateTime", F.explode(F.array(*cells)).alias("c")).select(
            "Reservoir", "DateTime", "c.*"
        )
    daily = daily_mean_gated(
        long, ["Reservoir", "depth_m"], "DateTime", "observation", rule.min_n, rule.count_nulls, date="datetime"
    )
    return daily.withColumnRenamed("Reservoir", "site_id")


def temperature_profiles(
    historic: DataFrame,
    current: DataFrame | None = None,
    offsets: DataFrame | None = None,
    historic_rules: dict[str, ProfileRule] = HISTORIC_RULES,
    current_rules: dict[str, ProfileRule] = CURRENT_RULES,
    **depth_args,
) -> DataFrame:
    """Daily temperature profiles, with each site's own depth rule and completeness limit (K3).

    Result: datetime (day), site_id, depth_m, observation, variable. A site without offsets must not
    be position-based; leave it out of the rules then.
    """
    parts = [_daily_profile(historic, s, r, offsets, **depth_args) for s, r in historic_rules.items()]
    if current is not None:
        parts += [_daily_profile(current, s, r, offsets, **depth_args) for s, r in current_rules.items()]
    out = stack(*parts).withColumns({"variable": F.lit("Temp_C_mean"), "observation": finite("observation")})
    return out.select("datetime", "site_id", "depth_m", "observation", "variable")

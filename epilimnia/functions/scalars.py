"""Scalar expressions: rounding, bins, text parts, dates, water physics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY = 9.81


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c: Column | str, digits: int) -> Column:
    return F.bround(_col(c), digits)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b with a NULL for a zero divisor."""
    return F.try_divide(_col(a), _col(b))


def to_number(c: Column | str) -> Column:
    """Text to double; text that is no number becomes NULL also under ANSI mode."""
    return _col(c).try_cast("double")


def part(c: Column | str, i: int, sep: str = "_") -> Column:
    """i-th piece of a split name (negative: from the end); NULL when there is none."""
    return F.nullif(F.split_part(_col(c), F.lit(sep), F.lit(i)), F.lit(""))


def depth_bin(x: Column | str, width: float, top: Column) -> Column:
    """Left edge of the left-closed bin holding x.

    Bins run from 0 to ``top``; the last one also holds ``top`` itself; values outside are NULL.
    """
    x, w = _col(x), F.lit(float(width))
    edge = F.floor(top / w) * w
    return (
        F.when((x < 0) | (x > edge), F.lit(None).cast("double"))
        .when(x == edge, edge - w)
        .otherwise(F.floor(x / w) * w)
        .cast("double")
    )


def water_density(t: Column | str) -> Column:
    """Density of fresh water in kg/m3 from temperature in Celsius (Martin & McCutcheon 1999)."""
    t = _col(t)
    # fixed values of the published formula
    top = (t + 288.9414) * (t - 3.9863) * (t - 3.9863)
    return 1000 * (1 - F.try_divide(top, 508929.2 * (t + 68.12963)))


def buoyancy_squared(rho: Column, rho_below: Column, z: Column, z_below: Column) -> Column:
    """Squared buoyancy frequency (1/s2) between one depth and the next deeper one."""
    return F.try_divide(F.lit(GRAVITY) * (rho_below - rho), rho * (z_below - z))


def overlay_day(d: Column | str, ref_year: int) -> Column:
    """Month and day moved onto one reference year; 29 Feb is NULL in a common year."""
    return F.try_to_date(F.concat(F.lit(f"{ref_year}-"), F.date_format(_col(d), "MM-dd")), "yyyy-MM-dd")


def year_day_as_date(d: Column | str) -> Column:
    """Day of year laid onto 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.dayofyear(_col(d)) - 1)

"""Day x depth grid by separable linear interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .fill import unroll
from .keyed import join_on
from .scan import with_neighbours


CHUNK = 64


def grid_interpolate(
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    depth: str,
    value: str,
    dz: float = 0.5,
    keep_empty: bool = True,
    depth_range: tuple[float, float] | None = None,
) -> DataFrame:
    """Interpolate casts onto every day and every ``dz`` of depth, per key (K8).

    Duplicates at one day and depth are averaged. Each cast is interpolated in depth onto the grid of
    its key (from the key's smallest depth, in steps of ``dz``), then each grid depth is interpolated in
    time between casts. Cells without a cast value on both sides are NULL (dropped with
    ``keep_empty=False``). Triangulated interpolation of the same points gives other values between
    casts and another outline; both reproduce a plane, and this one any bilinear surface.

    The unit of work is a cast in the first pass and a (key, depth) series of calendar days in the
    second, so no task holds a whole key; a cast is scanned in chunks of ``CHUNK`` depth units.
    ``keys`` should hold the year, as casts of different years are not to be joined up. Averaged points are written once
    (to the shared folder) and read by both passes. Levels and days are unrolled in blocks, so a wrong depth or date makes a long
    result, never a large array; ``depth_range`` leaves out points whose depth can't be true.

    Result: keys, day (x), depth (y), value (z).
    """
    rows = df.where(F.col(value).isNotNull() & F.col(depth).isNotNull() & F.col(date).isNotNull())
    if depth_range is not None:
        rows = rows.where(F.col(depth).between(*depth_range))
    points = rows.groupBy(*keys, F.to_date(date).alias("x"), F.col(depth).cast("double").alias("d")).agg(
        F.avg(value).alias("v")
    )
    points = settled(points, "points")
    frame = points.groupBy(*keys).agg(
        F.min("d").alias("__d0"), F.max("d").alias("__d1"), F.min("x").alias("__x0"), F.max("x").alias("__x1")
    )
    levels = F.floor((F.col("__d1") - F.col("__d0")) / dz + 1e-10).cast("long").alias("__levels")
    frame = frame.withColumn("__levels", levels)

    # pass 1: every pair of neighbouring depths of a cast serves the grid levels between them
    seg = with_neighbours(
        points.withColumn("__p", F.struct("d", "v")), [*keys, "x"], ["d"], "v", at="__p", chunk=F.floor(F.col("d") / CHUNK)
    ).select(*keys, "x", "d", "v", F.col("upcoming.d").alias("d2"), F.col("upcoming.v").alias("v2"))
    seg = join_on(seg, frame.select(*keys, "__d0", "__levels"), keys, "inner")
    lo = F.ceil((F.col("d") - F.col("__d0")) / dz - 1e-10).cast("long")
    # a level on d2 itself belongs to the next segment, or is the last point on its own
    hi = F.when(F.col("d2").isNull(), F.floor((F.col("d") - F.col("__d0")) / dz + 1e-10)).otherwise(
        F.ceil((F.col("d2") - F.col("__d0")) / dz - 1e-10) - 1
    ).cast("long")
    hi = F.least(hi, F.col("__levels"))
    share = F.coalesce(
        (F.col("__d0") + F.col("__k") * dz - F.col("d")) / (F.col("d2") - F.col("d")), F.lit(0.0)
    )
    at_depth = (
        unroll(seg.withColumns({"__lo": lo, "__hi": hi}).where("__hi >= __lo"), F.col("__hi") - F.col("__lo") + 1)
        .withColumn("__k", F.col("__lo") + F.col("__i"))
        .withColumn("z", F.col("v") + (F.coalesce(F.col("v2"), F.col("v")) - F.col("v")) * share)
        .select(*keys, "x", "__k", "__d0", "z")
    )

    # pass 2: every pair of neighbouring casts serves the days between them
    level = Window.partitionBy(*keys, "__k").orderBy("x")
    days = at_depth.withColumns({"x2": F.lead("x").over(level), "z2": F.lead("z").over(level)})
    cells = unroll(days, F.coalesce(F.date_diff("x2", "x").cast("long"), F.lit(1).cast("long")))
    cells = cells.withColumn("__day", F.date_add("x", F.col("__i").cast("int")))
    part = F.coalesce(F.date_diff("__day", "x") / F.date_diff("x2", "x"), F.lit(0.0))
    cells = cells.select(
        *keys,
        F.col("__day").alias("x"),
        "__k",
        "__d0",
        (F.col("z") + (F.coalesce(F.col("z2"), F.col("z")) - F.col("z")) * part).alias("z"),
    )
    if keep_empty:
        levels = unroll(frame, F.col("__levels") + 1).withColumnRenamed("__i", "__k")
        spine = unroll(levels, F.date_diff("__x1", "__x0").cast("long") + 1, [*keys, "__k"]).select(
            *keys, "__k", "__d0", F.date_add("__x0", F.col("__i").cast("int")).alias("x")
        )
        cells = join_on(spine, cells.drop("__d0"), [*keys, "x", "__k"], "left")
    return cells.select(*keys, "x", (F.col("__d0") + F.col("__k") * dz).alias("y"), "z")

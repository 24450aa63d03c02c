"""Run-length operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import with_neighbours, with_run_id


def runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bounded: bool = False, chunk: Column | None = None
) -> DataFrame:
    """Run-length encoding (F4): one row per run with value, length, and first and last order value."""
    numbered = with_run_id(df.select(*keys, *order, value), keys, order, value, "run_id", bounded, chunk)
    return numbered.groupBy(*keys, "run_id").agg(
        F.first(value).alias(value),
        F.count(F.lit(1)).alias("length"),
        F.min(order[0]).alias("start"),
        F.max(order[0]).alias("end"),
    )


def longest_run(run_table: DataFrame, keys: Sequence[str], value: str, wanted: object) -> DataFrame:
    """Longest run of one value per key; the earliest wins a tie (F5). Input: ``runs``."""
    best = F.struct((-F.col("length")).alias("l"), F.col("run_id").alias("r"))
    return (
        run_table.where(F.col(value) == wanted)
        .groupBy(*keys)
        .agg(F.min_by(F.struct("length", "start", "end"), best).alias("r"))
        .select(*keys, "r.length", "r.start", "r.end")
    )


def null_run_stats(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bounded: bool = False, chunk: Column | None = None
) -> DataFrame:
    """Longest run of NULLs, 0 if none (E13), and number of observed runs (E14) per key."""
    marked = df.select(*keys, *order, F.col(value).isNull().alias("__missing"))
    table = runs(marked, keys, order, "__missing", bounded, chunk)
    return table.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("__missing"), F.col("length"))), F.lit(0)).alias("longest_null_run"),
        F.count(F.when(~F.col("__missing"), F.lit(1))).alias("observed_runs"),
    )


def longest_null_run(df, keys, order, value, bounded=False, chunk=None) -> DataFrame:
    return null_run_stats(df, keys, order, value, bounded, chunk).drop("observed_runs")


def observed_run_count(df, keys, order, value, bounded=False, chunk=None) -> DataFrame:
    return null_run_stats(df, keys, order, value, bounded, chunk).drop("longest_null_run")


def profile_gradient(
    df: DataFrame, profile: Sequence[str], depth: str, names: Sequence[str], bounded: bool = False, chunk: Column | None = None
) -> DataFrame:
    """Each depth with the next deeper one of the same profile: ``next_<depth>``, ``next_<value>``.

    Needs one row per profile and depth.
    """
    points = df.withColumn("__point", F.struct(depth, *names))
    rows = with_neighbours(points, profile, [depth], depth, at="__point", bounded=bounded, chunk=chunk)
    return rows.select(*df.columns, *[F.col(f"upcoming.{c}").alias(f"next_{c}") for c in [depth, *names]])

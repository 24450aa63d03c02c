"""Query registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy access to the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


# Half-up rounding falls on exact ties for short decimals, where the last bit of a sum decides. Both
# sides round just below the tie instead, with the same arithmetic.
_HALF = 0.5000123


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10**digits)
    return F.floor(c * scale + _HALF) / scale


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r(n, digits) for n in names})


def _rounding(sql: str) -> str:
    """Write ``round(x, digits)`` in SQL text out as the arithmetic of ``r``."""
    at = sql.rfind(" round(")
    while at >= 0:
        start, depth, comma = at + 7, 1, None
        for i in range(start, len(sql)):
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            if depth == 0:
                break
        scale = f"1e{int(sql[comma + 1 : i])}"
        sql = f"{sql[:at]} (floor(({sql[start:comma]}) * {scale} + {_HALF}) / {scale}){sql[i + 1 :]}"
        at = sql.rfind(" round(")
    return sql


def query(sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        REGISTRY[fn.__name__] = Query(fn, None if sql is None else _rounding(sql.replace("(round(", "( round(")))
        return fn

    return register

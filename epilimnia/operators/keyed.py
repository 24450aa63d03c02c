"""The NULL-safe equi join that the other operators build on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RIGHT = "__r_"


def join_on(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join where NULL keys match each other; the left key columns are kept.

    ``how``: inner, left, left_semi or left_anti. Without keys the right side is a single row (an aggregate of the whole
    table), of which every left row gets a copy.
    """
    if not on:
        return left.join(F.broadcast(right.limit(1)), F.lit(True), how)
    right = right.withColumnsRenamed({k: _RIGHT + k for k in on})
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col(_RIGHT + k)) for k in on])
    return left.join(right, condition, how).drop(*[_RIGHT + k for k in on])
